"""Token counts from an exact histogram of encoded lengths.

Lengths are aggregated to (length, documents) in Spark; suffix sums over that histogram, whose size is the
number of different lengths, answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import Encoder


def _lengths(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            n = [len(encode.ids(x or "")) for part in range(0, batch.num_rows, 256) for x in batch.column("text").slice(part, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and n_tokens of each row; a null text has none."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_lengths(tokenizer), "doc_id long, n_tokens long")


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """For each encoded length that occurs, as a context limit:

    n_tokens, n_docs (of that length), docs_longer (above it), tokens_longer (theirs), total_docs, total_tokens,
    truncated_tokens (all documents cut to the limit) and quantile (the share of documents that fit whole).
    An empty table has no lengths, so no rows.
    """
    counts = lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    longer, every = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = counts.select(
        "n_tokens", "n_docs", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("docs_longer"), F.coalesce(F.sum(tokens).over(longer), F.lit(0)).alias("tokens_longer"),
        F.sum("n_docs").over(every).alias("total_docs"), F.sum(tokens).over(every).alias("total_tokens"),
    )
    return out.withColumns({
        "truncated_tokens": F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens"),
        "quantile": (F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs"),
    })
