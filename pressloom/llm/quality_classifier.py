"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of target text (labelled good) and one of all text, give each
document the log of their ratio. Grams are words, word pairs, and triples of word shapes (case, symbols, repetition).
A document's weight is its mean ratio per gram (the geometric mean) to the power SHARPNESS, as if each had that many
grams: length alone neither keeps nor drops a document. A Gumbel perturbation of the log weights and the k largest make a sample
without replacement in proportion to the weights. These lie far apart, so few rows change with the seed: where
k is the number of good documents, the sample is near to the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .tables import settle

BUCKETS = 1 << 16
#: The labels used to fit are the rows of so many ids with the least hash; everything else covers all rows.
MOST_LABELS = 50_000
#: Exponent of the per-gram ratio, the grams' worth of evidence that one document counts for.
SHARPNESS = 200.0
#: Documents kept beyond the share of good ones among the labels, as a share of all.
MARGIN = 0.01
SEED = 17


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each gram of a block, and the text that it is in."""
    w = K.Words(data, at)
    n = len(w.code)
    doc = np.repeat(np.arange(len(at) - 1), w.counts)
    upper = np.concatenate(([0], np.cumsum((data >= 0x41) & (data <= 0x5A))))
    plain = np.concatenate(([0], np.cumsum((data >= 0x80) | ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))))
    size = w.end - w.start
    back = np.zeros((n, 2), bool)
    back[1:, 0] = (w.code[1:] == w.code[:-1]) & (doc[1:] == doc[:-1])
    back[2:, 1] = (w.code[2:] == w.code[:-2]) & (doc[2:] == doc[:-2])
    shape = np.minimum(upper[w.end] - upper[w.start], 2) + 3 * np.minimum(size - (plain[w.end] - plain[w.start]), 3) + 12 * back[:, 0] + 24 * back[:, 1] + 48 * np.minimum(size // 4, 4)
    shape = K.TERM_CODE[shape % 64] * K.U(3) + shape.astype(K.U)
    within = np.arange(n)
    pairs, triples = within[within + 2 <= w.limit()], within[within + 3 <= w.limit()]
    two = w.code[pairs] * K.TERM_CODE[0] + w.code[np.minimum(pairs + 1, n - 1)] * K.TERM_CODE[1]
    three = shape[triples] * K.TERM_CODE[2] + shape[np.minimum(triples + 1, n - 1)] * K.TERM_CODE[3] + shape[np.minimum(triples + 2, n - 1)] * K.TERM_CODE[4]
    code = K.mix(np.concatenate([w.code + K.U(1), two, three]))
    return (code >> K.U(48)).astype(np.int64), np.concatenate([doc, doc[pairs], doc[triples]])


def _counts(good: np.ndarray):
    """Counts of each bucket in all texts, and in texts whose id is in `good` (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            chosen = np.isin(ids, good) & ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for first, last, data, at in K.blocks(batch.column("text")):
                bucket, doc = grams(data, at)
                total += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[chosen[first:last][doc]], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), "total": total, "target": target})

    return run


class Model:
    """The log ratio of each bucket, and the share of good documents among the labels."""

    def __init__(self, ratio: np.ndarray, share: float):
        self.ratio, self.share = ratio, share

    def scores(self, column: pa.Array) -> np.ndarray:
        """The mean log ratio of each text's grams; no grams: not a number."""
        out = np.full(len(column), np.nan)
        for first, last, data, at in K.blocks(column):
            bucket, doc = grams(data, at)
            n = np.bincount(doc, minlength=last - first)
            with np.errstate(invalid="ignore"):
                out[first:last] = np.bincount(doc, weights=self.ratio[bucket], minlength=last - first) / n
        return out

    def keys(self, batch: pa.RecordBatch, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the sampling keys: the log of the weight, which is the sharpened score, plus Gumbel noise drawn from id and seed."""
        score = self.scores(batch.column("text"))
        ids = batch.column("doc_id").fill_null(0).to_numpy().astype(np.int64).view(K.U)
        u = ((K.mix(K.mix(ids + K.U(seed)) + K.U(K.BASE)) >> K.U(11)).astype(float) + 0.5) / 2.0**53
        return score, score * SHARPNESS - np.log(-np.log(u))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Model:
    """Only the bucket counts (BUCKETS rows) and at most `most` labelled ids come to the driver."""
    spark: SparkSession = docs.sparkSession
    use = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long"), "quality").distinct()
    rows = use.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most).collect()
    good = spark.sparkContext.broadcast(np.array(sorted(x[0] for x in rows if x[1] > 0), np.int64))
    run = lambda batches: _counts(good.value)(batches)
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.frugal(run), "bucket long, total long, target long")
    total, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x in counted.groupBy("bucket").agg(F.sum("total"), F.sum("target")).collect():
        total[x[0]], target[x[0]] = x[1], x[2]
    if not len(rows) or not target.sum():
        return Model(np.zeros(BUCKETS), 1.0)  # nothing to learn from: all are alike
    smooth = 0.5
    p = (target + smooth) / (target.sum() + smooth * BUCKETS)
    q = (total + smooth) / (total.sum() + smooth * BUCKETS)
    return Model(np.log(p / q), sum(x[1] > 0 for x in rows) / len(rows))


def scored(docs: DataFrame, model: Model, seed: int = SEED) -> DataFrame:
    """doc_id, score and key of each row; both null where a text has no words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, key = held.value.keys(batch, seed)
            none = np.isnan(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, mask=none), pa.array(key, mask=none)], ["doc_id", "score", "key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.frugal(run), "doc_id long, score double, key double")


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest `key`, by histograms of ever narrower ranges; no more than 10,000 rows are sorted at once."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k >= n:
        return -np.inf if not n else low
    if k < 1:
        return np.inf
    while n > 10_000 and high > low:
        width = (high - low) / 4096
        bins = keys.where(F.col("key").between(low, high)).groupBy(F.least(F.lit(4095), F.floor((F.col("key") - low) / width)).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for row in sorted(bins.collect(), key=lambda x: -x["bin"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        if (row["lo"], row["hi"]) == (low, high):
            break
        low, high, n = row["lo"], row["hi"], row["n"]
    if low == high:
        return low
    return keys.where(F.col("key").between(low, high)).orderBy(F.desc("key")).limit(k).agg(F.min("key")).first()[0]


def _cut(found: DataFrame, model: Model, keep: float | None) -> float:
    n = found.count()
    share = min(1.0, model.share + MARGIN) if keep is None else keep
    return kth_largest(found, round(n * share))


def select(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, score, key and kept for each row of `docs`.

    keep: the share to sample; by default the share of good documents among the labels, plus MARGIN.
    Texts without words are never kept. Rows that tie at the cut (repeats of an id and text) are all kept.
    """
    model = fit(docs, labels)
    found = settle(scored(docs, model, seed))
    cut = _cut(found, model, keep)
    return found.withColumn("kept", F.coalesce(F.col("key") >= F.lit(float(cut)), F.lit(False)))


def kept(docs: DataFrame, labels: DataFrame, keep: float | None = None) -> DataFrame:
    """`docs`, all columns, without the rows that select() rejects: the same keys, computed again in place."""
    model = fit(docs, labels)
    cut = _cut(settle(scored(docs, model)), model, keep)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, key = held.value.keys(batch)
            yield batch.filter(pa.array(key >= cut))

    return docs.mapInArrow(K.frugal(run), docs.schema)
