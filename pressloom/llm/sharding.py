"""Sharding by proportional stratified interleaving.

Rows are ranked within their source in a seeded random order; the rank as a fraction of the source's size
orders all rows, so every stretch of that order holds the sources in their proportions; equal cuts of it are
the shards. Ranks come from two levels: counts of small ranges, summed up, and the order within a range.
No source, however large, is in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 8, "17"
#: Rows that a range should hold; the number of ranges follows from the number of rows.
RANGE = 4096


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, source: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of `docs`.

    Shard sizes in rows differ by one at most (law `rows`). A null source is a source of its own; a null text
    has size 1. Rows that tie in everything are alike, and take their places in any order.
    """
    ranges = max(1, docs.count() // RANGE)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.to_json(F.struct(F.col(f"`{source}`").alias("s"))).alias("stratum"),
    )
    rows = rows.withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32")))
    # The first 48 bits of the draw place a row in one of the ranges of its source, in the order of the draws.
    rows = rows.withColumn("cell", F.floor(F.conv(F.substring("draw", 1, 12), 16, 10).cast("double") * ranges / float(2**48)))
    cells = rows.groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("stratum").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("stratum", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("total"))
    order = ("draw", "doc_id", "bytes")
    ranked = rows.join(cells, ["stratum", "cell"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("stratum", "cell").orderBy(*order)))
    # Each source starts at a place of its own, so that sources with few rows don't all end up in the middle.
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "stratum")), 1, 12), 16, 10).cast("double") / float(2**48)
    ranked = ranked.withColumn("part", (F.col("rank") - 1 + start) / F.col("total"))
    ranked = ranked.withColumn("slice", F.floor(F.col("part") * ranges))
    slices = ranked.groupBy("slice").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("all"))
    # One row for each range of some thousand rows: a table of bounded size, summed up in one small task.
    placed = ranked.join(slices, "slice")
    within = Window.partitionBy("slice").orderBy("part", "stratum", *order)
    placed = placed.withColumn("place", F.col("ahead") + F.row_number().over(within) - 1)
    placed = placed.withColumn("shard", F.expr(f"int(place * {shards} div all)"))
    first = F.expr(f"(shard * all + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
