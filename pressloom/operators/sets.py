"""Sets of words that share enough of each other, and what they hang together in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut


def name_of(words: Column) -> Column:
    """A set of words as one string: the words in order, each once."""
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def asking(sets: DataFrame, counts: DataFrame, least: float, common: int | None = None) -> DataFrame:
    """(run, key, n, w): the words of each set that it asks by, its rarest ones.

    Of a set of n words, `least` * n must be shared, or `common` words; all words but so many less one hold one of the
    shared ones, whichever these are. So a set's most common words bring nothing together.
    """
    must = F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9))
    must = must if common is None else F.least(must, F.lit(common))
    rank = F.row_number().over(Window.partitionBy("run", "key").orderBy("df", "w"))
    return sets.select("run", "key", "n", F.explode("words").alias("w")).join(counts, ["run", "w"]).withColumn("rank", rank).where(F.col("rank") <= F.col("n") - must + 1).select("run", "key", "n", "w")


def pairs(left: DataFrame, right: DataFrame, least: float, common: int | None = None) -> DataFrame:
    """(run, a, b, both): a set of `left` and one of `right`, of a run, that share at least `least` of the smaller one's words, or `common` words.

    left, right: run, key, words (each once). Of two sets the smaller one asks, so a pair is made at most as often as its rare words are
    shared, and given out once.
    """
    sized = lambda df: df.select("run", "key", "words", F.size("words").alias("n")).where("n > 0")
    left, right = sized(left), sized(right)
    words = lambda df: df.select("run", "key", "n", F.explode("words").alias("w"))
    counts = words(left).unionByName(words(right)).groupBy("run", "w").agg(F.count("*").alias("df"))

    def met(small: DataFrame, large: DataFrame, a: str, b: str, test: str) -> DataFrame:
        ask = asking(small, counts, least, common).select("run", "w", F.col("key").alias(a), F.col("n").alias("n"))
        return ask.join(words(large).select("run", "w", F.col("key").alias(b), F.col("n").alias("m")), ["run", "w"]).where(test).select("run", "a", "b").distinct()

    found = met(left, right, "a", "b", "n <= m").unionByName(met(right, left, "b", "a", "n < m"))
    found = found.join(left.select("run", F.col("key").alias("a"), F.col("words").alias("v")), ["run", "a"]).join(right.select("run", F.col("key").alias("b"), F.col("words").alias("u")), ["run", "b"])
    both, smaller = F.size(F.array_intersect("v", "u")), F.least(F.size("v"), F.size("u"))
    enough = (both >= smaller * least - 1e-9) & (both > 0)
    enough = enough if common is None else enough | (both >= common)
    return found.withColumn("both", both).withColumn("smaller", smaller).where(enough).select("run", "a", "b", "both", "smaller")


def components(links: DataFrame) -> DataFrame:
    """(run, key, root): the least key that each key of `links` (run, a, b) hangs together with. In every round each key
    hands its larger neighbours to its least one, then its smaller ones, until nothing changes; no component is in one task."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("run", "a", "b").cast("decimal(38,0)"))).first())
    now = cut(links.where("a <> b").select("run", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before, after = None, mark(now)
    while after != before and after[0]:
        both = now.unionByName(now.select("run", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("run", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, ["run", "a"]).where("b > a").select("run", F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("run", "b").agg(F.min("a").alias("m"))
        small = large.join(low, ["run", "b"]).where("a <> m").select("run", F.col("m").alias("a"), F.col("a").alias("b"))
        now, before = cut(small.unionByName(low.select("run", F.col("m").alias("a"), "b")).distinct()), after
        after = mark(now)
    return now.groupBy("run", F.col("b").alias("key")).agg(F.min("a").alias("root"))
