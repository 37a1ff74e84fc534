"""URL rules by hashed host-suffix and path-prefix expressions, in DataFrame operations only.

A URL is expanded into one expression for each host suffix (at a dot) that some rule has, and for each path prefix of a length that
a rule of that host has. Suffixes and expressions meet rules in equi-joins on four bytes of their SHA-256; the whole
digest confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path prefix): fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_ROW = "verdict string, rule_host string, rule_path string"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_ROW)


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for each row of `pages` (page_id, url).

    A null url, or one without ://, has an empty host and path, which no rule fits. Of rules that fit, the one
    longest as a string wins, then the one with the longer host, then block. Without one: `default`.
    """
    rules = default_rules(pages.sparkSession) if rules is None else rules
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    known = rules.select(F.translate("rule_host", UPPER, LOWER).alias("rule_host"), "rule_path", F.col("verdict").alias("said"))
    known = known.withColumn("digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("digest", 1, 8))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    # Which lengths of path are asked for is up to the suffix: those that its own rules have.
    by_host = known.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"), F.first(F.substring(F.sha2("rule_host", 256), 1, 8)).alias("short"))
    different = rows.where("host <> ''").select("host", "path").distinct().withColumn("labels", labels)
    asked = different.select("host", "path", F.explode(suffixes).alias("suffix")).withColumn("short", F.substring(F.sha2("suffix", 256), 1, 8))
    asked = asked.join(by_host, "short").where("suffix = rule_host").select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.withColumn("prefix", F.expr("substring(path, 1, n)")).drop("n")
    asked = asked.withColumn("asked", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("asked", 1, 8))
    fits = asked.join(known, "short").where("asked = digest")
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.col("said") == "block", F.concat("rule_host", "rule_path").alias("rule"), "said")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    found = rows.join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"))
