"""The relations of a news desk, bound to the tables at hand. Every query takes its reference time from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("value").alias("priority"), F.col("event_type").alias("section"), F.col("event_id").alias("article_id"),
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("event_key"), F.col("user_id"),
    )


def pick(values: list[str], n: Column) -> Column:
    """One of `values`, by a number."""
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def with_latest(df: DataFrame, column: str = "ts") -> DataFrame:
    """`df` with `as_of`, the latest `column`: a one-row aggregate, attached to every row."""
    return df.join(F.broadcast(df.agg(F.max(column).alias("as_of"))), F.lit(True))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "live").when(F.col("o_orderstatus") == "O", "draft").otherwise("archived")
    return o.select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 101).alias("score"), F.col("o_orderdate").alias("published"),
        F.col("o_orderpriority").startswith("1").alias("pinned"), (F.col("o_orderkey") % 20).alias("pin_place"), F.col("o_custkey").alias("source_id"), F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("created"), F.when(F.col("o_orderkey") % 3 == 0, "auto").when(F.col("o_orderkey") % 3 == 1, "manual").alias("pinned_by"),
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines made from events: a template and a company, picked by numbers of the event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    title = F.regexp_replace(F.get(F.array(*map(F.lit, TEMPLATES)), (k % len(TEMPLATES)).cast("int")), r"\{company\}", F.get(F.array(*map(F.lit, COMPANIES)), (F.col("user_id") % len(COMPANIES)).cast("int")))
    return e.select(F.col("event_id").alias("id"), title.alias("title"), F.col("ts").alias("published"), F.col("event_type").alias("source_kind"), F.col("value").alias("score"), F.col("user_id"), k.alias("k"))


def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines with a source (name, kind, domain), a type of event and two further scores, made from the event's numbers."""
    user, h = F.col("user_id"), headlines(spark, sf_dir).drop("source_kind")
    return h.select(
        "*", pick(SOURCE_NAMES, user).alias("source_name"), pick(SOURCE_KINDS, user).alias("source_kind"), pick(SOURCE_DOMAINS, user).alias("source_domain"),
        pick(EVENT_KINDS, F.col("k")).alias("candidate_type"), (F.col("k") * 37 % 100).alias("attention"), (F.col("k") * 53 % 100).alias("numbers"),
    )


TEMPLATES = [
    "{company} raised its dividend after record results", "{company} cutting 200 jobs in Oslo", "New chief executive takes over at {company}",
    "Central bank raises key rate to 4.5 percent", "Oil price falls as output grows", "Local football club wins again", "{company} results beat forecasts by 12 percent",
    "Økonomien bremser og markedet venter rentekutt", "{company} shares surge 12 % after profit warning", "Warren Buffett buys a record stake in Apple", "Best stocks to buy now", "Film, restaurant og ferie: tips før skole", "Norges Bank hever styringsrenten",
]
COMPANIES = ["Nordlys Shipping", "Fjordkraft Energi", "Havbruk Seafood", "Bergtind Bank", "Skogen Papir"]
SOURCE_NAMES = ["Google News", "CNBC", "ECB", "E24 – Børs og finans", "E24 – Aksjetips", "Dagens Næringsliv", "Local Times"]
SOURCE_KINDS = ["news-index", "global-rss", "official", "rss", "rss", "fast-news-aggregator", "news-aggregator"]
SOURCE_DOMAINS = ["reuters.com", "www.dn.no", "example.com", "ssb.no"]
EVENT_KINDS = ["resultat", "annet", "renter", "sport"]
