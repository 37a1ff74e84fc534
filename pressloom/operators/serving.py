"""Ranked and counted views: front page, live feed, boards, queues, usage, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import articles, feed, headlines, seconds, table, with_latest


def live_feed_top12(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the last two hours, each with its article only if that is live; the first twelve."""
    live = articles(spark, d).where("status = 'live'").select(F.col("id").alias("article_id"), F.col("score").alias("article_score"))
    recent = with_latest(feed(spark, d)).where("ts >= as_of - INTERVAL 2 HOURS")
    return recent.join(live, "article_id", "left").orderBy(F.desc("ts"), F.desc_nulls_last("priority"), F.desc("id")).limit(12).select("id", "ts", "priority", "section", "article_id", "article_score")


def front_page_rank(spark: SparkSession, d: str) -> DataFrame:
    """Live articles: breaking first, then pins set by hand by their place, then score less two points an hour since publication,
    or since creation where that is unknown."""
    a = articles(spark, d).withColumns({"shown": F.coalesce("published", "created"), "by_hand": F.col("pinned") & (F.coalesce("pinned_by", F.lit("manual")) != "auto")})
    a = with_latest(a, "created").where("status = 'live'")
    age = F.least(F.lit(100.0), (seconds(F.col("as_of")) - seconds(F.col("shown"))) / 3600)
    breaking = F.coalesce(F.col("published") + F.expr("INTERVAL 2 HOURS") > F.col("as_of"), F.lit(False))
    ranked = a.select("id", "published", breaking.alias("breaking"), F.col("by_hand").alias("pinned"), F.when(F.col("by_hand"), F.col("pin_place")).alias("place"), F.round(F.coalesce("score", F.lit(50)) - 2 * age, 6).alias("rank_score"))
    return ranked.orderBy(F.desc("breaking"), F.desc("pinned"), F.asc_nulls_last("place"), F.desc("rank_score"), F.desc_nulls_last("published"), F.desc("id")).limit(12)


def related_top3(spark: SparkSession, d: str) -> DataFrame:
    """For each article of the front page the three best others that are live: the best four of all hold them."""
    live = articles(spark, d).where("status = 'live'")
    top = live.orderBy(F.desc_nulls_last("score"), F.desc("published"), F.desc("id")).limit(4).select(F.struct(F.coalesce("score", F.lit(-1)).alias("s"), "published", "id").alias("best"))
    best = top.agg(F.sort_array(F.collect_list("best"), asc=False).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, 3)
    x = live.select("id").join(F.broadcast(best), F.lit(True)).select("id", F.posexplode(others).alias("place", "b"))
    return x.select("id", F.col("place").cast("long").alias("place"), F.col("b.id").alias("other"))


def breaking_story(spark: SparkSession, d: str) -> DataFrame:
    a = with_latest(articles(spark, d), "published").where("status = 'live' and published + INTERVAL 48 HOURS > as_of")
    return a.orderBy(F.desc("published"), F.desc("id")).limit(1).select("id", "published")


def market_board_rank(spark: SparkSession, d: str) -> DataFrame:
    """The latest value of each symbol; symbols of a fixed list first, then by name; eighteen rows."""
    latest = feed(spark, d).groupBy("user_id").agg(F.max_by(F.struct("ts", "priority"), F.struct("ts", "id")).alias("x"))
    order = F.array_position(F.array(*[F.lit(x) for x in (7, 3, 11, 42)]), F.col("user_id").cast("int"))
    return latest.select(F.col("user_id").alias("symbol"), F.col("x.ts").alias("updated"), F.col("x.priority").alias("value"), F.when(order == 0, 99).otherwise(order).alias("place")).orderBy("place", "symbol").limit(18)


def usage_by_step_model(spark: SparkSession, d: str) -> DataFrame:
    l = with_latest(table(spark, d, "lineitem"), "l_shipdate").where("l_shipdate >= date_trunc('day', as_of) - INTERVAL 365 DAYS")
    return l.groupBy(F.col("l_returnflag").alias("step"), F.col("l_linestatus").alias("model")).agg(F.sum(F.col("l_quantity").cast("long")).alias("tokens"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("cost"), F.count("*").alias("calls"))


def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 4
    status = F.when(k == 0, "pending").when(k == 1, "running").when(k == 2, "done").otherwise("failed")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), status.alias("status")).agg(F.count("*").alias("n"))


def health_counts(spark: SparkSession, d: str) -> DataFrame:
    """Three counts in one row, each from its own table."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    a = one(articles(spark, d).where("status = 'live'"), "live_articles")
    return a.join(one(feed(spark, d), "feed_rows"), F.lit(True)).join(one(table(spark, d, "customer"), "sources"), F.lit(True))


def run_progress_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per run (customer): items, published items and different parts, zero where there are none."""
    c, o, l = (table(spark, d, x) for x in ("customer", "orders", "lineitem"))
    items = o.groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("items"), F.count_if(F.col("o_orderstatus") == "F").alias("published"))
    # Each order's parts are made distinct before the join: a run with very many lines doesn't meet in one task.
    different = l.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct()
    parts = o.select("o_orderkey", F.col("o_custkey").alias("run")).join(different, "o_orderkey").select("run", "l_partkey").distinct().groupBy("run").agg(F.count("*").alias("parts"))
    out = c.select(F.col("c_custkey").alias("run")).join(items, "run", "left").join(parts, "run", "left")
    return out.select("run", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("items", "published", "parts")])


def funnel_counts(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("priority")
    return feed(spark, d).groupBy("section").agg(F.count("*").alias("seen"), F.count_if(v.isNull()).alias("waiting"), F.count_if(v >= 70).alias("strong"), F.count_if((v >= 60) & (v < 70)).alias("fair"), F.count_distinct("user_id").alias("users"))


def source_list(spark: SparkSession, d: str) -> DataFrame:
    """Unread items with their source, newest first; thirty rows."""
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source"))
    a = articles(spark, d).where("status = 'draft'").orderBy(F.desc("published"), F.desc("id")).limit(30)
    return a.join(s, "source_id", "left").select("id", "published", "source")


def draft_detail(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    a = articles(spark, d).where("status = 'draft'")
    return a.join(c, a.source_id == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("id", "status", F.col("c_name").alias("source"), F.col("n_name").alias("place"))


def pulse_slots(spark: SparkSession, d: str) -> DataFrame:
    """One row for each five-minute slot that has rows: how many, and the first id."""
    slot = F.timestamp_seconds(F.floor(seconds(F.col("ts")) / 300) * 300).cast("timestamp_ntz")
    return feed(spark, d).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def feed_trim(spark: SparkSession, d: str) -> DataFrame:
    """Status of each row of the last day: the first twelve stay live, the rest expire. Only a top-k is sorted."""
    recent = with_latest(feed(spark, d)).where("ts >= as_of - INTERVAL 24 HOURS")
    first = recent.orderBy(F.desc("ts"), F.desc_nulls_last("priority"), F.desc("id")).limit(12).select("id", F.lit("live").alias("status"))
    return recent.select("id").join(F.broadcast(first), "id", "left").select("id", F.coalesce("status", F.lit("expired")).alias("status"))


def value_change_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of each series where the value differs from the one before, with the change in percent."""
    before = F.lag("priority").over(Window.partitionBy("user_id").orderBy("ts", "id"))
    x = feed(spark, d).select("user_id", "id", "ts", "priority", before.alias("before")).where("before is null or priority <> before")
    pct = F.when(F.col("before") == 0, 0.0).otherwise((F.col("priority") / F.col("before") - 1) * 100)
    return x.select(F.col("user_id").alias("symbol"), "id", "ts", F.round(pct, 4).alias("change_pct"))


def cost_tariff(spark: SparkSession, d: str) -> DataFrame:
    """Cost by weekday-and-hour tariff (rates per million tokens: fixed values)."""
    ts = F.col("ts").cast("timestamp")
    hour, day = F.hour("ts"), F.dayofweek("ts")
    peak = day.between(2, 6) & (hour.between(1, 3) | hour.between(6, 9))
    used = F.col("id") % 5000
    out = feed(spark, d).select("id", peak.alias("peak"), used.alias("tokens"), F.round(used * F.when(peak, 1.32).otherwise(0.66) / 1e6, 8).alias("cost"))
    return out.groupBy("peak").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def retry_queue(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that may be claimed: not finished, under five attempts, lease and retry time passed; oldest first."""
    k = F.get_json_object("props", "$.k").cast("long")
    j = with_latest(table(spark, d, "events")).select("event_id", "event_type", "ts", "as_of", (k % 6).alias("attempts"), (k % 3).alias("state"))
    wait = F.least(F.lit(300), 30 * F.col("attempts"))
    due = (F.col("state") == 0) | (seconds(F.col("ts")) + wait <= seconds(F.col("as_of")))
    ready = j.where("attempts < 5").where(due & (F.col("state") < 2))
    first = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return ready.select("event_id", "event_type", "attempts", wait.alias("wait_s"), first.alias("place")).where("place <= 3")


def live_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Strong recent headlines, without those in the feed by id, or by key within eight hours before.

    Shown rows (those of errors) and headlines meet by key and stretch of eight hours, so that a key with many rows is spread over time.
    """
    stretch = 8 * 3600
    part = lambda c: F.floor(seconds(F.col(c)) / stretch).cast("long")
    h = headlines(spark, d).where("score >= 55 and source_kind <> 'error'").withColumn("key", F.col("user_id") % 50)
    shown = headlines(spark, d).where("source_kind = 'error'").select("id", (F.col("user_id") % 50).alias("key"), F.col("published").alias("shown"))
    linked = shown.select((F.col("id") + 1).alias("id"))  # an error covers the row behind it, too
    left = h.join(linked, "id", "left_anti").withColumn("part", part("published"))
    s = shown.groupBy("key", part("shown").alias("at")).agg(F.min("shown").alias("low"), F.max("shown").alias("high"))
    # In its own stretch an item asks for any earlier row, in the one before for any within eight hours: the least and the last decide.
    s = s.select("key", "low", "high", F.explode(F.array(F.col("at"), F.col("at") + 1)).alias("part"), F.col("at"))
    within = ((F.col("s.at") == F.col("l.part")) & (F.col("low") <= F.col("published"))) | ((F.col("s.at") < F.col("l.part")) & (F.col("high") > F.col("published") - F.expr("INTERVAL 8 HOURS")))
    return left.alias("l").join(s.alias("s"), (F.col("l.key") == F.col("s.key")) & (F.col("l.part") == F.col("s.part")) & within, "left_anti").select("id", "title", "published")


def insert_if_new(spark: SparkSession, d: str) -> DataFrame:
    """Rows to append: the first of each key, without keys that are there already."""
    rows = feed(spark, d)
    first = rows.groupBy("event_key").agg(F.min_by("id", F.struct("ts", "id")).alias("id"))
    return first.join(rows.where("section = 'signup'").select("event_key").distinct(), "event_key", "left_anti")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The row of each key after all writes: the latest by time, then id."""
    x = F.max_by(F.struct("id", "priority", "ts"), F.struct("ts", "id")).alias("x")
    return feed(spark, d).groupBy("event_key").agg(x, F.count("*").alias("writes")).select("event_key", "x.id", "x.priority", "x.ts", "writes")


def review_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in which every user turn has exactly one answer right after it."""
    c = table(spark, d, "conversations")
    ask = c.where("role = 'user'").select("conv_id", "turn")
    answer = c.where("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.count("*").alias("n"))
    one = F.coalesce(F.col("n"), F.lit(0)) == 1
    return ask.join(answer, ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.count("*").alias("blocks"), F.count_if(one).alias("supported"), F.min(one).alias("passed"))
