"""Changes of state as DataFrames: what a table holds after an insert, an update, an expiry or a deletion, and what was logged.

Spark tables have no rows to change in place: each operator returns the rows after the change, or those to append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.tables import articles, feed, headlines, pick, seconds, table, with_latest
from .changes import updated
from .triage import judged

#: Fixed values.
LIVE_HOURS, LIVE_ROWS, PRUNE_ROWS, EVENT_HOURS = 2, 12, 500, 8
EDIT_SECTIONS = ["Markeder", "Selskaper", "Økonomi", "Renter", "Analyse", "Kalender"]
LIVE_KINDS = ["fast-news-aggregator", "news-index"]


def get_or_create(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Each asked row (keys, payload, asked) with the row of its key: the existing one, else the first that asks. Adds created."""
    first = rows.groupBy(*keys).agg(F.min(F.struct("asked", "payload")).alias("new"))
    held = first.join(existing.select(*keys, F.col("payload").alias("old"), F.lit(True).alias("there")), keys, "left")
    return held.select(*keys, F.when(F.col("there"), F.col("old")).otherwise(F.col("new.payload")).alias("payload"), F.col("there").isNull().alias("created"))


def expired(rows: DataFrame) -> DataFrame:
    """The feed after three expiries: its item too old or without a date, its own time too old, rank beyond LIVE_ROWS.

    rows: id, ts, priority, status, item_published, as_of. The rank counts only rows still live; only the first rows are
    sorted, so no task sees the whole feed.
    """
    old = lambda c: F.coalesce(F.col(c) < F.col("as_of") - F.expr(f"INTERVAL {LIVE_HOURS} HOURS"), F.lit(True))
    x = rows.withColumn("why", F.when(F.col("status") != "live", F.lit(None)).when(old("item_published"), "item").when(old("ts"), "time"))
    left = x.where("status = 'live' and why is null")
    first = left.orderBy(F.desc("ts"), F.desc_nulls_last("priority"), F.desc("id")).limit(LIVE_ROWS).select("id", F.lit(True).alias("stays"))
    x = x.join(F.broadcast(first), "id", "left")
    why = F.coalesce("why", F.when((F.col("status") == "live") & F.col("stays").isNull(), "rank"))
    return x.select("id", F.when(why.isNotNull(), "expired").otherwise(F.col("status")).alias("status"), why.alias("why"))


def pruned(items: DataFrame, kept_by: DataFrame) -> DataFrame:
    """Items to delete: of the newest PRUNE_ROWS without a score (the limit is the operator's), those that are not relevant
    and that no row of `kept_by` (id) refers to. items: id, title, source_name, discovered, score."""
    x = items.where("score is null").orderBy(F.desc("discovered"), F.desc("id")).limit(PRUNE_ROWS)
    return judged(x).where("not relevant").join(kept_by.select("id").distinct(), "id", "left_anti").select("id")


def attempts_after(attempts: Column, step: Column) -> Column:
    """A map of counts with one more for `step`."""
    return F.map_concat(F.map_filter(attempts, lambda k, v: k != step), F.create_map(step, F.coalesce(F.try_element_at(attempts, step), F.lit(0)) + 1))


def without(attempts: Column, step: str) -> Column:
    return F.map_filter(attempts, lambda k, v: k != step)


def insert_composite(spark: SparkSession, d: str) -> DataFrame:
    """Rows to append by (supplier, order): the first line of each key, without keys that returned lines have already."""
    l = table(spark, d, "lineitem")
    first = l.groupBy("l_suppkey", "l_orderkey").agg(F.min("l_linenumber").alias("line"), F.count("*").alias("asked"))
    there = l.where("l_returnflag = 'R'").select("l_suppkey", "l_orderkey").distinct()
    return first.join(there, ["l_suppkey", "l_orderkey"], "left_anti")


def slot_jobs(spark: SparkSession, d: str) -> DataFrame:
    """One job for each kind and hour: the first event's payload, unless the hour was there before the last day."""
    e = with_latest(table(spark, d, "events"))
    rows = e.select(F.col("event_type").alias("kind"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot"), F.col("props").alias("payload"), F.col("event_id").alias("asked"), "ts", "as_of")
    old = rows.where("ts < as_of - INTERVAL 1 DAY").groupBy("kind", "slot").agg(F.concat(F.lit("old "), F.min("asked").cast("string")).alias("payload"))
    return get_or_create(rows.where("ts >= as_of - INTERVAL 2 DAYS"), old, ["kind", "slot"])


def bulk_update(spark: SparkSession, d: str) -> DataFrame:
    """Orders updated from their returned lines: the status says how many, the priority is reset."""
    changes = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat(F.lit("R"), F.count("*").cast("string")).alias("o_orderstatus"))
    out = updated(table(spark, d, "orders"), changes, "o_orderkey", ["o_orderstatus"], {"o_orderpriority": F.lit("reset")})
    return out.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def guarded_update(spark: SparkSession, d: str) -> DataFrame:
    """How many articles each of the desk's guarded changes would touch: approve, reject (drafts only), archive, pin, unpin (live only)."""
    a = articles(spark, d)
    n = lambda c: F.count_if(F.expr(c))
    return a.groupBy(F.col("status")).agg(n("status = 'draft'").alias("approve"), n("status = 'draft' and score is null").alias("reject"), F.count("*").alias("archive"), n("status = 'live' and not pinned").alias("pin"), n("status = 'live' and pinned").alias("unpin"))


def pin_change(spark: SparkSession, d: str) -> DataFrame:
    """Live articles after each customer's best is pinned by hand: automatic pins fall, the best one is pinned at place 1."""
    a = articles(spark, d).where("status = 'live'").withColumn("pinned_by", F.when(F.col("pinned"), F.when(F.col("id") % 2 == 0, "auto").otherwise("manual")))
    best = a.groupBy("source_id").agg(F.max(F.struct(F.coalesce("score", F.lit(-1)), "id")).alias("b")).select(F.col("b.id").alias("id"), F.lit(True).alias("best"))
    x = a.join(best, "id", "left")
    keep = F.col("pinned") & (F.col("pinned_by") != "auto")
    by = F.when(F.col("best"), "manual").when(keep, F.col("pinned_by"))
    return x.select("id", by.isNotNull().alias("pinned"), F.when(F.col("best"), 1).when(keep, F.col("pin_place")).alias("place"), by.alias("pinned_by"))


def feed_expiry(spark: SparkSession, d: str) -> DataFrame:
    """The whole feed after the three expiries; an item's own date is a day older for every seventh row, and unknown for every eleventh."""
    f = with_latest(feed(spark, d))
    published = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    return expired(f.select("id", "ts", "priority", F.when(F.col("id") % 5 == 0, "draft").otherwise("live").alias("status"), published.alias("item_published"), "as_of"))


def prune_candidates(spark: SparkSession, d: str) -> DataFrame:
    h = headlines(spark, d)
    items = h.select("id", "title", F.lit("Local Times").alias("source_name"), F.col("published").alias("discovered"), F.when(F.col("k") % 3 == 0, F.col("score")).alias("score"))
    return pruned(items, table(spark, d, "labels").select(F.col("doc_id").alias("id")))


def attempt_maps(spark: SparkSession, d: str) -> DataFrame:
    """Attempts by step as JSON after a claim and after a success of writing."""
    k = F.get_json_object("props", "$.k").cast("int")
    have = F.map_filter(F.create_map(F.lit("research"), k % 3, F.lit("write"), k % 4), lambda s, n: n > 0)
    step = pick(["research", "write", "verify"], F.col("event_id"))
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), text(attempts_after(have, step)).alias("claimed"), text(without(have, "write")).alias("written"))


def failed_log(spark: SparkSession, d: str) -> DataFrame:
    """Cases that fail while their lease holds, with the log row that goes with the change."""
    e = with_latest(table(spark, d, "events"))
    k = F.get_json_object("props", "$.k").cast("long")
    lease = F.when(k % 4 != 0, F.col("ts") + F.expr("INTERVAL 4 MINUTES"))
    x = e.select(F.col("event_id").alias("case_id"), (k % 7).alias("revision"), lease.alias("lease_until"), "as_of", "ts", F.col("event_type"))
    held = x.where("event_type = 'error' and lease_until >= ts")
    return held.select("case_id", "revision", F.lit("failed").alias("status"), (F.col("ts") + F.expr("INTERVAL 2 MINUTES")).alias("retry_after"), F.to_json(F.struct(F.concat(F.lit("error of "), F.col("case_id").cast("string")).alias("error"))).alias("details"))


def revision_log(spark: SparkSession, d: str) -> DataFrame:
    """Revisions, one for each event, stage and hash, and which of them is the event's latest."""
    e = table(spark, d, "events")
    stage = F.when(F.col("event_type") == "purchase", "enriched").otherwise("flash")
    x = e.select(F.col("user_id").alias("event"), stage.alias("stage"), F.md5("props").alias("hash"), F.col("event_id").alias("revision"))
    one = x.groupBy("event", "stage", "hash").agg(F.min("revision").alias("revision"))
    last = one.groupBy("event").agg(F.max("revision").alias("last"))
    return one.join(last, "event").select("event", "stage", "hash", "revision", (F.col("revision") == F.col("last")).alias("latest"))


def register_cases(spark: SparkSession, d: str) -> DataFrame:
    """What registering each item as a case comes to: created, existing, or one of two mismatches.

    An item with a case keeps it, if the run is its own. A new item takes its event key, unless another item has it; of new items
    with one key the first takes it. Every order is a case of its own item and key.
    """
    e = table(spark, d, "events").select(F.col("event_id").alias("item"), (F.col("user_id") % 5).alias("run"), F.concat_ws("|", "user_id", "event_type").alias("key"))
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 5).alias("case_run"))
    own = e.join(c, "item", "left")
    new = own.where("case_run is null").groupBy("key").agg(F.min("item").alias("first"))
    taken = own.where("case_run is not null").select("key").distinct().withColumn("taken", F.lit(True))
    x = own.join(new, "key", "left").join(taken, "key", "left")
    state = (
        F.when(F.col("case_run").isNotNull() & (F.col("case_run") != F.col("run")), "CASE_RUN_MISMATCH").when(F.col("case_run").isNotNull(), "existing")
        .when(F.col("taken") | (F.col("item") != F.col("first")), "EVENT_ALREADY_ASSIGNED").otherwise("created")
    )
    return x.select("item", state.alias("state"))


def usage_log(spark: SparkSession, d: str) -> DataFrame:
    """Usage rows to append, one for each batch of fifteen items of a day with tokens: sums and cost."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    at = F.row_number().over(Window.partitionBy(F.to_date("ts"), "event_type").orderBy("ts", "event_id"))
    x = e.select(F.to_date("ts").alias("day"), F.col("event_type").alias("step"), F.floor((at - 1) / 15).alias("batch"), (k * 10).alias("tokens_in"), k.alias("tokens_out"))
    out = x.groupBy("day", "step", "batch").agg(F.count("*").alias("requested"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")).where("tokens_in > 0 or tokens_out > 0")
    return out.withColumn("cost", F.round((F.col("tokens_in") * 0.66 + F.col("tokens_out") * 1.98) / 1e6, 8))


def edited_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Edits held to what is allowed: known sections, trimmed and cut texts, null for empty ones; without a title or body: rejected."""
    p = table(spark, d, "documents")
    i = F.col("doc_id")
    cut = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)
    section, title = F.trim(pick([" Renter ", "Sport", "Analyse", ""], i)), cut(F.when(i % 9 != 0, F.col("text")), 220)
    body, author = cut(F.col("text"), 30_000), cut(pick(["", "  ", " Desk "], i), 120)
    return p.select(
        i.alias("id"), F.when(section.isin(EDIT_SECTIONS), section).otherwise(EDIT_SECTIONS[0]).alias("section"), F.sha2(title, 256).alias("title_sha256"), F.length(body).cast("long").alias("body_chars"),
        F.when(author == "", "Desk").otherwise(author).alias("author"), F.nullif(cut(F.when(i % 4 == 0, F.lit(" https://x.no/a.png ")), 2000), F.lit("")).alias("image_url"),
        F.when(title == "", "no title").when(body == "", "no body").alias("reject"),
    )


def live_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Whether an item may go live: dated within two hours (15 minutes ahead at most), and, from an aggregator, its original too, as checked."""
    e = with_latest(table(spark, d, "events"))
    i = F.col("event_id")
    fresh = lambda t: F.coalesce((seconds(F.col("as_of")) - seconds(t)).between(-900, 7200), F.lit(False))
    shifted = F.when(i % 13 != 0, F.col("as_of") - F.make_dt_interval(mins=(i % 200 - 30).cast("int")))
    x = e.select(i.alias("id"), "as_of", pick(["rss", *LIVE_KINDS], i).alias("kind"), shifted.alias("published"), (i % 4 != 0).alias("checked"), F.when(i % 6 != 0, i % 5 != 0).alias("fresh"), (F.col("as_of") - F.make_dt_interval(mins=(i % 150).cast("int"))).alias("original"))
    cached = F.when(F.col("checked"), (F.col("fresh").eqNullSafe(True)) & fresh(F.col("original")))
    ok = F.when(~fresh(F.col("published")), False).when(~F.col("kind").isin(LIVE_KINDS), True).otherwise(cached)
    return x.select("id", ok.alias("fresh"), ok.isNull().alias("to_check"))


def stale_live(spark: SparkSession, d: str) -> DataFrame:
    """The newest twelve live rows from aggregators whose original wasn't proven fresh."""
    f = feed(spark, d).select(F.col("id").alias("item"), "ts")
    i = F.col("event_id")
    r = table(spark, d, "events").select(i.alias("item"), pick(["rss", *LIVE_KINDS], i).alias("kind"), F.when(i % 3 != 0, i % 5 == 0).alias("fresh"))
    x = f.join(r.where(F.col("kind").isin(LIVE_KINDS) & ~F.coalesce("fresh", F.lit(False))), "item")
    return x.orderBy(F.desc("ts"), F.desc("item")).limit(LIVE_ROWS).select("item", "ts", "kind")


def decision_urls(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    url = F.concat(pick(["https://www.norges-bank.no", "https://norges-bank.no", "http://www.norges-bank.no", "https://www.norges-bank.no:443"], F.col("event_id")), F.lit("/aktuelt/nyheter/Pressemeldinger/"), F.year("ts").cast("string"), F.lit("/"), day, pick(["-rente/", "-rente", "-rente/?a=1", "-Rente/"], F.floor(F.col("event_id") / 4).cast("long")))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), urls.is_decision(url).alias("decision"))
