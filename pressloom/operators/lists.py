"""Lists, queues and joins of the desk: each a top-k or a semi or anti join over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import xml_escaped
from ..sources.tables import articles, feed, pick, radar, table, with_latest

#: How many rows each list shows, batches of a scoring call, statuses that cover a story.
DRAFTS, RAW, RADAR, CASES, SCORING, BATCH, RAW_SCORING, SITEMAP, NEWS_SITEMAP = 50, 30, 160, 50, 40, 15, 30, 5000, 1000
MODEL, COVERS = "model/v5", ["draft", "live", "archived"]
STATUS_ORDER = ["candidate", "duplicate", "overflow", "noise"]
LIVE_TYPES = ["breaking", "resultat", "oppkjøp", "renter", "makro", "markedsbevegelse"]
BOARD = [7, 3, 11, 42, 5, 1, 9, 2, 8, 4]


def items(spark: SparkSession, d: str) -> DataFrame:
    """Radar items with the state that triage and scoring leave: made from an event's numbers."""
    r, i, k = radar(spark, d), F.col("id"), F.col("k")
    return r.withColumns({
        "triage": pick([*STATUS_ORDER, "expired"], k), "model": F.when(i % 3 == 0, MODEL).when(i % 3 == 1, "model/v4"), "ai_score": F.when(i % 4 != 0, F.round("score")), "priority": F.when(i % 6 != 0, k * 29 % 100),
        "next_step": F.when(i % 5 != 0, pick(["overvak", "ignorer", "krediter"], i)), "retry_after": F.when(k % 5 == 0, F.col("published") + F.expr("INTERVAL 1 DAY")), "run": F.col("user_id") % 50,
        "event_key": F.when(i % 9 != 0, F.concat_ws("|", (F.col("user_id") % 200).cast("string"), F.col("candidate_type"), F.to_date("published").cast("string"))), "cluster_size": F.when(i % 2 == 0, k % 4), "article_of": F.when(i % 7 == 0, i),
    })


def draft_list(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d).where("status = 'draft'").orderBy(F.desc_nulls_last("score"), F.desc("published"), F.desc("id")).limit(DRAFTS)
    return a.join(table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source")), "source_id", "left").select("id", "score", "published", "source")


def published_list(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).where("status = 'live'").orderBy(F.desc_nulls_last("published"), F.desc("id")).limit(DRAFTS).select("id", "published", "pinned")


def feed_list(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d).orderBy(F.desc("ts"), F.desc("id")).limit(DRAFTS).select("id", "ts", "section", "priority")


def live_order(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d).where("status = 'live'")
    return a.orderBy(F.desc("pinned"), F.asc_nulls_last("pin_place"), F.desc_nulls_last("score"), F.desc_nulls_last("published"), F.desc("id")).limit(20).select("id", "pinned", "pin_place", "score")


def raw_list(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(RAW)
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published"), F.col("c_name").alias("source"))


def radar_list(spark: SparkSession, d: str) -> DataFrame:
    """The first RADAR items by status and six further keys, with their fact pack and whether an article covers them."""
    place = F.coalesce(*[F.when((F.col("triage") == s) & (F.col("model").eqNullSafe(MODEL) if n == 0 else F.lit(True)), n) for n, s in enumerate(["candidate", *STATUS_ORDER])], F.lit(5))
    x = items(spark, d).withColumn("place", place)
    down = [F.desc_nulls_last(c) for c in ("ai_score", "priority", "attention", "numbers", "published", "id")]
    top = x.orderBy("place", *down).limit(RADAR).select("id", "place", "triage", "ai_score", "priority")
    packs = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("can_write"))
    covered = articles(spark, d).where("status in ('draft', 'live')").select("id", F.lit(True).alias("covered"))
    return top.join(packs, "id", "left").join(covered, "id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def case_list(spark: SparkSession, d: str) -> DataFrame:
    """The last changed cases, with fields read from their JSON by path."""
    e = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(CASES)
    dossier = F.concat(F.lit('{"discovery": {"title": "'), F.col("event_type"), F.lit('"}, "research": {"reasons": ["a", "b'), F.col("event_id").cast("string"), F.lit('"]}, "sources": [{"publication": {"at": "2024"}}]}'))
    x = e.select(F.col("event_id").alias("id"), "ts", dossier.alias("j"))
    a = articles(spark, d).select("id", F.col("status").alias("article_status"))
    path = lambda p: F.get_json_object("j", p)
    return x.join(a, "id", "left").select("id", "ts", path("$.discovery.title").alias("title"), path("$.research.reasons[1]").alias("reason"), path("$.sources[0].publication.at").alias("at"), path("$.selection.reason").alias("selection"), "article_status")


def article_board(spark: SparkSession, d: str) -> DataFrame:
    """The board beside an article: the shorter list of symbols first."""
    latest = feed(spark, d).groupBy("user_id").agg(F.max_by("priority", F.struct("ts", "id")).alias("value"))
    order = F.array_position(F.array(*map(F.lit, BOARD)), F.col("user_id").cast("int"))
    return latest.select(F.col("user_id").alias("symbol"), "value", F.when(order == 0, 99).otherwise(order).alias("place")).orderBy("place", "symbol").limit(18)


def scoring_queue(spark: SparkSession, d: str, discovered_before: str | None = None, limit: int = SCORING) -> DataFrame:
    """Candidates to score, not yet scored by this model, in batches of BATCH. A cut-off in time is a filter only if given."""
    x = with_latest(items(spark, d), "published").where("triage = 'candidate' and (retry_after is null or retry_after <= as_of)")
    x = x.where(F.col("ai_score").isNull() | ~F.col("model").eqNullSafe(MODEL))
    x = x if discovered_before is None else x.where(F.col("published") <= F.lit(discovered_before).cast("timestamp_ntz"))
    top = x.orderBy(F.desc_nulls_last("priority"), F.desc_nulls_last("published"), F.desc("id")).limit(max(1, min(SCORING, limit)))
    at = F.row_number().over(Window.orderBy(F.desc_nulls_last("priority"), F.desc_nulls_last("published"), F.desc("id")))  # SCORING rows at most
    return top.select("id", "priority", "published", F.floor((at - 1) / BATCH).alias("batch"))


def scoring_state(spark: SparkSession, d: str) -> DataFrame:
    """Per run: items ready to score and deferred, of those that came in before the run's cut-off, its own median time."""
    x = items(spark, d).where("triage = 'candidate'").where(F.col("ai_score").isNull() | ~F.col("model").eqNullSafe(MODEL))
    cut = items(spark, d).groupBy("run").agg(F.max(F.when(F.col("k") % 2 == 0, F.col("published"))).alias("cutoff"))
    ready = F.col("retry_after").isNull() | (F.col("retry_after") <= F.col("cutoff"))
    x = x.join(cut, "run").where("cutoff is null or published <= cutoff")
    return x.groupBy("run").agg(F.count_if(ready).alias("ready"), F.count_if(F.col("retry_after") > F.col("cutoff")).alias("deferred"))


def raw_queue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(RAW_SCORING)
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("source"))
    return o.join(s, "o_custkey", "left").select(F.col("o_orderkey").alias("id"), "source")


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of job: the last success, and the last error with its time."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    done = F.max(F.when(F.col("k") % 4 == 2, F.col("ts")))
    error = F.max(F.when(F.col("k") % 4 == 3, F.struct("ts", "event_id")))
    return e.groupBy(F.col("event_type").alias("kind")).agg(done.alias("last_success"), error.alias("x")).select("kind", "last_success", F.col("x.ts").alias("error_at"), F.col("x.event_id").alias("error_id"))


def auto_highlight(spark: SparkSession, d: str) -> DataFrame:
    """For each run its best live article, unless one of its live articles is pinned by hand."""
    a = articles(spark, d).where("status = 'live'")
    r = items(spark, d).select("id", "run", (F.col("k") % 6).alias("rank"), F.col("attention").alias("selection"))
    x = a.select("id", "score", "published", (F.col("pinned") & (F.col("id") % 3 == 0)).alias("manual")).join(r, "id")
    order = F.struct(F.when(F.col("rank") != 5, -F.col("rank")).alias("rank"), "selection", F.coalesce("score", F.lit(-1)).alias("score"), "published", "id")
    best = x.groupBy("run").agg(F.max(order).alias("b"), F.max("manual").alias("locked"))
    return best.select("run", F.when(~F.col("locked"), F.col("b.id")).alias("id"), F.when(F.col("locked"), "manual_highlight_locked").otherwise("auto_highlight").alias("reason"))


def sitemap_xml(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the sitemaps: SITEMAP articles, and NEWS_SITEMAP of the last two days; written as XML."""
    a = with_latest(articles(spark, d), "published").where("status in ('live', 'archived')")
    x = a.orderBy(F.desc("published"), F.desc("id")).limit(SITEMAP)
    news = F.col("published") >= F.col("as_of") - F.expr("INTERVAL 2 DAYS")
    at = F.row_number().over(Window.orderBy(F.desc("published"), F.desc("id")))  # SITEMAP rows at most
    link = xml_escaped(F.concat(F.lit("https://www.example.com/a?id="), F.col("id").cast("string"), F.lit("&x='1'")))
    stamp = F.date_format("published", "yyyy-MM-dd")
    return x.select("id", F.concat(F.lit("<url><loc>"), link, F.lit("</loc><lastmod>"), stamp, F.lit("</lastmod></url>")).alias("xml"), (news & (at <= NEWS_SITEMAP)).alias("news"))


def live_json(spark: SparkSession, d: str) -> DataFrame:
    """The live feed's rows as JSON."""
    f = feed(spark, d).orderBy(F.desc("ts"), F.desc_nulls_last("priority"), F.desc("id")).limit(12)
    body = F.struct("id", F.col("section").alias("headline"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit(None).cast("string").alias("article"))
    return f.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def radar_packs(spark: SparkSession, d: str) -> DataFrame:
    """Every item's fact pack and whether an article covers it: left join and an existence flag."""
    packs = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "ready").otherwise("needs_source").alias("pack"))
    covered = articles(spark, d).where("status in ('draft', 'live')").select("id", F.lit(True).alias("covered"))
    return items(spark, d).select("id", "triage").join(packs, "id", "left").join(covered, "id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def not_top_twelve(spark: SparkSession, d: str) -> DataFrame:
    """Rows beyond each section's first twelve."""
    f = feed(spark, d)
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("ts"), F.desc_nulls_last("priority"), F.desc("id")))
    top = f.withColumn("rank", rank).where(F.col("rank") <= 12).select("id")
    return f.join(top, "id", "left_anti").groupBy("section").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def linked_updates(spark: SparkSession, d: str) -> DataFrame:
    """Feed rows after articles were published about them: linked to the article, and its time taken; only while the desk's switch is on."""
    switch = table(spark, d, "region").agg((F.count("*") > 0).alias("enabled"))
    a = articles(spark, d).where("status = 'live'").select("id", F.col("published").alias("at"))
    x = feed(spark, d).select("id", "ts").join(a, "id", "left").join(F.broadcast(switch), F.lit(True))
    return x.select("id", F.when(F.col("enabled") & F.col("at").isNotNull(), F.col("id")).alias("article_id"), F.coalesce(F.when(F.col("enabled"), F.col("at")), "ts").alias("at"))


def live_candidates_full(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for the live feed: score, next step, recency and interest, and not shown yet, by id or lately by key.

    The OR is two anti joins on equal keys. Events here are spread over months, so the horizons are 20 days.
    """
    x = with_latest(items(spark, d), "published").where("triage = 'candidate' and ai_score >= 60 and coalesce(next_step, 'overvak') <> 'ignorer' and published >= as_of - INTERVAL 20 DAYS")
    x = x.where(F.col("candidate_type").isin(LIVE_TYPES) | (F.coalesce("attention", F.lit(0)) >= 45) | (F.col("ai_score") >= 70))
    shown = with_latest(items(spark, d), "published").where("triage = 'duplicate'")
    recent = shown.where("event_key is not null and published >= as_of - INTERVAL 20 DAYS").select("event_key").distinct()
    left = x.join(shown.select("id"), "id", "left_anti").join(recent, "event_key", "left_anti")
    age = F.unix_seconds(F.col("as_of").cast("timestamp")) - F.unix_seconds(F.col("published").cast("timestamp"))
    return left.select("id", "ai_score", "published", F.floor(age / 60).alias("age_minutes"))


def selection_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Items that a run may select: scored candidates whose event no other run's case and no recent pick covers, with two flags.

    Each OR is two equi joins: by id and by event key. Covers: articles by id or by key; trusted: a sibling from a known paper;
    recent pick: an item of the event picked within six hours of the latest time, with a ready pack or an article of its own.
    """
    every = with_latest(items(spark, d), "published")
    x = every.where(F.expr("triage = 'candidate' and ai_score >= 60 and published >= as_of - INTERVAL 20 DAYS") & F.col("model").eqNullSafe(MODEL))
    keyed = every.where("event_key is not null")
    cases = every.where("k % 17 = 3").select("id", "event_key", "run")
    by_id = cases.select("id", F.col("run").alias("case_run"))
    by_key = cases.where("event_key is not null").groupBy("event_key").agg(F.min("run").alias("low"), F.max("run").alias("high"))
    x = x.join(by_id.where("case_run is not null"), "id", "left").where("case_run is null or case_run = run").drop("case_run")
    x = x.join(by_key, "event_key", "left").where("low is null or (low = run and high = run)").drop("low", "high")
    made = articles(spark, d).where(F.col("status").isin(COVERS)).select("id")
    ready = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    recent = keyed.where("k % 7 = 5 and published >= as_of - INTERVAL 6 HOURS").select("id", "event_key")
    recent = recent.join(made.union(ready).distinct(), "id", "left_semi").select("event_key").distinct()
    x = x.join(recent, "event_key", "left_anti")
    covered_items = keyed.join(made, "id", "left_semi").select("event_key").distinct().withColumn("by_key", F.lit(True))
    trusted = keyed.where(F.regexp_replace("source_domain", r"^www\.", "").isin(V.SELECTION_DOMAINS)).select("event_key").distinct().withColumn("trusted", F.lit(True))
    x = x.join(made.withColumn("by_id", F.lit(True)), "id", "left").join(covered_items, "event_key", "left").join(trusted, "event_key", "left")
    flag = lambda *c: reduce(lambda a, b: a | b, [F.coalesce(y, F.lit(False)) for y in c])
    return x.select("id", "run", "event_key", "ai_score", flag("by_id", "by_key").alias("has_article"), flag("trusted").alias("has_trusted_source"))
