"""The desk's own changes and calls: guarded edits, failed cases with their log, search words, costs of model calls, bodies of its API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import articles, feed, headlines, radar, table, with_latest
from .evidence import words

#: Dollars for a million tokens (found in the cache, not found, given out) off the peak, twice that at it.
TARIFFS = {"radar": (0.022, 0.66, 1.98), "raw": (0.003, 0.15, 0.6)}
#: Words of a search, how many it needs, and searches for an item.
TERMS, LEAST_TERMS, FIRST_TERMS, SEARCHES = 8, 2, 6, 3


def is_peak(ts: Column) -> Column:
    """Weekdays from 1 to 4 and from 6 to 10 UTC."""
    hour = F.hour(ts)
    return F.dayofweek(ts).between(2, 6) & (hour.between(1, 3) | hour.between(6, 9))


def call_cost(ts: Column, hit: Column, miss: Column, prompt: Column, output: Column, tariff: str) -> Column:
    """What a call costs; a prompt whose cache misses aren't told counts as missed whole, nulls count as none."""
    off = [F.lit(x) for x in TARIFFS[tariff]]
    tokens = (F.coalesce(hit, F.lit(0)), F.coalesce(miss, prompt, F.lit(0)), F.coalesce(output, F.lit(0)))
    return sum((n * r for n, r in zip(tokens, off, strict=True)), F.lit(0.0)) * F.when(is_peak(ts), 2).otherwise(1) / 1_000_000


def rolled_up(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and cost of each group: what a batch's calls (tokens_in, tokens_out, cost) add up to."""
    none = lambda c: F.coalesce(c, F.lit(0))
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(none("tokens_in")).alias("tokens_in"), F.sum(none("tokens_out")).alias("tokens_out"), F.round(F.sum(none("cost")), 6).alias("cost"))


def usage_costs(spark: SparkSession, d: str) -> DataFrame:
    """Each event is a call of one of the two scorers; some don't tell what the cache had."""
    k, i = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "ts", (k * 7).alias("hit"), F.when(i % 3 != 0, i % 900).alias("miss"), (i % 1000).alias("prompt"), F.when(i % 5 != 0, k * 3).alias("output"), (i % 2 == 0).alias("raw"))
    cost = F.when(F.col("raw"), call_cost(*map(F.col, ("ts", "hit", "miss", "prompt", "output")), "raw")).otherwise(call_cost(*map(F.col, ("ts", "hit", "miss", "prompt", "output")), "radar"))
    calls = e.select("day", F.col("event_type").alias("step"), F.when(F.col("raw"), "raw").otherwise("radar").alias("tariff"), F.col("prompt").alias("tokens_in"), F.col("output").alias("tokens_out"), cost.alias("cost"))
    return rolled_up(calls, "day", "step", "tariff")


def guarded(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of articles (id, status, pinned, pin_place, published, as_of) that the asked changes (id, action) touch, as they are then.

    Approve and reject take drafts only, pin and unpin live ones, archive any; what a guard holds back isn't a row.
    """
    x = rows.join(asked, "id")
    is_ = lambda s: F.col("status") == s
    does = lambda a: F.col("action") == a
    x = x.where((does("approve") | does("reject")) & is_("draft") | (does("pin") | does("unpin")) & is_("live") | does("archive"))
    gone = does("archive") | does("unpin")
    return x.select(
        "id", "action", F.when(does("approve"), "live").when(does("reject"), "rejected").when(does("archive"), "archived").otherwise(F.col("status")).alias("status"),
        F.when(gone, False).when(does("pin"), True).otherwise(F.col("pinned")).alias("pinned"), F.when(gone, F.lit(None)).when(does("pin"), 1).otherwise(F.col("pin_place")).cast("long").alias("pin_place"),
        F.when(does("approve"), F.coalesce("published", "as_of")).otherwise(F.col("published")).alias("published"),
    )


def guarded_changes(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d).withColumn("published", F.when(F.col("id") % 4 != 1, F.col("published")))
    asked = a.select("id", F.get(F.array(*map(F.lit, ["approve", "reject", "archive", "pin", "unpin"])), (F.col("id") % 5).cast("int")).alias("action"))
    as_of = articles(spark, d).agg(F.max("created").alias("as_of"))
    return guarded(a.select("id", "status", "pinned", "pin_place", "published").join(F.broadcast(as_of), F.lit(True)), asked)


def failed(cases: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases (id, state, revision, step, token, lease_until, retry_after, last_error) after errors (id, token, step, message, at), and the rows of the log: only
    the holder of a case's token changes it, and only what it changed is logged; of several errors the last one counts."""
    held = errors.groupBy("id", "token").agg(F.max(F.struct("at", "step", F.substring("message", 1, 800).alias("message"))).alias("e"))
    x = cases.join(held, ["id", "token"], "left")
    hit = F.col("e").isNotNull()
    log = x.where(hit).select(F.col("id").alias("case_id"), "revision", "e.step", F.lit("failed").alias("status"), F.to_json(F.struct(F.col("e.message").alias("error"))).alias("details"))
    none, wait = F.lit(None), F.col("e.at") + F.expr("INTERVAL 2 MINUTES")
    after = x.select("id", F.when(hit, "failed").otherwise(F.col("state")).alias("state"), "revision", "step", *(F.when(hit, none).otherwise(F.col(c)).alias(c) for c in ("token", "lease_until")), F.when(hit, wait).otherwise(F.col("retry_after")).alias("retry_after"), F.when(hit, F.col("e.message")).otherwise(F.col("last_error")).alias("last_error"))
    return after, log


def failed_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every case after the errors of workers, some of which lost their lease; with what is logged of each."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events")
    cases = e.select(i.alias("id"), F.lit("writing").alias("state"), (k % 7).alias("revision"), F.lit("write").alias("step"), F.when(i % 4 != 0, F.concat(F.lit("t"), i % 9)).alias("token"), (F.col("ts") + F.expr("INTERVAL 4 MINUTES")).alias("lease_until"), F.lit(None).cast("timestamp_ntz").alias("retry_after"), F.lit(None).cast("string").alias("last_error"))
    errors = e.where("event_type = 'error'").select(i.alias("id"), F.concat(F.lit("t"), F.when(i % 3 == 0, 99).otherwise(i % 9)).alias("token"), F.lit("write").alias("step"), F.concat(F.lit("no "), i, F.repeat(F.lit("x"), 900)).alias("message"), F.col("ts").alias("at"))
    after, log = failed(cases, errors)
    return after.join(log.select(F.col("case_id").alias("id"), F.length("details").cast("long").alias("logged")), "id", "left").select("id", "state", "revision", "token", "retry_after", F.length("last_error").cast("long").alias("error_chars"), "logged")


def searches(items: DataFrame) -> DataFrame:
    """(id, place, query): what to search the index for an item's source by: its first words, then phrases that its summary quotes.
    items: id, title, summary. An item of fewer than LEAST_TERMS words isn't searched for."""
    terms = F.slice(words(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))), 1, TERMS)
    quoted = F.transform(T.quoted(F.col("summary")), lambda q: F.concat(F.lit('"'), F.replace(q, F.lit('"'), F.lit("")), F.lit('"')))
    # One generator makes both, so that the filter and the queries don't work them out again.
    x = items.select("id", F.inline(F.array(F.struct(terms.alias("terms"), quoted.alias("quoted"))))).where(F.size("terms") >= LEAST_TERMS)
    every = F.slice(F.concat(F.array(F.array_join(F.slice("terms", 1, FIRST_TERMS), " ")), F.coalesce("quoted", F.array().cast("array<string>"))), 1, SEARCHES)
    return x.select("id", F.posexplode(every).alias("place", "query")).select("id", F.col("place").cast("long").alias("place"), "query")


def source_searches(spark: SparkSession, d: str) -> DataFrame:
    h, i = headlines(spark, d), F.col("id")
    summary = F.when(i % 3 == 0, F.concat(F.lit("They said «we will sell the whole fleet "), i, F.lit("» and left"))).when(i % 3 == 1, F.concat(F.lit("Item number "), i))
    return searches(h.select("id", "title", summary.alias("summary")))


def case_rows(spark: SparkSession, d: str) -> DataFrame:
    """A run's cases with their items and articles, in the order of selection: what the queue is folded from."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    cases = table(spark, d, "events").where("event_type <> 'view'").select(i.alias("id"), (i + k).alias("item"), (F.col("user_id") % 40).alias("run"), F.when(i % 2 == 0, i).alias("article"), F.when(i % 5 == 0, F.to_json(F.struct(F.struct((i % 10 == 0).alias("pending")).alias("verification")))).alias("dossier"))
    rank = radar(spark, d).select(F.col("id").alias("item"), F.when(F.col("k") % 3 != 0, F.col("attention")).alias("rank"))
    made = articles(spark, d).select(F.col("id").alias("article"), F.col("status").alias("article_status"))
    x = cases.join(rank, "item").join(made, "article", "left")
    return x.select("run", "id", "rank", F.get_json_object("dossier", "$.verification.pending").alias("verification_pending"), "article_status")


def breaking_json(spark: SparkSession, d: str) -> DataFrame:
    """The body of the breaking story's API: the latest live article whose two hours aren't over, or null."""
    a = articles(spark, d).where("status = 'live'").select("id", "published")
    latest = with_latest(a, "published").where("published > as_of - INTERVAL 2 HOURS").agg(F.max(F.struct("published", "id")).alias("s"))
    story = F.when(F.col("s").isNotNull(), F.struct(F.col("s.id").alias("id"), F.date_format("s.published", "yyyy-MM-dd'T'HH:mm:ss").alias("at")))
    return latest.select(F.to_json(F.struct(story.alias("story")), {"ignoreNullFields": "false"}).alias("json"))


def health_json(spark: SparkSession, d: str) -> DataFrame:
    """The body of the health API: counts of the tables behind the site."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(articles(spark, d), "articles").crossJoin(n(feed(spark, d), "feed")).crossJoin(n(table(spark, d, "events").select("user_id").distinct(), "markets"))
    return counts.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.struct("articles", "feed", "markets").alias("counts"))).alias("json"))
