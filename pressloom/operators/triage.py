"""Relevance, audience, triage and queue queries over radar items."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import scoring as S
from ..sources.storage import cut
from ..sources.tables import radar, seconds, table, with_latest
from . import lists
from .changes import updated
from .sets import components, name_of, pairs


def _age() -> Column:
    return (seconds(F.col("as_of")) - seconds(F.col("published"))) / 3600


def _text() -> Column:
    return S.joined(F.col("title"), F.lit(None).cast("string"))


def judged(items: DataFrame) -> DataFrame:
    """`items` (title, source_name) with `relevant`."""
    return P.with_counts(items, S.squeezed(_text()), S.RELEVANCE).select(*[f"`{c}`" for c in items.columns], S.relevant(F.col("source_name")).alias("relevant"))


def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    return judged(radar(spark, d)).select("id", "relevant")


def audience_assess(spark: SparkSession, d: str) -> DataFrame:
    return radar(spark, d).select("id", S.audience(_text(), F.col("candidate_type")).alias("a")).select("id", "a.*")


def _rated(counted: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of items that have the counts of S.TRIAGE, with rank, priority and `dropped`."""
    ranked = counted.withColumn("rank", S.triage_rank(F.col("source_kind"), F.col("source_domain")))
    score, explicit, noise = S.triage(F.col("source_name"), F.col("rank"), F.coalesce(_age(), F.lit(24.0)))
    scored = ranked.select(*[f"`{c}`" for c in columns], "rank", score.alias("priority"), explicit.alias("explicit_finance"), noise.alias("noise"))
    return scored.withColumn("dropped", F.expr("not explicit_finance or (noise > 0 and priority < 45) or priority < 22"))


def triaged(items: DataFrame) -> DataFrame:
    """`items` (title, source_name, source_kind, source_domain, published, as_of) with rank, priority and `dropped`."""
    return _rated(P.with_counts(items, _text(), S.TRIAGE), items.columns)


def _with(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """`rows` with the columns that `other` has for their keys, which may be null."""
    own = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(own, same, "left").drop(*[f"__{k}" for k in keys])


def triage_priority(spark: SparkSession, d: str) -> DataFrame:
    return triaged(with_latest(radar(spark, d), "published")).select("id", "rank", "priority", "explicit_finance", F.col("noise").cast("long").alias("noise"), "dropped")


def editorial(standing: Column) -> Column:
    """The weighted selection score of an item of `standing`: score, attention, numbers, audience, freshness and the source's rank."""
    fresh = F.greatest(F.lit(0.0), 10 - F.greatest(F.lit(0.0), F.coalesce(_age(), F.lit(24.0))) * 0.55)
    known = lambda c: F.coalesce(c, F.lit(0))
    parts = known("score") * 0.35 + known("attention") * 0.15 + known("numbers") * 0.10 + S.audience(_text(), F.col("candidate_type"))["score"] * 0.30
    return parts + fresh + standing * 2.8


def editorial_priority(spark: SparkSession, d: str) -> DataFrame:
    x = with_latest(radar(spark, d), "published")
    return x.select("id", F.round(editorial(S.selection_rank(F.col("source_kind"), F.col("source_domain"))), 4).alias("editorial_priority"))


class Likeness:
    """Sets of words in order, and how like each new one is to those before: only sets that share a word are looked at."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.holders: dict[str, list[int]] = {}

    def add(self, words: frozenset[str]) -> dict[int, tuple[float, int]]:
        """(similarity, shared words) of each earlier set that shares a word with this one."""
        both: dict[int, int] = {}
        for w in words:
            for i in self.holders.get(w, ()):
                both[i] = both.get(i, 0) + 1
            self.holders.setdefault(w, []).append(len(self.sizes))
        n = len(words)
        self.sizes.append(n)
        return {i: (max(k / min(n, self.sizes[i]), 1.35 * k / (n + self.sizes[i] - k)), k) for i, k in both.items()}


CLUSTERED = "run {run}, key string, cluster long, lead long"


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Give each set of a component, in order, to the cluster with its most similar member, or to a new one. A set's later
    rows only take the lead, if they are worth more."""
    like, sets, cluster, lead, born = Likeness(), {}, [], [], []
    rows = rows.sort_values("place")
    for key, second, value, place, ident in zip(*(rows[c] for c in ("key", "second", "value", "place", "id"))):
        if key not in sets:
            best: dict[int, float] = {}
            for i, (score, _) in like.add(frozenset(key.split(" "))).items():
                best[cluster[i]] = max(best.get(cluster[i], 0.0), score)
            c = min(best, key=lambda c: (-best[c], c), default=None)
            if c is None or not (best[c] >= 0.70 or (best[c] >= 0.52 and abs(second - lead[c][0]) <= 24 * 3600)):
                c = len(lead)
                lead.append((second, value, ident))
                born.append(place)
            sets[key] = c
            cluster.append(c)
        c = sets[key]
        lead[c] = (second, value, ident) if value > lead[c][1] else lead[c]
    run = rows["run"].iloc[0]
    return pd.DataFrame([(run, key, born[c], lead[c][2]) for key, c in sets.items()], columns=["run", "key", "cluster", "lead"])


def clustered(items: DataFrame) -> DataFrame:
    """Greedy clusters of each `run`'s items, in the order of their `place`.

    Adds cluster (the place of its first row) and leads (its representative). The result depends on the order, but a row only ever joins
    a row that is at least 0.52 similar to it, so what doesn't hang together by such pairs is folded apart: a task
    holds one component's different sets of words, never a run. Copies of a set follow it; of these, only the first of each worth, if it is
    worth more than all before, can lead. Items may bring the `words` of their titles.
    """
    if "words" not in items.columns:
        items = _with(items, cut(items.select("title").distinct().withColumn("words", S.triage_words(F.col("title")))), "title")
    x = items.select("run", "id", "title", "source_domain", "published", "rank", "priority", "words", F.coalesce(seconds(F.col("published")), F.lit(0.0)).alias("second"), "place")
    x = x.withColumn("key", name_of(F.col("words")))
    sets = cut(x.where("key <> ''").groupBy("run", "key").agg(F.first("words").alias("words")).select("run", "key", F.array_distinct("words").alias("words")))
    # A similarity of 0.52 by containment is so much of the smaller set; by Jaccard it is 0.52 / 1.35 of both, so of the smaller one at least.
    near = pairs(sets, sets, 0.52 / 1.35).where("a < b")
    roots = components(near)
    worth = (F.col("priority") + 1.4 * F.col("rank")).alias("value")
    first = x.where("key <> ''").select("run", "key", worth, "place", "second", "id").groupBy("run", "key", "value").agg(F.min(F.struct("place", "second", "id")).alias("f")).select("run", "key", "value", "f.*")
    before = F.max("value").over(Window.partitionBy("run", "key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    leads = first.withColumn("before", before).where("before is null or value > before").drop("before")
    held = leads.join(roots, ["run", "key"], "left").withColumn("root", F.coalesce("root", "key"))
    found = cut(held.groupBy("run", "root").applyInPandas(_fold, CLUSTERED.format(run=dict(x.dtypes)["run"])))
    out = x.join(found, ["run", "key"], "left").withColumns({"cluster": F.coalesce("cluster", F.col("place").cast("long")), "leads": F.coalesce(F.col("lead") == F.col("id"), F.lit(True))})
    return out.drop("key", "lead")


def labelled(items: DataFrame, most: int | None = 500, keep: int = 45) -> DataFrame:
    """Triage of each run's newest `most` items (all, if that is None): candidate, overflow, duplicate or noise, with the cluster's key, size
    and representative."""
    newest = [F.desc_nulls_last("published"), F.desc("id")]
    if most is not None:
        items = items.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(*newest))).where(F.col("place") <= most)
    # Each different title is read once; of its rows, only their numbers are joined to it.
    read = P.with_counts(items.select("title").distinct(), _text(), S.TRIAGE).drop("__text").withColumn("words", S.triage_words(F.col("title")))
    x = _rated(_with(items, cut(read), "title"), [*items.columns, "words"])
    if most is None:
        # Only the order of places counts: rows sorted in ranges are numbered where they lie, so that no task holds a run.
        x = x.repartitionByRange("run", *newest).sortWithinPartitions("run", *newest).withColumn("place", F.monotonically_increasing_id())
    x = cut(x)
    noise = x.where("dropped").select("run", "id", F.lit("noise").alias("status"), F.lit(0).cast("long").alias("priority"), F.lit(None).cast("string").alias("event_key"), F.lit(1).cast("long").alias("cluster_size"), F.col("id").alias("representative_id"))
    c = clustered(x.where("not dropped"))
    key = F.substring(F.sha1(F.concat(F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("unknown")), F.lit("|"), F.array_join(F.slice("words", 1, 10), "-"))), 1, 20)
    lead = lambda value: F.max(F.when(F.col("leads"), value))
    domains = F.size(F.collect_set(F.nullif(S.bare_domain(F.col("source_domain")), F.lit(""))))
    n = F.count("*")
    top = F.least(F.lit(100), F.max("priority") + F.least(F.lit(16), 3 * (n - 1)) + F.least(F.lit(10), F.greatest(F.lit(0), 2 * (domains - 1))))
    clusters = cut(c.groupBy("run", "cluster").agg(n.alias("cluster_size"), top.alias("top"), lead(key).alias("event_key"), lead(F.col("id")).alias("representative_id")))
    best = clusters.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("top"), "cluster"))).where(F.col("rank") <= keep)
    known = _with(_with(c.select("run", "id", "cluster", "leads", "priority"), clusters, "run", "cluster"), best.select("run", "cluster", F.lit(True).alias("best")), "run", "cluster")
    status = F.when(~F.col("leads"), "duplicate").when(F.col("best"), "candidate").otherwise("overflow")
    found = known.select("run", "id", status.alias("status"), F.when(F.col("leads"), F.col("top")).otherwise(F.col("priority")).cast("long").alias("priority"), "event_key", "cluster_size", "representative_id")
    return found.unionByName(noise)


#: Fixed value: hours that a candidate stays one, and that triage looks back.
WINDOW_HOURS = 36
TRIAGED = {"triage": "status", "priority": "priority", "local_key": "event_key", "cluster_size": "cluster_size", "representative": "representative_id"}


def triage_run(items: DataFrame, model: str, most: int | None = 500, keep: int = 45) -> DataFrame:
    """`items` after one triage: candidates that are too old expire; of the last WINDOW_HOURS the rows that `model` hasn't scored are
    clustered and labelled, and what their last attempts left is reset.

    items: id, title, source_name, source_kind, source_domain, published, discovered, ai_score, model, attempts, retry_after, triaged_at, as_of, and
    the columns of TRIAGED. All other rows stay as they are.
    """
    when = F.coalesce("published", "discovered")
    oldest = F.col("as_of") - F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")
    aged = items.withColumn("triage", F.when((F.col("triage") == "candidate") & (when < oldest), "expired").otherwise(F.col("triage")))
    due = F.coalesce((when >= oldest) & (F.col("ai_score").isNull() | ~F.col("model").eqNullSafe(model)), F.lit(False))
    scan = items.where(due).select("id", "title", "source_name", "source_kind", "source_domain", "published", "as_of", F.lit(1).alias("run"))
    found = labelled(scan, most, keep).select("id", *(F.col(v).alias(k) for k, v in TRIAGED.items())).withColumn("priority", F.col("priority").cast("long"))
    changed = updated(aged.where(due), found, "id", list(TRIAGED), {"attempts": F.lit(0), "retry_after": F.lit(None), "triaged_at": F.col("as_of")})
    return aged.where(~due).unionByName(changed)


def counted(items: DataFrame, most: int | None = 500, keep: int = 45) -> DataFrame:
    """The counters of each run's triage: scanned, relevant, clusters, candidates, duplicates, noise, overflow."""
    x = labelled(items, most, keep)
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return x.groupBy("run").agg(
        F.count("*").alias("scanned"), n("candidate", "overflow", "duplicate").alias("relevant"), n("candidate", "overflow").alias("clusters"), n("candidate").alias("candidates"),
        n("duplicate").alias("duplicates"), n("noise").alias("noise"), n("overflow").alias("overflow"),
    )


def triage_counters(spark: SparkSession, d: str) -> DataFrame:
    x = radar(spark, d).withColumn("run", F.to_date("published"))
    return counted(x.withColumn("as_of", F.max("published").over(Window.partitionBy("run"))))


def triage_round(spark: SparkSession, d: str) -> DataFrame:
    """One triage of all items at the time of the latest, without a limit of rows."""
    x = with_latest(lists.items(spark, d), "published").withColumns({
        "discovered": F.col("published"), "attempts": (F.col("k") % 4).cast("int"), "triaged_at": F.lit(None).cast("timestamp_ntz"), "local_key": F.col("event_key"), "cluster_size": F.col("cluster_size").cast("long"),
        "representative": F.col("id"), "priority": F.col("priority").cast("long"),
    })
    return triage_run(x, lists.MODEL, most=None).select("id", *TRIAGED, "attempts", "retry_after", "triaged_at")


def triage_labels(spark: SparkSession, d: str) -> DataFrame:
    """One triage run a day, as of the day's last item."""
    x = radar(spark, d).withColumn("run", F.to_date("published"))
    return labelled(x.withColumn("as_of", F.max("published").over(Window.partitionBy("run"))))


def folded(rows: DataFrame, limit: int = 3) -> DataFrame:
    """Work of each desk's queue: `rows` (desk, id, state, step, verification_pending, attempts, lease_until, retry_after,
    article_status, as_of; attempts are those of the step that the state asks for) as counts and drafts to write."""
    s, step = F.col("state"), F.col("step")
    asked = F.when(s.isin("selected", "researching"), "research").when(s.isin("ready", "writing"), "write").when((s == "verifying") | ((s == "review") & F.col("verification_pending")), "verify").when(s == "failed", step)
    later = lambda c: F.coalesce(F.col(c) > F.col("as_of"), F.lit(False))
    known = F.coalesce(asked.isin("research", "write", "verify"), F.lit(False))
    kind = (
        F.when(s == "blocked", "blocked").when(later("lease_until"), "busy").when(~known & (s == "failed"), "failed").when(~known, "none")
        .when(F.col("attempts") >= 3, "failed").when(later("retry_after"), F.concat(F.lit("deferred_"), asked)).otherwise(asked)
    )
    x = rows.select("desk", "id", kind.alias("kind"), F.col("article_status").isin("draft", "live", "archived").alias("made"))
    n = lambda k: F.count_if(F.col("kind") == k)
    names = ["research", "write", "verify", "deferred_research", "deferred_write", "deferred_verify", "busy", "blocked", "failed"]
    total = x.groupBy("desk").agg(F.count_if("made").alias("drafts"), *[n(k).alias(k) for k in names])
    left = F.greatest(F.lit(0), limit - F.col("drafts"))
    held = {"left": left, "write": F.least("write", left), **{k: F.when(left > 0, F.col(k)).otherwise(0) for k in ("research", "deferred_research", "deferred_write")}}
    first = x.where("kind = 'write'").withColumn("place", F.row_number().over(Window.partitionBy("desk").orderBy("id"))).where(F.col("place") <= limit)
    out = total.select("desk", "drafts", *[held.get(k, F.col(k)).cast("long").alias(k) for k in names])
    ids = first.join(out.select("desk", "write"), "desk").where("place <= write").groupBy("desk").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return out.join(ids, "desk", "left").withColumn("ids", F.coalesce("ids", F.lit("")))


def queue_fold(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e, o = with_latest(table(spark, d, "events")).withColumn("k", k), table(spark, d, "orders")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int"))
    ident = F.col("event_id")
    after = lambda every: F.when(ident % every == 0, F.timestamp_seconds(seconds(F.col("ts")) + F.col("k") * 86400).cast("timestamp_ntz"))
    rows = e.join(o.where("o_orderstatus = 'P'"), ident == F.col("o_orderkey"), "left").select(
        (F.col("user_id")).alias("desk"), ident.alias("id"), pick(STATES, F.col("k")).alias("state"), pick(STEPS, ident).alias("step"), (ident % 2 == 0).alias("verification_pending"),
        (F.col("k") % 5).alias("attempts"), after(3).alias("lease_until"), after(4).alias("retry_after"), F.when(F.col("o_orderkey").isNotNull(), "draft").alias("article_status"), "as_of",
    )
    return folded(rows)


STATES = ["blocked", "selected", "ready", "verifying", "review", "failed", "writing"]
STEPS = ["research", "write", "other"]
