"""The diversified pick: greedy event clusters of a run's best items, then few of each section."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..sources.tables import articles, radar, seconds, with_latest
from .gates import DEFAULT_SECTION, SECTIONS
from . import lists
from .lists import selection_candidates
from .sets import components, name_of, pairs
from .triage import Likeness, editorial, editorial_priority

#: Fixed values of the selection.
SCAN, KEEP, OF_A_SECTION, LEAST_SCORE, SURE_SCORE, CREDIBLE = 220, 6, 2, 70, 92, 3
NEAR_SECONDS = 18 * 3600
PICKED = "run {run}, id long, place int, section string, priority double, cluster_size long"
CLUSTERS = "run {run}, first int, id long, section string, priority double, standing int, eligible boolean, top double, covered boolean, cluster_size long"


def _clusters(rows: pd.DataFrame) -> pd.DataFrame:
    """Clusters of one component's rows, in order: a row joins, of those whose representative it is the same event as, the cluster
    with its most similar member."""
    rows = rows.sort_values("place").reset_index(drop=True)
    like, cluster, lead = Likeness(), [], []
    second, section, priority = (rows[c].tolist() for c in ("second", "section", "priority"))
    for i, key in enumerate(rows["key"]):
        near = like.add(frozenset(key.split(" ")))
        best: dict[int, float] = {}
        for j, (score, _) in near.items():
            best[cluster[j]] = max(best.get(cluster[j], 0.0), score)

        def same(c: int, i: int = i, near: dict = near) -> bool:
            score, both = near.get(lead[c], (0.0, 0))
            close = abs(second[lead[c]] - second[i]) <= NEAR_SECONDS
            return score >= 0.72 or (close and (score >= 0.52 or (section[i] is not None and section[i] == section[lead[c]] and both >= 3)))

        c = min((c for c in best if same(c)), key=lambda c: (-best[c], c), default=len(lead))
        if c == len(lead):
            lead.append(i)
        elif priority[i] > priority[lead[c]]:
            lead[c] = i
        cluster.append(c)
    whole = rows.groupby(cluster).agg(first=("place", "min"), top=("score", "max"), covered=("covered", "any"), cluster_size=("size", "sum"))
    return rows.loc[lead, ["run", "id", "section", "priority", "standing", "eligible"]].reset_index(drop=True).join(whole.reset_index(drop=True))[[x.split(" ")[0] for x in CLUSTERS.split(", ")]]


def event_clusters(items: DataFrame) -> DataFrame:
    """The clusters of each run's items (run, id, place, title, published, section, score, priority, standing, eligible, covered, size): the
    representative's columns, the highest score, whether any is covered, the summed size, and `first`, the place of its first row.

    Rows that are the same event share at least 0.52 / 1.35 of the smaller title's words, or three: what doesn't hang together by
    that is folded apart, so a task holds one component, never a run.
    """
    words = F.array_distinct(S.event_words(F.col("title")))
    x = items.select("run", "id", "place", "score", "priority", "standing", "eligible", "covered", "section", "size", name_of(words).alias("key"), seconds(F.col("published")).alias("second"))
    named = x.where("key <> ''")
    sets = named.select("run", "key").distinct().withColumn("words", F.split("key", " "))
    roots = components(pairs(sets, sets, 0.52 / 1.35, common=3).where("a < b"))
    held = named.join(roots, ["run", "key"], "left").withColumn("root", F.coalesce("root", "key"))
    run = dict(x.dtypes)["run"]
    found = held.groupBy("run", "root").applyInPandas(_clusters, CLUSTERS.format(run=run))
    alone = x.where("key is null or key = ''").select("run", F.col("place").alias("first"), "id", "section", "priority", "standing", "eligible", F.col("score").alias("top"), "covered", F.col("size").alias("cluster_size"))
    return found.unionByName(alone)


def _pick(rows: pd.DataFrame) -> pd.DataFrame:
    """The picks of a run, from each section's best clusters and the number that each section has."""
    rows = rows.sort_values(["priority", "first"], ascending=[False, True]).reset_index(drop=True)
    left = rows.groupby("section")["many"].first().to_dict()
    taken = dict.fromkeys(left, 0)
    picks: list[int] = []
    for i, section in enumerate(rows["section"]):
        others = sum(n for s, n in left.items() if s != section)
        if len(picks) < KEEP and (taken[section] < OF_A_SECTION or not others):
            picks.append(i)
            taken[section] += 1
            left[section] -= 1
    out = rows.loc[picks]
    return out.assign(place=np.arange(1, len(out) + 1, dtype=np.int32))[["run", "id", "place", "section", "priority", "cluster_size"]]


def picked(items: DataFrame, most: int | None = SCAN) -> DataFrame:
    """The clusters to research of each `run`, best first, at most KEEP.

    items: run, id, title, published, section, score, attention, priority, standing, eligible, covered, local_size (the items
    that triage found alike; a cluster's size is their sum). A run's best `most` items are looked at, all if that is
    None. A null section counts as the default one in the pick, and as none in clusters; a null title shares nothing, a null date
    is near to none. Of a section only the KEEP best clusters can be picked, so a task gets these.
    """
    best = Window.partitionBy("run").orderBy(F.desc("score"), F.desc_nulls_last("attention"), F.desc_nulls_last("published"), F.desc("id"))
    x = items.withColumn("place", F.row_number().over(best)).where(F.lit(True) if most is None else F.col("place") <= most)
    size = F.greatest(F.lit(1), F.coalesce("local_size", F.lit(1))).cast("long")
    columns = ["run", "id", "place", "title", "published", "score", "priority", "standing", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("eligible", "covered")]]
    clusters = event_clusters(x.select(*columns, "section", size.alias("size")))
    fine = clusters.where((~F.col("covered")) & F.col("eligible") & (F.col("top") >= LEAST_SCORE) & ((F.col("standing") >= CREDIBLE) | (F.col("top") >= SURE_SCORE)))
    own = Window.partitionBy("run", "section")
    ranked = fine.withColumn("section", F.coalesce("section", F.lit(DEFAULT_SECTION))).withColumns({"many": F.count("*").over(own), "rank": F.row_number().over(own.orderBy(F.desc("priority"), "first"))})
    return ranked.where(F.col("rank") <= KEEP).groupBy("run").applyInPandas(_pick, PICKED.format(run=dict(items.dtypes)["run"]))


def diversified_pick(spark: SparkSession, d: str) -> DataFrame:
    """One pick a day; every seventh item has an article."""
    x = radar(spark, d)
    text = S.joined(F.col("title"), F.lit(None).cast("string"))
    section = F.get(F.array(*map(F.lit, SECTIONS)), (F.col("user_id") % 3).cast("int"))
    own = with_latest(x, "published").select(
        F.to_date("published").alias("run"), "id", "title", "published", section.alias("section"), "score", "attention", S.selection_rank(F.col("source_kind"), F.col("source_domain")).alias("standing"),
        S.audience(text, F.col("candidate_type"))["eligible"].alias("eligible"), (F.col("id") % 7 == 0).alias("covered"), (F.col("k") % 4).alias("local_size"),
    )
    return picked(own.join(editorial_priority(spark, d).select("id", F.col("editorial_priority").alias("priority")), "id"))


def scoring_round(spark: SparkSession, d: str) -> DataFrame:
    """The selection of every run: its candidates (selection_candidates), their clusters, and the picks with rank, score, size and event key.
    As every event has an article by its number, only pinned live ones cover a story here."""
    pinned = articles(spark, d).where("status = 'live' and pinned").select("id", F.lit(True).alias("covered"))
    found = selection_candidates(spark, d).select("id", "has_trusted_source").join(pinned, "id", "left")
    x = with_latest(lists.items(spark, d), "published").join(found, "id")
    own = S.selection_rank(F.col("source_kind"), F.col("source_domain"))
    standing = F.when(F.lower("source_kind").contains("official"), own).when(F.col("has_trusted_source"), 5).otherwise(own)
    section = F.get(F.array(*map(F.lit, SECTIONS)), (F.col("user_id") % 3).cast("int"))
    rows = x.withColumns({"section": section, "standing": standing, "eligible": S.audience(S.joined(F.col("title"), F.lit(None).cast("string")), F.col("candidate_type"))["eligible"], "score": F.col("ai_score"), "priority": editorial(standing)})
    rows = rows.withColumn("local_size", F.col("cluster_size"))
    picks = picked(rows.select("run", "id", "title", "published", "section", "score", "attention", "priority", "standing", "eligible", "covered", "local_size"), most=None)
    keys = x.select("id", S.event_key(F.col("event_key"), F.col("title"), F.col("published")).alias("event_key"), F.col("title").alias("event_title"))
    return picks.join(keys, "id").select("run", "id", F.col("place").alias("rank"), F.round("priority", 1).alias("priority"), "cluster_size", "event_key", "event_title")


def event_group_keys(spark: SparkSession, d: str) -> DataFrame:
    """Items per event key, where every third item has a key from triage."""
    x = radar(spark, d)
    known = F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")))
    return x.groupBy(S.event_key(known, F.col("title"), F.col("published")).alias("event_key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
