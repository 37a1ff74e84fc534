import datetime as dt
import random

from pyspark.sql import functions as F

from pressloom.functions.scoring import event_words
from pressloom.functions import scoring as S
from pressloom.functions import vocabulary as V
from pressloom.operators import lists, selection
from pressloom.operators.gates import SECTIONS
from pressloom.sources.tables import articles

DAY = dt.datetime(2024, 5, 1, 12)
SCHEMA = "run date, id long, title string, published timestamp_ntz, section string, score double, attention long, priority double, standing int, eligible boolean, covered boolean, local_size int"


def items(spark, seed, n=150):
    r = random.Random(seed)
    words = ["equinor", "dividend", "record", "profit", "oil", "falls", "nvidia", "guidance", "shares", "bank", "rente", "salmon", "strike", "merger"]
    rows = [
        (DAY.date() + dt.timedelta(days=run), i, " ".join(r.sample(words, 4)) if i % 13 else None, DAY + dt.timedelta(hours=r.randrange(60)) if i % 11 else None, r.choice(["Aksjer", "Makro", None, "Aksjer"]),
         float(r.randrange(55, 100)), r.choice([1, 2, None]), float(r.randrange(20, 90)), r.randrange(1, 7), r.random() < 0.8, r.random() < 0.1, r.choice([None, 0, 1, 5]))
        for run in (0, 1) for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def likeness(a, b):
    both = len(a & b)
    return (max(both / min(len(a), len(b)), 1.35 * both / len(a | b)), both) if a and b else (0.0, 0)


def plain_pick(rows):
    """Brute force over rows in order of the scan."""
    clusters = []
    for r in rows:
        home, top = None, 0.0
        for c in clusters:
            value = max(likeness(r["words"], m["words"])[0] for m in c["rows"])
            lead = c["lead"]
            s, both = likeness(r["words"], lead["words"])
            near = bool(r["published"] and lead["published"]) and abs((r["published"] - lead["published"]).total_seconds()) <= 18 * 3600
            one = s >= 0.72 or (near and (s >= 0.52 or (r["section"] is not None and r["section"] == lead["section"] and both >= 3)))
            if one and value > top:
                home, top = c, value
        if home is None:
            clusters.append({"rows": [r], "lead": r})
        else:
            home["rows"].append(r)
            home["lead"] = r if r["priority"] > home["lead"]["priority"] else home["lead"]
    left = []
    for c in clusters:
        top = max(m["score"] for m in c["rows"])
        if c["lead"]["eligible"] and not any(m["covered"] for m in c["rows"]) and top >= 70 and (c["lead"]["standing"] >= 3 or top >= 92):
            left.append((c["lead"], c["lead"]["section"] or "Markeder", sum(max(1, m["local_size"] or 1) for m in c["rows"])))
    left.sort(key=lambda x: -x[0]["priority"])
    picks = []
    for x in left:
        if len(picks) == 6:
            break
        if sum(p[1] == x[1] for p in picks) < 2 or all(y in picks or y[1] == x[1] for y in left):
            picks.append(x)
    return [(p[0]["id"], p[1], p[2]) for p in picks]


def test_pick_equals_brute_force(spark):
    for seed in (1, 2, 3):
        df = items(spark, seed)
        rows = [r.asDict() | {"words": set(r.words or ())} for r in df.withColumn("words", event_words(F.col("title"))).collect()]
        got = selection.picked(df).collect()
        for run in {r["run"] for r in rows}:
            mine = [r for r in rows if r["run"] == run]
            mine.sort(key=lambda r: (r["score"], r["attention"] or -1, r["published"] or dt.datetime.min, r["id"]), reverse=True)
            want = plain_pick(mine[:220])
            assert want
            assert [(r.id, r.section, r.cluster_size) for r in sorted((r for r in got if r.run == run), key=lambda r: r.place)] == want


def test_no_limit(spark):
    df = items(spark, 7, n=320)
    rows = [r.asDict() | {"words": set(r.words or ())} for r in df.withColumn("words", event_words(F.col("title"))).collect()]
    got = selection.picked(df, most=None).collect()
    for run in {r["run"] for r in rows}:
        mine = sorted((r for r in rows if r["run"] == run), key=lambda r: (r["score"], r["attention"] or -1, r["published"] or dt.datetime.min, r["id"]), reverse=True)
        assert [(r.id, r.section, r.cluster_size) for r in sorted((r for r in got if r.run == run), key=lambda r: r.place)] == plain_pick(mine)


def test_scoring_round(spark):
    """Candidates, clusters and picks of whole runs over small tables."""
    d = "/root/testdata/sf0.01"
    found = {r.id: r for r in lists.selection_candidates(spark, d).collect()}
    pinned = {r.id for r in articles(spark, d).where("status = 'live' and pinned").collect()}
    x = [r.asDict() | {"words": set(r.words or ())} for r in lists.items(spark, d).withColumn("words", event_words(F.col("title"))).collect() if r.id in found]
    got = selection.scoring_round(spark, d).collect()
    rank = {"global-rss": 4, "rss": 3, "news-aggregator": 1}
    score = {r.id: r.a for r in lists.items(spark, d).select("id", S.audience(S.joined(F.col("title"), F.lit(None).cast("string")), F.col("candidate_type")).alias("a")).collect()}
    latest = max(r.published for r in lists.items(spark, d).select("published").collect())
    for r in x:
        c, domain = found[r["id"]], (r["source_domain"] or "").removeprefix("www.")
        r["standing"] = 6 if "official" in r["source_kind"] else 5 if c.has_trusted_source or domain in V.SELECTION_DOMAINS else rank.get(r["source_kind"], 2)
        age = (latest - r["published"]).total_seconds() / 3600
        r["section"], r["eligible"], r["covered"], r["score"], r["local_size"] = SECTIONS[r["user_id"] % 3], score[r["id"]].eligible, r["id"] in pinned, r["ai_score"], r["cluster_size"]
        r["priority"] = (r["ai_score"] or 0) * 0.35 + r["attention"] * 0.15 + r["numbers"] * 0.10 + score[r["id"]].score * 0.30 + max(0, 10 - age * 0.55) + r["standing"] * 2.8
    wanted = 0
    for run in {r["run"] for r in x}:
        mine = sorted((r for r in x if r["run"] == run), key=lambda r: (r["score"], r["attention"] or -1, r["published"], r["id"]), reverse=True)
        want = plain_pick(mine)
        wanted += len(want)
        assert [(r.id, r.cluster_size) for r in sorted((r for r in got if r.run == run), key=lambda r: r["rank"])] == [(i, n) for i, _, n in want]
    assert wanted and len(got) == wanted


def test_nothing_to_pick(spark):
    assert selection.picked(items(spark, 1).where("false")).count() == 0
    assert selection.picked(items(spark, 1).withColumn("eligible", F.lit(None).cast("boolean"))).count() == 0
