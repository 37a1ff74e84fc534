import datetime as dt
import random

from pyspark.sql import functions as F

from pressloom.functions import scoring as S
from pressloom.operators import triage

DAY = dt.datetime(2024, 5, 1, 12)


def test_relevance_and_audience(spark):
    rows = [
        ("Nvidia profit surges to record", "Local Times", True, True), ("Økonomien og markedet bremser", "ECB", True, False), ("Økonomien bremser", "ECB", False, False), ("Investor i markedet", "ECB", True, False),
        ("Fotball: landslaget vant", "CNBC", False, False), ("Norges Bank hever renten", None, True, True), ("", "CNBC", False, False), (None, "E24 – Aksjetips", False, False),
        ("Hva skjer?", "E24 – Aksjetips", True, False), ("Oslo Børs: aksjer og  utbytte", "x", True, False), ("Best stocks to buy now: Apple earnings", "x", True, False),
    ]
    df = spark.createDataFrame(rows, "title string, source string, relevant boolean, eligible boolean")
    text = S.joined(F.col("title"), F.lit(None).cast("string"))
    judged = triage.judged(df.withColumnRenamed("relevant", "wanted").withColumnRenamed("source", "source_name"))
    got = judged.select("title", F.col("wanted").alias("relevant"), F.col("relevant").alias("r"), "eligible", S.audience(text, F.lit(None).cast("string"))["eligible"].alias("e")).collect()
    assert [(r.title, r.r, r.e) for r in got] == [(r.title, r.relevant, r.eligible) for r in got]


def plain_clusters(rows):
    """Brute force: rows (words, second, value) in order; the cluster of each and the clusters' leads."""
    clusters = []
    for i, (words, second, value) in enumerate(rows):
        best, top = None, 0.0
        for c in clusters:
            for j in c["rows"]:
                a, b = set(words), set(rows[j][0])
                both = len(a & b)
                score = max(both / min(len(a), len(b)), 1.35 * both / len(a | b)) if a and b else 0.0
                if score > top:
                    best, top = c, score
        if best and (top >= 0.7 or (top >= 0.52 and abs(second - rows[best["lead"]][1]) <= 86400)):
            best["rows"].append(i)
            if value > rows[best["lead"]][2]:
                best["lead"] = i
        else:
            clusters.append({"rows": [i], "lead": i})
    return clusters


def items(spark):
    parts = ["Equinor", "raises", "dividend", "record", "profit", "oil price", "falls", "Nvidia", "earnings", "guidance", "shares jump", "Norges Bank", "styringsrente"]
    rows = [(run, i, " ".join(parts[(i * a + i // 3) % len(parts)] for a in (1, 2, 3, 5)) if i % 17 else None, DAY + dt.timedelta(hours=(i * 7) % 60), ["a.com", "www.b.no", None][i % 3], "rss", "E24") for run in (1, 2) for i in range(60 * run)]
    schema = "run int, id long, title string, published timestamp_ntz, source_domain string, source_kind string, source_name string"
    return spark.createDataFrame(rows, schema).withColumn("as_of", F.lit(DAY + dt.timedelta(hours=60)).cast("timestamp_ntz"))


def test_labels_equal_brute_force(spark):
    df = items(spark)
    got = {(r.run, r.id): r for r in triage.labelled(df, keep=5).collect()}
    assert len(got) == 180
    scored = triage.triaged(df).withColumn("words", S.triage_words(F.col("title"))).collect()
    for run in (1, 2):
        rows = sorted((r for r in scored if r.run == run), key=lambda r: (r.published, r.id), reverse=True)
        assert {r.id for r in rows if r.dropped} == {i for (n, i), r in got.items() if n == run and r.status == "noise"}
        rows = [r for r in rows if not r.dropped]
        found = plain_clusters([(r.words, r.published.timestamp(), r.priority + 1.4 * r.rank) for r in rows])
        assert any(len(c["rows"]) > 1 for c in found)
        for c in found:
            mine = [rows[j] for j in c["rows"]]
            domains = {(r.source_domain or "").removeprefix("www.") for r in mine} - {""}
            c["top"] = min(100, max(r.priority for r in mine) + min(16, 3 * (len(mine) - 1)) + min(10, 2 * max(0, len(domains) - 1)))
        for place, c in enumerate(sorted(found, key=lambda c: -c["top"])):
            for j in c["rows"]:
                r = got[run, rows[j].id]
                want = ("candidate" if place < 5 else "overflow") if j == c["lead"] else "duplicate"
                assert (r.status, r.cluster_size, r.representative_id) == (want, len(c["rows"]), rows[c["lead"]].id)
                assert r.priority == (c["top"] if j == c["lead"] else rows[j].priority)


def test_no_limit_and_hot_titles(spark):
    """Clusters of runs above the scan limit, half of all rows copies of few titles, equal the whole fold."""
    parts = ["equinor", "dividend", "record", "profit", "oil", "price", "falls", "nvidia", "earnings", "norges", "bank", "salmon", "strike"]
    rng, rows = random.Random(4), []
    for i in range(900):
        title = rng.choice(["equinor dividend record", "nvidia earnings falls sharply today"]) if i % 2 else " ".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))
        rows.append((1 + i % 2 * (i > 600), i, title, DAY + dt.timedelta(minutes=rng.randrange(5000)), "a.com", rng.randint(1, 6), rng.randint(0, 100), i))
    df = spark.createDataFrame(rows, "run int, id long, title string, published timestamp_ntz, source_domain string, rank int, priority long, place int")
    got = triage.clustered(df).collect()
    assert len(got) == 900
    for run in (1, 2):
        mine = sorted((r for r in got if r.run == run), key=lambda r: r.place)
        found = plain_clusters([(r.words, r.second, r.priority + 1.4 * r.rank) for r in mine])
        want = {mine[j].id: (mine[c["rows"][0]].place, j == c["lead"]) for c in found for j in c["rows"]}
        assert {r.id: (r.cluster, r.leads) for r in mine} == want


def test_no_window_holds_a_run(spark):
    """Without a limit of rows, places come from sorted ranges, and only the best clusters of a run meet in one window."""
    df = items(spark)
    rows = df.unionByName(df.where("id % 9 = 0").withColumns({"id": F.col("id") + 1000, "published": F.lit(None).cast("timestamp_ntz")}))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = triage.labelled(rows, most=None, keep=5)
        plan = [x.strip(" :+-") for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
        windows = [i for i, x in enumerate(plan) if x.startswith("Window [")]
        assert windows and all("WindowGroupLimit" in plan[i + 1] for i in windows)
        got = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 201 and got == sorted(map(tuple, triage.labelled(rows, most=10**6, keep=5).collect()))


def test_no_rows(spark):
    assert triage.labelled(items(spark).where("false")).count() == 0


def test_triage_run_changes_what_it_should(spark):
    df = items(spark).where("run = 2").drop("run").withColumns({
        "discovered": F.col("published"), "ai_score": F.when(F.col("id") % 5 == 0, F.lit(50.0)), "model": F.when(F.col("id") % 5 == 0, "m"), "triage": F.when(F.col("id") % 2 == 0, "candidate").otherwise("noise"), "priority": F.lit(7).cast("long"), "local_key": F.lit("old"),
        "cluster_size": F.lit(9).cast("long"), "representative": F.lit(-1).cast("long"), "attempts": F.lit(3), "retry_after": F.col("published"), "triaged_at": F.lit(None).cast("timestamp_ntz"),
    })
    out = {r.id: r for r in triage.triage_run(df, "m", keep=5).collect()}
    edge = DAY + dt.timedelta(hours=60 - triage.WINDOW_HOURS)
    fresh = items(spark).where("run = 2").where((F.col("published") >= F.lit(edge)) & F.expr("id % 5 <> 0"))
    want = {r.id: r for r in triage.labelled(fresh, keep=5).collect()}
    assert len(out) == 120 and 20 < len(want) < 100
    for i, r in out.items():
        if i in want:
            w = want[i]
            assert (r.triage, r.priority, r.local_key, r.cluster_size, r.representative, r.attempts, r.retry_after) == (w.status, w.priority, w.event_key, w.cluster_size, w.representative_id, 0, None) and r.triaged_at == r.as_of
        else:
            old = r.published < edge and i % 2 == 0
            assert (r.triage, r.priority, r.local_key, r.attempts, r.triaged_at) == ("expired" if old else "candidate" if i % 2 == 0 else "noise", 7, "old", 3, None)
