"""Sets that share words, their components, and the most similar title in range, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pressloom.operators import evidence, sets

START = dt.datetime(2024, 5, 1)


def some_sets(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400)]
    return sorted({(run, " ".join(sorted(set(rng.choices(words, k=rng.randint(1, 6)))))) for run in (1, 2) for _ in range(n)})


@pytest.mark.parametrize("least,common", [(0.65, None), (0.385, None), (0.385, 3), (0.0, None)])
def test_pairs(spark, least, common):
    left, right = some_sets(1, 60), some_sets(2, 50)
    frame = lambda rows: spark.createDataFrame(rows, "run int, key string").withColumn("words", F.split("key", " "))
    got = sorted((r.run, r.a, r.b, r.both) for r in sets.pairs(frame(left), frame(right), least, common).collect())
    want = []
    for run, a in left:
        for other, b in right:
            v, u = set(a.split()), set(b.split())
            both, small = len(v & u), min(len(v), len(u))
            if run == other and both and (both >= small * least - 1e-9 or (common and both >= common)):
                want.append((run, a, b, both))
    assert got == sorted(want) and want


def test_common_words_bring_nothing_together(spark):
    """Titles that share one very common word make no pair, so they aren't compared either."""
    rows = [(1, f"a{i} b{i} c{i} common") for i in range(300)]
    frame = spark.createDataFrame(rows, "run int, key string").withColumn("words", F.split("key", " "))
    counts = frame.select("run", F.explode("words").alias("w")).groupBy("run", "w").agg(F.count("*").alias("df"))
    asked = sets.asking(frame.withColumn("n", F.size("words")), counts, 0.52)
    assert asked.where("w = 'common'").count() == 0 and asked.count() == 600
    assert sets.pairs(frame, frame, 0.52).where("a < b").count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(1, 2), f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(150)] + [(3, f"c{i:03}", f"c{i + 1:03}") for i in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for run, a, b in links:
        one, two = sorted((find((run, a)), find((run, b))))
        root[two] = one
    got = {(r.run, r.key): r.root for r in sets.components(spark.createDataFrame(links, "run int, a string, b string")).collect()}
    assert {x: got.get(x, x[1]) for x in root} == {x: find(x)[1] for x in root} and len(got) < len(root)
    assert sets.components(spark.createDataFrame([], "run int, a string, b string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_best_titles(spark, seed):
    rng = random.Random(seed)
    parts = ["equinor", "dividend", "record", "profit", "oil", "falls", "the", "bank", "salmon", "strike", "raises", "norges", "hydro", "quota"]
    said = lambda: " ".join(rng.choices(parts, k=rng.randint(0, 6)))
    at = lambda: START + dt.timedelta(hours=rng.randrange(0, 24 * 40))
    items = [(i, said(), at() if i % 19 else None) for i in range(120)]
    raw = [(i, rng.choice(["equinor dividend", said()]), at() if i % 17 else None) for i in range(150)]
    got = {r.id: (r.raw_id, r.score) for r in evidence.best_titles(spark.createDataFrame(items, "id long, title string, published timestamp_ntz"), spark.createDataFrame(raw, "raw_id long, raw_title string, raw_published timestamp_ntz")).collect()}
    bag = lambda t: {w for w in t.split() if w not in evidence.STOP and len(w) >= 3}
    want = {}
    for i, t, p in items:
        found = []
        for j, u, q in raw:
            v, x = bag(t), bag(u)
            if p and q and v & x and dt.timedelta(days=-4) <= q - p <= dt.timedelta(days=2):
                found.append((len(v & x) / min(len(v), len(x)), q, -j))
        if found:
            best = max(found)
            want[i] = (-best[2], round(best[0], 6))
    assert got == want and len(want) > 60
