"""Thinning against the ordered fold: ties, hot keys, gaps, nulls."""

import datetime as dt
import random

import pytest

from pressloom.operators import thinning
from pressloom.streaming import live

SCHEMA = "id long, ts timestamp, event_key string"
START = dt.datetime(2024, 5, 1)


def fold(rows, hours):
    kept, last = [], {}
    for i, ts, key in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        if key is None or key not in last or ts - last[key] >= dt.timedelta(hours=hours):
            kept.append(i)
            last[key] = ts
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_fold(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(400):
        minutes = rng.choice([rng.randrange(0, 30_000), 480 * rng.randrange(0, 40), rng.randrange(0, 300)])
        rows.append((i, START + dt.timedelta(minutes=minutes), rng.choice(["hot", "hot", "hot", f"k{i % 7}", None])))
    rows += [(1000, None, "hot"), (1001, None, None)]
    got = sorted(r.id for r in thinning.thinned(spark.createDataFrame(rows, SCHEMA), 8).collect())
    assert got == fold(rows, 8) and len(got) < 300


def test_edges(spark):
    assert thinning.thinned(spark.createDataFrame([], SCHEMA), 8).count() == 0
    twice = [(5, START, "a"), (5, START, "a"), (4, START + dt.timedelta(hours=8), "a"), (3, START + dt.timedelta(hours=8), "a")]
    assert sorted(r.id for r in thinning.thinned(spark.createDataFrame(twice, SCHEMA), 8).collect()) == [3, 5, 5]


def test_late_rows_look_both_ways(spark):
    """A row that comes late isn't shown close to one that is shown already, be it earlier or later."""
    at = lambda h: START + dt.timedelta(hours=h)
    shown = spark.createDataFrame([(1, at(8), "a"), (2, at(40), "a")], SCHEMA)
    batch = spark.createDataFrame([(3, at(5), "a"), (4, at(16), "a"), (5, at(20), "a"), (6, at(33), "a"), (7, at(0), "a"), (8, at(5), "b")], SCHEMA)
    assert sorted(r.id for r in live.first_of_event(shown, batch).collect()) == [4, 7, 8]


def test_many_rows_of_a_span_gaps_and_times_before_1970(spark):
    """Thousands of rows in one span are read once each, and blocks are entered behind gaps of any length."""
    rng, start = random.Random(5), dt.datetime(1969, 12, 20)
    at = [0, *(rng.randrange(0, 24 * 60 * 60) for _ in range(3000)), *(rng.randrange(0, 13 * 86_400) for _ in range(300)), *(rng.randrange(20 * 86_400, 24 * 86_400) for _ in range(300)), 29 * 86_400]
    rows = [(i, start + dt.timedelta(seconds=s), rng.choice(["a", "b"])) for i, s in enumerate(at)]
    kept = thinning.thinned(spark.createDataFrame(rows, SCHEMA), 8)
    assert sorted(r.id for r in kept.collect()) == fold(rows, 8)
    times = spark.createDataFrame([("a", 1), ("a", 9)], "key string, t long")
    # A frame that ends with its group is read again for every row: time would grow with the square.
    assert "unboundedfollowing" not in thinning.following(times, 4)._jdf.queryExecution().optimizedPlan().toString().lower()
