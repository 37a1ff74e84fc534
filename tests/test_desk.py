"""The desk's changes on rows that their guards let through and hold back."""

import datetime as dt

from pyspark.sql import functions as F

from pressloom.operators import desk

NOON = dt.datetime(2024, 5, 3, 12)


def test_guarded(spark):
    rows = [(1, "draft", False, None, None), (2, "live", True, 3, NOON), (3, "archived", False, None, NOON), (4, "draft", False, None, NOON)]
    a = spark.createDataFrame(rows, "id long, status string, pinned boolean, pin_place long, published timestamp_ntz").withColumn("as_of", F.lit(NOON + dt.timedelta(hours=1)).cast("timestamp_ntz"))
    ask = lambda *x: {tuple(r) for r in desk.guarded(a, spark.createDataFrame(list(x), "id long, action string")).collect()}
    assert ask((1, "approve"), (2, "approve"), (4, "approve")) == {(1, "approve", "live", False, None, NOON + dt.timedelta(hours=1)), (4, "approve", "live", False, None, NOON)}
    assert ask((1, "reject"), (3, "reject"), (2, "pin"), (3, "unpin")) == {(1, "reject", "rejected", False, None, None), (2, "pin", "live", True, 1, NOON)}
    assert ask((2, "archive"), (9, "archive")) == {(2, "archive", "archived", False, None, NOON)}
    assert ask((2, "unpin"), (2, None)) == {(2, "unpin", "live", False, None, NOON)}


def test_failed(spark):
    cases = spark.createDataFrame([(1, "writing", 2, "write", "a", NOON, None, None), (2, "writing", 0, "write", None, None, NOON, "old")], "id long, state string, revision long, step string, token string, lease_until timestamp_ntz, retry_after timestamp_ntz, last_error string")
    errors = spark.createDataFrame([(1, "a", "write", "first", NOON), (1, "a", "write", "y" * 900, NOON + dt.timedelta(minutes=1)), (1, "b", "write", "not mine", NOON), (2, None, "write", "no token", NOON)], "id long, token string, step string, message string, at timestamp_ntz")
    after, log = desk.failed(cases, errors)
    got = {r.id: r for r in after.collect()}
    assert (got[1].state, got[1].token, got[1].lease_until, got[1].retry_after, len(got[1].last_error)) == ("failed", None, None, NOON + dt.timedelta(minutes=3), 800)
    assert (got[2].state, got[2].retry_after, got[2].last_error) == ("writing", NOON, "old")
    assert [(r.case_id, r.revision, r.status) for r in log.collect()] == [(1, 2, "failed")]


def test_searches_and_costs(spark):
    items = [(1, "Equinor Equinor raises the dividend and buys more shares in a rival", "It said «we are buying the whole rival company» and \"nothing more is planned for this year\""), (2, "Oil", None), (3, None, None)]
    got = [(r.id, r.place, r.query) for r in desk.searches(spark.createDataFrame(items, "id long, title string, summary string")).orderBy("id", "place").collect()]
    assert got[0] == (1, 0, "equinor raises dividend buys more shares") and [q for _, _, q in got[1:]] == ['"we are buying the whole rival company"', '"nothing more is planned for this year"'] and {i for i, _, _ in got} == {1}
    calls = [(dt.datetime(2024, 5, 3, 9, 59), 100, 200, 999, 10), (dt.datetime(2024, 5, 3, 10), None, None, 300, None), (dt.datetime(2024, 5, 4, 2), 0, 0, 5, 1000)]
    df = spark.createDataFrame(calls, "ts timestamp_ntz, hit long, miss long, prompt long, output long")
    cost = lambda t: [round(r[0] * 1e6, 6) for r in df.select(desk.call_cost(*map(F.col, df.columns), t)).collect()]
    assert cost("radar") == [round(2 * (2.2 + 132 + 19.8), 6), 198.0, 1980.0] and cost("raw") == [round(2 * (0.3 + 30 + 6), 6), 45.0, 600.0]


def test_words_of_a_search_are_made_once(spark):
    x = desk.searches(spark.createDataFrame([(1, "Norway raises rates", None), (2, "Rates", "")], "id long, title string, summary string"))
    assert x._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9æøå]+") == 1
    assert [tuple(r) for r in x.collect()] == [(1, 0, "norway raises rates")]
