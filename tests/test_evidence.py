"""Sources of events are ranked and chosen once for each event, however many items it has."""

import datetime as dt

from pyspark.sql import functions as F

from pressloom.operators import evidence

COLUMNS = "id long, event_key string, url string, title string, summary string, score double, published timestamp_ntz"
TEXT = "A summary that is long enough to count as a text"
PAGES = ["https://www.reuters.com/a", "https://dn.no/b", "https://www.ssb.no/c", "https://www.sec.gov/d", "https://blog.example.com/e"]


def frame(spark, copies):
    rows = [(100 * n + i, f"e{n % 3}" if n < 9 else None, u, "Title", TEXT, float(i), dt.datetime(2024, 5, 1)) for n in range(copies) for i, u in enumerate(PAGES)]
    return spark.createDataFrame(rows, COLUMNS)


def test_an_event_hands_its_sources_to_each_item(spark):
    x = frame(spark, 12)
    held = evidence.leading(x)
    assert held.count() == len({(r.event_key, r.url) for r in held.collect()}) <= 3 * 4
    want = {(r.id, s.rank, s.url) for r in x.where("event_key is not null").collect() for s in held.collect() if s.event_key == r.event_key}
    got = [(r.item, r["rank"], r.url) for r in evidence.mates(x).collect()]
    assert len(got) == len(want) and set(got) == want


def test_supporting_is_decided_for_events(spark):
    x = frame(spark, 9)
    held = evidence.leading(x)
    texts = spark.createDataFrame([(u, 30 if "dn.no" in u else 90) for u in PAGES], "url string, chars int")
    got = evidence.supporting(held, held.where("rank = 1"), texts)
    for event in ("e0", "e1", "e2"):
        urls = [r.url for r in sorted(held.where(F.col("event_key") == event).collect(), key=lambda r: r["rank"])]
        kept = [u for u in urls[1:4] if "dn.no" not in u][:2]
        assert [r.url for r in got.where(F.col("event_key") == event).orderBy("place").collect()] == kept


def test_a_search_reads_each_text_once(spark):
    items = spark.createDataFrame([(1, "Statistics of the quarter", TEXT)], "id long, title string, summary string")
    found = spark.createDataFrame([(1, "https://www.ssb.no/c", "Statistics of the quarter")], "id long, url string, hit_title string")
    got = evidence.search_scores(items, found)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9æøå]+") <= 4
    assert [(r.id, r.url, r.score) for r in got.collect()] == [(1, "https://www.ssb.no/c", 2.6)]
