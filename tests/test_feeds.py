import datetime as dt

from pyspark.sql import functions as F

from pressloom.functions.urls import canonical, cleaned, role
from pressloom.sources import feeds as S

RSS = """<rss><channel><title>Desk</title>
<item><title><![CDATA[Rates &amp; <b>bonds</b>]]></title><link>https://www.a.no/x?utm_source=q&amp;id=1#top</link><description>&lt;p&gt;One&#233; &#x20AC;5&lt;/p&gt;</description><pubDate>Wed, 01 May 2024 12:30:00 +0200</pubDate><source url="https://www.b.no/feed">B  News</source></item>
<item><title>No date</title><guid>https://c.no/2</guid></item>
<item><title></title><link>https://c.no/3</link></item>
<item><title>No link</title></item>
<item><title>Old</title><link>https://c.no/4</link><pubDate>1 Apr 2024 08:00:00 GMT</pubDate></item>
<ITEM><title>Bad date</title><link>https://c.no/5</link><pubDate>soon</pubDate></ITEM>
</channel></rss>"""
ATOM = """<feed><entry><title type="html">Nvidia profit surges to record</title><link rel="alternate" href="https://d.com/a"/><summary>s</summary><updated>2024-05-01T09:00:00Z</updated></entry></feed>"""


def rows(spark):
    feeds = [("Desk", "rss", None, RSS), ("CNBC", None, 48, ATOM), ("Empty", "rss", None, ""), ("Null", "rss", None, None)]
    return spark.createDataFrame(feeds, "name string, kind string, max_age_hours int, body string").withColumn("as_of", F.lit("2024-05-01 20:00:00").cast("timestamp"))


def test_entries(spark):
    got = {r.title: r for r in S.entries(rows(spark)).withColumn("second", F.unix_timestamp("published")).collect()}
    assert set(got) == {"Rates & bonds", "No date", "Bad date", "Nvidia profit surges to record"}
    r = got["Rates & bonds"]
    assert (r.url, r.source_name, r.source_domain) == ("https://www.a.no/x?id=1", "Desk · B News", "b.no")
    assert r.second == dt.datetime(2024, 5, 1, 10, 30, tzinfo=dt.UTC).timestamp()
    assert "Oneé €5" in r.summary
    assert (got["No date"].url, got["No date"].published, got["No date"].source_domain) == ("https://c.no/2", None, "c.no")
    assert got["Bad date"].published is None
    r = got["Nvidia profit surges to record"]
    assert (r.url, r.source_kind, r.second) == ("https://d.com/a", "rss", dt.datetime(2024, 5, 1, 9, tzinfo=dt.UTC).timestamp())


def test_relevant(spark):
    assert [r.title for r in S.relevant_entries(rows(spark)).where("name = 'CNBC'").collect()] == ["Nvidia profit surges to record"]


def test_references(spark):
    texts = ["&#65;b", "&#x1F600;", "&#;", "a&#99999999;", "&#55296;", "&amp;#65;", "", None, "plain"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.decoded(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == ["Ab", "😀", "&#;", "a&#99999999;", "&#55296;", "A", "", None, "plain"]


def test_an_address_is_made_once(spark):
    """What makes an address isn't computed again for each of its parts."""
    made = F.concat(F.col("url"), F.lit("#MADE"))
    x = spark.createDataFrame([(" https://a.no/x?utm_source=1&b=2",), ("no url ",), (None,)], "url string").select("url", cleaned(made).alias("c"), canonical(made).alias("k"), role(made, F.col("url")).alias("r"))
    assert x._jdf.queryExecution().optimizedPlan().toString().count("MADE") <= 3
    assert [(r.c, r.k, r.r.role) for r in x.collect()] == [("https://a.no/x?b=2", "https://a.no/x?b=2", "unknown"), ("no url #MADE", None, "unknown"), (None, None, "unknown")]
