"""Readers on literal bodies, with their edge cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pressloom.functions import urls
from pressloom.functions.text import entities, html_plain
from pressloom.operators.dates import publication
from pressloom.sources import parsers
from pressloom.sources.feeds import decoded

URL = "https://www.norges-bank.no/aktuelt/nyheter/Pressemeldinger/2024/2024-05-03-rente/"


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column).first()[0]


def test_references(spark):
    got = lambda f, t: value(spark, f(F.col("t")), t=t)
    assert got(decoded, "a &AMP;lt; b &amp;#x41; &lt;p&GT; <![CDATA[x &amp; y]]> &#160;|") == "a < b A <p> x & y  |"
    assert got(entities, "&amp;lt; &Oslash;&oslash; &#229; &#x1F600; &unknown; &#xD800; &#0; & x; &") == "&lt; Øø å 😀 &unknown; &#xD800; &#0; & x; &"
    assert got(html_plain, "<p>A&nbsp;b<script>x</script>\n <b>c</b></p>") == "A b c"


def test_index(spark):
    body = json.dumps({"articles": [
        {"url": "https://a.com/x?utm_source=1&b=2#y", "title": "One &amp; <b>two</b>", "seendate": "20240503T101500Z", "domain": "a.com", "language": "English", "sourcecountry": "US"},
        {"url": "https://www.b.no/y", "title": "No domain", "seendate": "202405031015"}, {"url": "", "title": "none"}, {"url": "https://c.no", "title": " "},
    ]})
    rows = parsers.index_articles(spark.createDataFrame([("N", body), ("M", "not json"), ("O", '{"articles": null}'), ("P", None)], "name string, body string")).collect()
    assert [(r.source_name, r.source_domain, r.title, r.summary, r.url) for r in rows] == [("N · a.com", "a.com", "One & two", "US · English", "https://a.com/x?b=2"), ("N", "b.no", "No domain", "", "https://www.b.no/y")]
    assert {r.published for r in rows} == {dt.datetime(2024, 5, 3, 10, 15)}


def test_series(spark):
    body = lambda obs: json.dumps({"data": {"dataSets": [{"series": {"0:0": {"observations": obs}, "0:1": {"observations": {"0": ["9"]}}}}]}})
    rows = spark.createDataFrame([("USD", body({"10": ["11.0"], "9": ["10.0"], "2": ["x"], "11": [None]})), ("SEK", body({"0": ["0"], "1": ["105.5"]})), ("EUR", body({"0": [11.5, "note"]})), ("GBP", body({})), ("CHF", "{}"), ("DKK", None)], "currency string, body string")
    got = {r.symbol: (r.value, round(r.change_pct, 6)) for r in parsers.exchange_rates(rows).collect()}
    assert got == {"USDNOK": (11.0, 10.0), "SEKNOK": (1.055, 0.0), "EURNOK": (11.5, 0.0)}
    page = "<style>5 %</style><p>Mål 2 %. Styringsrenten er n&aring; 4,25 % fra mai</p>"
    x = spark.createDataFrame([(1, page, body({"0": ["4.5"]})), (2, "<p>ingen</p>", body({"1": ["4.5"]})), (3, None, "{}")], "id int, page string, api string")
    assert sorted((r.id, r.rate, r.api_rate, r.source) for r in parsers.policy_rate(x).collect()) == [(1, 4.25, 4.5, "official-page"), (2, 4.5, 4.5, "api")]


def test_quotes(spark):
    chart = lambda **meta: json.dumps({"chart": {"result": [{"meta": meta}]}})
    rows = [("A", chart(regularMarketPrice=110, chartPreviousClose=100, previousClose=1)), ("B", chart(regularMarketPrice=5, previousClose=0)), ("C", chart(previousClose=3)), ("D", '{"chart": {"result": null}}'), ("E", "<html>")]
    got = {r.symbol: (r.value, r.change_pct and round(r.change_pct, 6), r.error) for r in parsers.quotes(spark.createDataFrame(rows, "symbol string, body string")).collect()}
    assert got == {"A": (110.0, 10.0, None), "B": (5.0, 0.0, None), "C": (None, None, "no valid price"), "D": (None, None, "no market data"), "E": (None, None, "no market data")}


def test_table(spark):
    row = lambda when, who, what, href="/en/company-news/1": f"<tr class='x'><td>{when}</td><td>{who}</td><td><a href='{href}'>{what}</a></td><td>Energy</td><td>Half &amp; year</td></tr>"
    body = "<table><tr><th>no</th></tr>" + row("3 MAY 2024 08:05 CEST", "A <b>ASA</b>", "Result") + row("03 Jan 2024 08:05 CET", "B", "More", "https://x.no/y") + row("soon", "C", "x") + row("3 Jan 2024 08:05 CET", "", "x") + "<tr><td>3</td></tr></table>"
    got = parsers.news_table(spark.createDataFrame([(1, body), (2, ""), (3, None)], "id int, body string")).orderBy("place").collect()
    assert [(r.company, r.title, r.category, r.url, r.published) for r in got] == [
        ("A ASA", "Result", "Half & year", "https://live.euronext.com/en/company-news/1", dt.datetime(2024, 5, 3, 6, 5)), ("B", "More", "Half & year", "https://x.no/y", dt.datetime(2024, 1, 3, 7, 5)),
    ]
    assert got[0].body == "Selskap: A ASA\nKategori: Half & year\nSektor: Energy\nTittel: Result" and len(got[0].external_id) == 40


def page(title="Styringsrenten settes opp til 4,5 prosent", text="Komiteen besluttet å sette styringsrenten opp fra 4,25 til 4,5 prosent.", meta=""):
    return f"<html><head>{meta}</head><h1>Meny</h1><h1 class='a'>{title}</h1><p>{text}</p><p>Kontakt: x</p></html>"


DECISIONS = [
    (page(), {}, None, (4.5, 4.25, "up")),
    (page("Styringsrenten senkes til 4 prosent", "Komiteen besluttet å sette styringsrenten ned fra 4,25 til 4 prosent."), {}, None, (4.0, 4.25, "down")),
    (page("Styringsrenten holdes uendret på 4,25 prosent", "Komiteen besluttet å holde styringsrenten uendret på 4,25 prosent."), {}, None, (4.25, None, "unchanged")),
    (page(), {"url": URL.replace("https", "http")}, "UNTRUSTED_DECISION_URL", None),
    (page() + page(), {}, "AMBIGUOUS_RATE_HEADING", None),
    (page("Styringsrenten diskuteres"), {}, "AMBIGUOUS_RATE_DECISION", None),
    (page(), {"published": None}, "PUBLICATION_TIME_MISSING", None),
    (page(meta='<meta property="article:published_time" content="2024-05-03T08:02:00Z">'), {}, "PUBLICATION_TIME_CONFLICT", None),
    (page(), {"as_of": dt.datetime(2024, 5, 3, 10, 1)}, "DECISION_NOT_FRESH", None),
    (page(), {"url": URL.replace("05-03", "05-02")}, "DECISION_DATE_CONFLICT", None),
    (page(text="Renten er 4,5."), {}, "DECISION_NOT_CONFIRMED", None),
    (page(text="Komiteen besluttet å sette styringsrenten opp fra 4,25 til 4,75 prosent."), {}, "RATE_TEXT_CONFLICT", None),
    (page(text="Komiteen besluttet å sette styringsrenten opp fra 4,75 til 4,5 prosent."), {}, "RATE_DIRECTION_CONFLICT", None),
    (page("Styringsrenten holdes uendret på 4,25 prosent", "Komiteen besluttet styringsrenten."), {}, "UNCHANGED_RATE_NOT_CONFIRMED", None),
    (page(meta='<meta name="datePublished" content="2024-05-03T10:00:30+0200">'), {"published": None}, None, (4.5, 4.25, "up")),
]


def test_decisions(spark):
    base = {"url": URL, "published": dt.datetime(2024, 5, 3, 8, 0), "as_of": dt.datetime(2024, 5, 3, 8, 30)}
    rows = [(i, *(base | given).values(), body) for i, (body, given, _, _) in enumerate(DECISIONS)]
    got = {r.id: r for r in parsers.decisions(spark.createDataFrame(rows, "id int, url string, published timestamp, as_of timestamp, body string")).collect()}
    for i, (_, _, code, want) in enumerate(DECISIONS):
        assert got[i].reject == code, i
        assert (None if code else (got[i].rate, got[i].previous, got[i].direction)) == want
    assert got[0].headline == "Norges Bank hever styringsrenten til 4,5 prosent" and got[0].fact == "Norges Bank hever styringsrenten fra 4,25 til 4,5 prosent."
    assert got[2].fact == "Norges Bank holder styringsrenten uendret på 4,25 prosent."
    item = lambda u, d: f"<item><title>x</title><link><![CDATA[{u}]]></link><pubDate>{d}</pubDate></item>"
    feed = "<rss>" + item(URL, "Fri, 03 May 2024 10:00:00 +0200") + item(URL.replace("-03", "-04"), "Fri, 03 May 2024 08:20:00 GMT") + item(URL + "?a", "Fri, 03 May 2024 08:20:00 GMT") + item(URL, "Fri, 03 May 2024 05:00:00 GMT") + "</rss>"
    links = parsers.decision_links(spark.createDataFrame([(dt.datetime(2024, 5, 3, 8, 30), feed)], "as_of timestamp, body string")).collect()
    assert [r.url for r in links] == [URL.replace("-03", "-04"), URL]


@pytest.mark.parametrize(("html", "want"), [
    ('<meta property="article:published_time" content="2024-05-03T10:00:00+02:00">', "2024-05-03 08:00:00"),
    ("<META content='2024-05-03T08:00Z' itemprop='datePublished'>", "2024-05-03 08:00:00"),
    ('<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "NewsArticle"], "datePublished": "2024-05-03T08:00:00Z"}, [{"@type": "Person"}]]}</script>', "2024-05-03 08:00:00"),
    ('<meta name="datePublished" content="2024-05-03T08:00:00Z"><script type="application/ld+json">{"@type": "Article", "datePublished": "2024-05-03T09:00:00Z"}</script>', None),
    ('<meta name="datePublished" content="2024-02-31T08:00:00Z">', None), ('<meta name="date" content="2024-05-03T08:00:00Z"><time>2024-05-03T08:00:00Z</time>', None),
    ('<meta name="datePublished" content="2024-05-03">', None), ('<script type="application/ld+json">{broken</script>', None), ("", None), (None, None),
])
def test_publication(spark, html, want):
    got = spark.createDataFrame([(html,)], "h string").select(publication(F.col("h"))["at"]).first()[0]
    assert (got and str(got)) == want


def test_urls(spark):
    say = lambda f, u: spark.createDataFrame([(u,)], "u string").select(f(F.col("u"))).first()[0]
    assert say(urls.canonical, "HTTPS://A.com:443?b=2&utm_x=1&a=1&a=0&c#f") == "https://a.com/?a=1&a=0&b=2&c="
    assert [say(urls.canonical, u) for u in ("ftp://a.com/x", "https://u:p@a.com/", "nothing", None)] == [None] * 4
    assert say(urls.cleaned, "https://a.com/x?ref&b=2&REF=1#f") == "https://a.com/x?b=2" and say(urls.cleaned, "https://a.com/x?b&c=%20") == "https://a.com/x?b&c=%20" and say(urls.cleaned, " x ") == "x"
    assert say(urls.brand, "https://www.vaar-energi.co.no/x") == "co" and say(urls.brand, "https://ir.equinor.com") == "equinor"
    assert [say(urls.is_index, u) for u in ("https://a.no/", "https://a.no/news/", "https://a.no/news/1", "https://a.no/x/index.html", "x", None)] == [True, True, False, True, True, True]
    assert [say(urls.is_public, a) for a in ("8.8.8.8", "10.1.1.1", "172.16.0.1", "172.32.0.1", "100.64.0.1", "198.18.1.1", "256.1.1.1", "1.2.3", "2a00:1450::1", "2001:db8::1", "::1", "::ffff:8.8.8.8")] == [
        True, False, False, True, False, False, False, False, True, False, False, False]
    role = lambda u, t="": tuple(spark.createDataFrame([(u, t)], "u string, t string").select(urls.role(F.col("u"), F.col("t")).alias("r")).first().r)
    assert role("https://www.ssb.no/x") == ("primary", "official") and role("http://www.ssb.no/x")[0] == "unknown" == role("https://ssb.no:444/x")[0]
    assert role("https://www.dn.no/x") == ("trusted_secondary", "high") and role("https://equinor.com/x", "Equinor øker") == ("primary", "corporate_official") and role("https://equinor.com/x", "Equinors") == ("unknown", "unknown")
