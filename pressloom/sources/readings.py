"""Queries of the readers: bodies of each kind written from the events, with what goes wrong in them, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entities
from ..operators.gates import review_reasons
from . import parsers
from .tables import pick, table

CURRENCIES = list(parsers.UNITS)
SAID = "Komiteen besluttet å {} styringsrenten {} prosent."
PAGE_URL = "https://www.norges-bank.no/aktuelt/nyheter/Pressemeldinger/"


def _events(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_trunc("second", "ts").alias("ts"), "user_id", "event_type", "value", k.alias("k"), F.to_date("ts").alias("day"))


def _text(*parts: Column | str | int) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _listed(x: DataFrame, by: list[str], one: Column) -> DataFrame:
    """The texts of each group's rows in the order of their ids: a group is one user's day."""
    return x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", one.alias("one")))).alias("rows")).select(*by, F.transform("rows", lambda r: r["one"]).alias("texts"))


def index_read(spark: SparkSession, d: str) -> DataFrame:
    """A JSON index for each user and day."""
    i = F.col("id")
    seen = F.when(i % 3 == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).when(i % 3 == 1, F.date_format("ts", "yyyyMMddHHmm")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    article = F.to_json(F.struct(
        _text("https://www.n", i % 5, ".example.com/a?utm_source=x&id=", i).alias("url"), F.when(i % 11 != 0, _text("Item &amp; <b>", i, "</b>")).otherwise(" ").alias("title"), seen.alias("seendate"),
        F.when(i % 4 != 0, "www.n.example.com").alias("domain"), F.when(i % 2 == 0, "English").otherwise("").alias("language"), F.lit("US").alias("sourcecountry"),
    ))
    name = _text("index ", F.col("user_id"), " ", F.col("day"))
    bodies = _listed(_events(spark, d).withColumn("name", name), ["name"], article).select("name", _text('{"articles": [', F.array_join("texts", ", "), "]}").alias("body"))
    return parsers.index_articles(bodies).select("source_name", "source_kind", "source_domain", "title", "summary", "url", F.unix_timestamp("published").alias("second"), F.col("place").cast("long").alias("place"))


def fx_read(spark: SparkSession, d: str) -> DataFrame:
    """A series for each user and day: its observations come in no order, some are no numbers."""
    i = F.col("id")
    one = F.when(i % 13 == 0, _text('"', i, '": ["x"]')).otherwise(_text('"', i, '": ["', F.floor(F.col("value")).cast("long"), '", "n"]'))
    lists = _listed(_events(spark, d), ["user_id", "day"], one)
    body = _text('{"data": {"dataSets": [{"series": {"0:0": {"observations": {', F.array_join(F.reverse("texts"), ", "), "}}}}]}}")
    bodies = lists.select("user_id", F.col("day").cast("string").alias("day"), pick(CURRENCIES, F.col("user_id")).alias("currency"), body.alias("body"))
    return parsers.exchange_rates(bodies).withColumns({"value": F.round("value", 6), "change_pct": F.round("change_pct", 6)})


def quotes_read(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    price, before = _text('"regularMarketPrice": ', F.floor("value").cast("long")), lambda name, v: F.concat(F.lit(f', "{name}": '), v.cast("string"))
    meta = F.when(i % 7 == 0, F.lit('"previousClose": 3')).when(i % 7 == 1, F.concat(price, before("chartPreviousClose", F.lit(0)))).when(i % 7 == 2, F.concat(price, before("previousClose", F.col("k") + 1)))
    meta = meta.otherwise(F.concat(price, before("chartPreviousClose", F.col("k") + 2), before("previousClose", F.lit(1))))
    body = F.when(i % 7 == 5, "<html>").when(i % 7 == 6, '{"chart": {"result": null}}').otherwise(_text('{"chart": {"result": [{"meta": {', meta, "}}]}}"))
    x = _events(spark, d).select("id", _text("S", F.col("user_id") % 11).alias("symbol"), body.alias("body"))
    return parsers.quotes(x).withColumn("change_pct", F.round("change_pct", 6))


def policy_read(spark: SparkSession, d: str) -> DataFrame:
    """The rate on a page, whose number has a comma or none, or only in the series."""
    i, k = F.col("id"), F.col("k")
    page = F.when(i % 4 == 0, _text("<style>5 %</style><p>M&aring;l 2 %. Styringsrenten er n&aring; ", k % 9, ",25 % fra mai</p>")).when(i % 4 == 1, _text("<p>Renten er ", k % 7, " %</p>")).when(i % 4 == 2, "<p>ingen</p>")
    api = F.when(i % 5 != 0, _text('{"data": {"dataSets": [{"series": {"0": {"observations": {"10": ["', k, '.5"], "9": ["1"]}}}}]}}'))
    return parsers.policy_rate(_events(spark, d).select("id", page.alias("page"), api.alias("api")))


def company_read(spark: SparkSession, d: str) -> DataFrame:
    """A table of company news for each user and day; of its rows some have no date, no title or too few cells."""
    i = F.col("id")
    cell = lambda *parts: _text("<td>", *parts, "</td>")
    stamp = F.when(i % 6 == 0, "soon").otherwise(_text(F.date_format("ts", "d MMM yyyy HH:mm"), F.when(i % 2 == 0, " CET").otherwise(" CEST")))
    title = F.when(i % 7 == 0, "").otherwise(_text("<a href='/en/company-news/", i, "'>News &amp; ", i, "</a>"))
    row = _text("<tr>", cell(stamp), cell("A <b>", F.col("user_id"), "</b>"), F.when(i % 9 == 0, "").otherwise(F.concat(cell(title), cell("Energy"), cell(F.col("event_type")))), "</tr>")
    pages = _listed(_events(spark, d).withColumn("page", _text(F.col("user_id"), " ", F.col("day"))), ["page"], row).select(F.col("page").alias("id"), _text("<table><tr><th>x</th></tr>", F.array_join("texts", ""), "</table>").alias("body"))
    return parsers.news_table(pages).select("id", F.col("place").cast("long").alias("place"), F.unix_timestamp("published").alias("second"), "company", "title", "category", "url", "body", "external_id")


def decision_feed(spark: SparkSession, d: str) -> DataFrame:
    """An official feed for each event, read some minutes before or after the page that it names was published."""
    i = F.col("id")
    url = _text(PAGE_URL, F.date_format("ts", "yyyy/yyyy-MM-dd"), F.when(i % 5 == 0, "-tale/").otherwise("-rente/"), F.when(i % 7 == 0, "?a=1").otherwise(""))
    body = _text("<rss><item><title>", i, "</title><link><![CDATA[", url, "]]></link><pubDate>", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), " GMT</pubDate></item></rss>")
    as_of = F.timestamp_seconds(F.unix_timestamp("ts") + (F.col("k") % 60 - 5) * 180)
    return parsers.decision_links(_events(spark, d).select(as_of.alias("as_of"), body.alias("body"))).select("url", F.unix_timestamp("published").alias("second"))


def decision_read(spark: SparkSession, d: str) -> DataFrame:
    """Decision pages: rates go up, down or stay, and every reason against a page occurs."""
    i, k, case = F.col("id"), F.col("k"), F.col("id") % 14
    old, new = k % 9 + 1, F.when(case == 12, k % 9 + 1).when(i % 3 == 1, k % 9).otherwise(k % 9 + 2)
    up, down, flat = (i % 3 == 0) | (case == 12), (i % 3 == 1) & (case != 12), (i % 3 == 2) & (case != 12)
    title = F.when(case == 2, "Styringsrenten diskuteres").otherwise(_text("Styringsrenten ", F.when(up, "settes opp til ").when(down, "senkes til ").otherwise("holdes uendret på "), F.when(flat, old).otherwise(new), " prosent"))
    moved = _text(F.when(up, "opp").otherwise("ned"), " fra ", old, " til ", F.when(case == 10, new + 9).otherwise(new))
    text = F.when(case == 9, "Ingen beslutning her.").when(flat, F.when(case == 11, "Komiteen besluttet styringsrenten.").otherwise(_text("Komiteen besluttet å holde styringsrenten uendret på ", old, " prosent.")))
    text = text.otherwise(_text("Komiteen besluttet å sette styringsrenten ", moved, " prosent."))
    meta = F.when(case == 5, _text('<meta property="article:published_time" content="', F.date_format(F.col("ts") + F.expr("INTERVAL 2 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), '">')).otherwise("")
    heading = _text("<h1>", title, "</h1>")
    body = _text("<html><head>", meta, "</head>", heading, F.when(case == 1, heading).otherwise(""), "<p>", text, "</p><p>Kontakt: x</p></html>")
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Oslo")
    day = F.date_format(F.when(case == 8, local - F.expr("INTERVAL 1 DAY")).otherwise(local), "yyyy-MM-dd")
    url = _text(F.when(case == 0, "http").otherwise("https"), PAGE_URL[5:], F.substring(day, 1, 4), "/", day, "-rente/")
    as_of = F.timestamp_seconds(F.unix_timestamp("ts") + F.when(case == 7, 10_000).otherwise(600))
    pages = _events(spark, d).select("id", url.alias("url"), F.when(case != 4, F.col("ts").cast("timestamp")).alias("published"), as_of.alias("as_of"), body.alias("body"))
    return parsers.decisions(pages).select("id", "reject", "rate", "previous", "direction", "headline", "fact", F.unix_timestamp("published").alias("second"))


def named_signs(spark: SparkSession, d: str) -> DataFrame:
    """Character references by name and number, known and unknown ones."""
    text = _text("&Oslash;l &amp;lt; &#229;&#x1F600; &unknown; &#xD800; ", F.col("event_type"), "&hellip;", F.col("id"), "&")
    return _events(spark, d).select("id", entities(text).alias("text"))


def review_gate(spark: SparkSession, d: str) -> DataFrame:
    """A review of each conversation: its turns are the blocks, some without a check, some checks against them."""
    c, t = F.col("conv_id"), F.col("turn")
    name = _text("b", t)
    check = F.struct(name.alias("id"), (t % 5 != 3).alias("supported"), F.when(t % 4 == 2, F.array().cast("array<string>")).when(t % 6 == 4, F.array(F.lit("f9"))).otherwise(F.array(F.lit("f1"))).alias("fact_ids"), (t % 7 != 5).alias("entity_numbers_units_dates_match"))
    rows = table(spark, d, "conversations").withColumns({"block": F.struct(name.alias("id"), F.when((c + t) % 11 == 0, "").otherwise(F.col("text")).alias("text")), "check": F.when(c % 3 != 0, check).when(t % 2 == 0, check)})
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "block", "check"))).alias("x"))
    review = F.struct((c % 5 != 0).alias("passed"), (c % 7 == 0).alias("personal_advice"), F.array_compact(F.transform("x", lambda r: r["check"])).alias("checks"))
    reasons = review_reasons(F.transform("x", lambda r: r["block"]), F.array(F.lit("f1"), F.lit("f2")), review)
    return held.select("conv_id", F.array_join(reasons, ",").alias("reasons"))
