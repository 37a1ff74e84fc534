"""Readers of other bodies than feeds: article indexes, rate and quote documents, news tables, decision pages.

Every reader maps rows with a `body` to typed rows by column expressions; what can't be read gives no row, or a reject code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timing, urls
from ..functions.phrases import SPACE, hit
from ..functions.text import html_plain
from ..functions.urls import let
from ..operators.dates import publication
from .feeds import bare, content, decoded, elements, moment
from .tables import seconds

#: Currencies and the unit their rate is given for, and how much of a body is read.
UNITS = {"USD": 1, "EUR": 1, "GBP": 1, "SEK": 100, "DKK": 100, "CHF": 100}
INDEX_ROWS, TABLE_ROWS, RATE_TEXT, FIRST_TEXT, DECISION_TEXT = 60, 50, 800, 1600, 20_000
SITE = "https://live.euronext.com"
PAGE = SITE + "/en/markets/oslo/equities/company-news"
RAISED, LOWERED, HELD = "settes opp til|heves til", "settes ned til|senkes til", "holdes uendret på"
RATE = r"(\d{1,2}(?:[,.]\d{1,2})?)"

INDEX = "struct<articles: array<struct<url: string, title: string, seendate: string, domain: string, language: string, sourcecountry: string, socialimage: string>>>"
SERIES = "struct<data: struct<dataSets: array<struct<series: map<string, struct<observations: map<string, array<string>>>>>>>>"
CHART = "struct<chart: struct<result: array<struct<meta: struct<regularMarketPrice: double, chartPreviousClose: double, previousClose: double, regularMarketTime: bigint>>>>>"


def index_date(text: Column) -> Column:
    """A compact date, YYYYMMDD[T]HHMM[SS][Z] in UTC, or any that moment() reads."""
    compact = F.regexp_extract(text, r"^(\d{8})T?(\d{4})(?:\d{2})?Z?$", 1) != ""
    digits = F.rpad(F.regexp_replace(text, "[TZ]", ""), 14, "0")
    return F.when(compact, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))).otherwise(moment(text))


def index_articles(bodies: DataFrame) -> DataFrame:
    """The articles of JSON indexes (name, body, ...): at most INDEX_ROWS of each, as radar items. Other columns stay."""
    a = F.slice(F.from_json("body", INDEX)["articles"], 1, INDEX_ROWS)
    rest = [c for c in bodies.columns if c != "body"]
    x = bodies.select(*rest, F.posexplode(a).alias("place", "a")).select(*rest, "place", "a.*")
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    domain = some(F.col("domain"))
    return x.select(
        *rest, F.coalesce(F.concat("name", F.lit(" · "), domain), F.col("name")).alias("source_name"), F.lit("news-index").alias("source_kind"), F.coalesce(domain, urls.host(F.col("url"))).alias("source_domain"),
        bare(F.coalesce("title", F.lit(""))).alias("title"), F.concat_ws(" · ", some(F.col("sourcecountry")), some(F.col("language"))).alias("summary"), urls.cleaned(F.coalesce("url", F.lit(""))).alias("url"),
        some(F.col("socialimage")).alias("image_url"), index_date(F.col("seendate")).alias("published"), "place",
    ).where("title <> '' and url <> ''")


def observations(body: Column) -> Column:
    """The values of the first series of an SDMX-JSON body, in the order of their numbers; null if there is none."""
    series = F.get(F.map_values(F.get(F.from_json(body, SERIES)["data"]["dataSets"], 0)["series"]), 0)
    number = lambda e: e["value"][0].try_cast("double")
    ordered = F.array_sort(F.transform(F.map_entries(series["observations"]), lambda e: F.struct(e["key"].try_cast("long").alias("at"), number(e).alias("x"))))
    return F.filter(F.transform(ordered, lambda e: e["x"]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def exchange_rates(bodies: DataFrame) -> DataFrame:
    """The latest rate of each currency (currency, body, ...) and its change in percent from the one before; without one: 0. Other columns stay."""
    values = observations(F.col("body"))
    unit = F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), F.col("currency"))
    rest = [c for c in bodies.columns if c not in ("currency", "body")]
    x = bodies.select(*rest, "currency", values.alias("v"), F.coalesce(unit, F.lit(1)).alias("unit")).where("size(v) > 0")
    latest = F.element_at("v", -1) / F.col("unit")
    before = F.coalesce(F.try_element_at("v", F.lit(-2)), F.element_at("v", -1)) / F.col("unit")
    return x.select(*rest, F.concat("currency", F.lit("NOK")).alias("symbol"), latest.alias("value"), F.when(before == 0, 0.0).otherwise((latest / before - 1) * 100).alias("change_pct"))


def page_rate(html: Column) -> Column:
    """The first percentage behind the policy rate's name on its page, else the first near its beginning."""
    def read(t: Column) -> Column:
        at = F.position(F.lit("styringsrenten"), F.lower(t))
        part = F.when(at > 0, t.substr(at, F.lit(RATE_TEXT))).otherwise(F.substring(t, 1, FIRST_TEXT))
        return F.nullif(F.regexp_replace(F.regexp_extract(part, rf"(?<!\d){RATE}\s*%", 1), ",", "."), F.lit("")).cast("double")

    return let(html_plain(html), read)


def policy_rate(bodies: DataFrame) -> DataFrame:
    """(id, rate, api_rate, source) from (id, page, api): the page's rate, else the last observation; neither: no row."""
    x = bodies.select("id", page_rate(F.col("page")).alias("page_rate"), F.try_element_at(observations(F.col("api")), F.lit(-1)).alias("api_rate"))
    x = x.select("id", F.coalesce("page_rate", "api_rate").alias("rate"), "api_rate", F.when(F.col("page_rate").isNotNull(), "official-page").otherwise("api").alias("source"))
    return x.where("rate is not null")


def quotes(bodies: DataFrame) -> DataFrame:
    """(symbol, value, change_pct, error) from chart documents (symbol, body, ...): other columns stay; a symbol that can't be read keeps its row, with an error."""
    meta = F.get(F.from_json("body", CHART)["chart"]["result"], 0)["meta"]
    rest = [c for c in bodies.columns if c not in ("symbol", "body")]
    x = bodies.select(*rest, "symbol", meta.alias("m"))
    now, before = F.col("m.regularMarketPrice"), F.coalesce("m.chartPreviousClose", "m.previousClose")
    change = F.when(before.isNull() | (before == 0), 0.0).otherwise((now / before - 1) * 100)
    error = F.when(F.col("m").isNull(), "no market data").when(now.isNull(), "no valid price")
    return x.select(*rest, "symbol", now.alias("value"), F.when(now.isNotNull(), change).alias("change_pct"), error.alias("error"))


def table_date(text: Column) -> Column:
    """`1 Mar 2024 08:05 CET` (or CEST) as an instant."""
    part = lambda i: F.regexp_extract(text, r"(?i)(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}:\d{2})\s+(CEST|CET)", i)
    shift = F.when(F.upper(part(5)) == "CEST", " +0200").otherwise(" +0100")
    return F.when(part(1) != "", F.try_to_timestamp(F.concat(part(1), F.lit(" "), F.initcap(part(2)), F.lit(" "), part(3), F.lit(" "), part(4), shift), F.lit("d MMM yyyy HH:mm Z")))


def news_table(pages: DataFrame) -> DataFrame:
    """Company news from table pages (id, body): rows of five cells or more with a date, a company and a title, TABLE_ROWS a page."""
    x = pages.select("id", F.posexplode(elements(F.col("body"), "tr")).alias("row", "tr")).withColumn("td", elements(F.col("tr"), "td")).where("size(td) >= 5")
    text = lambda i: decoded_text(F.get("td", F.lit(i)))
    link = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for c, p in ((F.col("tr"), r"""(?i)href=["']([^"']*/company-news/[^"']+)["']"""), (F.get("td", F.lit(2)), r"""(?i)href=["']([^"']+)["']"""))])
    url = F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("/"), F.concat(F.lit(SITE), link)).otherwise(PAGE)
    x = x.select("id", "row", text(0).alias("published_text"), text(1).alias("company"), text(2).alias("title"), text(3).alias("sector"), text(4).alias("category"), url.alias("url"))
    x = x.withColumn("published", table_date(F.col("published_text"))).where("title <> '' and company <> '' and published is not null")
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("row"))).where(F.col("place") <= TABLE_ROWS)
    line = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
    body = F.concat_ws("\n", line("Selskap", "company"), line("Kategori", "category"), line("Sektor", "sector"), line("Tittel", "title"))
    key = F.substring(F.sha2(F.concat_ws("|", "published_text", "company", "title"), 256), 1, 40)
    return x.select("id", "place", "published", "company", "title", "sector", "category", "url", body.alias("body"), key.alias("external_id"))


def decoded_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style).*?</\1>", " "), "<[^>]+>", " ")), f"{SPACE}+", " "))


def decision_links(feeds: DataFrame) -> DataFrame:
    """Decision pages named in official feeds (as_of, body), from a minute ahead to two hours old, the newest first."""
    x = feeds.select("as_of", F.explode(elements(F.col("body"), "item")).alias("item"))
    x = x.select("as_of", content(F.col("item"), "link").alias("url"), moment(content(F.col("item"), "pubDate")).alias("published"))
    age = seconds(F.col("as_of")) - seconds(F.col("published"))
    return x.where(urls.is_decision(F.col("url")) & age.between(-60, 7200)).select("url", "published").orderBy(F.desc("published"))


def decisions(pages: DataFrame) -> DataFrame:
    """Rate decisions from pages (id, url, published, as_of, body): rate, previous, direction, headline, fact and hash, or `reject`,
    the first reason against the page."""
    headings = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)(<h1\b[^>]*>.*?</h1>)"), F.lit(1)), lambda h: F.struct(html_plain(h).alias("title"), h.alias("raw")))
    x = pages.select("id", "url", "published", "as_of", "body", F.filter(headings, lambda h: hit(h["title"], r"^Styringsrenten\s")).alias("h"), publication(F.col("body")).alias("meta"))
    x = x.withColumns({"title": F.get("h", F.lit(0))["title"], "raw": F.get("h", F.lit(0))["raw"]})
    line = lambda i: F.regexp_extract("title", rf"(?iu)^Styringsrenten\s+({RAISED}|{LOWERED}|{HELD})\s+{RATE}\s+prosent\.?$", i)
    text = F.substring(F.get(F.split(html_plain(F.col("body").substr(F.position(F.col("raw"), F.col("body")), F.lit(2_000_000))), r"(?iu)Kontakt:|Fant du det du lette etter"), F.lit(0)), 1, DECISION_TEXT)
    x = x.withColumns({"said": line(1), "amount": line(2), "text": text, "at": F.coalesce(F.col("meta.at"), F.col("published").cast("timestamp"))})
    number = lambda c: F.regexp_replace(c, ",", ".").try_cast("double")
    shown = lambda c: F.regexp_replace(c, r"\.", ",")
    moved = lambda i: F.regexp_extract("text", rf"(?iu)styringsrenten\s+(?:opp|ned)\s+fra\s+{RATE}\s+til\s+{RATE}\s+prosent", i)
    direction = F.when(hit(F.col("said"), "opp|hev"), "up").when(hit(F.col("said"), "ned|senk"), "down").otherwise("unchanged")
    x = x.withColumns({"rate": number(F.col("amount")), "direction": direction, "before": number(moved(1)), "after": number(moved(2))})
    age = seconds(F.col("as_of")) - seconds(F.col("at"))
    day = F.date_format(timing.local(F.col("at")), "yyyy-MM-dd")
    held = F.concat(F.lit("(?iu)(?:holde|holdes) styringsrenten uendret på "), F.regexp_replace("amount", "[,.]", "[,.]"), F.lit(" prosent"))
    flat, no = F.col("direction") == "unchanged", lambda c: ~F.coalesce(c, F.lit(False))
    reject = F.coalesce(*[F.when(c, name) for c, name in (
        (~urls.is_decision(F.col("url")), "UNTRUSTED_DECISION_URL"), (F.size("h") != 1, "AMBIGUOUS_RATE_HEADING"), (F.col("said") == "", "AMBIGUOUS_RATE_DECISION"),
        (F.col("at").isNull(), "PUBLICATION_TIME_MISSING"), (F.abs(seconds(F.col("meta.at")) - seconds(F.col("published"))) > 60, "PUBLICATION_TIME_CONFLICT"),
        (no(age.between(-60, 7200)), "DECISION_NOT_FRESH"), (~F.col("url").contains(F.concat(F.lit("/"), day, F.lit("-rente/"))), "DECISION_DATE_CONFLICT"),
        (no(F.col("rate").between(0, 25)) | ~hit(F.col("text"), "komiteen besluttet|komité.*besluttet|besluttet.*styringsrenten"), "DECISION_NOT_CONFIRMED"),
        (~flat & no(F.col("after") == F.col("rate")), "RATE_TEXT_CONFLICT"), (((F.col("direction") == "up") & (F.col("rate") <= F.col("before"))) | ((F.col("direction") == "down") & (F.col("rate") >= F.col("before"))), "RATE_DIRECTION_CONFLICT"),
        (flat & ~F.rlike("text", held), "UNCHANGED_RATE_NOT_CONFIRMED"),
    )])
    verb = F.when(F.col("direction") == "up", "hever").when(F.col("direction") == "down", "senker").otherwise("holder")
    said = lambda *rest: F.concat(F.lit("Norges Bank "), verb, *rest)
    headline = said(F.when(flat, " styringsrenten uendret på ").otherwise(" styringsrenten til "), shown(F.col("amount")), F.lit(" prosent"))
    plain = F.regexp_replace(F.col("before").cast("string"), r"\.0$", "")
    fact = F.when(flat, F.concat(headline, F.lit("."))).otherwise(said(F.lit(" styringsrenten fra "), shown(plain), F.lit(" til "), shown(F.col("amount")), F.lit(" prosent.")))
    fine = lambda c: F.when(F.col("reject").isNull(), c)
    out = x.withColumn("reject", reject)
    return out.select(
        "id", "reject", fine(F.col("rate")).alias("rate"), fine(F.when(~flat, F.col("before"))).alias("previous"), fine(F.col("direction")).alias("direction"), fine(headline).alias("headline"),
        fine(fact).alias("fact"), fine(F.col("at")).alias("published"), fine(F.sha2("text", 256)).alias("text_sha256"),
    )
