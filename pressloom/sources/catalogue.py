"""The catalogue of feeds and index queries, the live subset of it, and a round over their bodies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.phrases import hit
from ..operators.triage import judged
from . import bodies
from .feeds import AGE_HOURS, OF_A_FEED, entries, written
from .parsers import index_articles
from .storage import cut, shared
from .tables import pick, radar, table

#: Name, address, kind and most hours of age (none: AGE_HOURS) of each feed.
FEEDS = [
    ("Dagens Næringsliv – RSS", "https://services.dn.no/api/feed/rss/", "rss", None),
    ("E24 – Børs og finans", "https://e24.no/rss2/?seksjon=boers-og-finans", "rss", None),
    ("E24 – Makro og politikk", "https://e24.no/rss2/?seksjon=makro-og-politikk", "rss", None),
    ("E24 – Aksjetips", "https://e24.no/rss2/?seksjon=aksjetips", "rss", None),
    ("Federal Reserve – pengepolitikk", "https://www.federalreserve.gov/feeds/press_monetary.xml", "official-rss", None),
    ("ECB – nyheter og presse", "https://www.ecb.europa.eu/rss/press.html", "official-rss", None),
    ("Google News – Fast global finance desks", "https://news.google.com/rss/search?q=%28site%3Areuters.com%20OR%20site%3Abloomberg.com%20OR%20site%3Aft.com%20OR%20site%3Acnbc.com%20OR%20site%3Awsj.com%29%20%28markets%20OR%20stocks%20OR%20rates%20OR%20earnings%20OR%20acquisition%20OR%20inflation%20OR%20Fed%20OR%20oil%20OR%20Bitcoin%29%20when%3A2h&hl=en-US&gl=US&ceid=US%3Aen", "fast-news-aggregator", 2),
    ("Google News – Fast Norway finance", "https://news.google.com/rss/search?q=%28site%3Ae24.no%20OR%20site%3Adn.no%29%20%28b%C3%B8rs%20OR%20aksjer%20OR%20rente%20OR%20krone%20OR%20selskap%20OR%20oppkj%C3%B8p%20OR%20resultat%29%20when%3A2h&hl=no&gl=NO&ceid=NO%3Ano", "fast-news-aggregator", 2),
    ("CNBC – Global Business", "https://www.cnbc.com/id/100003114/device/rss/rss.html", "global-rss", 24),
    ("Yahoo Finance – Global", "https://finance.yahoo.com/news/rssindex", "global-rss", 24),
    ("Financial Times – Global", "https://www.ft.com/rss/home", "global-rss", 24),
    ("WSJ – Markets", "https://feeds.a.dj.com/rss/RSSMarketsMain.xml", "global-rss", 24),
    ("The Economist – Finance & Economics", "https://www.economist.com/finance-and-economics/rss.xml", "global-rss", 36),
    ("Google News – Global markets", "https://news.google.com/rss/search?q=%28earnings%20OR%20guidance%20OR%20acquisition%20OR%20%22profit%20warning%22%20OR%20%22shares%20surge%22%20OR%20%22shares%20plunge%22%29%20when%3A1d&hl=en-US&gl=US&ceid=US%3Aen", "news-aggregator", 30),
    ("Google News – Megacap & AI", "https://news.google.com/rss/search?q=%28Nvidia%20OR%20Apple%20OR%20Microsoft%20OR%20Alphabet%20OR%20Amazon%20OR%20Meta%20OR%20Tesla%20OR%20Broadcom%20OR%20AMD%20OR%20TSMC%20OR%20ASML%29%20%28earnings%20OR%20guidance%20OR%20shares%20OR%20revenue%20OR%20profit%29%20when%3A1d&hl=en-US&gl=US&ceid=US%3Aen", "news-aggregator", 30),
    ("Google News – Macro & central banks", "https://news.google.com/rss/search?q=%28%22Federal%20Reserve%22%20OR%20ECB%20OR%20%22Bank%20of%20Japan%22%20OR%20inflation%20OR%20CPI%20OR%20payrolls%20OR%20GDP%29%20%28markets%20OR%20rates%20OR%20stocks%20OR%20bonds%29%20when%3A1d&hl=en-US&gl=US&ceid=US%3Aen", "news-aggregator", 30),
    ("Google News – Deals & global companies", "https://news.google.com/rss/search?q=%28merger%20OR%20takeover%20OR%20acquisition%20OR%20bankruptcy%20OR%20IPO%20OR%20%22capital%20raise%22%20OR%20%22job%20cuts%22%29%20%28company%20OR%20shares%20OR%20billion%29%20when%3A1d&hl=en-US&gl=US&ceid=US%3Aen", "news-aggregator", 30),
]
#: Name, time span and words of each query of the news index.
INDEX_QUERIES = [
    ('GDELT – global makro og sentralbanker', '12h', '("Federal Reserve" OR FOMC OR ECB OR "Bank of Japan" OR BOJ OR "Bank of England" OR inflation OR CPI OR PCE OR payrolls OR GDP OR PMI OR tariffs) (rates OR economy OR market OR stocks OR bonds OR currency)'),
    ('GDELT – globale storselskaper og resultater', '24h', '(Nvidia OR Apple OR Microsoft OR Alphabet OR Google OR Amazon OR Meta OR Tesla OR Broadcom OR AMD OR Oracle OR Netflix OR TSMC OR ASML OR Samsung OR "Novo Nordisk" OR "Eli Lilly" OR JPMorgan OR "Goldman Sachs" OR Exxon OR Chevron OR Shell OR Airbus OR Boeing OR Berkshire) (earnings OR revenue OR profit OR EPS OR guidance OR forecast OR results OR shares OR acquisition OR buyback)'),
    ('GDELT – selskapsbegivenheter og store penger', '24h', '("quarterly results" OR earnings OR "profit warning" OR acquisition OR takeover OR merger OR bankruptcy OR restructuring OR IPO OR "capital raise" OR "job cuts") (company OR shares OR stock OR investors OR billion)'),
    ('GDELT – globale markeder, råvarer og krypto', '12h', '(Brent OR oil OR OPEC OR gold OR copper OR Bitcoin OR Ethereum OR "S&P 500" OR Nasdaq OR "Stoxx 600") (surge OR plunge OR rally OR selloff OR record OR market OR price OR supply OR demand)'),
]
#: Names of the live desk's feeds and queries, and its hours.
LIVE_FEEDS = "Dagens Næringsliv|E24 – Børs|E24 – Makro|Federal Reserve|ECB|CNBC|Financial Times|WSJ|Fast global finance desks|Fast Norway finance"
LIVE_QUERIES, LIVE_HOURS = "makro og sentralbanker|markeder, råvarer og krypto", 2


def feeds(spark: SparkSession, live: bool = False) -> DataFrame:
    """name, url, kind, max_age_hours; with `live` those of the live desk only, none older than LIVE_HOURS."""
    x = spark.createDataFrame(FEEDS, "name string, url string, kind string, max_age_hours int")
    if not live:
        return x.withColumn("max_age_hours", F.coalesce("max_age_hours", F.lit(AGE_HOURS)))
    return x.where(hit(F.col("name"), LIVE_FEEDS)).withColumn("max_age_hours", F.least(F.coalesce("max_age_hours", F.lit(LIVE_HOURS)), F.lit(LIVE_HOURS)))


def index_queries(spark: SparkSession, live: bool = False) -> DataFrame:
    x = spark.createDataFrame(INDEX_QUERIES, "name string, timespan string, query string")
    return x.where(hit(F.col("name"), LIVE_QUERIES)).withColumn("timespan", F.lit(f"{LIVE_HOURS}h")) if live else x


def sources(spark: SparkSession, live: bool = False) -> DataFrame:
    """name, kind and max_age_hours of feeds and index queries; an index's own time span is part of what it is asked for."""
    return feeds(spark, live).select("name", "kind", "max_age_hours").unionByName(index_queries(spark, live).select("name", F.lit("news-index").alias("kind"), F.lit(None).cast("int").alias("max_age_hours")))


def round_items(fetched: DataFrame) -> DataFrame:
    """The relevant items of `fetched` bodies (name, kind, max_age_hours, as_of, body): feeds and article indexes, the first OF_A_FEED of each body."""
    index = F.col("kind") == "news-index"
    read = entries(fetched.where(~index)).unionByName(index_articles(fetched.where(index)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("name", "as_of").orderBy("place"))
    return judged(read).where("relevant").withColumn("n", first).where(F.col("n") <= OF_A_FEED).drop("n", "relevant")


def round_stats(fetched: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New items and, per source, what rounds over `fetched` bodies (name, kind, max_age_hours, as_of, body, error) saw and brought.

    An item is new if no row of `existing` (external_id) and no item before it, in an earlier round or of a source or place before, has
    its address and title. A source keeps its row if none of its bodies could be read, with the error.
    """
    read = round_items(fetched.where("error is null").drop("error"))
    keyed = read.withColumn("external_id", F.substring(F.sha2(F.concat_ws("|", "url", "title"), 256), 1, 48))
    first = F.row_number().over(Window.partitionBy("external_id").orderBy("as_of", "name", "place"))
    known = existing.select("external_id", F.lit(True).alias("known")).distinct()
    keyed = keyed.withColumn("first", first).join(known, "external_id", "left").withColumn("new", (F.col("first") == 1) & F.col("known").isNull())
    per_source = keyed.groupBy("name").agg(F.count("*").alias("seen"), F.count_if("new").alias("inserted"))
    stats = fetched.groupBy("name", "kind").agg(F.max("error").alias("error")).join(per_source, "name", "left")
    return keyed.where("new").drop("first", "known", "new"), stats.select("name", "kind", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("inserted", F.lit(0)).alias("inserted"), "error")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Each event's headline as an item of one of the sources, by its user."""
    names = [x[0] for x in (*FEEDS, *INDEX_QUERIES)]
    url = F.concat(F.lit("https://www.example.com/a?id="), F.col("id").cast("string"))
    return radar(spark, d).select(pick(names, F.col("user_id")).alias("name"), "id", "title", url.alias("url"), "published", F.to_date("published").cast("string").alias("day"), "user_id")


def written_bodies(items: DataFrame) -> DataFrame:
    """(name, day, body): an RSS document of each feed's items of a day, or a JSON index of a query's; one source's are empty."""
    index = F.col("name").startswith("GDELT")
    rss = written(items.where(~index), "name", "day").withColumn("body", F.when(F.col("name").startswith("ECB"), "").otherwise(F.col("body")))
    article = F.struct("url", "title", F.date_format("published", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    listed = F.reverse(F.array_sort(F.collect_list(F.struct("published", "id", article.alias("article")))))
    found = items.where(index).groupBy("name", "day").agg(listed.alias("x")).select("name", "day", F.to_json(F.struct(F.transform("x", lambda r: r["article"]).alias("articles"))).alias("body"))
    return rss.unionByName(found)


def _round(spark: SparkSession, d: str, live: bool) -> DataFrame:
    items = _items(spark, d)
    known = items.join(table(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("id")), "id")
    existing = known.select(F.substring(F.sha2(F.concat_ws("|", "url", "title"), 256), 1, 48).alias("external_id"))
    folder = f"{shared(spark)}/bodies-{uuid.uuid4().hex}"
    bodies.write(written_bodies(items), folder, "name", "day")
    # Fetched once: feeds, indexes and errors are read from what was kept.
    fetched = cut(bodies.read(spark, folder)).select(F.col("keys.name").alias("name"), (F.to_date("keys.day") + F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("as_of"), "body", "error")
    return round_stats(fetched.join(F.broadcast(sources(spark, live)), "name"), existing)[1]


def source_stats(spark: SparkSession, d: str) -> DataFrame:
    """A round at the end of each day over all sources, whose bodies are written to a folder and fetched from there; views are known
    already, and one source has only empty bodies."""
    return _round(spark, d, live=False)


def live_sources(spark: SparkSession, d: str) -> DataFrame:
    """The same for the live desk's sources: fewer of them, and only the last two hours of each day from feeds."""
    return _round(spark, d, live=True)
