"""Where a story's facts come from: roles of sources, cluster mates, the chain of choices for the main source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timing, urls
from ..functions.scoring import squeezed
from ..functions.standard_urls import in_standard_form
from ..sources.tables import headlines, pick, seconds, table
from ..sources.storage import cut
from .dates import publication
from .sets import pairs

#: Fixed values of research: words that titles are compared without, and the bounds of each step.
STOP = (
    "og i på til for med av er en et den det de som fra om etter mot skal har the a an of to in and on from with"
).split()
MATES, LEAST_TEXT, TRIED, KEPT, LEAST_TITLE, BEFORE_DAYS, AFTER_DAYS = 12, 40, 3, 2, 0.65, 4, 2
CHAIN = ["trusted-discovery-url", "event-cluster-primary", "original-source-search", "raw-item-title-match", "event-cluster-trusted-secondary", "trusted-secondary-fallback"]


def words(title: Column) -> Column:
    return T.tokens(title, STOP)


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller set that both have; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def item_text(title: Column, summary: Column) -> Column:
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return squeezed(F.concat_ws(". ", some(title), some(summary)))


def sourced(items: DataFrame) -> DataFrame:
    """`items` (url, title, summary, ...) with role, quality and method: a primary source, a known paper with enough text, or neither (null)."""
    text = item_text(F.col("title"), F.col("summary"))
    x = items.withColumn("source", urls.role(F.col("url"), F.concat_ws(" ", "title", "summary")))
    primary, paper = F.col("source.role") == "primary", urls.paper(F.col("url")).isNotNull() & (F.length(text) >= LEAST_TEXT)
    return x.withColumns({
        "role": F.when(primary, "primary").when(paper, "trusted_secondary"), "quality": F.when(primary, F.col("source.quality")).when(paper, "high"),
        "method": F.when(primary, CHAIN[1]).when(paper, CHAIN[4]), "text": text,
    }).drop("source")


def leading(items: DataFrame) -> DataFrame:
    """(event_key, rank, url, role, quality, method, mate): the sources of each event: known papers first, then by score and time, MATES rows
    looked at.

    items: id, event_key, url, title, summary, score, published. Each event is ranked once, not once for each item.
    """
    best = Window.partitionBy("event_key").orderBy(F.when(urls.paper(F.col("url")).isNotNull(), 0).otherwise(1), F.desc_nulls_last("score"), F.desc_nulls_last("published"), "id")
    top = sourced(items.where("event_key is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MATES)).where("role is not null and url <> ''")
    first = Window.partitionBy("event_key", "url").orderBy("rank")
    return top.withColumn("again", F.row_number().over(first)).where("again = 1").select("event_key", "rank", "url", "role", "quality", "method", F.col("id").alias("mate"))


def handed(items: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (event_key, ...) of its event for each item, as (event_key, item, ...). An event's rows travel as one, so a join holds
    no more than one row for each event, however many items it has; items are sorted, never broadcast, as small as their file may look."""
    columns = [c for c in rows.columns if c != "event_key"]
    held = rows.groupBy("event_key").agg(F.collect_list(F.struct(*columns)).alias("held"))
    return items.select(F.col("id").alias("item"), "event_key").join(held.hint("merge"), "event_key").select("event_key", "item", F.inline("held"))


def mates(items: DataFrame) -> DataFrame:
    """(event_key, item, rank, url, ...): for each item the sources of its event, see leading()."""
    return handed(items, leading(items))


def newest_at(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` (key, at, ...) with `last`, the newest row of `rows` (key, at, id) of its key not after `at`, as (at, id), of rows at
    the same time the least id; null if there is none. Times are in microseconds. A window holds one key's rows of one day; a day
    without any takes the newest of the days before it."""
    day = F.expr("at div 86400000000")
    own = rows.select("key", "at", day.alias("day"), F.struct("at", (-F.col("id")).alias("least")).alias("row"))
    days = own.groupBy("key", "day").agg(F.max("row").alias("top"))
    # Days that are asked for stand beside those that have rows, so that each knows the newest of the days before it.
    known = days.unionByName(asked.select("key", day.alias("day")).distinct().withColumn("top", F.lit(None).cast(dict(days.dtypes)["top"])))
    each = known.groupBy("key", "day").agg(F.max("top").alias("top"))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = each.select("key", "day", F.max("top").over(before).alias("earlier"))
    columns = [c for c in asked.columns if c not in ("key", "at")]
    both = asked.select("key", "at", day.alias("day"), F.struct(*columns).alias("ask"), F.lit(None).cast(dict(own.dtypes)["row"]).alias("row"))
    both = both.unionByName(own.withColumn("ask", F.lit(None).cast(dict(both.dtypes)["ask"])))
    till = Window.partitionBy("key", "day").orderBy("at", F.col("ask").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("here", F.max("row").over(till)).where("ask is not null").join(earlier, ["key", "day"])
    return seen.select("key", "at", "ask.*", F.coalesce("here", "earlier").alias("last"))


#: Shares of the smaller title's words that are looked for in turn, down to any word at all.
SHARES = (LEAST_TITLE, 0.34, 0.0)


def best_titles(items: DataFrame, raw: DataFrame) -> DataFrame:
    """For each item the raw row of the most similar title, published from BEFORE_DAYS before it to AFTER_DAYS after it.

    Different sets of words are compared, not rows, and first only those that can share most of the smaller one's
    words, found by its rare ones; items whose best title is that similar are done, as no other can be more so. Only the
    rest are compared by commoner words. A row of a matching title in the item's days is found in the order of time. Of equally
    similar titles the newest counts, then the least id. items: id, title, published; raw: raw_id, raw_title, raw_published.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    i = cut(items.where("published is not null").select("id", micros("published").alias("t"), F.array_sort(F.array_distinct(words(F.col("title")))).alias("words")).withColumn("key", F.array_join("words", " ")))
    r = cut(raw.where("raw_published is not null").select(F.col("raw_id").alias("id"), micros("raw_published").alias("at"), F.array_sort(F.array_distinct(words(F.col("raw_title")))).alias("words")).withColumn("key", F.array_join("words", " ")))
    sets = lambda df: df.where("key <> ''").select(F.lit(0).alias("run"), "key", "words").distinct()
    day, titles, left, found = 86_400_000_000, sets(r), i.where("key <> ''"), None
    for share in SHARES:
        alike = pairs(sets(left), titles, share).select(F.col("a").alias("own"), F.col("b").alias("key"), (F.col("both") / F.col("smaller")).alias("score"))
        asked = left.select("id", "t", F.col("key").alias("own")).join(alike, "own").select("key", (F.col("t") + AFTER_DAYS * day).alias("at"), "id", "t", "score")
        near = newest_at(r, asked).where(F.col("last.at") >= F.col("t") - BEFORE_DAYS * day)
        best = cut(near.groupBy("id").agg(F.max(F.struct("score", "last.at", "last.least")).alias("m")))
        found = best if found is None else found.unionByName(best)
        left = left.join(best, "id", "left_anti")
        if left.isEmpty():
            break
    return found.select("id", (-F.col("m.least")).alias("raw_id"), F.round("m.score", 6).alias("score"))


def search_scores(items: DataFrame, found: DataFrame) -> DataFrame:
    """The best original source that a search found for each item: official and company pages, by likeness and kind of page.

    items: id, title, summary; found: id, url, hit_title. Pages that only list others don't count; a page of a company
    that the item doesn't name needs a similar title.
    """
    # What a page's address alone decides is asked once for each address.
    pages = found.select("url").distinct().withColumns({"is_index": urls.is_index(F.col("url")), "page": F.struct(urls.is_official_host(F.col("url")).alias("official"), urls.has_company_path(F.col("url")).alias("company"), urls.brand(F.col("url")).alias("brand"))})
    # What an item's own text gives is worked out once for the item, and kept by generators: no later rule or filter repeats it.
    text, once = F.concat_ws(" ", "title", "summary"), lambda value: F.explode(F.array(value))
    compact = F.replace(T.normalised(text), F.lit(" "), F.lit(""))
    asked = items.select("id", text.alias("text"), F.inline(F.array(F.struct(words(text).alias("own"), compact.alias("compact"), (F.size(T.quoted(F.col("summary"))) > 0).alias("quotes")))))
    x = found.join(pages.where("not is_index"), "url").join(asked, "id").select("*", once(urls.role(F.col("url"), F.col("text"))).alias("r"))
    x = x.where(F.col("r.role") == "primary").select("*", once(words(F.col("hit_title"))).alias("hit"))
    likeness = containment(F.col("own"), F.col("hit"))
    x = x.withColumns({"likeness": likeness, "named": F.contains(F.col("compact"), F.col("page.brand"))}).where("named or likeness >= 0.25")
    extra = lambda c, n: F.when(c, n).otherwise(0.0)
    score = F.col("likeness") + F.when(F.col("r.quality") == "official", 1.2).otherwise(1.0) + extra(F.col("page.official"), 0.4) + extra(F.col("page.company"), 0.35)
    score = score + extra(F.col("quotes"), 0.25)
    per_url = x.groupBy("id", "url").agg(F.max(F.round(score, 6)).alias("score"))
    return per_url.groupBy("id").agg(F.max_by("url", F.struct("score", "url")).alias("url"), F.max("score").alias("score"))


def chosen(items: DataFrame, sources: DataFrame, searched: DataFrame, raw_best: DataFrame) -> DataFrame:
    """(id, method, url, role): the first of CHAIN that gives a source; no row where none does.

    items: see leading(); sources: from leading(items); searched: id, url; raw_best: id, url, score.
    """
    roles = ("primary", "primary", "primary", "primary", "trusted_secondary", "trusted_secondary")
    step = lambda prio, url: F.struct(F.lit(prio).alias("prio"), F.lit(CHAIN[prio]).alias("method"), url.alias("url"), F.lit(roles[prio]).alias("role"))
    given = lambda prio, url, holds=None: F.when(url.isNotNull() if holds is None else holds, step(prio, url))
    u = F.col("url")
    primary, secondary = (F.col("role") == "primary") & ~urls.is_index(u), F.col("role") == "trusted_secondary"
    # An event gives at most two sources to its items, which are asked for all that they and their event know in one row.
    events = sources.groupBy("event_key").agg(F.min_by(F.when(primary, u), F.when(primary, F.struct("rank", "url"))).alias("primary"), F.min_by(F.when(secondary, u), F.when(secondary, F.struct("rank", "url"))).alias("secondary"))
    mates_ = items.select("id", "event_key").join(events.hint("merge"), "event_key").select("id", F.coalesce(given(1, F.col("primary")), given(4, F.col("secondary"))).alias("c"))
    own = sourced(items).select("id", F.coalesce(given(0, u, urls.is_specific(u) & ~urls.is_index(u)), given(5, u, F.col("role") == "trusted_secondary")).alias("c"))
    raw = raw_best.where((F.col("score") >= LEAST_TITLE) & urls.is_specific(u)).select("id", step(3, u).alias("c"))
    every = own.unionByName(mates_).unionByName(searched.select("id", step(2, u).alias("c"))).unionByName(raw).where("c is not null")
    return every.groupBy("id").agg(F.min("c").alias("c")).select("id", "c.method", "c.url", "c.role")


def supporting(sources: DataFrame, main: DataFrame, texts: DataFrame) -> DataFrame:
    """(event_key, place, url): up to KEPT of the first TRIED other sources of an event whose text has LEAST_TEXT characters.

    sources: from leading(); main: event_key, url of the main source; texts: url, chars. What an event's sources support is decided once for
    the event; handed() gives it to its items.
    """
    x = sources.select("event_key", "rank", "url").join(main.select("event_key", F.col("url").alias("main")), "event_key", "left").where("main is null or url <> main")
    by = Window.partitionBy("event_key").orderBy("rank")
    x = x.withColumn("tried", F.row_number().over(by)).where(F.col("tried") <= TRIED).join(texts, "url").where(F.col("chars") >= LEAST_TEXT)
    return x.withColumn("place", F.row_number().over(by)).where(F.col("place") <= KEPT).select("event_key", "place", "url")


# Queries: items made from events, with URLs of hosts of every kind.

HOSTS = ["www.ssb.no", "www.reuters.com", "equinor.com", "blog.example.com", "dn.no", "live.euronext.com", "newsweb.no", "nvidia.com", "finance.yahoo.com", "www.sec.gov"]
PATHS = ["/statistikk/1", "/news/", "/investor/q2", "/", "/en/company-news/7", "/index.html", "/a/b?utm_source=x&b=2&a=1#top", "/press/releases/5"]
SCHEMES = ["https://", "https://", "https://", "http://", "https://user:pw@"]


def item_url(k: Column) -> Column:
    return F.concat(pick(SCHEMES, k), pick(HOSTS, k), pick(PATHS, F.floor(k / 3).cast("long")))


def items(spark: SparkSession, d: str) -> DataFrame:
    h = headlines(spark, d)
    summary = F.when(F.col("id") % 4 != 0, F.concat(F.lit("Summary of item "), F.col("id").cast("string"), F.lit(" with enough text")))
    return h.select("id", "title", summary.alias("summary"), item_url(F.col("id")).alias("url"), "score", "published", F.concat_ws("|", (F.col("user_id") % 97).cast("string"), "source_kind", F.to_date("published").cast("string")).alias("event_key"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return items(spark, d).select("id", urls.canonical(u).alias("canonical"), urls.cleaned(u).alias("cleaned"), urls.brand(u).alias("brand"), urls.is_index(u).alias("is_index"), urls.is_specific(u).alias("specific"), urls.is_official_host(u).alias("official_host"), urls.has_company_path(u).alias("company_path"))


def standard_forms(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in other spellings than the standard one, the form they come to, and the rules on it."""
    i = F.col("event_id")
    spelt = [
        F.concat(F.lit("HTTPS://WWW.Example.NO:443/a/../b/./"), i), F.concat(F.lit(" http://0x7f.1/%41 é?q='"), i), F.concat(F.lit("https:\\\\Bücher.example\\x#"), i),
        F.concat(F.lit("http://[2001:DB8:0:0::"), F.hex(i % 65536), F.lit("]:80")), F.concat(F.lit("https://a.no/x?utm_source=1&b=2&a="), i), F.concat(F.lit("http://a b.no/"), i), F.concat(F.lit("https://u:p@a.no/"), i),
    ]
    url = F.coalesce(*[F.when(i % len(spelt) == n, u) for n, u in enumerate(spelt)])
    x = table(spark, d, "events").select(i.alias("id"), in_standard_form(url).alias("standard"))
    return x.select("id", "standard", urls.canonical(F.col("standard")).alias("canonical"), urls.host(F.col("standard")).alias("host"))


def source_role(spark: SparkSession, d: str) -> DataFrame:
    r = urls.role(F.col("url"), F.concat_ws(" ", "title", "summary"))
    x = sourced(items(spark, d)).withColumn("r", r)
    return x.select("id", F.col("r.role").alias("url_role"), F.col("r.quality").alias("url_quality"), "role", "method", urls.paper(F.col("url")).alias("paper"))


def public_addresses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    octet = lambda n: (i * n % 256).cast("string")
    six = F.concat(pick(["2a00", "fe80", "2001:db8", "3fff", ""], i), F.lit(":"), F.hex(i), F.lit("::1"))
    a = F.when(i % 3 == 0, six).when(i % 7 == 0, F.concat_ws(".", F.lit("300"), octet(3), octet(5), octet(7))).otherwise(F.concat_ws(".", octet(1), octet(37), octet(5), octet(7)))
    return table(spark, d, "events").select(i.alias("id"), urls.is_public(a).alias("public"))


def publication_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Pages made from events that state their date in eight ways."""
    i, stamp = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    meta = lambda name, s: F.concat(F.lit(f'<meta {name} content="'), s, F.lit('">'))
    linked = lambda kind, s: F.concat(F.lit(f'<script type="application/ld+json">{{"@graph": [{{"@type": "{kind}", "datePublished": "'), s, F.lit('"}]}</script>'))
    nothing, other = F.lit(""), F.lit("2020-01-01T00:00:00Z")
    first = F.when((i % 8).isin(0, 1, 2), meta('property="article:published_time"', stamp)).when(i % 8 == 3, meta('name="date"', stamp)).when(i % 8 == 4, meta('itemprop="datePublished"', F.lit("2024-02-31T10:00:00Z"))).otherwise(nothing)
    second = F.when(i % 8 == 1, linked("NewsArticle", stamp)).when(i % 8 == 2, linked("Article", other)).when(i % 8 == 5, linked("Article", stamp)).when(i % 8 == 6, linked("Person", stamp)).otherwise(nothing)
    p = publication(F.concat(F.lit("<html><head>"), first, second, F.lit("</head></html>")))
    return table(spark, d, "events").select(i.alias("id"), p.alias("p")).select("id", F.unix_seconds("p.at").alias("second"), "p.kind", "p.raw")


def strict_dates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    date = F.concat(F.date_format("ts", "yyyy-MM-"), F.lpad((i % 33).cast("string"), 2, "0"))
    text = F.concat(date, F.date_format("ts", "'T'HH:mm"), F.when(i % 2 == 0, F.date_format("ts", ":ss")).otherwise(""), pick(["Z", "+02:00", "-0530", ""], i))
    return table(spark, d, "events").select(i.alias("id"), F.unix_seconds(timing.strict_iso(text)).alias("second"))


def cluster_mates(spark: SparkSession, d: str) -> DataFrame:
    return mates(items(spark, d)).select("item", "rank", "mate", "url", "role", "method")


def title_range_match(spark: SparkSession, d: str) -> DataFrame:
    """Clicks' headlines against the headlines of all errors published around them."""
    h = headlines(spark, d)
    raw = h.where("source_kind = 'error'").select(F.col("id").alias("raw_id"), F.col("title").alias("raw_title"), F.col("published").alias("raw_published"))
    return best_titles(h.where("source_kind = 'click'"), raw)


def _searched(x: DataFrame) -> DataFrame:
    found = x.select(F.explode(F.array(F.col("id") - 1, F.col("id") - 2)).alias("id"), "url", F.col("title").alias("hit_title"))
    return search_scores(x.select("id", "title", "summary"), found)


def source_search(spark: SparkSession, d: str) -> DataFrame:
    """Each item's search finds the next event's page and the one after it."""
    return _searched(items(spark, d))


def source_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each item's main source: its searches and the titles of raw items are those of source_search and title_range_match."""
    x = cut(items(spark, d))
    raw = title_range_match(spark, d).join(x.select(F.col("id").alias("raw_id"), "url"), "raw_id")
    return chosen(x, leading(x), _searched(x), raw.select("id", "url", "score"))


def supporting_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each item's other sources than the first of its event."""
    x = items(spark, d)
    sources = cut(leading(x))
    texts = x.groupBy("url").agg(F.min("id").alias("i")).select("url", (F.col("i") * 7 % 90).alias("chars"))
    return handed(x, supporting(sources, sources.where("rank = 1"), texts)).select(F.col("item").alias("id"), "place", "url")
