"""Text, URL, hash and matching queries over pages, documents and headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..sources.tables import headlines, table

#: Words that titles are compared without: fixed values.
STOP = ["the", "and", "for", "with", "after", "its", "over", "again", "new"]


def normalised_titles(spark: SparkSession, d: str) -> DataFrame:
    return headlines(spark, d).select("id", T.normalised(F.col("title")).alias("plain"), T.slug(F.col("title")).alias("slug"), F.array_join(F.array_sort(T.tokens(F.col("title"), STOP)), " ").alias("tokens"))


def title_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different titles of at least 0.52 similarity.

    A pair that similar shares 0.385 of the smaller title's words or more (0.52 / 1.35). So the smaller title only asks by its
    rarest words, as many as must hold one of the shared ones: its most common words bring nothing together.
    """
    titles = headlines(spark, d).select("title").distinct().withColumn("t", T.tokens(F.col("title"), STOP))
    words = titles.select("title", "t", F.size("t").alias("m"), F.explode("t").alias("w"))
    common = words.groupBy("w").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("title").orderBy("df", "w"))
    asking = words.join(common, "w").withColumn("rank", rank).where(F.col("rank") <= F.col("m") - F.ceil(F.col("m") * 0.385) + 1)
    other = words.select(F.col("title").alias("other"), F.col("t").alias("u"), F.col("m").alias("n"), "w")
    pairs = asking.join(other, "w").where("title <> other and m <= n")
    pairs = pairs.select(F.least("title", "other").alias("title"), F.greatest("title", "other").alias("other"), F.when(F.col("title") < F.col("other"), F.col("t")).otherwise(F.col("u")).alias("t"), F.when(F.col("title") < F.col("other"), F.col("u")).otherwise(F.col("t")).alias("u")).distinct()
    return pairs.select("title", "other", F.round(T.similarity(F.col("t"), F.col("u")), 6).alias("similarity")).where("similarity >= 0.52")


def event_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows per event: a hash of the UTC day and the first ten tokens of the title."""
    h = headlines(spark, d)
    day = F.date_format(F.col("published"), "yyyy-MM-dd")
    words = F.array_join(F.slice(T.tokens(F.col("title"), STOP), 1, 10), "-")
    key = F.substring(F.sha1(F.concat_ws("|", day, words)), 1, 20)
    return h.groupBy(key.alias("event_key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.count_distinct("user_id").alias("users"))


def clean_urls(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    url = urls.cleaned(F.col("url"))
    return p.select("page_id", url.alias("clean"), T.domain(F.col("url")).alias("domain"), F.substring(F.sha2(F.concat_ws("|", url, F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)), 256), 1, 48).alias("external_id"))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    title = T.html_text(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1))
    links = F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", title.alias("title"), T.xml_escaped(title).alias("title_xml"), F.sha2(T.html_text(html), 256).alias("text_sha256"), F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("different_links"))


def domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(T.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"), F.count_if(F.col("url").startswith("https://")).alias("secure"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda x: x != "")
    paragraphs = F.filter(F.split("text", r"\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.size(paragraphs).cast("long").alias("paragraphs"), F.size(F.regexp_extract_all("text", F.lit(r"\d+(?:[,.]\d+)?"), F.lit(0))).cast("long").alias("numbers"))


#: Items whose quote has at most two words, which no whole word can index: so many are compared with all texts.
SHORT = 1_000


def quote_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Per item: how many documents hold its first sentence of twelve characters or more, word for word.

    Quotes and texts meet over whole words inside the quote, two of them or, in quotes of three words, one; ids are joined first
    and texts fetched for candidates only. Quotes of one or two words are compared with every text, if there are no more than SHORT.
    """
    quote = F.trim(F.regexp_extract("text", r"^([^.]{12,}\.)", 1))
    two = lambda w, i: F.array_join(F.slice(w, i, 2), " ")
    b = table(spark, d, "benchmark").select("item_id", quote.alias("quote"), F.split(quote, "[ \n]").alias("q")).where("quote <> ''")
    b = b.select("item_id", "quote", F.when(F.size("q") > 3, two(F.col("q"), 2)).when(F.size("q") == 3, F.get("q", F.lit(1))).alias("lead"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    # The words are split once: inside the loop they are a variable of it.
    pairs = lambda w: F.concat(w, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))
    asked = b.select("lead").where("lead is not null").distinct()
    leads = docs.select("doc_id", F.explode(F.array_distinct(urls.let(F.split("text", "[ \n]"), pairs))).alias("lead")).join(asked, "lead", "left_semi")
    near = leads.join(b, "lead").select("doc_id", "item_id", "quote").distinct().join(docs, "doc_id")
    short = b.where("lead is null").limit(SHORT + 1)
    if short.count() > SHORT:
        raise ValueError(f"more than {SHORT} quotes of one or two words")
    every = docs.join(F.broadcast(short), F.contains("text", "quote")).select("item_id", "doc_id")
    hits = near.where(F.contains("text", "quote")).select("item_id", "doc_id").union(every).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n"))
    return b.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("documents"))


def source_quality(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels, per source: counts and shares of good and toxic ones."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.sum("n_chars").alias("chars"))


def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal texts: a hash, the least id, the size."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")
