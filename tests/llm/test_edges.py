"""Empty tables, nulls, repeats and clashing names where the larger tests don't have them."""

from pyspark.sql import functions as F

from pressloom.llm import decontamination, near_dedup, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filter
from pressloom.llm.queries import tokenizer_path

NAMES = ["host", "path", "suffix", "rule", "labels", "lengths", "digest", "short", "words", "lines", "n_words", "score", "key", "__id", "__th", "__spans", "row", "spans"]
TEXT = " ".join(f"word{i}" for i in range(120))


def clashing(df):
    return df.select("*", *[F.lit("x").alias(n) for n in NAMES if n not in df.columns])


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.com/fr/x"), (1, "http://a.com/fr/x"), (2, None), (None, "http://a.com/de/"), (3, "")], "page_id long, url string")
    got = url_filter.judge(clashing(pages)).collect()
    assert sorted((str(r.page_id), r.host, r.rule, r.verdict) for r in got) == [("1", "a.com", "com/fr/", "allow")] * 2 + [("2", "", None, "allow"), ("3", "", None, "allow"), ("None", "a.com", "com/de/", "block")]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_rules_and_counts(spark):
    docs = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, None), (3, ""), (None, " \n\t")], "doc_id long, text string")
    got = quality_rules.judge(clashing(docs)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.base_failed) for r in got) == [("1", 120, False), ("1", 120, False), ("2", 0, True), ("3", 0, True), ("None", 0, True)] and not any(r.kept for r in got if r.base_failed)
    assert quality_rules.judge(docs.limit(0)).count() == 0
    counts = token_counts.histogram(clashing(docs), tokenizer_path()).collect()
    assert sum(r.n_docs for r in counts) == 5 and min(r.n_tokens for r in counts) == 0 and {r.total_docs for r in counts} == {5}
    assert token_counts.histogram(docs.limit(0), tokenizer_path()).count() == 0


def test_classifier(spark):
    rows = [(i, f"good words here {i % 3}") for i in range(30)] + [(100 + i, f"bad stuff $$$ {i % 3}") for i in range(30)] + [(0, "good words here 0"), (200, None), (201, ""), (None, "good words here 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i is not None and i < 130] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality_classifier.select(clashing(docs), labels).collect()
    assert len(got) == len(rows) and all(r.score is None and not r.kept for r in got if r.doc_id in (200, 201))
    assert len({(r.score, r.key, r.kept) for r in got if r.doc_id == 0}) == 1
    kept = quality_classifier.kept(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and kept.count() == sum(r.kept for r in got)


def test_clashing_columns(spark):
    docs = clashing(spark.createDataFrame([(1, TEXT), (2, TEXT), (3, "other text"), (None, None)], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    for out, ids in (
        (suffix_dedup.stripped(docs, window=100), [None, 1, 2, 3]), (suffix_dedup.stripped(docs, words=51), [None, 1, 2, 3]), (near_dedup.deduplicated(docs), [None, 1, 3]), (decontamination.clean(docs, bench), [None, 3]),
    ):
        rows = out.collect()
        assert out.columns == docs.columns and sorted((r.doc_id for r in rows), key=lambda x: x or 0) == ids
        assert all(r[n] == "x" for r in rows for n in NAMES)
