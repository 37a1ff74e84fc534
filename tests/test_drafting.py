"""Drafts made from long texts, against plain Python."""

import re

from pyspark.sql import functions as F

from pressloom.functions.scoring import squeezed
from pressloom.operators import drafting


def test_squeezed_holds_for_any_length(spark):
    long = "word " * 40_000
    texts = ["a b", "", " ", " a", "a ", "a  b", "a\tb", "a\nb", "a b\n", "å b", "a  b", "a ", long, long.strip(), long + "\n", None]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", squeezed(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [None if t is None else re.sub(r"\s+", " ", t).strip() for t in texts]


def test_drafts_of_long_and_absent_texts(spark, tmp_path):
    line = "word " * 30_000
    spark.createDataFrame([(1, f"{line}\n\n  last line "), (2, None), (13, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.id: r for r in drafting.draft_shape(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 13]
    assert rows[1].paragraphs == 2 and rows[1].analysis_chars == drafting.ANALYSIS and rows[1].words == 30_002 + 84 and not rows[1].passed
    assert rows[13].paragraphs == 0 and rows[13].words == 0


def test_window_holds_its_line_once(spark):
    """The line of a text stands in the plan once, and is the part around the title's first long word."""
    from pressloom.functions import text as T

    parts = ["ord  \t om\nalt ", "x " * 50 + "uventet  slutt", None, " \n"]
    x = spark.createDataFrame([(i, t) for i, t in enumerate(parts)], "i int, t string").select("i", T.window_of(F.col("t"), F.lit("en uventet tittel"), 20, 6).alias("w"))
    assert [r.w for r in x.orderBy("i").collect()] == ["ord om alt", ("x " * 50 + "uventet slutt")[100 - 6 :][:20], "", ""]
    assert x._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(coalesce(t") == 1
