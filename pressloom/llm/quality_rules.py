"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Frequent words of the four languages: fixed values.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "was", "on", "as",
    "der", "die", "das", "und", "ist", "ein", "eine", "nicht", "mit", "zu", "den", "von", "auf", "für",
    "el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "no", "por", "con", "para",
    "le", "les", "des", "et", "est", "une", "dans", "pour", "qui", "sur", "au", "pas",
]
#: (name, numerator, denominator, least, most): a text fails where numerator / denominator is outside.
THRESHOLDS = [
    ("words", "n_words", None, 50, 1_000_000),
    ("word_length", "word_chars", "n_words", 2, 15),
    ("symbols", "n_symbols", "n_words", 0, 0.1),
    ("stop_words", "n_stop_words", None, 2, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", 0, 0.3),
    ("bullet_lines", "n_bullet_lines", "n_lines", 0, 0.9),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", 0, 0.3),
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` applied to `value`, which is computed once though `use` names it in a loop."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in windows of `window` words that are found twice or more."""

    def of(w: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(window)]).alias("h"), i.alias("i")))
        return let(F.array_sort(places), doubled)

    def doubled(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(window)])))))

    return F.when(F.size(words) > window, let(words, of)).otherwise(F.lit(0)).cast("long")


def passed() -> Column:
    tests = []
    for _, part, whole, least, most in THRESHOLDS:
        scale = F.lit(1) if whole is None else F.col(whole)
        tests += [F.col(part) >= least * scale] if least is not None else []
        tests += [F.col(part) <= most * scale] if most is not None else []
    out = tests[0]
    for x in tests[1:]:
        out = out & x
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use, for each row of `docs`. A null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    count = lambda x: F.size(x).cast("long")
    return rows.select(
        "doc_id", count("words").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"), count("lines").alias("n_lines"),
        count(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"), count(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).alias("n_bullet_lines"),
        count(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the other counts.

    Null, empty and wordless texts have no words, so they fail; a row without an id is judged like any other; rows that repeat
    one another are each judged; other columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passed())
