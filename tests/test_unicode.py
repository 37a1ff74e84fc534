"""Normal forms against unicodedata, on every code point and on strings of several."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from pressloom.functions import scoring, text, unicode

EVERY = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]


def letters(s):
    plain = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not 0x300 <= ord(c) < 0x370)
    return re.sub("[^a-z0-9æøå]+", " ", plain).strip(" ")


def test_every_code_point(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(EVERY)], "i int, c string").repartition(4)
    got = df.select("i", *(unicode.normalised(F.col("c"), f).alias(f) for f in ("NFKC", "NFKD")), text.normalised(F.concat(F.lit("x"), "c", F.lit("y"))).alias("plain")).toPandas().sort_values("i")
    for form in ("NFKC", "NFKD"):
        assert got[form].tolist() == [unicodedata.normalize(form, c) for c in EVERY]
    wrong = [(hex(ord(c)), a, letters(f"x{c}y")) for c, a in zip(EVERY, got["plain"]) if a != letters(f"x{c}y")]
    assert not wrong, wrong[:10]


def test_strings(spark):
    rng = random.Random(5)
    pool = [chr(c) for c in (0x61, 0x41, 0x65, 0x301, 0x323, 0x308, 0x30A, 0xC5, 0x212B, 0xFB01, 0xFF21, 0xFF4B, 0x1E9B, 0x2460, 0xBD, 0xD55C, 0x1112, 0x1161, 0x11AB, 0x20, 0x3042, 0x5E9, 0x5C1, 0x1D400, 0xF8, 0xE6)]
    rows = [(i, "".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(2000)] + [(2000, None), (2001, ""), (2002, "plain ascii only"), (2003, "é" * 100_000)]
    got = spark.createDataFrame(rows, "i int, s string").select("i", *(unicode.normalised(F.col("s"), f).alias(f) for f in ("NFC", "NFD", "NFKC", "NFKD")), text.normalised(F.col("s")).alias("plain")).collect()
    for r, (_, s) in zip(sorted(got), rows):
        for form in ("NFC", "NFD", "NFKC", "NFKD"):
            assert r[form] == (None if s is None else unicodedata.normalize(form, s))
        assert r["plain"] == (None if s is None else letters(s))


def test_words_of_titles(spark):
    rows = [("Ｅquinor raises dividend", ["equinor", "raise", "dividend"]), ("Łódź ﬁnance Ⅳ", ["dz", "finance"]), ("Börs fåller", ["bors", "faller"])]
    got = spark.createDataFrame(rows, "t string, w array<string>").select(scoring.triage_words(F.col("t")).alias("g"), "w").collect()
    assert [r.g for r in got][0] == rows[0][1] and [r.g for r in got][2] == rows[2][1]
    assert [r.g for r in got][1][-1] == "finance"
