"""Patterns looked up in tokens against the patterns themselves, on texts made of their own words."""

import random
import re

import pytest

from pressloom.functions import phrases as P
from pressloom.functions import scoring as S
from pressloom.functions import vocabulary as V
from pyspark.sql import functions as F

EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
EVERY = {**{f"r_{k}": v for k, v in S.RELEVANCE.items()}, **{f"t_{k}": v for k, v in S.TRIAGE.items()}}
EVERY["audience"] = [V.AUDIENCE_NORWEGIAN, V.AUDIENCE_GLOBAL, V.AUDIENCE_EVENT, V.AUDIENCE_NOISE]


def plain(pattern, text):
    wide = pattern.replace(r"\b", EDGE).replace(r"\w", "[A-Za-z0-9_]").replace(r"\d", "[0-9]")
    # Without full case folding these three signs match no ASCII letter.
    return re.search(wide, re.sub("[\u212a\u212b\u0130]", "\x01", text), re.IGNORECASE) is not None


def texts(n, seed):
    rng = random.Random(seed)
    words = sorted({w for ps in EVERY.values() for p in ps for w in re.findall(r"[^\W_]+(?:[ &/.-][^\W_]+)*", re.sub(r"\\[bswd]", " ", p))})
    joins, odd = [" ", "  ", "-", ", ", "", "_", "\n", "ø", " ", "/"], ["makroøkonomi", "Økonomien", "aØkonomisk", "BUD PÅx", "bud på", "xårsresultat", "up 3,5 %x", "down 12%", "S&P  500", "CEO of Aker resigns", "norskeid", "shares\tsurges", "Keyence oİl", "NOK", "eur/nok", "RÅVAREMARKED"]
    for i in range(n):
        out = ""
        for _ in range(rng.randint(0, 9)):
            w = rng.choice(odd) if rng.random() < 0.15 else rng.choice(words)
            out += rng.choice([w, w.upper(), w.title(), w]) + rng.choice(joins if rng.random() < 0.4 else [" "])
        yield i, out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_each_pattern(spark, seed):
    rows = list(texts(1500, seed))
    got = P.with_counts(spark.createDataFrame(rows, "id int, text string"), F.col("text"), EVERY).collect()
    some = 0
    for r in got:
        want = {f"__{k}": sum(plain(p, dict(rows)[r["id"]]) for p in ps) for k, ps in EVERY.items()}
        assert {k: r[k] for k in want} == want, dict(rows)[r["id"]]
        some += sum(want.values())
    assert some > 3000


def test_what_is_compiled():
    assert P.compiled(V.COMPANY[2]).phrases >= {"bank of america", "ubs"} and not P.compiled(V.COMPANY[2]).rest
    assert P.compiled(V.STRONG[10]).phrases >= {"nok", "eur/nok"}
    assert P.compiled(V.AUDIENCE_EVENT).stems >= {"guid", "rate"}
    assert [w for _, w in P.compiled(V.TRIAGE_MARKET_MOVE[0]).rest] == [["share", "shares", "stock"]]
    assert sum(len(P.compiled(p).rest) for ps in EVERY.values() for p in ps) < 15


def test_edges(spark):
    rows = [(1, ""), (2, None), (3, "x " * 40_000 + "bank of england")]
    got = {r["id"]: r["__r_strong"] for r in P.with_counts(spark.createDataFrame(rows, "id int, text string"), F.coalesce("text", F.lit("")), EVERY).collect()}
    assert got == {1: 0, 2: 0, 3: 2}
    assert [r[0] for r in spark.createDataFrame([("GDELT world",), ("x",)], "t string").select(P.names(F.col("t"), "gdelt|Google News")).collect()] == [True, False]
