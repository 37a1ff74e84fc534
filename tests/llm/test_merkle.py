"""The manifest against trees built in plain Python, with nulls, ties, lone leaves and leaves chosen out of many."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from pressloom.llm import merkle, ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at int, digest string, level int"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(r, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def grown(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0], leaf(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {lang: grown([x[1] for x in by[lang]]) for lang in langs}
    crown, out = grown([trees[x][-1][0] for x in langs]), []
    for k, lang in enumerate(langs):
        for i, (doc_id, own, r) in enumerate(by[lang]):
            steps, folded = path(trees[lang], i) + path(crown, k), own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and r[1] is not None:
                folded = leaf(r, r[1].translate(str.maketrans(merkle.UPPER, merkle.LOWER)))
            for left, right in steps:
                folded = digest(left + folded + right)
            out.append((doc_id, own, trees[lang][-1][0], crown[-1][0], digest("".join(a + b for a, b in steps)), folded, folded == crown[-1][0]))
    return sorted(out, key=str)


def table(n):
    rows = [(i, ["Some Text", "ÅÄ lower", None, "", "x" * 300_000][i % 5], ["en", "de", None, "", "fr"][min(i * i % 7, 4)], None if i % 4 == 0 else "src", i if i % 3 else None, "t", 1, "d", 2) for i in range(n)]
    return rows + [rows[3], rows[3], (None, "No id", "en", "s", 5, "t", 1, "d", 2), (7, "Alone", "øl", "s", 5, "t", 1, "d", 2)]


@pytest.mark.parametrize("n", [0, 5, 90])
def test_equals_plain_trees(spark, n):
    rows = table(n) if n else []
    got = merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == (expected(rows) if rows else [])


def test_large_blocks(spark):
    rows = [(i, f"Text {i}", "en" if i % 50 else "de", "s", i, "t", 1, "d", 2) for i in range(9_000)]
    got = merkle.verified(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_blocks_share_copies_of_nodes(spark, monkeypatch):
    """With small blocks every kind of request occurs: own levels, shared copies, tops."""
    monkeypatch.setattr(merkle, "BLOCK", 64)
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SHARED", 2)
    rows = [(i, f"Text {i}", "en" if i % 9 else "de", "s", i, "t", 1, "d", 2) for i in range(1_500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, merkle.verified(docs).collect()), key=str) == expected(rows)
    some = spark.createDataFrame([(x,) for x in (3, 4, 700, 1_499, 10**9)], "doc_id long")
    got = {x["doc_id"]: x for x in merkle.proofs(docs, some).collect()}
    whole = {x["doc_id"]: x for x in merkle.proofs(docs).collect()}
    assert sorted(got) == [3, 4, 700, 1_499] and all(whole[k] == x for k, x in got.items())


def test_fewest_nodes():
    """missing() asks for no node that the own leaves give, and for all others that a path needs."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 8, 9, 70, 600):
        leaves = [digest(str(i)) for i in range(n)]
        levels = grown(leaves)
        for k in {1, min(n, 5), n}:
            own = np.sort(rng.choice(n, k, replace=False))
            need = merkle.missing(own, n)
            assert len(need) == len(set(need))
            for level, at in need:
                assert not any(int(x) // 8**level == at for x in own)
            found = merkle.expanded({int(x): leaves[x] for x in own}, {(a, b): levels[a][b] for a, b in need}, n)
            assert found == {int(x): path(levels, int(x)) for x in own}


def test_positions(spark):
    rows = [(("a", "b", None)[i % 3 and 1 + i % 2], i * 7 % 50) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(7)
    got = defaultdict(list)
    for r in ranks.ranked(df, ["g"], ["x"], "at").collect():
        got[r["g"]].append((r["at"], r["x"]))
    for g, found in got.items():
        assert [a for a, _ in sorted(found)] == list(range(len(found))) and [x for _, x in sorted(found)] == sorted(x for k, x in rows if k == g)
