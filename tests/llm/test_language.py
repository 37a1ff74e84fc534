"""Viterbi against a plain one, spans of mixed texts, scripts, accuracy on texts held out, and the odd rows."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from pressloom.llm import language_id as L

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, score double, held_out int"


def plain(score, first, prior, penalty):
    best = []
    for a, b in zip(first[:-1], first[1:]):
        value, back = np.array(prior, float), []
        for row in score[a:b]:
            away = value.max() - penalty
            back.append(np.where(away > value, value.argmax(), np.arange(len(value))))
            value = np.maximum(value, away) + row
        best.append(value.max() if b > a else None)
    return best


def cost(score, first, prior, penalty, state):
    out = []
    for a, b in zip(first[:-1], first[1:]):
        path = state[a:b]
        if not len(path):
            out.append(None)
            continue
        start = max(prior[path[0]], prior.max() - penalty)
        out.append(start + score[np.arange(a, b), path].sum() - penalty * (path[1:] != path[:-1]).sum())
    return out


@pytest.mark.parametrize("states", [1, 2, 5])
def test_viterbi_is_exact(states):
    rng = np.random.default_rng(states)
    count = np.array([0, 1, 31, 32, 33, 64, 0, 500, 7, 129])
    first = np.concatenate(([0], np.cumsum(count)))
    score, prior = -3 * rng.random((first[-1], states)) * rng.integers(0, 2, (first[-1], states)), np.log(rng.random(states))
    found = L.viterbi(score, first, prior, 2.5)
    for a, b in zip(cost(score, first, prior, 2.5, found), plain(score, first, prior, 2.5), strict=True):
        assert (a is None and b is None) or abs(a - b) < 1e-9


def docs():
    return [(r["doc_id"], r["text"], r["lang"], "s", 0.0, 1) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def test_held_out_accuracy(spark):
    rows = docs()
    want = {r[0]: r[2] for r in rows}
    found = L.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    held = [r["lang_pred"] == want[r["doc_id"]] for r in found if r["held_out"]]
    assert len(found) == len(rows) and len(held) > 200 and np.mean(held) > 0.98


def test_only_learned_rows_matter(spark):
    """Languages and sources of held out rows change nothing, nor does any language where a text is predicted."""
    rows = docs()
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    other = [(i, t, "xx" if out(i) else g, "other", 9.0, 0) for i, t, g, *_ in rows]
    a, b = ({r["doc_id"]: tuple(r) for r in L.report(spark.createDataFrame(x, SCHEMA)).collect()} for x in (rows, other))
    assert a == b


def test_spans_of_mixed_texts(spark):
    rows = docs()
    model = L.fit(spark.createDataFrame([x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2], SCHEMA))
    held = {g: max((x[1] for x in rows if x[2] == g and zlib.crc32(str(x[0]).encode()) % 4 == 2 and "$" not in x[1]), key=len) for g in ("de", "fr", "en")}
    parts = [(g, " ".join(held[g].split()[:120])) for g in ("de", "fr", "en")]
    text = "\n".join(x for _, x in parts)
    found = [(r["lang"], text[r["begin"] : r["end"]]) for r in sorted(L.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect(), key=lambda r: r["begin"])]
    assert [g for g, _ in found] == ["de", "fr", "en"]
    for (_, got), (_, want) in zip(found, parts):
        assert abs(len(got) - len(want)) < 30


def test_scripts_narrow_and_odd_rows(spark):
    rows = [(4 * i, t, g, "s", 0.0, 1) for i, (t, g) in enumerate([("добрый день товарищ", "ru"), ("good day comrade", "en"), ("καλημέρα σας", "el")] * 30)]
    rows = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    model = L.fit(spark.createDataFrame(rows, SCHEMA))
    odd = ["день", "ΣΑΣ", "GOOD", "123 --- !!", "", None, "中文", "day " * 100_000 + "день", "ж" * 300_000]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predictions(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()}
    assert [found[i][0] for i in range(6)] == ["ru", "el", "en", "und", "und", "und"] and found[6][1] == 0.0 and found[6][0] in ("ru", "en", "el")
    assert found[7][0] == "en" and 0.99 < found[7][1] < 1 and found[8] == ("ru", 1.0) and found[3][1] == 0.0


def test_nothing_to_learn_from(spark):
    rows = [(1, "some text", None, "s", 0.0, 1), (None, "more", None, None, None, None)]
    assert {(r["doc_id"], r["lang_pred"], r["score"], r["held_out"]) for r in L.report(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, "und", 0.0, False), (None, "und", 0.0, False)}
    assert L.report(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = [(5, "same text here", "en", "s", 0.0, 1)] * 2 + [(None, "same text here", "en", "s", 0.0, 1)]
    assert {r["lang_pred"] for r in L.report(spark.createDataFrame(twice, SCHEMA)).collect()} == {"en"}
