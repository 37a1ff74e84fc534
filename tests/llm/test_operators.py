"""The ten operators against brute force on small tables with nulls, empties, repeats and hot groups."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pressloom.llm import decontamination, near_dedup, packing, phrase_dedup, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, url_filter
from pressloom.llm.queries import queries, tokenizer_path

WORD, TERM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found int, a string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéöñ", k=rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    shared, base = say(90), say(150).split(" ")
    out = [None, "", "  \n ", "one", "One two", say(3), say(13), say(9000), "x" * 900, "same line here\n" * 80, "é" * 500, "é" * 500]
    for i in range(40):
        out.append(say(rng.randint(5, 60)) + " " + shared + "\n" + say(rng.randint(0, 60)))
        near = list(base)
        for k in rng.sample(range(150), rng.randint(0, 9)):
            near[k] = rng.choice(words)
        out.append(" ".join(near))
    return out + [out[20]] * 5 + [say(rng.randint(1, 200)) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "hot" if i % 3 else None, len(t or ""), i, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_sharding(docs, texts, empty):
    got = sharding.interleaved(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    for null in (True, False):
        each = [sum(r.shard == s and (r.doc_id % 3 == 0) == null for r in got) for s in range(8)]
        assert max(each) - min(each) <= 2
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.interleaved(empty).count() == 0


def test_near_dedup(docs, texts, empty):
    sets = []
    for t in texts:
        w = re.findall(WORD, (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    want = [(len(s), top(i), top(i) == i) for i, s in enumerate(sets)]
    for members in (near_dedup.MEMBERS, 7):
        got = rows_of(near_dedup.components(docs, members=members))
        assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(sets))] == want
    kept = near_dedup.deduplicated(docs.union(docs.limit(3)))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if w[2]] and kept.columns == docs.columns
    assert near_dedup.components(empty).count() == 0


def test_ids_missing_or_repeated(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "other words here"), (9, "a b c d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.components(df).collect()}
    assert got == {(None, None, True), (4, 4, True), (9, 4, False)}
    for f in (phrase_dedup.digests, suffix_dedup.digests, sharding.interleaved, quality_rules.judge, lambda x: packing.pieces(x, tokenizer_path())):
        assert f(df.selectExpr("*", "string(null) AS source")).count() == 5


def test_phrase_dedup(docs, texts, empty):
    want, seen = [], {}
    for i, t in enumerate(texts):
        w, gone = re.findall(WORD, t or ""), set()
        keys = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        for k, x in enumerate(keys):
            if seen.setdefault(x, i) < i:
                gone |= set(range(k, k + 13))
        want.append((len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    for most in (phrase_dedup.MOST, 3, 1):
        got = rows_of(phrase_dedup.digests(docs, most=most))
        assert [(got[i].n_words, got[i].n_removed, got[i].kept_sha256) for i in range(len(texts))] == want
    assert phrase_dedup.digests(empty).count() == 0


def test_suffix_dedup(docs, texts, empty):
    raw, seen = [(t or "").encode() for t in texts], {}
    for b in raw:
        for k in range(len(b) - 399):
            seen[b[k : k + 400]] = seen.get(b[k : k + 400], 0) + 1
    want = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        want.append((len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    for most in (suffix_dedup.MOST, 3, 1):
        got = rows_of(suffix_dedup.digests(docs, most=most))
        assert [tuple(got[i])[1:] for i in range(len(texts))] == want
    out = suffix_dedup.stripped(docs)
    assert out.columns == docs.columns and out.where("n_chars <> length(text) or text like '%�%'").count() == 0
    assert suffix_dedup.digests(empty).count() == 0


def test_suffix_dedup_passages(spark, texts, tmp_path):
    """Passages of over 50 words that repeat are reported, though they have fewer than the 400 bytes that go."""
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choices("fghijk", k=4)) for _ in range(n))
    planted = say(51)
    texts = [*texts, f"{say(70)} {planted} {say(40)}", f"{say(9)}\n" + planted.replace(" ", "\n ") + f" {say(80)}", f"{say(60)} {planted[:-5]} {say(60)}", planted, say(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words, seen = [re.findall(WORD, t or "") for t in texts], {}
    for w in words:
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])] = seen.get(tuple(w[k : k + 51]), 0) + 1
    want = [len({x for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for x in range(k, k + 51)}) for w in words]
    assert len(planted) < 400 and want[-5:] == [51, 51, 0, 51, 0] and sum(map(bool, want)) < len(want) - 60
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = rows_of(suffix_dedup.digests(docs))
    for out in (queries()["op8_suffix_dedup"](spark, str(tmp_path)), suffix_dedup.digests(docs, most=3, words=51), suffix_dedup.digests(docs, most=1, words=51)):
        got = rows_of(out)
        assert [got[i].n_passage_words for i in range(len(texts))] == want
        assert [tuple(got[i])[:5] for i in range(len(texts))] == [tuple(plain[i]) for i in range(len(texts))]
    assert suffix_dedup.digests(docs.limit(0), words=51).count() == 0


def test_decontamination(spark, docs, texts, empty):
    w = re.findall(TERM, texts[12].translate(LOWER))
    items = [(1, " ".join(w[3:30])), (2, "One, TWO!"), (3, None), (4, "..."), (10, " ".join(w[8:18])), (5, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        x = re.findall(TERM, (t or "").translate(LOWER))
        for k in range(max(1, len(x) - 9) if x else 0):
            windows.setdefault(tuple(x[k : k + 10]), set()).add(i)
    for together, most in ((decontamination.TOGETHER, decontamination.BROADCAST), (2, decontamination.BROADCAST), (2, 0)):
        got = rows_of(decontamination.report(docs, bench, together=together, most=most))
        for i, t in enumerate(texts):
            x, hit, found = re.findall(TERM, (t or "").translate(LOWER)), set(), set()
            for key, ids in windows.items():
                for k in range(len(x) - len(key) + 1):
                    if tuple(x[k : k + len(key)]) == key:
                        hit |= set(range(k, k + len(key)))
                        found |= ids
            assert tuple(got[i])[1:] == (len(x), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    assert decontamination.report(empty, bench).count() == 0 and decontamination.report(docs, bench.limit(0)).where("contaminated").count() == 0
    near = {(r.doc_id, x) for r in decontamination.search(decontamination.build_index(docs), bench, slack=2).collect() for x in r["items"]}
    for i, t in enumerate(texts):
        x = re.findall(TERM, (t or "").translate(LOWER))
        for key, ids in windows.items():
            fit = any(all(key[k] in x[max(0, p + k - 2) : max(0, p + k + 3)] for k in range(len(key))) for p in range(-2, len(x) - len(key) + 3))
            assert all(((i, item) in near) >= fit for item in ids)
    assert decontamination.clean(docs, bench).count() == decontamination.report(docs, bench).where("not contaminated").count()


def test_tokens_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    encode = lambda t: Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids
    odd = ["<|endoftext|> a", "I'm  here\n\n\tx ", "\x1c\x85 　é", "12345 'll!!", "日本語 text\r\n"]
    from pressloom.llm.tokens import Encoder

    assert [Encoder(path).ids(x) for x in odd] == [encode(x) for x in odd]
    ids = [np.array([*encode(t), 0], "<u4") for t in texts]
    got = packing.pieces(docs, path).collect()
    for i, x in enumerate(ids):
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(x)
    total = 0
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += 1024
    assert total - sum(map(len, ids)) < 1024 and packing.pieces(empty, path).count() == 0
    counts = [len(x) - 1 for x in ids]
    for r in token_counts.histogram(docs, path).collect():
        assert r.n_docs == counts.count(r.n_tokens) and r.truncated_tokens == sum(min(c, r.n_tokens) for c in counts)
        assert (r.docs_longer, r.tokens_longer, r.total_tokens) == (sum(c > r.n_tokens for c in counts), sum(c for c in counts if c > r.n_tokens), sum(counts))


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/x?y", "https://example.org/en/12#z", "http://example.org", "http://x.com/fr/1", "ftp://com/de/", "http://notexample.org/en/1", "x.org/en", None, "://", "http://a.net/?://b.org/es/"]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [x[3] for x in got.values()].count("block") == 3
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2] == ("example.org", "", None, "allow") and got[4][3] == "block" and got[5][2] == "org/"
    assert got[6] == got[7] == got[8] == ("", "", None, "allow") and got[9][:3] == ("a.net", "/", None)


def test_quality_rules(docs, texts):
    got = rows_of(quality_rules.judge(docs))
    for i, t in enumerate(texts):
        w = re.findall(WORD, t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 2000 else None
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert again is None or got[i].n_repeat_words == len(again)
        assert not (got[i].base_failed and got[i].kept)


def test_classifier(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").cache()
    fit_on = labels.where("doc_id % 2 = 0")
    held = quality_classifier.select(docs, fit_on).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.kept for r in held if r.quality], [r.kept for r in held if not r.quality]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)
    assert quality_classifier.select(docs, labels, keep=0.5).where("kept").count() == round(docs.count() * 0.5)
    assert quality_classifier.kept(docs, fit_on).count() == quality_classifier.select(docs, fit_on).where("kept").count()
    assert quality_classifier.select(docs.limit(0), labels).count() == 0
