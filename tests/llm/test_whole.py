"""Cases that the operators and the pipeline's stages once left out."""

import random
import re

import corpus_pipeline
import pyarrow as pa
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="module")
def say():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeéöñ", k=rng.randint(1, 5))) for _ in range(3000)]
    return lambda n: " ".join(rng.choices(words, k=n))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), i) for i, t in enumerate(texts)], SCHEMA)


def test_stage_repeats(spark, say):
    passages, short, wide = [say(51) for _ in range(4)], say(50), "x" * 150 + " " + "é" * 150
    assert all(len(p.encode()) < 400 for p in passages)
    texts = [None, "", "one", say(300), say(51), passages[0], f"{say(40)}\n{passages[3]}"]
    for p in passages:
        texts += [f"{say(30)} {p} {say(20)}", f"{say(7)}\n{p.replace(' ', '  ')}"]
    texts += [f"{say(9)} {short} {say(9)}", f"{say(3)} {short} {say(60)}", f"{say(5)} {wide} {say(8)}", f"{say(70)}\n{wide}\n{say(4)}", "y " * 60]
    seen = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for w in split:
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])] = seen.get(tuple(w[k : k + 51]), 0) + 1
    want = []
    for w in split:
        gone = {k + j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(51)}
        want.append([x for k, x in enumerate(w) if k not in gone and x not in wide.split(" ")])
    got = {r.doc_id: r for r in corpus_pipeline.repeats(spark, table(spark, texts), "").collect()}
    for i, t in enumerate(texts):
        assert (got[i].text or "").split() == want[i]
        assert got[i].n_chars == (None if t is None else len(got[i].text)) and got[i].extra == i
        if want[i] == split[i]:
            assert got[i].text == t


def test_few_words(spark):
    from pressloom.llm import kernels, near_dedup, phrase_dedup

    for n in (1, 2, 3, 4, 5):
        text = " ".join("pqrst"[:n])
        w = kernels.Words(*kernels.text_bytes(pa.array([text])))
        assert len(w.grams(5)) == n
        if n in (2, 3):
            df = table(spark, [text])
            assert [(r.n_shingles, r.kept) for r in near_dedup.components(df).collect()] == [(1, True)]
            assert [(r.n_words, r.n_removed) for r in phrase_dedup.digests(df).collect()] == [(n, 0)]


def test_long_white_space():
    from pressloom.llm.queries import tokenizer_path
    from pressloom.llm.tokens import Encoder
    from tokenizers import Tokenizer

    ours, theirs = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ("a<|endoftext|>" + " " * 1_000_000 + "b", "\n" * 100_000, "c" + "　 " * 50_000, "d" + " " * 99_999 + "e"):
        assert ours.ids(text) == theirs.encode(text, add_special_tokens=False).ids


def test_stage_near_duplicates(spark):
    from pressloom.llm import near_dedup

    rng, texts = random.Random(3), []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(400)]
        texts.append(" ".join(base))
        # Each changed word, at least five from the next, takes five shingles: 8 of them leave 356 / 436 = 0.817, 10 leave 346 / 446 = 0.776.
        for changes in (8, 10):
            copy = list(base)
            for k in rng.sample(range(10, 390, 8), changes):
                copy[k] = f"other{group}n{changes}k{k}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(396)} for w in (t.split() for t in texts)]
    near = [len(sets[i] & sets[i - i % 3]) / len(sets[i] | sets[i - i % 3]) for i in range(len(sets))]
    assert all((0.8 <= near[i] < 0.85) if i % 3 == 1 else near[i] < 0.8 for i in range(len(sets)) if i % 3)
    got = corpus_pipeline.near_duplicates(spark, table(spark, texts), "").collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(len(texts)) if i % 3 != 1]
    assert near_dedup.plan(85) == (24, 13) and near_dedup.plan(80) == (28, 15)
    with pytest.raises(ValueError):
        near_dedup.plan(50)


def test_decontamination_equal_segments(spark):
    from pressloom.llm import decontamination

    df = spark.createDataFrame([(i, "a b c d e f g h i j k") for i in (1, 1, 1, None)], "doc_id long, text string").repartition(4).union(spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string"))
    bench = spark.createDataFrame([(i, f"{w} b c d e f g h i j") for i, w in enumerate("axyz")] + [(9, "b c d e f g h i j k")], "item_id long, text string")
    for together, most in ((decontamination.TOGETHER, decontamination.BROADCAST), (2, 0)):
        got = decontamination.search(decontamination.build_index(df), bench, together=together, most=most).collect()
        assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "1", "None"]
        assert all(sorted(r["items"]) == [0, 9] for r in got)
    one = decontamination.build_index(df.where("doc_id = 1").limit(1).coalesce(1))
    twice = df.where("doc_id = 1").limit(1).coalesce(1)
    got = decontamination.search(decontamination.build_index(twice.union(twice)), bench, together=2, most=0)
    assert one.count() == 1 and got.count() == 2


def test_urls_many_lengths(spark):
    from pressloom.llm import url_filter

    rules = spark.createDataFrame([("block", "a.org", "/" + "x" * n) for n in range(0, 1200, 1)] + [("allow", "org", None)], url_filter.RULE_ROW)
    pages = spark.createDataFrame([(n, "http://b.A.org/" + "x" * n) for n in (0, 998, 1100, 1199, 1500)] + [(-1, "http://b.org/x"), (-2, None)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    for n in (0, 998, 1100, 1199, 1500):
        assert got[n].rule == "a.org/" + "x" * min(n, 1199) and got[n].verdict == "block"
    assert got[-1].rule is None and got[-2].verdict == "allow"
    assert url_filter.judge(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == 7
