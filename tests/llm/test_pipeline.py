"""The pipeline and its stages against brute force, on rows with nulls, empties, repeats and clashing column names."""

import math
import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from pressloom.llm import kernels, quality_classifier, tables
from pressloom.llm.queries import tokenizer_path

WORD, TERM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use inside, or once did.
CLASH = ["row", "spans", "words", "doc", "th", "id", "a", "n", "key", "one", "segment", "least", "__th", "__spans", "__id", "__doc", "__n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)


def rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t), *range(len(CLASH))) for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(23)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 5))) for _ in range(900)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    out: list[tuple] = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, say(2500))]
    passages, leak = [say(60) for _ in range(3)], say(14)
    for k in range(60):
        parts = [say(rng.randint(20, 70))]
        if k % 3 == 0:
            parts.append(passages[k % 9 // 3])
        if k % 11 == 0:
            parts.append(leak)
        out.append((10 + k, "\n".join([*parts, say(rng.randint(1, 30))])))
    base = say(150).split(" ")
    for k in range(8):
        near = list(base)
        for at in rng.sample(range(150), k):
            near[at] = rng.choice(words)
        out.append((100 + k, " ".join(near)))
    for k in range(40):
        out.append((200 + k, " ".join([f"BUY!!! {k} $$$ now"] * rng.randint(5, 30))))
    out += [(300, out[20][1]), (301, out[20][1].upper()), (12, out[7][1]), (12, say(30)), (None, say(40)), (None, say(40))]
    return out, leak


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    own, leak = texts
    spark.createDataFrame(rows(own), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i, _ in own if i is not None and i % 2] + [(None, 1, 0), (77, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, f"Start, {leak.translate(str.maketrans(dict(zip(LOWER.values(), LOWER.keys()))))} end"), (2, "not there " * 6), (3, None), (4, ""), (None, leak)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def pairs(df):
    """(doc_id, text), in order; the other columns must be the row's own."""
    found = df.collect()
    assert df.columns[5:] == CLASH and all(tuple(r)[5:] == tuple(range(len(CLASH))) for r in found)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
    return sorted(((r.doc_id, r.text) for r in found), key=repr)


def words(t):
    return re.findall(WORD, t or "")


def quality(own, labels):
    """Counts, ratio, keys and cut, document by document."""
    grams = lambda t: quality_classifier.grams(*kernels.text_bytes(pa.array([t or ""])))[0].tolist()
    good = {i for i, q, _ in labels if i is not None and q}
    total, target = np.zeros(quality_classifier.BUCKETS), np.zeros(quality_classifier.BUCKETS)
    for i, t in own:
        for g in grams(t):
            total[g] += 1
            target[g] += i in good
    p, q = ((x + 0.5) / (x.sum() + 0.5 * len(x)) for x in (target, total))
    mask = 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    keys = []
    for i, t in own:
        g = grams(t)
        u = ((mix((mix(((i or 0) + 17) & mask) + kernels.BASE) & mask) >> 11) + 0.5) / 2**53
        keys.append(sum(math.log(p[x] / q[x]) for x in g) / len(g) * 200 - math.log(-math.log(u)) if g else None)
    known = [x for x in labels if x[0] is not None and x[1] is not None]
    share = min(1.0, sum(x[1] > 0 for x in known) / len(known) + 0.01)
    cut = sorted((k for k in keys if k is not None), reverse=True)[round(len(own) * share) - 1]
    return [x for x, k in zip(own, keys) if k is not None and k >= cut]


def near(own):
    def grams(t):
        w = words((t or "").translate(LOWER))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in own]
    ids = [(0, i) if i is not None else (1, k) for k, (i, _) in enumerate(own)]
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(own)):
        for y in range(x):
            if ids[x][0] == ids[y][0] == 0 and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                one, two = sorted((top(ids[x]), top(ids[y])))
                root[two] = one
    # Rows that repeat an id are one document: one of them stays.
    return {i for i in ids if top(i) == i}


def test_stages(spark, texts, sf_dir):
    own = texts[0]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    got = stages["quality"](spark, docs, sf_dir)
    want = quality(own, labels)
    assert pairs(got) == sorted(want, key=repr) and 0 < len(want) < len(own)

    every = sorted(docs.select("doc_id", "text").collect(), key=repr)
    kept = pairs(stages["near_duplicates"](spark, docs, sf_dir))
    alive = near([tuple(r) for r in every])
    assert sorted(i for i, _ in kept if i is not None) == sorted(i for null, i in alive if not null)
    assert sum(i is None for i, _ in kept) == 2 and all(x in map(tuple, every) for x in kept)

    seen: dict[tuple, int] = {}
    split = [(i, t, words(t)) for i, t in own]
    for _, _, w in split:
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])] = seen.get(tuple(w[k : k + 51]), 0) + 1
    left = []
    for i, t, w in split:
        gone = {k + j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(51)}
        left.append((i, t is None, [x for k, x in enumerate(w) if k not in gone], t if not gone else None))
    stripped = pairs(stages["repeats"](spark, docs, sf_dir))
    assert sorted(((i, t is None, words(t)) for i, t in stripped), key=repr) == sorted((x[:3] for x in left), key=repr)
    assert {(i, t) for i, _, _, t in left if t is not None} <= set(stripped) and any(t is None and not null for _, null, _, t in left)

    leaked = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id is not null").collect():
        w = re.findall(TERM, (r.text or "").translate(LOWER))
        leaked |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()

    def hit(t):
        w = re.findall(TERM, (t or "").translate(LOWER))
        return any(tuple(w[k : k + len(x)]) == x for x in leaked for k in range(len(w) - len(x) + 1))

    clean = pairs(stages["decontaminate"](spark, docs, sf_dir))
    assert clean == sorted(((i, t) for i, t in own if not hit(t)), key=repr) and 0 < len(own) - len(clean) < 20

    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    packed = stages["pack"](spark, docs, sf_dir).collect()
    held: dict[tuple, int] = {}
    for r in packed:
        held[(r.doc_id, r.doc_tokens)] = held.get((r.doc_id, r.doc_tokens), 0) + r.length
    want_tokens: dict[tuple, int] = {}
    for i, t in own:
        n = len(encode(t or "", add_special_tokens=False).ids) + 1
        want_tokens[(i, n)] = want_tokens.get((i, n), 0) + n
    assert held == want_tokens


def test_run(spark, sf_dir):
    """The stages one after the other, each written and read again, give what run() gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf_dir}/after_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count()
    by_doc = lambda df: sorted(((r.doc_id, r.doc_tokens, r.n) for r in df.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()), key=repr)
    got = corpus_pipeline.run(spark, sf_dir)
    assert by_doc(got) == by_doc(docs)
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in got.collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for places in [*sequences.values(), *(x for (i, n), x in texts.items() if sum(b for _, b in x) == n)]:
        assert all(at == sum(n for _, n in sorted(places)[:k]) for k, (at, _) in enumerate(sorted(places)))
    assert all(sum(n for _, n in x) <= 1024 for x in sequences.values())


def test_results_of_stages_live_side_by_side(spark, sf_dir, tmp_path, monkeypatch):
    """A stage deletes nothing that another's lazy result reads; run() leaves its result alone."""
    monkeypatch.setattr(tables, "shared_dir", lambda spark: str(tmp_path))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    lazy = [stages[name](spark, docs, sf_dir) for name in ("repeats", "decontaminate", "near_duplicates", "pack")]
    before = len(list(tmp_path.iterdir()))
    first = [x.count() for x in lazy]
    run = corpus_pipeline.run(spark, sf_dir)
    assert len(list(tmp_path.iterdir())) == before + 1 and run.count() and [x.count() for x in reversed(lazy)] == first[::-1]
    assert before <= 7  # two lists of spans, written twice; two of decisions; pieces


def test_empty(spark, sf_dir, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Without labels there is nothing to tell documents apart by: all that have words stay.
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == docs.where("text rlike '[^ \\n]'").count()
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == docs.count()
