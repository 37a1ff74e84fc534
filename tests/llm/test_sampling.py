"""The classifier's grams, scores, keys and kept rows built anew in plain Python, and the frequencies of its sample."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pressloom.llm import quality_classifier as Q

MASK = 2**64 - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def grams(text):
    """Words, pairs of words and triples of shapes, as plain tuples: no hash."""
    words = (text or "").split()
    shapes = []
    for i, w in enumerate(words):
        b = w.encode()
        upper = sum(0x41 <= x <= 0x5A for x in b)
        plain = sum(x >= 0x80 or 0x61 <= x | 0x20 <= 0x7A for x in b)
        shapes.append((min(upper, 2), min(len(b) - plain, 3), i > 0 and words[i - 1] == w, i > 1 and words[i - 2] == w, min(len(b) // 4, 4)))
    return [("w", w) for w in words] + [("p", *x) for x in zip(words, words[1:])] + [("s", *x) for x in zip(shapes, shapes[1:], shapes[2:])]


def corpus():
    rng = random.Random(11)
    good, bad = ["Ab", "c,"], ["Ab", "$$$"]  # few different grams, so that no two share a bucket
    docs = [(i, " ".join(rng.choices(good if i % 3 else bad, k=rng.randint(1, 25)))) for i in range(90)]
    return [*docs, (90, None), (91, " "), (92, docs[5][1]), (None, docs[7][1])]


def test_select_equals_plain_python(spark):
    docs, labels = corpus(), [(i, int(i % 3 > 0)) for i in range(0, 90, 2)] + [(None, 1), (500, 0), (3, None)]
    got = Q.select(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), keep=0.5).collect()
    chosen = {i for i, q in labels if i is not None and q}
    total, target = Counter(), Counter()
    for i, text in docs:
        total.update(grams(text))
        target.update(grams(text) if i in chosen else [])
    ratio = {g: math.log((target[g] + 0.5) / (sum(target.values()) + 0.5 * Q.BUCKETS)) - math.log((n + 0.5) / (sum(total.values()) + 0.5 * Q.BUCKETS)) for g, n in total.items()}
    want = []
    for i, text in docs:
        own = grams(text)
        score = sum(ratio[g] for g in own) / len(own) if own else None
        u = ((mix((mix(((i or 0) + Q.SEED) & MASK) + 0x9E3779B97F4A7C15 & MASK)) >> 11) + 0.5) / 2.0**53
        want.append((i, score, None if score is None else score * Q.SHARPNESS - math.log(-math.log(u))))
    keys = sorted((k for _, _, k in want if k is not None), reverse=True)
    cut = keys[round(0.5 * len(docs)) - 1]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for r, (i, score, key) in zip(order(map(tuple, got)), order(want), strict=True):
        assert r[0] == i and (r[1] is None) == (score is None)
        assert score is None or (abs(r[1] - score) < 1e-9 and abs(r[2] - key) < 1e-6)
        assert r[3] == (key is not None and key >= cut - 1e-9)


def test_sample_follows_the_weights():
    """Over many seeds, rows are drawn without replacement in proportion to their weights."""
    texts = ["a a b", "a b b", "b b b b", "a", "a b"]
    model = Q.Model(np.zeros(Q.BUCKETS), 1.0)
    fixed = np.log(np.array([1.0, 2.0, 4.0, 0.5, 2.5])) / Q.SHARPNESS
    model.scores = lambda column: fixed
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts})
    first, both, n = np.zeros(5), np.zeros(5), 20_000
    for seed in range(n):
        order = np.argsort(-model.keys(batch, seed)[1])
        first[order[0]] += 1
        both[order[:2]] += 1
    w = np.exp(fixed * Q.SHARPNESS)
    w /= w.sum()
    two = np.array([w[i] + sum(w[j] * w[i] / (1 - w[j]) for j in range(5) if j != i) for i in range(5)])
    assert np.abs(first / n - w).max() < 0.012 and np.abs(both / n - two).max() < 0.012
