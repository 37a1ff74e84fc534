"""Language identification of every text, with spans where languages mix.

Words are runs of letters of one script. A word's script, by code-point ranges, narrows the languages that it can
be in; sums of log probabilities of its letter n-grams score these; Viterbi over a text's words, with a penalty for
each switch, labels spans, and the language that holds most letters is the text's. Counts cover all texts to learn from.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BUCKETS = 1 << 16
#: Lengths of the n-grams; a word's edges count as letters.
SIZES = (2, 3, 4)
#: Log odds that a switch of language must make up for.
PENALTY = 12.0
#: A language is a candidate for a script if at least this share of its letters is in it.
CANDIDATE = 0.01
#: How much less likely (log) a word is in a language that is no candidate for its script.
NARROW = 30.0
#: More languages than that are an error: tables of counts go to every worker.
MOST_LANGUAGES = 1_000
SMOOTH = 0.5
#: Words whose transfer tables are computed together.
CHUNK = 32
UNDETERMINED = "und"

#: First and last code point of the scripts told apart. Letters outside are of the script 0, "other".
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0xFF21, 0xFF5A), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Cyrillic", 0x1C80, 0x1C8F), ("Cyrillic", 0x2DE0, 0x2DFF), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Arabic", 0xFB50, 0xFDFF), ("Arabic", 0xFE70, 0xFEFE), ("Syriac", 0x0700, 0x074F),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Odia", 0x0B00, 0x0B7F),
    ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF),
    ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF),
    ("Kana", 0x3040, 0x30FF), ("Kana", 0x31F0, 0x31FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0xF900, 0xFAFF), ("Han", 0x20000, 0x323AF),
]
NAMES = ["other", *dict.fromkeys(x for x, _, _ in SCRIPTS)]
#: Marks of these belong to the letters around them.
_ALPHABET = 0x110000


@cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point 1 + its script, 0 if it is no letter; and what it is in lower case, where that is one code point."""
    script, lower = np.zeros(_ALPHABET, np.uint8), np.arange(_ALPHABET, dtype=np.int32)
    inside = np.zeros(_ALPHABET, np.uint8)
    for name, first, last in SCRIPTS:
        inside[first : last + 1] = NAMES.index(name)
    for code in range(_ALPHABET):
        if (one := chr(code)).isalpha() or code > 0x7F and unicodedata.category(one)[0] == "M":
            script[code] = 1 + inside[code]
            if len(small := one.lower()) == 1:
                lower[code] = ord(small)
    return script, lower


class Text:
    """The words of a block of texts laid end to end: spans of code points, script, text, and the code points."""

    def __init__(self, texts: list[str | None]):
        script, lower = alphabet()
        held = [x or "" for x in texts]
        at = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int64)
        code = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kind = script[code]
        edge = np.zeros(len(code) + 1, bool)
        edge[at] = True
        new = np.ones(len(code), bool)
        new[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(code))
        word = kind[start] > 0 if len(code) else np.zeros(0, bool)
        self.start, self.end, self.code = start[word], end[word], lower[code]
        self.script = kind[self.start].astype(np.int64) - 1
        self.first = np.searchsorted(self.start, at).astype(np.int64)
        self.begins = at

    @property
    def letters(self) -> np.ndarray:
        return self.end - self.start

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each n-gram, and the word that it is in."""
        size = self.letters + 1
        first = np.cumsum(size) - size
        n = int(size.sum())
        row = np.zeros(n + max(SIZES), np.uint64)
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(n) - first[word]
        inside = place > 0
        row[:n][inside] = self.code[(self.start[word] + place - 1)[inside]].astype(np.uint64)
        limit = np.append(first + size, n)  # a word's closing edge is where the next one begins
        out, of = [], []
        for k in SIZES:
            found = np.flatnonzero(np.arange(n) + k - 1 <= limit[word])
            code = np.zeros(len(found), np.uint64)
            for j in range(k):
                code += (row[found + j] + K.U(1)) * K.TERM_CODE[8 * k % 56 + j]
            out.append((K.mix(code) >> K.U(48)).astype(np.int64))
            of.append(word[found])
        return np.concatenate(out), np.concatenate(of)


def blocks(column: pa.Array, size: int) -> Iterator[tuple[int, Text]]:
    """(first row, words) of runs of rows of about `size` bytes; a longer text is one alone, and whole."""
    for first, last, *_ in K.blocks(column, size):
        yield first, Text(column.slice(first, last - first).to_pylist())


def _counts(langs: list[str]):
    """Counts of n-grams and of letters by script, for each language, over one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, wide = len(langs), BUCKETS + len(NAMES)
        total = np.zeros((n, wide), np.int64)
        number = {x: i for i, x in enumerate(langs)}
        docs = np.zeros(n, np.int64)
        for batch in batches:
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            docs += np.bincount(own, minlength=n)
            for first, words in blocks(batch.column("text"), 1 << 19):
                if not len(words.start):
                    continue
                lang = np.repeat(own[first : first + len(words.first) - 1], np.diff(words.first))
                bucket, word = words.grams()
                np.add.at(total.ravel(), lang[word] * wide + bucket, 1)
                np.add.at(total.ravel(), lang * wide + BUCKETS + words.script, words.letters)
        for i, lang in enumerate(langs):
            at = np.flatnonzero(total[i])
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": np.append(at, -1), "n": np.append(total[i][at], docs[i])})

    return run


class Model:
    """Languages, log probabilities of buckets, prior, and the candidates of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
        self.langs = langs
        p = (grams + SMOOTH) / (grams.sum(1, keepdims=True) + SMOOTH * BUCKETS)
        self.table = np.ascontiguousarray(np.log(p).T.astype(np.float32))
        self.prior = np.log((docs + 1.0) / (docs.sum() + len(langs))) if langs else np.zeros(0)
        self.candidates = (scripts > 0) & (scripts >= CANDIDATE * scripts.sum(1, keepdims=True))

    def scores(self, words: Text) -> tuple[np.ndarray, np.ndarray]:
        """Each word's log likelihood in each language (its best one: 0), and whether it tells anything."""
        n, m = len(words.start), len(self.langs)
        out = np.zeros((n, m))
        bucket, word = words.grams()
        for j in range(m):
            out[:, j] = np.bincount(word, weights=self.table[bucket, j], minlength=n)
        allowed = self.candidates.T[words.script]
        known = allowed.any(1)
        best = np.where(allowed, out, -np.inf).max(1, initial=-np.inf)
        out = np.where(allowed, out - np.where(known, best, 0)[:, None], -NARROW)
        out[~known] = 0.0
        return out, known

    def block_bytes(self) -> int:
        """Bytes of text worked on at once: the transfer tables grow with the square of the number of languages."""
        return int(min(1 << 19, max(1 << 15, (1 << 23) // max(1, len(self.langs) ** 2))))


def viterbi(score: np.ndarray, first: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word; words first[i] to first[i + 1] are those of text i. A switch costs `penalty`.

    Texts are cut into chunks of words. All chunks at once: the best score from each state before a chunk to each state at its
    end. Then, chunk by chunk over all texts at once, the states at the cuts; last, again all at once, the words within.
    """
    n, m = score.shape
    count = np.diff(first)
    if not n:
        return np.zeros(0, np.int64)
    chunks = -(-count // CHUNK)
    own = np.repeat(np.arange(len(count)), chunks)
    order = np.arange(len(own)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    word = first[own, None] + order[:, None] * CHUNK + np.arange(CHUNK)
    real = word < first[own + 1, None]
    grid = np.where(real[:, :, None], score[np.minimum(word, n - 1)], 0.0)
    pay = np.where(real, penalty, np.inf)  # no switch in what fills up a chunk
    move = np.where(np.eye(m, dtype=bool), 0.0, -np.inf)[None].repeat(len(own), 0)
    for k in range(CHUNK):
        move = np.maximum(move, move.max(2, keepdims=True) - pay[:, k, None, None]) + grid[:, k, None, :]
    base, held = np.cumsum(chunks) - chunks, np.zeros((len(own), m))  # held: the best score before each chunk
    live = np.flatnonzero(chunks > 0)
    value = np.tile(prior, (len(live), 1))
    for k in range(int(chunks.max())):
        at = base[live] + k
        held[at] = value
        value = (value[:, :, None] + move[at]).max(1)
        last = chunks[live] == k + 1
        live, value = live[~last], value[~last]
    before, state = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)  # at each chunk's start and end
    for k in range(int(chunks.max()) - 1, -1, -1):
        on = np.flatnonzero(chunks > k)
        at = base[on] + k
        ends = chunks[on] == k + 1
        state[at[ends]] = (held[at[ends]][:, :, None] + move[at[ends]]).max(1).argmax(1)
        state[at[~ends]] = before[at[~ends] + 1]
        before[at] = (held[at] + move[at, :, state[at]]).argmax(1)
    value = np.full((len(own), m), -np.inf)
    value[np.arange(len(own)), before] = 0.0
    switched, source = np.zeros((CHUNK, len(own), m), bool), np.zeros((CHUNK, len(own)), np.int64)
    for k in range(CHUNK):
        top = value.max(1)
        source[k] = value.argmax(1)
        away = top[:, None] - pay[:, k, None]
        switched[k] = away > value
        value = np.maximum(value, away) + grid[:, k]
    out, at = np.zeros((len(own), CHUNK), np.int64), np.arange(len(own))
    for k in range(CHUNK - 1, -1, -1):
        out[:, k] = state
        state = np.where(switched[k, at, state], source[k], state)
    return out[real]


def fit(texts: DataFrame) -> Model:
    """A model of `texts` (text, lang); rows without either are left out. Only the languages and the counts of their
    buckets, BUCKETS for each at most, come to the driver."""
    use = texts.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs = sorted(x[0] for x in use.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    counts, docs = np.zeros((len(langs), BUCKETS + len(NAMES))), np.zeros(len(langs))
    number = {x: i for i, x in enumerate(langs)}
    if langs:
        found = use.mapInArrow(_counts(langs), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        row = np.array([number[x] for x in found["lang"].to_pylist()], np.int64)
        bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
        counts[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
        docs[row[bucket < 0]] = n[bucket < 0]
    return Model(langs, counts, docs)


def _labelled(model: Model, column: pa.Array, penalty: float) -> Iterator[tuple[int, Text, np.ndarray, np.ndarray]]:
    for first, words in blocks(column, model.block_bytes()):
        score, known = model.scores(words)
        yield first, words, viterbi(score, words.first, model.prior, penalty), known


def predictions(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred and score of each row: the language whose spans hold most letters, and its share of all letters, counting
    only words of a script that some language was learned in. Of equals, the more frequent one in training, then the first by name."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        rank = np.lexsort((np.arange(len(model.langs)), -model.prior))
        for batch in batches:
            best, share = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for first, words, state, known in _labelled(model, batch.column("text"), penalty) if model.langs else ():
                n, m = len(words.first) - 1, len(model.langs)
                own = np.repeat(np.arange(n), np.diff(words.first))
                held_by = np.bincount(own * m + state, weights=words.letters, minlength=n * m).reshape(n, m)
                sure = np.bincount(own * m + state, weights=words.letters * known, minlength=n * m).reshape(n, m)
                pick = rank[held_by[:, rank].argmax(1)]
                every = held_by.sum(1)
                best[first : first + n] = np.where(every > 0, pick, -1)
                share[first : first + n] = sure[np.arange(n), pick] / np.maximum(every, 1)
            names = [model.langs[x] if x >= 0 else UNDETERMINED for x in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, begin, end (code points), lang and letters of each run of words of one language; texts without letters have none."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for first, words, state, _ in _labelled(model, batch.column("text"), penalty) if model.langs else ():
                own = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
                if not len(own):
                    continue
                new = np.flatnonzero(np.concatenate(([True], (state[1:] != state[:-1]) | (own[1:] != own[:-1]))))
                last, text = np.append(new[1:], len(own)) - 1, own[new]
                ids = batch.column("doc_id").take(pa.array(first + text))
                begin, end = words.start[new] - words.begins[text], words.end[last] - words.begins[text]
                letters = np.add.reduceat(words.letters, new)
                langs = pa.array([model.langs[x] for x in state[new]], pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(begin), pa.array(end), langs, pa.array(letters)], ["doc_id", "begin", "end", "lang", "letters"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, begin long, end long, lang string, letters long")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: by its id alone."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of each row, learned from those not held out.

    A null text, one without letters, and every text if there is nothing to learn from: `und`, score 0. A row without an id
    isn't held out. Rows that repeat are predicted alike; each counts in learning.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(rows.where("not held_out"))
    found = predictions(rows, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
