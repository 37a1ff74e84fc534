"""Removal of word passages that an earlier document has, by sharded Aho-Corasick automata.

Anchors (runs of ANCHOR words) that recur across documents nominate passages; equal fragments around an anchor are
one, owned by the least document. Different fragments of several documents meet in the shard that owns their anchor:
windows found in two documents are confirmed as phrases and compiled to automata of bounded size; all fragments of the
shard stream through them, the least document in which a phrase is met owns it, and every other occurrence goes.
Fragments of an anchor with more than MOST of them are cut to single windows, of which equal ones are one again.
Every text is scanned whole for anchors; a shard only sees the parts of it that hold one of its anchors, which spares
streaming all texts through all automata.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchored, kernels as K
from .suffix_dedup import SPANS, _span_rows, with_lists
from .tables import settle, width

WINDOW, ANCHOR = 13, 5
#: Bytes of fragments that a task holds at once, phrases in one automaton (about 100 MB), fragments of a group in one shard.
SHARD, PHRASES, MOST = 1 << 18, 20_000, 5_000


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each run of windows listed in `spans`, joined by one space."""
    for batch in batches:
        rows, found = anchored.lists(batch.column("spans"))
        all_a, at_words = found.field("a").to_numpy(), found.field("at").to_numpy()
        starts, stops = _start(at_words), _stop(at_words)
        ids = {c: batch.column(c).to_numpy() for c in ("doc", "th")}
        for first, last, data, at in K.blocks(batch.column("text")):
            w = K.Words(data, at)
            own = np.arange(rows[first], rows[last])
            text = np.repeat(np.arange(last - first), np.diff(rows[first : last + 1]))
            raw, start, end = data.tobytes(), w.start, w.end
            words = [b" ".join(raw[s:e] for s, e in zip(start[x:y], end[x:y])) for x, y in zip(w.at[text] + starts[own], w.at[text] + stops[own])]
            columns = (all_a[own], ids["doc"][first:last][text], ids["th"][first:last][text], starts[own].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(words, pa.binary())], ["a", "doc", "th", "low", "words"])


def _confirmed(data: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> list[str]:
    """The different windows that fragments of two documents have."""
    w = K.Words(data, at)
    whole = np.flatnonzero(np.arange(len(w.code)) + window <= w.limit())
    code, whose = w.grams(window)[whole], doc[np.searchsorted(w.at, whole, "right") - 1]
    order = np.lexsort((whose, code))
    code, whose = code[order], whose[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))[: len(code)])
    last = np.append(first[1:], len(code))[: len(first)] - 1
    some = whole[order[first[whose[last] > whose[first]]]]
    raw = data.tobytes()
    return sorted({raw[s:e].decode("utf-8", "replace") for s, e in zip(w.start[some].tolist(), w.end[some + window - 1].tolist())})


def _matches(window: int):
    """For fragments of whole groups: spans of the windows that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in anchored.whole_groups(batches, SHARD):
            doc, th, low = (table.column(c).to_numpy() for c in ("doc", "th", "low"))
            column = table.column("words").combine_chunks()
            confirmed = _confirmed(*K.text_bytes(column), doc, window)
            texts = [f" {x.decode('utf-8', 'replace')} " for x in column.to_pylist()] if confirmed else []
            for at in range(0, len(confirmed), PHRASES):
                shard = ahocorasick.Automaton()
                for number, phrase in enumerate(confirmed[at : at + PHRASES]):
                    shard.add_word(f" {phrase} ", number)
                shard.make_automaton()
                found = np.array([(i, number, last) for i, text in enumerate(texts) for last, number in shard.iter(text)], np.int64).reshape(-1, 3)
                owner = np.full(PHRASES, np.iinfo(np.int64).max)
                np.minimum.at(owner, found[:, 1], doc[found[:, 0]])
                found = found[doc[found[:, 0]] > owner[found[:, 1]]]
                if not len(found):
                    continue
                # A match ends at a blank; the words up to it are counted by the blanks before.
                stop = np.empty(len(found), np.int64)
                edges = np.flatnonzero(np.concatenate(([True], found[1:, 0] != found[:-1, 0], [True])))
                for x, y in zip(edges, edges[1:]):
                    blanks = np.flatnonzero(np.frombuffer(texts[found[x, 0]].encode("utf-32-le"), "<u4") == 32)
                    stop[x:y] = np.searchsorted(blanks, found[x:y, 2])
                which, base = found[:, 0], low[found[:, 0]]
                yield _span_rows(doc[which], th[which], base + stop - window, base + stop)

    return run


ROWS = "a long, fh long, doc long, th long, at long, settled boolean"


def _start(at):
    """`at` holds a run of words: its start, and its length in the low bits (a column or an array)."""
    return at // 1024


def _stop(at):
    return at // 1024 + at % 1024


def _settled_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal fragments in a batch, only the smallest document's have to ask elsewhere.

    The others are settled; they get a key of their own, so that a very common passage sends few rows to the
    partition that owns its anchor.
    """
    for batch in batches:
        a, fh, doc, pos, low, high = (batch.column(c).to_numpy() for c in ("a", "fh", "doc", "pos", "start", "stop"))
        order = np.lexsort((doc, fh, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (fh[order][1:] != fh[order][:-1])
        least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
        settled = np.zeros(len(a), bool)
        settled[order] = doc[order] > least
        own = K.i64(K.mix(doc.view(K.U) * K.TERM_CODE[0] + pos.astype(K.U)))
        columns = (np.where(settled, own, a), fh, doc, batch.column("th").to_numpy(), low.astype(np.int64) * 1024 + (high - low), settled)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in ROWS.split(", ")])


def _windows(window: int):
    """A hash and the place of each window of each fragment, for anchors with very many fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in K.blocks(batch.column("words")):
                w = K.Words(data, at)
                whole = np.flatnonzero(np.arange(len(w.code)) + window <= w.limit())
                seg = np.searchsorted(w.at, whole, "right") - 1
                doc, th, low = (batch.column(c).to_numpy()[first:last][seg] for c in ("doc", "th", "low"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (K.i64(w.grams(window)[whole]), doc, th, (low + whole - w.at[seg]).astype(np.int32))], ["code", "doc", "th", "start"])

    return run


def passage_spans(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, most: int = MOST) -> DataFrame:
    """(doc, th, start, stop): spans of words of each text that windows of smaller documents cover."""
    n = width(docs.sparkSession)
    texts = anchored.keyed(docs.where("doc_id is not null and text is not null"))
    find = anchored.find(anchored.word_units, window, size)
    rows = texts.mapInArrow(lambda batches: _settled_here(find(batches)), ROWS)
    by_a, by_fh = Window.partitionBy("a"), Window.partitionBy("a", "fh")
    seen = rows.repartition(n, "a").withColumns({
        "first_doc": F.min("doc").over(by_fh), "group_first": F.min("doc").over(by_a), "group_last": F.max("doc").over(by_a), "mixed": F.min("fh").over(by_a) != F.max("fh").over(by_a),
    })
    seen = seen.withColumn("settled", F.col("settled") | (F.col("doc") > F.col("first_doc")))
    seen = settle(seen.where("settled or (mixed and group_first < group_last)").select("a", "fh", "doc", "th", "at", "settled"))
    spans = seen.where("settled").select("doc", "th", F.expr("int(at div 1024)").alias("start"), F.expr("int(at div 1024 + at % 1024)").alias("stop"))
    lists = anchored.per_text(seen.where("not settled").select("a", "doc", "th", "at").distinct(), "a", "at")
    pieces = settle(texts.join(lists, ["doc", "th"]).mapInArrow(_cut, "a long, doc long, th long, low int, words binary"))
    large = pieces.groupBy("a").count().where(F.col("count") > most).select("a")
    small = pieces.join(large, "a", "left_anti").repartition(n, "a").sortWithinPartitions("a").mapInArrow(_matches(window), SPANS)
    codes = pieces.join(large, "a", "left_semi").mapInArrow(_windows(window), "code long, doc long, th long, start int")
    owners = codes.groupBy("code").agg(F.min("doc").alias("owner"))
    rest = codes.join(owners, "code").where("owner < doc").select("doc", "th", "start", (F.col("start") + window).alias("stop"))
    return spans.union(small).union(rest)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = anchored.lists(batch.column("spans"))
        starts, stops = found.field("start").to_numpy(), found.field("stop").to_numpy()
        for first, last, data, at in K.blocks(batch.column("row").field("text")):
            w = K.Words(data, at)
            raw, counts = data.tobytes(), w.counts
            removed, sha = [], []
            for d in range(last - first):
                own = slice(rows[first + d], rows[first + d + 1])
                gone = K.covered(counts[d], starts[own], np.minimum(stops[own], counts[d])) if own.start < own.stop else np.zeros(counts[d], bool)
                keep = w.at[d] + np.flatnonzero(~gone)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist())])).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("row").field("doc_id").slice(first, last - first), "n_words": counts, "n_removed": removed, "kept_sha256": sha})


def digests(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row. A null text has no words.

    Rows without a doc_id are smaller than none and greater than none: they lose and take nothing. Rows that
    repeat a doc_id are one document's, each judged by its own text.
    """
    found = with_lists(docs.select("doc_id", "text"), spans=passage_spans(docs, window, size, most))
    return found.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
