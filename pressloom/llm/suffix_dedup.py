"""Removal of repeated byte strings, by maximal repeats of enhanced suffix arrays.

Anchors bring together the fragments that can share a string of WINDOW bytes: a shared string has its anchor in its
first or in its second half, so fragments meet by the hash of what is then sure to be common. Equal fragments are one,
with a count. Over the different fragments of a group an enhanced suffix array is built in a task; a stack scan of
its common-prefix intervals reports, for each interval that can't be extended to the left in all its occurrences,
the repeat with all its places. A group of more than MOST fragments is dealt anew by longer keys, at last by the
whole string, so that no array grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchored, kernels as K
from .tables import alone, settle, width

WINDOW, ANCHOR = 400, 32
#: Bytes that stand for a word and its next where repeats are looked for by words, and words of a passage that is reported.
CODE, PASSAGE = 4, 51
#: Bytes of small groups that share an array, and the most fragments of a group in one array.
BLOCK, MOST = 1 << 18, 1_000


def suffix_array(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, and the common prefix of each with the one before it.

    A suffix ends with its segment [at[i], at[i+1]); segments of different groups share nothing.
    Ranks by the first 7 bytes, or the first code of more bytes, are doubled until no two suffixes tie but by their whole length.
    """
    n, lengths, head = len(data), np.diff(at), 7 if data.itemsize == 1 else 1
    left = np.repeat(at[1:], lengths) - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(head):
        key <<= K.U(9)
        inside = np.flatnonzero(left > k)
        key[inside] |= data[inside + k].astype(K.U) + K.U(1)
    _, rank = np.unique(key, return_inverse=True)
    _, rank = np.unique(np.repeat(group, lengths) * (rank.max() + 1) + rank, return_inverse=True)
    counts = np.bincount(rank)
    rank = (np.cumsum(counts) - counts)[rank]  # from here, the number of suffixes before its class
    levels, step, live = [rank], head, np.arange(n)
    while True:
        counts = np.bincount(rank, minlength=n)
        live = live[(counts[rank[live]] > 1) & (left[live] > step)]
        if not len(live):
            break
        after = rank[live + step]
        order = np.lexsort((after, rank[live]))
        who, after = live[order], after[order]
        old, place = rank[who], np.arange(len(who))
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        new_pair = new_old | np.concatenate(([True], after[1:] != after[:-1]))
        ended = counts[old] - np.bincount(old, minlength=n)[old]  # suffixes that end here come first
        rank = rank.copy()
        rank[who] = old + ended + np.maximum.accumulate(np.where(new_pair, place, 0)) - np.maximum.accumulate(np.where(new_old, place, 0))
        step *= 2
        levels.append(rank)
    order = np.argsort(rank, kind="stable")
    one, two, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    live = np.ones(len(common), bool)
    for k in range(len(levels) - 1, -1, -1):
        reach = head * 2**k
        spot = np.flatnonzero(live & (one < n) & (two < n))
        same = spot[levels[k][one[spot]] == levels[k][two[spot]]]
        same = same[(left[one[same]] > 0) & (left[two[same]] > 0)]
        common[same] += reach
        ended = same[(left[one[same]] <= reach) | (left[two[same]] <= reach)]
        live[ended] = False
        one[same] += reach
        two[same] += reach
    tail = np.flatnonzero(live)
    for _ in range(head - 1):
        tail = tail[(one[tail] < n) & (two[tail] < n)]
        ends = np.minimum(left[order[:-1][tail]], left[order[1:][tail]])
        tail = tail[common[tail] < ends]
        tail = tail[data[one[tail]] == data[two[tail]]]
        common[tail] += 1
        one[tail] += 1
        two[tail] += 1
    groups = np.repeat(group, lengths)[order]
    common = np.minimum(common, np.minimum(left[order[:-1]], left[order[1:]]))
    common[groups[1:] != groups[:-1]] = 0
    return order, common


def maximal_repeats(data: np.ndarray, at: np.ndarray, group: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of each repeat of `least` bytes or more that no common byte on either side extends."""
    if not len(data):
        return
    order, common = suffix_array(data, at, group)
    before = np.empty(len(data), np.int64)
    before[1:] = data[:-1]
    before[at[:-1][np.diff(at) > 0]] = -1 - np.flatnonzero(np.diff(at) > 0)  # at an edge, unlike any other
    before = before[order]
    start, end = K.runs(common >= least)
    if not len(start):
        return
    # Where every occurrence goes on to the left alike, the interval is part of a longer repeat.
    unlike = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    diverse = (unlike[end] > unlike[start]) | (before[start] < 0)
    for a, b in zip(start[diverse].tolist(), end[diverse].tolist()):
        stack: list[tuple[int, int]] = []
        heights = [*common[a:b].tolist(), 0]
        for i, h in enumerate(heights, a):
            low = i
            while stack and stack[-1][0] > h:
                length, low = stack.pop()
                if unlike[i] > unlike[low] or before[low] < 0:
                    yield length, order[low : i + 1]
            if h and (not stack or stack[-1][0] < h):
                stack.append((h, low))


PIECES = "a long, kinds long, n long, doc long, th long, pos int, low int, piece binary"


def _bytes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, at


def _codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data.view("<u4"), at // CODE


def _pairs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each two words in a row of each text: n words repeat where n - 1 codes do."""
    w = K.Words(data, at)
    inside = np.ones(len(w.code), bool)
    inside[w.at[1:][w.counts > 0] - 1] = False
    return w.grams(2).astype("<u4")[inside], np.concatenate(([0], np.cumsum(np.maximum(w.counts - 1, 0))))


def _cut(read: Callable):
    """The parts of texts (beginning at `base`) that `spans` lists, in the units that `read` makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last, data, at in K.blocks(whole.column("text")):
                batch, (data, at) = whole.slice(first, last - first), read(data, at)
                rows, found = anchored.lists(batch.column("spans"))
                text = np.repeat(np.arange(batch.num_rows), np.diff(rows))
                base = at[text] - batch.column("base").to_numpy()[text]
                low, high = found.field("start").to_numpy(), found.field("stop").to_numpy()
                for part in np.array_split(np.arange(len(text)), len(text) // 4096 + 1):
                    own = {c: found.field(c).take(pa.array(part)) for c in ("a", "kinds", "n", "pos")} | {c: batch.column(c).to_numpy()[text[part]] for c in ("doc", "th")}
                    own |= {"low": low[part], "piece": [data[x:y].tobytes() for x, y in zip(base[part] + low[part], base[part] + high[part])]}
                    names = [x.split()[0] for x in PIECES.split(", ")]
                    yield pa.RecordBatch.from_pydict({c: own[c] for c in names})

    return run


def _segments(table: pa.Table, read: Callable):
    """From rows by place and length, the units, offsets, group and first place of segments: overlapping fragments of one text and anchor are one."""
    a, doc, th, low = (table.column(c).to_numpy() for c in ("a", "doc", "th", "low"))
    data, at = read(*K.text_bytes(table.column("piece")))
    high = low + np.diff(at)
    joins = np.zeros(len(a), bool)
    joins[1:] = (a[1:] == a[:-1]) & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (low[1:] <= high[:-1])
    again = np.zeros(len(a), np.int64)
    again[1:] = np.where(joins[1:], high[:-1] - low[1:], 0)
    keep = ~K.covered(len(data), at[:-1], at[:-1] + again)
    first = np.flatnonzero(~joins)
    own = np.concatenate(([0], np.cumsum(np.diff(at) - again)))
    group = np.cumsum(np.concatenate(([0], (a[1:] != a[:-1]).astype(np.int64))))
    return data[keep], own[np.append(first, len(a))], group[first], doc[first], th[first], low[first]


SPANS = "doc long, th long, start int, stop int"


def _span_rows(doc, th, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["doc", "th", "start", "stop"])


def _runs_within(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of true values that end where a segment does."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[at] = True
    before, after = np.append(False, mask[:-1]), np.append(mask[1:], False)
    return np.flatnonzero(mask & (~before | edge[:-1])), np.flatnonzero(mask & (~after | edge[1:])) + 1


def _repeats(read: Callable, window: int):
    """All occurrences of the maximal repeats within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in anchored.whole_groups(batches, BLOCK):
            data, at, group, doc, th, low = _segments(table, read)
            stop = np.zeros(len(data) + 1, np.int64)
            for length, places in maximal_repeats(data, at, group, window):
                np.maximum.at(stop, places, places + length)
            first = np.flatnonzero(stop)
            start, end = _runs_within(K.covered(len(data), first, stop[first]), at)
            if len(start):
                seg = np.searchsorted(at, start, "right") - 1
                yield _span_rows(doc[seg], th[seg], low[seg] + start - at[seg], low[seg] + end - at[seg])

    return run


def _settled_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal fragments in a batch one row goes on, with their number; the spans of all are given out at once.

    Spans (a is null) are united per text, so that neither a text that repeats itself nor a group of copies
    sends a row for each occurrence.
    """
    for batch in batches:
        names = ("a", "fh", "doc", "th", "start", "stop")
        a, fh, doc, th, low, high = (batch.column(c).to_numpy() for c in names)
        order = np.lexsort((low, th, doc, fh, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (fh[order][1:] != fh[order][:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(a)))
        yield batch.take(pa.array(order[first])).append_column("n", pa.array(count))
        yield anchored.united(batch, order[np.repeat(count, count) > 1])


def _long_words(window: int, words: int):
    """Texts in which some `window` bytes hold fewer than `words` words whole, besides one at either edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, _, data, at in K.blocks(batch.column("text")):
                w = K.Words(data, at)
                for i in range(len(at) - 1):
                    start = np.concatenate(([at[i] - 1], w.start[w.at[i] : w.at[i + 1]], [at[i + 1]]))
                    step = min(words + 2, len(start) - 1)
                    keep.append(bool((start[step:] - start[:-step] > window).any()))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def word_spans(docs: DataFrame, words: int, size: int = ANCHOR, most: int = MOST) -> DataFrame:
    """(doc, th, start, stop): spans, counted in words, that repeats of `words` words or more cover; they may overlap."""
    texts = anchored.keyed(docs).where(F.octet_length("text") >= 2 * words - 1)
    return _spans_in(texts, words - 1, size // CODE, most, _pairs, _codes).withColumn("stop", F.col("stop") + 1)


def repeat_spans(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, most: int = MOST) -> DataFrame:
    """(doc, th, start, stop): byte spans that repeats of `window` bytes or more cover; they may overlap."""
    return _spans_in(anchored.keyed(docs).where(F.octet_length("text") >= window), window, size, most)


def _spans_in(texts: DataFrame, window: int, size: int, most: int, read: Callable = _bytes, again: Callable = _bytes) -> DataFrame:
    """Spans of repeats of `window` units, which `read` makes of texts, and `again` of pieces cut from these."""
    n, step = width(texts.sparkSession), anchored.half(window, size)
    find = anchored.find(anchored.units_of(read), window, size)
    found = settle(texts.mapInArrow(K.frugal(lambda batches: _settled_here(find(batches))), anchored.ROWS + ", n long"))
    rows = found.where("a is not null")
    spans = found.where("a is null").select("doc", "th", "start", "stop")

    def several(rows: DataFrame, kinds: DataFrame) -> DataFrame:
        return rows.join(kinds.where("n > 1").select("a", "fh"), ["a", "fh"], "left_semi").select("doc", "th", "start", "stop")

    def kinds_of(rows: DataFrame, *one: str) -> DataFrame:
        """The different fragments, their number, and where one of each is: firsts are of one row, as in dropDuplicates()."""
        return settle(rows.groupBy("a", "fh").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in one]))

    kinds = kinds_of(rows, "doc", "th", "pos", "start", "stop", "k0", "k1")
    spans = spans.union(several(rows, kinds))
    sides = kinds.select("n", "doc", "th", F.lit(0).alias("base"), "pos", F.inline(anchored.halves(window, size))).where("a is not null")
    held = texts.select("doc", "th", F.lit(0).alias("base"), "text")
    while True:
        # Where all fragments of a group occur several times, nothing is left to find.
        groups = sides.groupBy("a").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).where("kinds > 1 and fewest = 1").select("a", "kinds")
        at = ("doc", "th", "base")
        lists = anchored.per_text(sides.join(groups, "a"), "a", "kinds", "n", "pos", "start", "stop", keys=at)
        pieces = settle(held.join(lists, list(at)).mapInArrow(K.frugal(_cut(read)), PIECES))
        small = pieces.where(F.col("kinds") <= most).select("a", "doc", "th", "low", "piece")
        spans = spans.union(small.repartition(n, "a").sortWithinPartitions("a", "doc", "th", "low", F.length("piece")).mapInArrow(K.frugal(_repeats(again, window)), SPANS))
        large = pieces.where(F.col("kinds") > most)
        if step == 1 or large.isEmpty():
            return spans
        # Only pieces of large groups go on: the texts aren't shuffled again.
        step, read = max(1, step // 8), again
        rows = settle(large.mapInArrow(anchored.dealt(anchored.units_of(read), step, window, size), anchored.DEALT))
        kinds = kinds_of(rows, "doc", "th", "base", "pos", "start", "stop")
        spans = spans.union(several(rows, kinds))
        sides = kinds.select("a", "n", "doc", "th", "base", "pos", "start", "stop")
        held = large.select("doc", "th", F.col("low").alias("base"), F.col("piece").alias("text"))


def marked(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, most: int = MOST) -> DataFrame:
    """row (the columns of `docs`) and `spans`: the spans to remove in its text (null: none)."""
    return with_lists(docs, spans=repeat_spans(docs, window, size, most))


def with_lists(docs: DataFrame, **spans: DataFrame) -> DataFrame:
    """row (all columns of `docs`, so that none of their names can clash), and a list for each of `spans`."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("th"))
    for name, rows in spans.items():
        out = out.join(anchored.per_text(settle(rows.distinct()), "start", "stop", name=name), ["doc", "th"], "left")
    return out.select("row", *spans)


def _removed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of each text, and which of them to remove."""
    data, at = K.text_bytes(batch.column("row").field("text"))
    rows, found = anchored.lists(batch.column("spans"))
    start, stop = found.field("start").to_numpy(), found.field("stop").to_numpy()
    by_words = "words" in batch.schema.names
    if by_words:
        word_rows, found = anchored.lists(batch.column("words"))
        first, last = found.field("start").to_numpy(), found.field("stop").to_numpy()
    for i in range(batch.num_rows):
        n, own, text = at[i + 1] - at[i], slice(rows[i], rows[i + 1]), data[at[i] : at[i + 1]]
        gone = K.covered(n, start[own], np.minimum(stop[own], n)) if rows[i] < rows[i + 1] else np.zeros(n, bool)
        if by_words and word_rows[i] < word_rows[i + 1]:
            w, own = K.Words(text, np.array([0, n])), slice(word_rows[i], word_rows[i + 1])
            low, high = K.runs(K.covered(len(w.start), first[own], np.minimum(last[own], len(w.start))))
            gone = gone | K.covered(n, w.start[low], w.end[high - 1])
        yield text, gone


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": batch.column("row").field("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for data, gone in _removed(batch.select(["row", "spans"])):
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(len(K.runs(gone)[0]))
            out["kept_sha256"].append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        if "words" in batch.schema.names:
            rows, found = anchored.lists(batch.column("words"))
            start, stop = found.field("start").to_numpy(), found.field("stop").to_numpy()
            out["n_passage_words"] = [int(K.covered(stop[a:b].max(), start[a:b], stop[a:b]).sum()) if a < b else 0 for a, b in zip(rows, rows[1:])]
        yield pa.RecordBatch.from_pydict(out)


def digests(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, most: int = MOST, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row. A null text is empty.

    A string of `window` bytes that starts at two places anywhere goes at both; rows that repeat a document
    count as two documents. With `words`, n_passage_words counts the words of each row in a sequence of so many
    that starts at two places anywhere, however few bytes it has; these alone remove nothing.
    """
    docs, schema = docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if words is None:
        return marked(docs, window, size, most).mapInArrow(_digests, schema)
    spark = docs.sparkSession
    by_bytes, by_words = alone(spark, lambda: repeat_spans(docs, window, size, most)), alone(spark, lambda: word_spans(docs, words, size, most))
    return with_lists(docs, spans=by_bytes, words=by_words).mapInArrow(K.frugal(_digests), schema + ", n_passage_words long")


def _kept_texts(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for (data, gone), null in zip(_removed(batch), batch.column("row").field("text").is_null().to_pylist()):
                if gone.any():
                    # A character goes only with all its bytes.
                    first = np.flatnonzero((data & 0xC0) != 0x80)
                    whole = np.logical_and.reduceat(gone, first)
                    data = data[~np.repeat(whole, np.diff(np.append(first, len(data))))]
                texts.append(None if null else data.tobytes().decode("utf-8", "replace"))
            fields = dict(zip(columns, batch.column("row").flatten())) | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([fields[c] for c in columns], columns)

    return run


def stripped(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, words: int | None = None, most: int = MOST) -> DataFrame:
    """`docs`, its columns kept, with repeats removed from the texts and n_chars, if there, counted anew.

    With `words`, repeats of so many words go, from the first word to the last, whatever their bytes. Repeats of
    `window` bytes are then looked for only in texts where such a repeat can hold fewer words: elsewhere
    it is one of `words` words, and goes but for words cut at its edges. Null texts stay null; a text that is
    all repeats becomes empty; rows that repeat an id are each judged by their own text.
    """
    spark = docs.sparkSession
    if words is None:
        found = marked(docs, window, size, most)
    else:
        texts = anchored.keyed(docs).where(F.octet_length("text") >= window).mapInArrow(_long_words(window, words), "doc long, th long, text string")
        by_bytes, by_words = alone(spark, lambda: _spans_in(texts, window, size, most)), alone(spark, lambda: word_spans(docs, words, size, most))
        found = with_lists(docs, spans=by_bytes, words=by_words)
    out = found.mapInArrow(K.frugal(_kept_texts(docs.columns)), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
