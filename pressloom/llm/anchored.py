"""Where equal windows may be: occurrences of content-chosen anchors, and the fragment around each.

Two windows can be equal only where their anchors (see kernels.anchors) are, at the same place within them.
So instead of every window, a text sends one row for each anchor: a hash of the anchor, a hash of the
fragment that its windows cover, and where it is. Equal fragments are one from there on; only differing fragments
around a common anchor have their text compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

ROWS = "a long, fh long, doc long, th long, pos int, start int, stop int, k0 long, k1 long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc (the id, null as the least long), th (a hash of the text) and text of each row: what a row is found by."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("th"), "text")


def half(window: int, size: int) -> int:
    """Places that an anchor can have in a window, halved."""
    return (window - size) // 2 + 1


def core(pos: np.ndarray, place: np.ndarray, step: int, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What all windows with their anchor (at `pos`) at place * step units or up to step - 1 more have in common."""
    return pos - place * step, pos - np.minimum((place + 1) * step - 1, window - size) + window


def find(units: Callable, window: int, size: int) -> Callable:
    """For mapInArrow over (doc, th, text): the rows of ROWS.

    [start, stop) is what the windows of the anchor at `pos` cover. k0 and k1 hash the cores of windows with the
    anchor in their first or their second half (null: there is none): equal windows share one of these keys.
    """
    step = half(window, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in K.blocks(batch.column("text")):
                gram, at, span = units(data, at, size)
                pos, low, high = K.anchors(gram, at, window, size)
                text = np.searchsorted(at, pos, "right") - 1
                doc, th = (batch.column(c).to_numpy()[first:last][text] for c in ("doc", "th"))
                here = [(x - at[text]).astype(np.int32) for x in (pos, low, high + window)]
                columns = [pa.array(x) for x in (K.i64(gram[pos]), K.i64(span(low, high + window)), doc, th, *here)]
                for place in (0, 1):
                    some = (pos - high < step) if place == 0 else (pos - low >= step)
                    key = np.zeros(len(pos), np.int64)
                    key[some] = K.i64(K.mix(span(*core(pos[some], place, step, window, size)) + K.U(place)))
                    columns.append(pa.array(key, mask=~some))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROWS.split(", ")])

    return run


def units_of(read: Callable) -> Callable:
    """For find() and dealt(): hashes over the units (bytes, or codes of more) that `read` makes of bytes and offsets."""

    def units(data: np.ndarray, at: np.ndarray, size: int):
        data, at = read(data, at)
        sums = K.prefix(data) if data.itemsize == 1 else K.sums_of_words(data.astype(K.U))
        start = np.arange(max(0, len(data) - size + 1))
        gram = np.zeros(len(data), K.U)
        gram[: len(start)] = K.spans(sums, start, start + size)
        return gram, at, lambda low, high: K.spans(sums, low, high)

    return units


def word_units(data: np.ndarray, at: np.ndarray, size: int):
    w = K.Words(data, at)
    sums = K.sums_of_words(w.code)
    return w.grams(size), w.at, lambda low, high: K.spans(sums, low, high)


def united(batch: pa.RecordBatch, some: np.ndarray) -> pa.RecordBatch:
    """The spans of `some` rows of ROWS, united for each text, as rows of ROWS and n whose key is null."""
    doc, th, low, high = (batch.column(c).to_numpy()[some] for c in ("doc", "th", "start", "stop"))
    order = np.lexsort((low, th, doc))
    doc, th, low, high = doc[order], th[order], low[order], high[order]
    apart = np.ones(len(doc), bool)
    # Spans of one text follow their anchors: none holds another that starts later.
    apart[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (low[1:] > high[:-1])
    head = np.flatnonzero(apart)
    tail = np.append(head[1:], len(doc))[: len(head)] - 1
    own = {"doc": doc[head], "th": th[head], "start": low[head], "stop": high[tail], "n": np.zeros(len(head), np.int64)}
    fields = [(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in (*ROWS.split(", "), "n long")]
    return pa.RecordBatch.from_arrays([pa.array(own[c], kind) if c in own else pa.nulls(len(head), kind) for c, kind in fields], [c for c, _ in fields])


DEALT = "a long, fh long, doc long, th long, base int, pos int, start int, stop int, n long"


def dealt(units: Callable, step: int, window: int, size: int) -> Callable:
    """For mapInArrow over pieces of texts (doc, th, pos, low, piece, n; `piece` begins at `low`): the windows of each piece
    in runs with the anchor at `step` places, by the hash of what all such windows share. With a step of 1 that is the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in K.blocks(batch.column("piece")):
                _, at, span = units(data, at, size)
                doc, th, anchor, low, n = (batch.column(c).to_numpy()[first:last] for c in ("doc", "th", "pos", "low", "n"))
                pos, high = anchor.astype(np.int64) - low, np.diff(at)
                least, most = np.maximum(0, pos - high + window) // step, pos // step
                many = most - least + 1
                one = np.repeat(np.arange(last - first), many)
                place = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + least[one]
                start, stop = np.maximum(0, pos[one] - (place + 1) * step + 1), np.minimum(high[one], pos[one] - place * step + window)
                left, right = core(pos[one], place, step, window, size)
                key = K.mix(span(at[one] + left, at[one] + right) + place.astype(K.U))
                columns = [K.i64(key), K.i64(span(at[one] + start, at[one] + stop)), doc[one], th[one], low[one], anchor[one]]
                columns += [(x + low[one]).astype(np.int32) for x in (start, stop)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, n[one])], [x.split()[0] for x in DEALT.split(", ")])

    return run


def halves(window: int, size: int) -> Column:
    """For F.inline: key and span of the windows with the anchor in their first half, and of the others."""
    step = half(window, size)
    run = lambda key, start, stop: F.struct(F.col(key).alias("a"), start.alias("start"), stop.alias("stop"))
    return F.array(run("k0", F.greatest("start", F.col("pos") - step + 1), F.col("stop")), run("k1", F.col("start"), F.least("stop", F.col("pos") - step + window)))


def per_text(rows: DataFrame, *values: str | Column, name: str = "spans", keys: tuple[str, ...] = ("doc", "th")) -> DataFrame:
    """The rows of each text (doc, th) as one list; no longer than the text itself, if `rows` repeats none."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*values)).alias(name))


def lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Offsets and values of a column of lists of structs; a null counts as empty."""
    if column.null_count:
        lengths = column.value_lengths().fill_null(0).to_numpy()
    else:
        lengths = column.value_lengths().to_numpy()
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), column.flatten()


def whole_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """From rows sorted by `a`: tables of about `size` bytes that split no group."""

    def parts(table: pa.Table) -> Iterator[pa.Table]:
        key, at = table.column("a").to_numpy(), 0
        each = max(1, int(len(key) * size / max(table.nbytes, 1)))
        while at < len(key):
            end = int(np.searchsorted(key, key[min(at + each, len(key)) - 1], "right"))
            yield table.slice(at, end - at)
            at = end

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.nbytes for x in held) >= size:
            table = pa.Table.from_batches(held)
            key = table.column("a").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from parts(table.slice(0, cut))
                held = table.slice(cut).to_batches()
    if held:
        yield from parts(pa.Table.from_batches(held))
