"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: each segment covers some documents and holds the postings of each of its terms,
sorted by position. Windows of the test items are a table too: up to BROADCAST of them, counted first, are sent to all
segments; of more, each goes to the segments that hold its rarest term, and to no other. There its terms' lists
are intersected, the rarest first: the starts that its list implies are looked up in the next list, shifted by that
term's place in the window, by binary search. What is left is an exact phrase match; with `slack`, the terms need only
be near their places. Nothing of the documents or the items is collected by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import alone, settle

WINDOW = 10
#: A segment is searched for so many windows at a time; more come in further rows.
TOGETHER = 20_000
#: So many windows (some 10 MB) are broadcast at most.
BROADCAST = 100_000

INDEX = "doc_ids array<long>, lengths array<int>, terms array<long>, firsts array<int>, positions binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in K.blocks(batch.column("text"), 1 << 21):
            w = K.Words(data, at, K.NON_ALNUM, lower=True)
            code = K.i64(w.code)
            order = np.argsort(code, kind="stable")
            code = code[order]
            firsts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, np.int64)
            ids = batch.column("doc_id").slice(first, last - first).to_pylist()
            parts = (ids, w.counts.astype(np.int32), code[firsts], firsts.astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.list_(k)) for x, k in zip(parts, kinds)), pa.array([order.astype("<i4").tobytes()], pa.binary())], [x.split()[0] for x in INDEX.split(", ")])


def build_index(docs: DataFrame) -> DataFrame:
    """One row for each segment: its number, its documents and their lengths, its terms and the postings of each.

    The number is written with the segment: equal segments (a file read twice, repeated rows) stay apart.
    """
    return settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.frugal(_segments), INDEX).withColumn("segment", F.monotonically_increasing_id()))


class Segment:
    """The postings of one segment."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, firsts: np.ndarray, positions: bytes):
        self.terms, self.positions = terms, np.frombuffer(positions, "<i4").astype(np.int64)
        self.firsts = firsts.astype(np.int64)
        self.ends = np.append(self.firsts[1:], len(self.positions))
        self.at = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        # Lists follow one another in the order of terms, so number * (n + 1) + position is sorted as a whole.
        self.span = len(self.positions) + 1
        self.sorted = np.repeat(np.arange(len(terms)), self.ends - self.firsts) * self.span + self.positions

    def number(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term's list, -1 if there is none."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        spot = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[spot] == terms, spot, -1)

    def phrases(self, windows: np.ndarray, sizes: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, document) of each start from which every term of a window stands within `slack` of its place,
        all in one document. With a slack a start may lie that far before the document or behind its last whole window.

        windows: one row of terms for each window; only the first sizes[i] count.
        """
        none = np.empty(0, np.int64)
        if not len(windows) or not len(self.terms):
            return none, none, none
        number = self.number(windows)
        used = np.arange(windows.shape[1]) < sizes[:, None]
        count = np.where(number >= 0, (self.ends - self.firsts)[number], 0)
        count = np.where(used, count, np.iinfo(np.int64).max)
        live = np.flatnonzero(count.min(axis=1) > 0)
        by_rarity = np.argsort(count[live], axis=1, kind="stable")
        rarest = by_rarity[:, 0]
        n = count[live, rarest]
        row = np.repeat(np.arange(len(live)), n)
        who = live[row]
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        found = self.positions[self.firsts[number[who, rarest[row]]] + inside]
        doc = np.searchsorted(self.at, found, "right") - 1
        shift = np.tile(np.arange(-slack, slack + 1), len(row))
        row, who, doc, start = (np.repeat(x, 2 * slack + 1) for x in (row, who, doc, found - rarest[row]))
        start = start + shift
        ok = (start >= self.at[doc] - slack) & (start + sizes[who] <= self.at[doc + 1] + slack)
        who, row, start, doc = who[ok], row[ok], start[ok], doc[ok]
        for k in range(1, windows.shape[1]):
            place = by_rarity[row, k]
            low = np.maximum(start + place - slack, self.at[doc])
            high = np.minimum(start + place + slack, self.at[doc + 1] - 1)
            key = number[who, place] * self.span
            # The first entry of the list at `low` or behind it is a hit if it isn't behind `high`.
            spot = np.searchsorted(self.sorted, key + low)
            following = self.sorted[np.minimum(spot, len(self.sorted) - 1)]
            hit = (place >= sizes[who]) | ((spot < len(self.sorted)) & (following <= key + high) & (low <= high))
            who, row, start, doc = who[hit], row[hit], start[hit], doc[hit]
        if slack:
            # Several places of the rarest term may imply one start.
            who, start, doc = np.unique(np.stack([who, start, doc]), axis=1)
        return who, start, doc


def _windows(size: int):
    """The windows of each item: its terms, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in K.blocks(batch.column("text")):
                w = K.Words(data, at, K.NON_ALNUM, lower=True)
                code, item, terms = K.i64(w.code), [], []
                for i, ident in enumerate(batch.column("item_id").slice(first, last - first).to_pylist()):
                    own = code[w.at[i] : w.at[i + 1]]
                    for j in range(max(1, len(own) - size + 1) if len(own) else 0):
                        item.append(ident)
                        terms.append(own[j : j + size])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["item", "terms"])

    return run


FOUND = "segment long, row int, item long, start int, stop int"


def _search(slack: int):
    """From segments with `asked`, a list of (item, terms): each place where an item's window is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                flat = {c: part.column(c).flatten().to_numpy() for c in ("lengths", "terms", "firsts")}
                s = Segment(**flat, positions=part.column("positions")[0].as_py())
                asked = part.column("asked").flatten()
                item, terms = asked.field("item").to_numpy(), asked.field("terms")
                sizes = terms.value_lengths().to_numpy().astype(np.int64)
                windows = np.zeros((len(sizes), int(sizes.max(initial=1))), np.int64)
                windows[np.arange(windows.shape[1]) < sizes[:, None]] = terms.flatten().to_numpy()
                who, start, doc = s.phrases(windows, sizes, slack)
                low, high = np.maximum(start, s.at[doc]), np.minimum(start + sizes[who], s.at[doc + 1])
                columns = (np.full(len(who), part.column("segment")[0].as_py()), doc.astype(np.int32), item[who], (low - s.at[doc]).astype(np.int32), (high - s.at[doc]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in FOUND.split(", ")])

    return run


def _by_rarest(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(segment, one): each window beside the segments that hold its rarest term. One with a term that no document has is left out."""
    asked = windows.select(F.explode("terms").alias("term")).distinct()
    held = index.select("segment", F.posexplode("terms").alias("i", "term"), "firsts", F.octet_length("positions").alias("end"))
    size_of = F.coalesce(F.get("firsts", F.col("i") + 1), (F.col("end") / 4).cast("int")) - F.get("firsts", F.col("i"))
    held = settle(held.select("segment", "term", size_of.alias("n")).join(asked, "term", "left_semi"))
    counts = held.groupBy("term").agg(F.sum("n").alias("n"))
    each = windows.select("terms", F.size(F.array_distinct("terms")).alias("different"), F.explode(F.array_distinct("terms")).alias("term")).distinct()
    rarest = each.join(counts, "term").groupBy("terms").agg(F.first("different").alias("different"), F.count("*").alias("there"), F.min(F.struct("n", "term"))["term"].alias("term")).where("there = different")
    return rarest.select("terms", "term").join(windows, "terms").join(held.select("term", "segment"), "term").select("segment", F.struct("item", "terms").alias("one"))


def occurrences(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = 0, together: int = TOGETHER, most: int = BROADCAST) -> DataFrame:
    """(segment, row, item, start, stop): each place, in words of a document, where a window of an item is found.

    Items without words or without an id match nothing. Repeated items and windows are found once. With `slack`,
    each term may stand that far from its place, and spans are cut at the document's edges. Up to `most` windows are
    broadcast; more are joined by their rarest terms. A task holds a segment and `together` windows.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    windows = settle(items.mapInArrow(_windows(size), "item long, terms array<long>").distinct())
    n, part = windows.count(), F.pmod(F.xxhash64("one.terms", "one.item"), F.col("parts"))
    if n <= most:
        blocks = windows.select(F.struct("item", "terms").alias("one"), F.lit(-(-n // together) or 1).alias("parts")).groupBy(part.alias("part")).agg(F.collect_list("one").alias("asked"))
        found = index.join(F.broadcast(blocks), F.lit(True))
    else:
        there = _by_rarest(index, windows)
        parts = there.groupBy("segment").agg(F.ceil(F.count("*") / together).alias("parts"))
        found = index.join(there.join(parts, "segment").groupBy("segment", part.alias("part")).agg(F.collect_list("one").alias("asked")), "segment")
    return found.select("segment", "lengths", "terms", "firsts", "positions", "asked").mapInArrow(K.frugal(_search(slack)), FOUND)


def search(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = 0, together: int = TOGETHER, most: int = BROADCAST) -> DataFrame:
    """A row for each indexed document: doc_id, n_words, the items found in it, and the word spans they cover."""
    found = occurrences(index, benchmark, size, slack, together, most)
    # Per document, spans are united before they are listed: as many words as it has bound them.
    found = found.groupBy("segment", "row").agg(F.collect_set("item").alias("items"), F.collect_set(F.struct(F.col("start").alias("a"), F.col("stop").alias("b"))).alias("spans"))
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("row", "one")).select("segment", "row", F.col("one.doc_ids").alias("doc_id"), F.col("one.lengths").cast("long").alias("n_words"))
    return docs.join(found, ["segment", "row"], "left").select("segment", "row", "doc_id", "n_words", F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"))


def _hit_count(spans):
    """Words in the union of the spans, taken in order of their starts."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["reach"]))).alias("n"), F.greatest(s["reach"], x["b"]).alias("reach"))
    return F.aggregate(F.array_sort(spans), start, step)["n"].cast("long")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = 0, together: int = TOGETHER, most: int = BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row. A null text has no words; rows that
    repeat a document are judged each by itself. With `slack`, near matches count too."""
    found = search(build_index(docs), benchmark, size, slack, together, most)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", _hit_count(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = 0) -> DataFrame:
    """`docs`, all columns, without the rows that hold a window of a benchmark item.

    A row is told by its text, so that rows repeating an id are judged each on its own. The caller's columns
    stay in a struct meanwhile: their names can't clash.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("th"))

    def hit() -> DataFrame:
        index = build_index(docs.select(F.xxhash64("text").alias("doc_id"), "text").where("text is not null"))
        bad = occurrences(index, benchmark, size, slack).select("segment", "row").distinct()
        return index.select("segment", F.posexplode("doc_ids").alias("row", "th")).join(bad, ["segment", "row"]).select("th").distinct()

    return rows.join(alone(docs.sparkSession, hit), "th", "left_anti").select("row.*")
