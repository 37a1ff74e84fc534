"""Near-duplicate components: b-bit MinHash signatures, multi-index Hamming join, exact confirmation.

A signature has POSITIONS minima of BITS bits. Documents whose signatures differ in at most `radius` positions
become candidates with certainty: the positions are split into `chunks`, one of which has at most
radius // chunks = 1 error, and each chunk is indexed once for each position that may be wrong. Both follow from
the similarity asked for (see `plan`): at 0.85 a signature differs in 9.6 positions on average, and in more than 24
with a probability of 2.4 in a million; at 0.80, in more than 28 with 4.2 in a million. Every candidate is then
confirmed on full sets of shingles.

Buckets never become all their pairs. Equal word sequences are one node. In each bucket the least
document is compared with the rest; what that links is united; only members of a bucket that are still in
different components are compared further, in blocks: by signature, and, where that leaves a partner, by
counting common shingles. Only links that unite two components are given out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .anchored import whole_groups
from .tables import alone, settle, width

SHINGLE, PERCENT = 5, 85
POSITIONS, BITS = 64, 16
#: The most that a pair exactly at the threshold may be missed with, and the fewest positions of a chunk.
MISS, LEAST = 5e-6, 3
#: A larger group is split into parts of so many; every two of its parts meet, so no pair is missed.
MEMBERS = 4_000
_rng = np.random.default_rng(64_16)
STEP = _rng.integers(1, 2**62, POSITIONS, dtype=np.int64).astype(K.U) * K.U(2) + K.U(1)
SHIFT = _rng.integers(1, 2**62, POSITIONS, dtype=np.int64).astype(K.U)
SLOT = _rng.integers(1, 2**62, POSITIONS, dtype=np.int64).astype(K.U) * K.U(2) + K.U(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, K.Words]:
    """Distinct shingle hashes of each text, sorted, with their offsets. Fewer words than `size`: all as one."""
    w = K.Words(data, at, K.WHITE, lower=True)
    n = w.counts
    whole = np.arange(len(w.code)) + size <= w.limit()
    doc = np.repeat(np.arange(len(n)), n)
    code, doc = w.grams(size)[whole], doc[whole]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        alone = [K.mix(np.sum(w.code[w.at[d] : w.at[d + 1]] * K.TERM_CODE[: n[d]], dtype=K.U)[None] + K.U(n[d])) for d in short]
        code, doc = np.concatenate([code, *alone]), np.concatenate([doc, short])
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    code, doc = code[new], doc[new]
    return code, np.searchsorted(doc, np.arange(len(n) + 1)), w


def signatures(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BITS bits of the least value of each of POSITIONS hash functions, for each set that isn't empty."""
    out = np.zeros((len(at) - 1, POSITIONS), np.uint16)
    some = np.flatnonzero(np.diff(at))
    for k in range(POSITIONS) if len(some) else ():
        out[some, k] = K.mix(np.minimum.reduceat(code * STEP[k] + SHIFT[k], at[some])) & K.U(2**BITS - 1)
    return out


def plan(percent: int) -> tuple[int, int]:
    """(radius, chunks): the least radius that misses a pair at `percent` with a probability of at most MISS, and its chunks.

    A chunk of fewer than LEAST positions would bring most documents together: such a threshold is an error.
    """
    p = 1 - percent / 100
    miss = lambda r: sum(math.comb(POSITIONS, k) * p**k * (1 - p) ** (POSITIONS - k) for k in range(r + 1, POSITIONS + 1))
    radius = next(r for r in range(POSITIONS + 1) if miss(r) <= MISS)
    chunks = radius // 2 + 1
    if not 0 < percent <= 100 or POSITIONS // chunks < LEAST:
        raise ValueError(f"signatures of {POSITIONS} positions can't carry a similarity of {percent} %")
    return radius, chunks


def chunk_keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """For each signature: each chunk, with each of its positions left out."""
    part = sig.astype(K.U) * SLOT + K.U(1)
    part = K.mix(part * K.U(K.BASE))
    keys = np.empty(part.shape, K.U)
    for c in np.array_split(np.arange(POSITIONS), chunks):
        total = part[:, c].sum(axis=1, dtype=K.U)
        for left_out in c:
            keys[:, left_out] = K.mix(total - part[:, left_out] + SLOT[left_out])
    return keys


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in K.blocks(batch.column("text")):
                code, sets, w = shingle_sets(data, at, size)
                there, back, n = K.sums_of_words(w.code), K.sums_of_words(w.code[::-1]), len(w.code)
                columns = {
                    "doc_id": batch.column("doc_id").slice(first, last - first),
                    "n_shingles": np.diff(sets),
                    "f1": K.i64(K.spans(there, w.at[:-1], w.at[1:])),
                    "f2": K.i64(K.spans(back, n - w.at[1:], n - w.at[:-1])),
                    "sig": [x.tobytes() for x in signatures(code, sets)],
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _keys(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _unpack(batch.column("sig"))
            yield pa.RecordBatch.from_pydict({"key": K.i64(chunk_keys(sig, chunks).ravel()), "id": np.repeat(batch.column("id").to_numpy(), POSITIONS)})

    return run


def _unpack(column: pa.Array) -> np.ndarray:
    return K.text_bytes(column)[0].view(np.uint16).reshape(-1, POSITIONS)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in K.blocks(batch.column("text")):
                code, sets, _ = shingle_sets(data, at, size)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(first, last - first), "set": [code[a:b].tobytes() for a, b in zip(sets, sets[1:])]})

    return run


def _near(radius: int):
    """Pairs whose signatures differ in at most `radius` positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = (_unpack(batch.column("sig_a")) != _unpack(batch.column("sig_b"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(far <= radius))

    return run


def _similar(percent: int):
    """Pairs of sets with 100 * |A and B| >= percent * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (one, at), (two, bt) = K.text_bytes(batch.column("set_a")), K.text_bytes(batch.column("set_b"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = one[at[i] : at[i + 1]].view(K.U), two[bt[i] : bt[i + 1]].view(K.U)
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
                    continue
                spot = np.searchsorted(b, a)
                both = np.count_nonzero(b[np.minimum(spot, len(b) - 1)] == a)
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _across(radius: int, chunks: int):
    """From rows sorted by `a`, two parts of a bucket `key`: the members that have a partner in the other part (or in
    their own, if they are one), near by signature, of another component.

    A pair that shares several buckets counts in the first of them only. Pairs are not given out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1 << 20):
            group, key, root, own = (table.column(c).to_numpy() for c in ("a", "key", "root", "own"))
            sig = _unpack(table.column("sig"))
            every, asks = chunk_keys(sig, chunks), np.zeros(len(key), bool)
            low = np.searchsorted(group, group)
            apart = own[low] != own[np.searchsorted(group, group, "right") - 1]
            index, step = np.arange(len(key)), 0
            while len(index):
                step += 1
                index = index[index + step < len(key)]
                index = index[group[index] == group[index + step]]
                for part in np.array_split(index, len(index) // 20_000 + 1):
                    part = part[(root[part] != root[part + step]) & (~apart[part] | (own[part] != own[part + step]))]
                    part = part[(sig[part] != sig[part + step]).sum(axis=1) <= radius]
                    first = np.argmax(every[part] == every[part + step], axis=1)
                    part = part[every[part, first].view(np.int64) == key[part]]
                    asks[part] = asks[part + step] = True
            yield from table.select(["key", "id", "root"]).filter(pa.array(asks)).to_batches()

    return run


def met(rows: DataFrame, key: str, most: int) -> DataFrame:
    """`rows` (key, id, ...) with `a`: each two parts of about `most` rows of a key's meet under an `a` of their own.

    `own` numbers a row's part. A task so holds two parts at once, however many rows have one key.
    """
    parts = rows.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).alias("parts"))
    own = rows.join(parts, key).withColumn("own", F.pmod(F.xxhash64("id"), "parts"))
    out = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("a", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).drop("parts", "other")


def _linked(percent: int):
    """From rows sorted by group `a`: links between members of different components, as many as unite them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1 << 22):
            key, ident, root = (table.column(c).to_numpy() for c in ("a", "id", "root"))
            data, at = K.text_bytes(table.column("set"))
            code, at = data.view(K.U), at // 8
            found: list[tuple[int, int]] = []
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            for low, high in zip(edges, edges[1:]):
                found += _unite(code[at[low] : at[high]], at[low : high + 1] - at[low], ident[low:high], root[low:high], percent)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _unite(code: np.ndarray, at: np.ndarray, ident: np.ndarray, root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a group that unite its components. Each member's common shingles with all others are counted
    at once, from the postings of its shingles."""
    n, size = len(ident), np.diff(at)
    _, term = np.unique(code, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(term, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(term))))
    posting = owner[order]
    label = np.unique(root, return_inverse=True)[1]
    out = []
    for x in range(n - 1):
        mine = term[at[x] : at[x + 1]]
        length = first[mine + 1] - first[mine]
        spot = np.repeat(first[mine] - np.cumsum(length) + length, length) + np.arange(length.sum())
        both = np.bincount(posting[spot], minlength=n)
        hit = np.flatnonzero((100 * both >= percent * (size[x] + size - both)) & (label != label[x]))
        for y in hit:
            if label[y] != label[x]:
                out.append((int(ident[x]), int(ident[y])))
                label[label == label[y]] = label[x]
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) for each end of `edges` (a, b): root is the least id that it reaches.

    Alternating large-star and small-star steps until the edges stay the same; each round is written, so
    that a lost executor costs no earlier round. Only a count and a checksum come to the driver.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = mark(pairs)
    while before[0]:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        down = large.select(F.col("b").alias("hi"), F.col("a").alias("lo"))
        low = down.groupBy("hi").agg(F.min("lo").alias("m"))
        small = down.join(low, "hi").where("lo <> m").select(F.col("m").alias("a"), F.col("lo").alias("b"))
        pairs = settle(small.union(low.select(F.col("m").alias("a"), F.col("hi").alias("b"))).distinct())
        after = mark(pairs)
        if after == before:
            break
        before = after
    return pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, members: int = MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs` (doc_id, text; others are ignored).

    Null, empty and wordless texts have no shingles and are linked with nothing. A row without a doc_id is
    linked with nothing and kept, with a null component. Rows that repeat a doc_id are one node.
    """
    radius, chunks = plan(percent)
    spark = docs.sparkSession
    n = width(spark)
    base = settle(docs.select("doc_id", "text").mapInArrow(K.frugal(_fingerprints(size)), "doc_id long, n_shingles long, f1 long, f2 long, sig binary"))
    nodes = settle(base.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    sigs = nodes.select("id", "sig")
    keys = sigs.mapInArrow(_keys(chunks), "key long, id long").repartition(n, "key")
    heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head < tail")
    grouped = settle(keys.join(heads, "key").select("key", "head", "id"))
    star = settle(grouped.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())

    def side(df: DataFrame, name: str, value: str) -> DataFrame:
        return df.select(F.col("id").alias(name), F.col(value).alias(f"{value}_{name}"))

    wanted = settle(star.join(side(sigs, "a", "sig"), "a").join(side(sigs, "b", "sig"), "b").mapInArrow(_near(radius), "a long, b long").distinct())
    suspects = grouped.select("id").distinct()
    sets = settle(docs.select(F.col("doc_id").alias("id"), "text").join(suspects, "id", "left_semi").mapInArrow(K.frugal(_sets(size)), "id long, set binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        found = pairs.join(side(sets, "b", "set"), "b").join(side(sets, "a", "set"), "a")
        return found.mapInArrow(K.frugal(_similar(percent)), "a long, b long").distinct()

    first = settle(confirmed(wanted))
    roots = settle(connected(first))
    placed = grouped.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    across = met(placed.join(mixed, "key"), "key", members).join(sigs, "id").select("a", "key", "id", "root", "own", "sig")
    asking = settle(across.repartition(n, "a").sortWithinPartitions("a", "own").mapInArrow(_across(radius, chunks), "key long, id long, root long").distinct())
    second = met(asking, "key", members).select("a", "id", "root").join(sets, "id").repartition(n, "a").sortWithinPartitions("a").mapInArrow(K.frugal(_linked(percent)), "a long, b long")
    roots = connected(first.union(second))
    label = settle(nodes.select("f1", "f2", "id").join(roots, "id", "left").select("f1", "f2", F.coalesce("root", "id").alias("root")))
    found = base.join(label, ["f1", "f2"], "left")
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("root")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def deduplicated(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs`, all columns, with one row of each component: its least doc_id's.

    Rows without a doc_id all stay. Of rows that repeat a doc_id, the one with the least text hash stays.
    """
    gone = alone(docs.sparkSession, lambda: components(docs, size, percent).where("not kept").select(F.col("doc_id").alias("id")).distinct())
    # The caller's columns stay in a struct, so that none of their names can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    twice = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("th").alias("least")).where("n > 1 and id is not null")
    found = rows.join(gone, "id", "left_anti").join(twice, "id", "left")
    single = found.where("n is null").select("row.*")
    return single.union(found.where("n is not null and th = least").dropDuplicates(["id"]).select("row.*"))
