"""NumPy kernels that work on a block of texts at once, inside Spark tasks.

A block is the UTF-8 bytes of some texts laid end to end, with the offsets where each begins.
All hashes are 64 bits and depend on content alone, so that equal strings meet wherever they are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


@cache
def _trim():
    """The C library's call that gives free memory back to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def frugal(run: Callable) -> Callable:
    """`run`, a function over the batches of a partition, handing back memory that is free when these are done: a worker stays for
    the next tasks, beside those of other cores and the JVM."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := _trim()) is not None:
            trim(0)

    return out


_rng = np.random.default_rng(0x5EED)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
TERM_CODE = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and letters.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x30] = NON_ALNUM[0x3A:0x41] = NON_ALNUM[0x5B:0x61] = NON_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = BASE if which == "up" else pow(BASE, -1, 2**64)
        steps = np.full(1 << max(18, (n - 1).bit_length()), base, U)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=U)
    return _powers[which][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and n+1 offsets. A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of texts of about `size` bytes; one longer text is a block alone."""
    if not len(column):
        return
    data, at = text_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1))
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * _power("up", len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span [start, end) of bytes."""
    raw = (sums[end] - sums[start]) * _power("down", len(sums))[start]
    return mix(raw + (end - start).astype(U) * TERM_CODE[63])


class Words:
    """The words of a block: byte spans, the document offsets counted in words, and a hash of each word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, separators: np.ndarray = WHITE, lower: bool = False):
        data = LOWER[data] if lower else data
        self.data, inside = data, ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.start, at).astype(np.int64)
        self.code = spans(prefix(data), self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def limit(self) -> np.ndarray:
        """For each word, where its document ends."""
        return np.repeat(self.at[1:], self.counts)

    def grams(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on; those that cross into the next document mean nothing."""
        out = np.zeros(len(self.code), U)
        for k in range(min(n, len(out))):
            out[: len(self.code) - k] += self.code[k:] * TERM_CODE[k]
        return mix(out)


def sums_of_words(code: np.ndarray) -> np.ndarray:
    out = np.zeros(len(code) + 1, U)
    np.cumsum(code * _power("up", len(code)), out=out[1:])
    return out


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` keys in a row, in two passes over blocks of that width."""
    n = len(keys)
    if n < width:
        return keys[:0]
    full = np.full(-(-n // width) * width, U(2**64 - 1), U)
    full[:n] = keys
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(gram: np.ndarray, at: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that hold the least hash (the first of equals) of any whole window of `window` units, and where
    the first and the last window with that anchor start.

    gram[i] hashes the `size` units from i. Equal windows have their anchor at the same place within
    them, so two windows can be equal only where their anchors have the same hash.
    """
    n = len(gram)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none, none
    key = (gram & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    least = sliding_min(key[: n - size + 1], window - size + 1)
    limit = np.repeat(at[1:], np.diff(at))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + window <= limit)
    if not len(start):
        return none, none, none
    found = (least[start] & U(0xFFFFFFFF)).astype(np.int64)
    # The windows of an anchor follow one another: a lower hash that comes in stays until the anchor has gone.
    new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    return found[new], start[new], start[np.append(new[1:], len(start)) - 1]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64)
