"""Packing documents into sequences of fixed length at balanced attention cost.

A document's tokens go to pieces: whole sequences first, cut off where the text is encoded, then one rest. Rests,
each shorter than a sequence, are packed in independent buckets of about BUCKET; so neither a long document nor a
hot key makes a bucket large. In a bucket the number of sequences follows from the number of tokens;
rests, longest first, each go to the sequence with the lowest estimated cost (linear in tokens, plus
quadratic in the length of each piece) that has room. What fits nowhere whole is cut to fill the rooms left,
so a bucket pads less than one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import settle
from .tokens import Encoder

LENGTH, BUCKET, END = 1024, 2048, 0
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
ENCODED = "doc_id long, row long, start long, length long, ids binary, doc_tokens long"
ENCODED_SCHEMA = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in ENCODED.split(", ")])
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _encoded(tokenizer: str, length: int, end: int):
    """Pieces of `length` ids with a place in a sequence of their own (offset 0), and rests with none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = Encoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows: list[tuple] = []
                for doc, row, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                    ids = encode(text or "") + tail
                    n = len(ids) // 4
                    rows += [(doc, row, at, min(length, n - at), ids[4 * at : 4 * (at + length)], n) for at in range(0, n, length)]
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "row", "start", "length", "ids", "doc_tokens"), zip(*rows))), schema=ENCODED_SCHEMA)

    return run


def assign(lengths: np.ndarray, room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start in it, length): each piece whole if it can be, else cut over the rooms left."""
    n = -(-int(lengths.sum()) // room)
    cost, left = np.zeros(n), np.full(n, room)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

    def put(s: int, piece: int, start: int, length: int) -> None:
        out[s].append((piece, start, length))
        left[s] -= length
        cost[s] += LINEAR * length + QUADRATIC * length * length

    late = []
    for piece in np.argsort(-lengths, kind="stable"):
        fits = np.where(left >= lengths[piece], cost, np.inf)
        s = int(np.argmin(fits))
        if fits[s] < np.inf:
            put(s, int(piece), 0, int(lengths[piece]))
        else:
            late.append(int(piece))
    for piece in late:
        start = 0
        while start < lengths[piece]:
            s = int(np.argmax(left))
            length = int(min(left[s], lengths[piece] - start))
            put(s, piece, start, length)
            start += length
    return out


def _packed(length: int):
    def run(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "ids", "row"], ignore_index=True)
        which, start, size, sequence, offset = [], [], [], [], []
        for number, held in enumerate(assign(frame["length"].to_numpy(), length)):
            at = 0
            for piece, first, n in held:
                which.append(piece)
                start.append(first)
                size.append(n)
                sequence.append((int(key[0]) << 32) + number)
                offset.append(at)
                at += n
        out = frame.loc[which, ["doc_id", "start", "length", "ids", "doc_tokens"]].reset_index(drop=True)
        out["ids"] = [ids[4 * first : 4 * (first + n)] for ids, first, n in zip(out["ids"], start, size)]
        out["start"] += np.array(start, np.int64)
        return out.assign(length=np.array(size, np.int64), sequence_id=np.array(sequence, np.int64), offset=np.array(offset, np.int64)).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, bucket: int = BUCKET) -> DataFrame:
    """The pieces of all rows of `docs` (doc_id, text), with their ids (little-endian 32-bit) and places.

    A null text is empty: one token, the end. Each row is a document, also one that repeats another: rows are dealt
    by their place in the table too, so repeats share no bucket. Sequences of rests have numbers from 0 on, whole ones below 0.
    """
    buckets = max(1, -(-docs.count() // bucket))
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    cut = settle(rows.mapInArrow(K.frugal(_encoded(tokenizer, length, end)), ENCODED))
    # A piece of full length is a sequence by itself: it takes no part in the exchange.
    whole = F.col("length") == length
    full = cut.where(whole).select("doc_id", "start", "length", "ids", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = cut.where(~whole).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)))
    return full.union(dealt.groupBy("bucket").applyInPandas(_packed(length), PIECES))


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces of pack(), with the CRC-32 of their ids in place of the ids."""
    return pack(docs, tokenizer, length).withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
