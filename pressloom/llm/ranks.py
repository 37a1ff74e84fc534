"""Positions of rows within their group, for groups of any size: no group is held by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settle


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the number of the run of equal groups in it, and the place within the run."""
    part, last, run, held = TaskContext.get().partitionId(), None, -1, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        group = batch.column("__group").dictionary_encode()
        code, at = group.indices.to_numpy(), np.arange(n)
        new = np.concatenate(([run < 0 or group.dictionary[code[0]].as_py() != last], code[1:] != code[:-1]))
        since = np.maximum.accumulate(np.where(new, at, -1))
        place = np.where(since >= 0, at - since, held + at)
        runs = run + np.cumsum(new)
        last, run, held = group.dictionary[code[-1]].as_py(), int(runs[-1]), int(place[-1]) + 1
        added = [pa.array(np.full(n, part, np.int32)), pa.array(runs, pa.int64()), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "__part", "__run", "__place"])


def ranked(df: DataFrame, group: list[str], order: list[Column | str], name: str, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all, if none are given), settled, with `name`: each row's position from 0 within its group, in
    the given order, nulls first.

    Rows are sorted in ranges, whose runs of one group are numbered where they lie. A range starts within at most one
    group, so the counts to add are at most one for each range: that many rows are broadcast. Rows that tie in `order` may
    be many: a last key, the row's place in the input, spreads them.
    """
    keyed = df.withColumn("__group", F.to_json(F.struct(*group)) if group else F.lit("")).withColumn("__salt", F.monotonically_increasing_id())
    by = [*[F.col(x).asc_nulls_first() for x in group], *[F.col(x).asc_nulls_first() if isinstance(x, str) else x for x in order], F.col("__salt")]
    kept = df.columns if keep is None else keep
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(*kept, "__group")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    rows = settle(dealt.mapInArrow(_numbered, f"{schema}, __part int, __run long, __place long"))
    counts = rows.groupBy("__group", "__part").agg(F.count("*").alias("n"), F.min("__run").alias("run"))
    before = F.sum("n").over(Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("__start", before).where("__start > 0 and run = 0").select("__part", F.lit(0).cast("long").alias("__run"), "__start")
    placed = rows.join(F.broadcast(starts), ["__part", "__run"], "left").withColumn(name, F.col("__place") + F.coalesce("__start", F.lit(0)))
    return placed.select(*kept, name)
