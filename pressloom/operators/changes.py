"""Tables after changes to some of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def updated(base: DataFrame, changes: DataFrame, key: str, columns: list[str], reset: dict[str, Column] | None = None) -> DataFrame:
    """`base` after a bulk update: rows of `changes` replace `columns` (nulls too) and reset others; the rest stays as it is."""
    new = changes.select(key, F.struct(*columns).alias("__new"))
    x = base.join(new, key, "left")
    hit = F.col("__new").isNotNull()
    set_ = {c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns} | {c: F.when(hit, v).otherwise(F.col(c)) for c, v in (reset or {}).items()}
    return x.select(*[set_.get(c, F.col(c)).alias(c) for c in base.columns])
