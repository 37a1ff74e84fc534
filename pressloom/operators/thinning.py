"""Ordered thinning: of each event the first row, then always the next one at least some hours after the last that was kept.

Which row is kept depends on all kept before it, but where a kept row leads is a function of its time alone: to the first
row of its event at least so many hours later. These pointers come from windows over a few hours of one event each. A chain has one row
at most in as many hours, its entry there; blocks of hours are joined in pairs, and in every round only the rows by which a block can be
entered are kept, with the pointer that leaves it. So a round has about half the rows of the one before, and there are as many rounds as
the number of blocks has binary digits. On the way back, each entry on the chain gives the one in its block's second half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from ..sources.tables import table


def cell(t: str, span: int) -> Column:
    """The span that a time lies in, also before 1970."""
    return F.expr(f"({t} - pmod({t}, {span})) div {span}")


def following(times: DataFrame, span: int) -> DataFrame:
    """(key, t, next): for each of an event's times the first one at least `span` later. times: key, t (long), each once.

    A window holds the times of one event within one span; which spans of an event have any is a small table of its own.
    """
    x = times.withColumn("cell", cell("t", span))
    cells = x.groupBy("key", "cell").agg(F.min("t").alias("first"))
    order = Window.partitionBy("key").orderBy("cell")
    ahead = cells.select("key", "cell", *(F.lead(c, n).over(order).alias(f"{c}{n}") for n in (1, 2) for c in ("cell", "first")))
    # The place to look for t + span is the next cell; behind its last time comes the first of the cell after it.
    asked = x.select("key", (F.col("cell") + 1).alias("cell"), (F.col("t") + span).alias("at"), F.lit(None).cast("long").alias("there"), F.col("t").alias("by"))
    there = x.select("key", "cell", F.col("t").alias("at"), F.col("t").alias("there"), F.lit(None).cast("long").alias("by"))
    # From the last time down, so that each row adds itself to what is known: a frame that ends with the group is read again for every row.
    rest = Window.partitionBy("key", "cell").orderBy(F.desc("at"), F.col("by").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(there).withColumn("next", F.last("there", ignorenulls=True).over(rest)).where("by is not null")
    found = found.select("key", (F.col("cell") - 1).alias("cell"), F.col("by").alias("t"), "next").join(ahead, ["key", "cell"])
    later = F.when(F.col("cell1") == F.col("cell") + 1, F.coalesce("next", "first2")).otherwise(F.col("first1"))
    return found.select("key", "t", later.alias("next"))


def reached(pointers: DataFrame, start: DataFrame, span: int) -> DataFrame:
    """(key, t): what the chains of `pointers` (key, t, next), each `span` ahead at least, from `start` (key, t) reach, the starts included."""
    now = cut(pointers)
    low, high = now.agg(F.min(cell("t", span)), F.max(cell("t", span))).first()
    block = lambda t, level: F.shiftright(cell(t, span) - F.lit(low), level)
    level, rounds = 0, []
    while low is not None and (high - low) >> level:
        rounds.append(now)
        level += 1
        inside = block("t", level) == block("next", level)
        on = now.select("key", F.col("t").alias("next"), F.col("next").alias("then"))
        stay = now.where(inside).join(on, ["key", "next"], "left").select("key", "t", F.col("then").alias("next"))
        left = stay.unionByName(now.where(~F.coalesce(inside, F.lit(False))))
        entries = left.where("next is not null").select("key", F.col("next").alias("t")).unionByName(start.select("key", "t")).distinct()
        now = cut(left.join(entries, ["key", "t"], "left_semi"))
    found = start.select("key", "t")
    for level, now in reversed(list(enumerate(rounds, 1))):
        more = now.where(block("t", level) == block("next", level)).join(found, ["key", "t"], "left_semi").select("key", F.col("next").alias("t"))
        found = cut(found.unionByName(more))
    return found


def thinned(rows: DataFrame, hours: float) -> DataFrame:
    """Rows of `rows` (id, ts, event_key, ...) to keep, in order of time and then of id. A row without an event is kept, one without a time isn't;
    of rows at the same time the least id counts, and rows that repeat an id and time are kept together."""
    span = int(hours * 3_600_000_000)
    timed = rows.where("ts is not null").withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp")))
    own = timed.where("event_key is not null")
    times = cut(own.groupBy(F.col("event_key").alias("key"), F.col("__t").alias("t")).agg(F.min("id").alias("least")))
    first = times.groupBy("key").agg(F.min("t").alias("t"))
    chain = reached(following(times.select("key", "t"), span), first, span).join(times, ["key", "t"])
    kept = own.join(chain.select(F.col("key").alias("event_key"), F.col("t").alias("__t"), F.col("least").alias("id")), ["event_key", "__t", "id"], "left_semi")
    return kept.select(*rows.columns).unionByName(timed.where("event_key is null").select(*rows.columns))


def thinned_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of a kind at least eight hours apart: few kinds, so each is a hot key."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("event_key"))
    return thinned(e, 8)
