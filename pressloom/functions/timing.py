"""Time and number rules as column expressions: local hours, health, relative and written dates, retry waits, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import seconds

ZONE, OPENS = "Europe/Oslo", 6
#: Minutes of delay that count, months, symbols written with four digits, waits by number of attempts.
PULSE_MINUTES, WARNING_MINUTES, ERROR_MINUTES = 5, 10, 15
MONTHS = "januar februar mars april mai juni juli august september oktober november desember".split()
FOUR_DIGITS = ["EURNOK", "USDNOK", "GBPNOK", "CHFNOK", "SEKNOK", "DKKNOK"]
SCORING_WAITS, RESEARCH_WAITS, JOB_STEP, JOB_MOST, CASE_WAIT = (90, 300, 900), (120, 420, 1200), 30, 300, 120
ISO = r"(?i)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def local(ts: Column) -> Column:
    """A UTC time as the clock shows it in ZONE."""
    return F.from_utc_timestamp(ts.cast("timestamp_ntz").cast("timestamp"), ZONE)


def is_open(ts: Column) -> Column:
    return F.hour(local(ts)) >= OPENS


def health(last_success: Column, enabled: Column, now: Column) -> Column:
    """A struct (status, delay_minutes, gap_minutes): how late a five-minute pulse is within its hours."""
    opened = (F.hour(local(now)) - OPENS) * 60 + F.minute(now) + F.second(now) / 60
    age = F.when(last_success.isNotNull(), F.greatest(F.lit(0.0), (seconds(now) - seconds(last_success)) / 60))
    gap = F.greatest(F.lit(0.0), F.least(age, opened))  # least() passes over a null: never succeeded
    status = F.when(~enabled, "paused").when(~is_open(now), "closed").when(gap >= ERROR_MINUTES, "error").when(gap >= WARNING_MINUTES, "warning").otherwise("ok")
    late = F.when(enabled & is_open(now), F.floor(F.greatest(F.lit(0.0), gap - PULSE_MINUTES))).otherwise(0)
    return F.struct(status.alias("status"), late.cast("long").alias("delay_minutes"), F.floor(gap).cast("long").alias("gap_minutes"))


def watch_late(last_success: Column, now: Column) -> Column:
    """Whether the official watch, open on weekdays from 6 to 16 UTC, has been without success for over 10 minutes."""
    watching = F.dayofweek(now).between(2, 6) & F.hour(now).between(6, 16)
    return watching & (last_success.isNull() | (seconds(now) - seconds(last_success) > 600))


def relative(ts: Column, now: Column) -> Column:
    minutes = F.floor(F.greatest(F.lit(0.0), seconds(now) - seconds(ts)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    said = lambda n, one, more: F.concat(n.cast("string"), F.when(n == 1, f" {one} siden").otherwise(f" {more} siden"))
    return F.when(ts.isNull(), "").when(minutes < 1, "nå").when(minutes < 60, said(minutes, "min", "min")).when(hours < 24, said(hours, "time", "timer")).otherwise(said(days, "dag", "dager"))


def clock(ts: Column) -> Column:
    return F.coalesce(F.date_format(local(ts), "HH:mm"), F.lit(""))


def full_date(ts: Column) -> Column:
    t = local(ts)
    month = F.get(F.array(*map(F.lit, MONTHS)), F.month(t) - 1)
    return F.coalesce(F.concat(F.dayofmonth(t).cast("string"), F.lit(". "), month, F.lit(" "), F.year(t).cast("string"), F.lit(" kl. "), F.date_format(t, "HH:mm")), F.lit(""))


def strict_iso(text: Column) -> Column:
    """The instant of a complete ISO date and time with its zone; null for anything else, also for days that don't exist."""
    zoned = F.regexp_replace(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"(?i)(T\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    return F.when(text.rlike(ISO), zoned.try_cast("timestamp"))


def wait_seconds(attempts: Column, waits: tuple[int, int, int]) -> Column:
    """Wait before the next try, by the attempts made before this failure."""
    n = F.coalesce(attempts, F.lit(0))
    return F.when(n >= 2, waits[2]).when(n == 1, waits[1]).otherwise(waits[0])


def job_wait_seconds(attempts: Column) -> Column:
    return F.least(F.lit(JOB_MOST), JOB_STEP * attempts)


def _number(x: Column, digits: int) -> Column:
    return F.translate(F.format_number(x, digits), ",.-", " ,−")


def market_value(symbol: Column, x: Column) -> Column:
    return F.when(symbol == "NOKPOLICY", F.concat(_number(x, 2), F.lit(" %"))).when(symbol.isin(FOUR_DIGITS), _number(x, 4)).otherwise(_number(x, 2))


def market_change(symbol: Column, x: Column) -> Column:
    sign = F.when(x > 0, "+").when(x < 0, "−").otherwise("")
    return F.concat(sign, _number(F.abs(x), 2), F.when(symbol == "NOKPOLICY", " pp").otherwise(" %"))
