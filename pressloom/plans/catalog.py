"""All queries of the library by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import clocks, desk, drafting, evidence, gates, lists, selection, serving, state, texts, thinning, triage
from ..sources import catalogue, feeds, readings
from ..streaming import pulses
from . import oracle, oracle_desk, oracle_drafting, oracle_evidence, oracle_readings, oracle_streams, oracle_work


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    modules = (catalogue, clocks, desk, drafting, evidence, feeds, gates, lists, readings, selection, serving, state, texts, thinning, triage)
    found = {name: next(getattr(m, name) for m in modules if hasattr(m, name)) for name in oracle_sql()}
    # Greedy clusters, picks and pulses depend on order, which SQL can't express.
    return found | {"triage_labels": triage.triage_labels, "triage_counters": triage.triage_counters, "diversified_pick": selection.diversified_pick, "live_pulses": pulses.live_pulses, "triage_round": triage.triage_round, "scoring_round": selection.scoring_round}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | oracle_evidence.SQL | oracle_desk.SQL | oracle_drafting.SQL | oracle_readings.SQL | oracle_streams.SQL | oracle_work.SQL
