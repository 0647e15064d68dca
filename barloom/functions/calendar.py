"""Sessions and calendar keys of a UTC timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def session_code(dt: Column) -> Column:
    """0 closed or weekend, 1 Tokyo [2, 8), 2 London [8, 13), 3 New York [17, 22), 4 overlap [13, 17)."""
    h = F.hour(dt)
    code = F.when(h.between(2, 7), 1).when(h.between(8, 12), 2).when(h.between(17, 21), 3).when(h.between(13, 16), 4).otherwise(0)
    return F.when(F.weekday(dt) >= 5, 0).otherwise(code)


def session_phase(dt: Column) -> Column:
    """sydney [0, 2), tokyo [2, 9), london [9, 13), newyork [13, 22), pre_tokyo [22, 24)."""
    h = F.hour(dt)
    return F.when(h < 2, "sydney").when(h < 9, "tokyo").when(h < 13, "london").when(h < 22, "newyork").otherwise("pre_tokyo")


# Weights of phases, and of the two severest regimes.
PHASE_WEIGHT = {"pre_tokyo": 0.5, "tokyo": 0.6, "london": 0.8, "newyork": 1.0, "sydney": 0.4}
REGIME_WEIGHT = {4: 0.3, 3: 0.7}


def bridge_gate(dt: Column, regime: Column) -> Column:
    """Weight of the phase times weight of the regime's code (1 below 3); 0 at weekends."""
    phase = session_phase(dt)
    weight = F.coalesce(*(F.when(phase == k, F.lit(v)) for k, v in PHASE_WEIGHT.items()), F.lit(0.0))
    severe = F.coalesce(*(F.when(regime >= k, F.lit(v)) for k, v in REGIME_WEIGHT.items()), F.lit(1.0))
    return F.when(F.weekday(dt) >= 5, 0.0).otherwise(weight * severe)


def slot_id(dt: Column) -> Column:
    """Number of the five-minute slot within the week, Monday's first being 0."""
    return F.weekday(dt) * 288 + F.hour(dt) * 12 + F.floor(F.minute(dt) / 5)


def hour_of_week(dt: Column) -> Column:
    return F.weekday(dt) * 24 + F.hour(dt)


def quarter_id(dt: Column) -> Column:
    return F.concat(F.year(dt).cast("string"), F.lit("Q"), F.quarter(dt).cast("string"))


def week_start(dt: Column) -> Column:
    return F.date_trunc("week", dt).cast("timestamp_ntz")
