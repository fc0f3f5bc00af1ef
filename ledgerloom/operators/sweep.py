"""Days against intervals by an event sweep: starts, days and ends of a key in one ordered stream.

A join of days with the intervals they lie in gives a row per day and interval. Here an interval is two events, whatever
it covers, so the stream is as long as days and intervals together. The running value comes from slices that are cut from
the events themselves (`ordered.along`), so a key with nearly all days or intervals is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import SLICE_ROWS, along

_AT, _KIND, _STEP, _RUN = "_at", "_kind", "_step", "_run"  # kinds: 0 begins, 1 day, 2 ends


def _days(points: DataFrame, key: str, at: str, step) -> DataFrame:
    return points.select(F.col(key).alias("_key"), F.col(at).cast("date").alias(_AT), F.lit(1).alias(_KIND), step.alias(_STEP),
                         F.struct(*points.columns).alias("_day"))


def _edges(intervals: DataFrame, key: str, start: str, end: str, begin_step, end_step, *extra: str) -> DataFrame:
    """Two events an interval; none if it is empty or lacks a bound."""
    edge = lambda at, kind, step: F.struct(F.col(at).cast("date").alias(_AT), F.lit(kind).alias(_KIND), step.alias(_STEP))
    whole = intervals.where(F.col(start) <= F.col(end))
    return whole.select(F.col(key).alias("_key"), *extra, F.explode(F.array(edge(start, 0, begin_step), edge(end, 2, end_step))).alias("_e")) \
        .select("_key", *extra, "_e.*")


def sums_within(intervals: DataFrame, points: DataFrame, key: str, interval: str, start: str, end: str, at: str,
                value: str, name: str, rows: int = SLICE_ROWS) -> DataFrame:
    """(interval, name): the sum of `value` over the key's points from start to end, both included.

    It is the running sum at the end less the one before the start. Intervals without a bound or that end before they
    start are left out; points without a date belong to none. `interval` must be unique.
    """
    zero = F.lit(0).cast(points.schema[value].dataType)
    days = _days(points.where(F.col(at).isNotNull()).select(key, at, value), key, at, F.coalesce(value, zero)).withColumn(interval, F.lit(None).cast(intervals.schema[interval].dataType))
    edges = _edges(intervals, key, start, end, zero, zero, interval)
    events = days.drop("_day").unionByName(edges)
    ran = along(events, ["_key"], [_AT, _KIND], running={_RUN: _STEP}, rows=rows).where(F.col(_KIND) != 1)
    return ran.groupBy(interval).agg(F.sum(F.when(F.col(_KIND) == 2, F.col(_RUN)).otherwise(-F.col(_RUN))).alias(name))


def under_cover(points: DataFrame, intervals: DataFrame, key: str, start: str, end: str, at: str, name: str,
                rows: int = SLICE_ROWS) -> DataFrame:
    """The points with whether any interval of their key covers them; a point without a date is not covered."""
    days = _days(points, key, at, F.lit(0))
    edges = _edges(intervals, key, start, end, F.lit(1), F.lit(-1)).withColumn("_day", F.lit(None).cast(days.schema["_day"].dataType))
    ran = along(days.unionByName(edges), ["_key"], [_AT, _KIND], running={_RUN: _STEP}, rows=rows).where(F.col(_KIND) == 1)
    return ran.select("_day.*", ((F.col(_RUN) > 0) & F.col(_AT).isNotNull()).alias(name))
