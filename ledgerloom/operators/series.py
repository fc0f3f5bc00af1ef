"""Operators on a short ordered series (one row per month): these run over a calendar, not over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(by: list[str], at: str):
    return Window.partitionBy(*by).orderBy(at)


def interpolate(spine: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """Fill gaps linearly by days between the known neighbours; beyond the ends, hold the end value."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).cast("double").alias("v")))
    back = _window(by, at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = _window(by, at).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = spine.withColumn("_k", known) \
        .withColumn("_a", F.last("_k", ignorenulls=True).over(back)) \
        .withColumn("_b", F.first("_k", ignorenulls=True).over(ahead))
    span, offset = F.datediff("_b.t", "_a.t"), F.datediff(at, "_a.t")
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * offset / F.nullif(span, F.lit(0))
    return out.withColumn(name, F.coalesce(line, "_a.v", "_b.v")).drop("_k", "_a", "_b")


def compound(frame: DataFrame, by: list[str], at: str, rate: Column, name: str) -> DataFrame:
    """Index grown by the rate of each period, starting at 1 before the first."""
    upto = _window(by, at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumn("_g", F.log1p(rate)).withColumn(name, F.exp(F.sum("_g").over(upto))).drop("_g")


def monthly_rate(annual: Column, low: float, high: float) -> Column:
    """Annual rate clipped to a range and turned into a monthly one."""
    return F.pow(1 + F.least(F.greatest(annual, F.lit(low)), F.lit(high)), 1.0 / 12) - 1


def lag_clamped(frame: DataFrame, by: list[str], at: str, value: str, k: int, name: str) -> DataFrame:
    """Value k periods earlier; the first periods use the first value."""
    w = _window(by, at)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return frame.withColumn(name, F.coalesce(F.lag(value, k).over(w), first))


def standardise(frame: DataFrame, value: str, name: str, beta: float = 1.0, floor: float = 0.1) -> DataFrame:
    """beta * (x - mean) / max(population deviation, floor), over the whole series."""
    stats = frame.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    mean, deviation = stats.select("m").scalar(), stats.select("s").scalar()
    return frame.withColumn(name, beta * (F.col(value) - mean) / F.greatest(deviation, F.lit(floor)))
