"""Allocation, rescaling and rounding of amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.keyed import null_safe_join


def cents(value) -> Column:
    """Round half up to cents, after dropping binary noise below the eighth decimal."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("decimal(28,8)"), 2).cast("decimal(18,2)")


def allocate(parts: DataFrame, by: list[str], total: str, weight: str, name: str) -> DataFrame:
    """Split each group's total over its rows by weight; all-zero weights split it equally."""
    sums = parts.groupBy(*by).agg(F.sum(weight).cast("double").alias("_w"), F.count("*").alias("_k"))
    share = F.when(F.col("_w") <= 0, 1.0 / F.col("_k")).otherwise(F.col(weight) / F.nullif(F.col("_w"), F.lit(0.0)))
    return null_safe_join(parts, sums, by) \
        .withColumn(name, F.col(total).cast("double") * share).drop("_w", "_k")


def rescale(lines: DataFrame, targets: DataFrame, by: list[str], amount: str, target: str,
            also: list[str] = ()) -> DataFrame:
    """Scale amounts so that each group sums to its target, to the cent; groups without one stay.

    The factors are one row per group of a calendar-by-segment kind. They are cached and counted,
    so that Spark knows their true size when it decides whether to broadcast them; too large a
    table falls back to a shuffled join.
    """
    sums = lines.groupBy(*by).agg(F.sum(amount).alias("_sum"))
    positive = (F.col("_sum") > 0) & (F.col(target) > 0)
    factors = null_safe_join(sums, targets.select(*by, target), by) \
        .select(*by, F.when(positive, F.col(target).cast("double") / F.col("_sum").cast("double")).alias("_f"))
    factors = factors.persist()
    factors.count()
    out = null_safe_join(lines, factors, by, "left")
    for c in [amount, *also]:
        scaled = cents(F.col(c).cast("double") * F.coalesce("_f", F.lit(1.0)))
        out = out.withColumn(c, scaled)
    return out.drop("_f")


def settle_residual(lines: DataFrame, document: str, order: list[str], amount: str, totals: DataFrame,
                    total: str, name: str) -> DataFrame:
    """Round line amounts to cents and let the last line absorb what the document total lacks.

    `totals` holds the document and its total. One aggregate per document finds the sum and the
    last line (combined map-side, so a document with very many lines is no problem); the lines are
    joined once, with what their document's last line has to take.
    """
    rounded = lines.withColumn(name, cents(amount))
    sums = rounded.groupBy(document).agg(F.sum(name).alias("_sum"), F.max(F.struct(*order)).alias("_last"))
    gaps = sums.join(totals.select(document, cents(total).alias("_total")), document) \
        .select(document, "_last", (F.col("_total") - F.col("_sum")).alias("_gap"))
    is_last = F.struct(*order) == F.col("_last")
    return rounded.join(gaps, document) \
        .withColumn(name, (F.col(name) + F.when(is_last, F.col("_gap")).otherwise(0)).cast("decimal(18,2)")) \
        .drop("_gap", "_last")


def split_by_mix(totals: DataFrame, mix: DataFrame, measures: list[str], digits: int = 1) -> DataFrame:
    """Split consolidated totals over segments by their mix, rounding each part by itself.

    `mix` holds one array column `segments` of (segment_code, segment_name, mix) structs in one
    row; exploding that array keeps this a per-row expression instead of a join.
    """
    parts = totals.withColumn("_s", F.explode(mix.select("segments").scalar()))
    return parts.select(
        *[c for c in totals.columns if c not in measures],
        F.col("_s.segment_code"), F.col("_s.segment_name"),
        *[F.round(F.col(m) * F.col("_s.mix"), digits).alias(m) for m in measures])


def scale_to_target(frame: DataFrame, by: list[str], amount: str, target: Column, name: str) -> DataFrame:
    """amount * target / sum(amount) per group, unrounded."""
    sums = frame.groupBy(*by).agg(F.sum(amount).cast("double").alias("_sum"))
    return null_safe_join(frame, sums, by).withColumn(
        name, F.col(amount).cast("double") * target / F.nullif(F.col("_sum"), F.lit(0.0))).drop("_sum")
