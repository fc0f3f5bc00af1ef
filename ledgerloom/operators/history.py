"""Versioned history (half-open intervals) and snapshots of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fixed
from ledgerloom.operators.ordered import SLICE_ROWS, along, cut


def scd2(changes: DataFrame, key: str, at: str, attrs: list[str], tiebreak: str,
         slice_by: Column | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """State changes -> versions [effective_from, effective_to), numbered, last one open.

    Repeats of the same state collapse into one version. Both passes work on (key, slice)
    groups, so one very busy key is spread over as many tasks as it has slices. Without
    `slice_by` the slices are cut from the changes, at most about `rows` each, so that a key
    whose changes share one instant is spread too; see `along`.
    """
    order, rows_of_key = [at, tiebreak], changes.select(key, at, tiebreak, *attrs)
    if slice_by is None:  # cut once for both passes
        rows_of_key, order, slice_by = cut(rows_of_key, [key, *order], rows), ["_row"], F.col("_slice")
    seen = along(rows_of_key, [key], order, slice_by, previous={f"_was_{a}": a for a in attrs}, number="_seq")
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(f"_was_{a}")) for a in attrs])
    starts = seen.where((F.col("_seq") == 1) | ~same).select(*rows_of_key.columns)
    versions = along(starts, [key], order, slice_by, following={"_next": at}, number="version_seq")
    end_type = changes.schema[at].dataType
    return versions.select(
        key, "version_seq",
        F.col(at).alias("effective_from"),
        F.coalesce("_next", F.lit(fixed.OPEN_END).cast(end_type)).alias("effective_to"),
        F.col("_next").isNull().alias("is_current"),
        *attrs)


def snapshot(history: DataFrame, dates: DataFrame, date: str = "snapshot_date",
             start: str = "effective_from", end: str = "effective_to", step: str = "day") -> DataFrame:
    """Every version valid on each date: start <= date < end.

    The versions are expanded to the calendar dates they cover, by arithmetic on their own bounds,
    and met with the wanted dates by equality. No range comparison across the two tables.
    `step` is "day" for arbitrary dates, or "quarter" when every date is a quarter end.
    """
    bounds = dates.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    kind = dict(history.dtypes)[start]
    if kind == "date":
        first, last_day = F.col(start), F.date_sub(end, 1)
    else:
        # A date stands for its midnight: a version counts from the first midnight at or after its
        # start to the last one before its end.
        midnight = F.to_date(start).cast(kind)
        first = F.when(F.col(start) == midnight, F.to_date(start)).otherwise(F.date_add(F.to_date(start), 1))
        last_day = F.to_date(F.col(end) - F.expr("interval 1 microsecond"))
    first = F.greatest(first, lo)
    last = F.least(last_day, hi)
    covered = history.withColumn("_a", first).withColumn("_z", last).where(F.col("_a") <= F.col("_z"))
    if step == "quarter":
        # Quarter ends by index: year * 4 + quarter - 1, kept when they fall inside [_a, _z].
        index = lambda c: F.year(c) * 4 + F.quarter(c) - 1
        quarter_of = F.explode(F.sequence(index(F.col("_a")), index(F.col("_z"))))
        listed = covered.withColumn("_q", quarter_of)
        year, quarter = F.floor(F.col("_q") / 4).cast("int"), (F.col("_q") % 4 + 1).cast("int")
        listed = listed.withColumn(date, F.last_day(F.make_date(year, quarter * 3, F.lit(1)))) \
            .where(F.col(date).between(F.col("_a"), F.col("_z"))).drop("_q")
    else:
        listed = covered.withColumn(date, F.explode(F.sequence("_a", "_z", F.expr("interval 1 day"))))
    return listed.drop("_a", "_z").join(dates.dropDuplicates([date]), date)
