"""Row-order operators (previous row, next row, numbering, running sums) that survive hot keys.

A plain window sends every row of a key to one task. Here each key is cut into slices along the
sort order (say one per month). A window inside (key, slice) does most of the work; what must
cross a slice edge travels through one summary row per slice. The result equals the plain window.

Slices need not be given: `cut` makes them from the rows themselves, as ranges of about so many rows each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.lake import settled

_SLICE, _N, _LAST, _ROW = "_slice", "_n", "_last", "_row"
SLICE_ROWS = 100_000


def cut(df: DataFrame, order: list[str | Column], rows: int = SLICE_ROWS) -> DataFrame:
    """A written copy with `_slice`, a range of about `rows` rows along `order`, and `_row`, which ascends with it.

    Spark samples the rows and cuts between any two of them: rows that agree in `order` are told apart by their place
    in a first written copy, so neither a key with nearly all rows nor one instant with nearly all rows is one slice.
    """
    stored = settled(df.withColumn(_ROW, F.monotonically_increasing_id()), "rows", rebalance=False)
    ranges = max(1, -(-stored.count() // rows))  # the count comes from the files' footers
    ranged = stored.repartitionByRange(ranges, *order, _ROW).sortWithinPartitions(*order, _ROW)
    return settled(ranged.withColumns({_SLICE: F.spark_partition_id(), _ROW: F.monotonically_increasing_id()}),
                   "slices", rebalance=False)


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 0, rows: int = SLICE_ROWS) -> DataFrame:
    """Consecutive numbers over the whole table; only one row a slice meets in one task."""
    sliced = cut(df, order, rows)
    ends = sliced.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("_rows"), F.min(_ROW).alias("_first"))
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select(_SLICE, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + start).alias("_base"))
    return sliced.join(bases, _SLICE).select(*df.columns, (F.col("_base") + F.col(_ROW)).alias(name))


def along(df: DataFrame, key: list[str], order: list[str], slice_by: Column | None = None, *,
          previous: dict[str, str] | None = None, following: dict[str, str] | None = None,
          running: dict[str, str] | None = None, number: str | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """Add order-dependent columns per key.

    Without `slice_by` the slices are cut here, at most about `rows` rows each; then keys may be NULL, NULLs come
    first in `order`, and rows that `order` does not tell apart follow each other as they are stored.

    previous / following map a new column to the column read from the row before / after;
    running maps a new column to the column summed up to and including the row; number names
    a 1-based position. With `slice_by`, `order` must be a total order within the key, keys must
    not be NULL, and `slice_by` must never decrease along `order`.
    """
    previous, following, running = previous or {}, following or {}, running or {}
    columns = df.columns
    if slice_by is None:
        df = cut(df, [*key, *order], rows)
        order, slice_by = [_ROW], F.col(_SLICE)
    within = Window.partitionBy(*key, _SLICE).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # Partitioned by key and slice on purpose: rows that arrive partitioned by the key alone would
    # satisfy the window as well, and then a hot key would stay in one task.
    sliced = df.withColumn(_SLICE, slice_by).repartition(*key, _SLICE)
    local = sliced.select(
        "*",
        F.row_number().over(within).alias(_N),
        F.lead(F.lit(1)).over(within).isNull().alias(_LAST),
        *[F.lag(c).over(within).alias(f"_p_{n}") for n, c in previous.items()],
        *[F.lead(c).over(within).alias(f"_f_{n}") for n, c in following.items()],
        *[F.sum(c).over(upto).alias(f"_s_{n}") for n, c in running.items()],
    )

    # One row per slice, already partitioned and sorted by (key, slice): no further shuffle.
    tail = [F.col(c).alias(n) for n, c in previous.items()]
    head = [F.col(c).alias(n) for n, c in following.items()]
    slices = local.groupBy(*key, _SLICE).agg(
        F.max(_N).alias("_rows"),
        *([F.max(F.when(F.col(_LAST), F.struct(*tail))).alias("_tail")] if tail else []),
        *([F.max(F.when(F.col(_N) == 1, F.struct(*head))).alias("_head")] if head else []),
        *[F.sum(c).alias(f"_t_{n}") for n, c in running.items()],
    )
    across = Window.partitionBy(*key).orderBy(_SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = slices.select(
        *key, _SLICE,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
        *([F.lag("_tail").over(across).alias("_tail")] if tail else []),
        *([F.lead("_head").over(across).alias("_head")] if head else []),
        *[F.sum(f"_t_{n}").over(before).alias(f"_t_{n}") for n in running],
    )

    here = edges.withColumnsRenamed({c: f"_e{c}" for c in [*key, _SLICE]})
    same = reduce(lambda a, b: a & b, [local[c].eqNullSafe(here[f"_e{c}"]) for c in [*key, _SLICE]])
    joined = local.join(here, same)
    out = [F.col(c) for c in columns]
    for n in previous:
        out.append(F.when(F.col(_N) > 1, F.col(f"_p_{n}")).otherwise(F.col(f"_tail.{n}")).alias(n))
    for n in following:
        out.append(F.when(F.col(_LAST), F.col(f"_head.{n}")).otherwise(F.col(f"_f_{n}")).alias(n))
    for n in running:
        carried, own = F.col(f"_t_{n}"), F.col(f"_s_{n}")
        out.append(F.when(own.isNull(), carried).otherwise(
            own + F.coalesce(carried, F.lit(0))).alias(n))
    if number:
        out.append((F.col("_base") + F.col(_N)).cast("int").alias(number))
    return joined.select(*out)
