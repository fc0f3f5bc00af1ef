"""Small relational helpers used all over: one row per key, shares, ranking, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.session import cut


def one_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order.

    An aggregate rather than a ranked window: map-side combine reduces a hot key to one row per
    task before the shuffle, and no task sorts a whole key.
    """
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*key, "_first.*").select(*df.columns)


def share_of_total(grouped: DataFrame, value: str, name: str, digits: int = 1) -> DataFrame:
    """Percentage each row of an aggregated table holds of the grand total.

    The total is a scalar subquery over the aggregate, so no window pulls all groups into one task.
    """
    grand = grouped.agg(F.sum(value)).scalar()
    return grouped.withColumn(name, R.percent(value, grand, digits))


def with_total(grouped: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the total of each partition of an aggregated table, by an aggregate and a join."""
    totals = grouped.groupBy(*by).agg(F.sum(value).alias(name))
    return null_safe_join(grouped, totals, by)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key; keeps the left keys."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, match, how).drop(*[f"_r_{k}" for k in keys])


def top_k(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Sort and limit; Spark keeps only n rows per task on the way. Give a total order."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, bins: int = 1 << 20) -> DataFrame:
    """n rows with the least hashes of their key (ties: least key, then least rows): random-looking, the same on every run.

    The hashes are counted in `bins` ranges, and the counts added up give the range that the n-th row is in. Rows of
    lower ranges are taken where they are; only the rows of that one range, about rows / bins of them, are sorted.
    Where a range holds more than rows / bins because one key has many rows, the sort takes n of them in each task.
    """
    if n <= 0:
        return df.limit(0)
    digest, width = F.md5(F.col(key).cast("string")), bins.bit_length() - 1
    # A NULL key sorts before all others.
    bin_of = F.coalesce(F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - width), F.lit(-1))
    counts = df.groupBy(bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut(counts)  # added up by groups of 1,024 first, so that few rows reach the driver
    coarse = counts.groupBy(F.floor(F.col("_bin") / 1024).alias("_group")).agg(F.sum("_n").alias("_n"))
    group = _reached(coarse, "_group", n)
    if group is None:
        return df  # there are no more than n rows
    at, below = _reached(counts.where(F.floor(F.col("_bin") / 1024) == group[0]), "_bin", n - group[1])
    rest = n - group[1] - below
    edge = df.where(bin_of == at).orderBy(digest, key, *[c for c in df.columns if c != key and _orders(df, c)]).limit(rest)
    return df.where(bin_of < at).unionByName(edge)


def _reached(parts: DataFrame, bin: str, wanted: int) -> tuple[int, int] | None:
    """The range in which the wanted row is, and how many rows are below it."""
    below = 0
    for row in sorted(parts.select(bin, "_n").collect()):  # at most 1,025 rows
        if below + row[1] >= wanted:
            return row[0], below
        below += row[1]
    return None


def _orders(df: DataFrame, column: str) -> bool:
    return not any(word in df.schema[column].dataType.simpleString() for word in ("map<", "variant"))


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right does not have."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def most_common(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    order = F.struct(-F.col("_n"), F.col(value))
    return counts.groupBy(*by).agg(F.min_by(value, order).alias(name))


def coverage(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """Rows of df, how many of them have a partner in other, and the percentage."""
    known = other.select(F.col(key)).distinct().withColumn("_hit", F.lit(1))
    out = df.select(key).join(known, key, "left").agg(
        F.count("*").alias("source_rows"), F.count("_hit").alias("matched_rows"))
    return out.withColumn("coverage_pct", R.percent("matched_rows", "source_rows", 2))
