"""Batch scans of source files, with provenance columns and a place for unreadable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from ledgerloom.sources.schemas import SOURCES, Source

CORRUPT = "_corrupt_record"


def schema_of(source: Source, aliases: dict[str, str] | None = None) -> StructType:
    """File schema. Text formats get a column that keeps a row that does not fit the types.

    `aliases` maps a column of ours to its name in the files, for formats that carry names per row.
    Headers of CSV files are compared with the schema, so a reordered or renamed column is an error.
    """
    fields = _parse_datatype_string(source.columns).fields
    if aliases:
        fields = [StructField(aliases.get(f.name, f.name), f.dataType) for f in fields]
    if source.kind != "parquet":
        fields = [*fields, StructField(CORRUPT, StringType())]
    return StructType(fields)


def options_of(source: Source) -> dict[str, str]:
    if source.kind == "csv":
        return {"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "enforceSchema": "false"}
    return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} if source.kind == "json" else {}


def provenance() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_source_file"),
            F.col("_metadata.file_modification_time").alias("_ingested_at")]


def conformed_names(df: DataFrame, aliases: dict[str, str] | None) -> DataFrame:
    for ours, theirs in (aliases or {}).items():
        df = df.withColumnRenamed(theirs, ours)
    return df


def read_raw(spark: SparkSession, root: str, name: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Full scan of one source: all its files below the landing folder."""
    source = SOURCES[name]
    frame = spark.read.format(source.kind).options(**options_of(source)) \
        .schema(schema_of(source, aliases)).load(f"{root.rstrip('/')}/{source.pattern}")
    return conformed_names(frame.select("*", *provenance()), aliases)


def readable(df: DataFrame) -> DataFrame:
    """Rows that fit their schema. Use on a stored bronze table, not on a raw text scan."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in df.columns else df


def quarantined(df: DataFrame) -> DataFrame:
    """Rows that do not, with the original text and the file they came from."""
    if CORRUPT not in df.columns:
        return df.limit(0)
    return df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT, "_source_file", "_ingested_at")


def month_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per month from start to end, for interpolation and period calendars."""
    months = F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("period_month"))


def period_calendar(months: DataFrame) -> DataFrame:
    """Ledger periods of a month spine; every period is closed except the last."""
    last = months.agg(F.max("period_month")).scalar()
    m = F.col("period_month")
    return months.select(
        F.date_format(m, "yyyy-MM").alias("period_name"), F.year(m).alias("period_year"),
        F.month(m).alias("period_num"), m.alias("start_date"), F.last_day(m).alias("end_date"),
        F.when(m == last, "Open").otherwise("Closed").alias("period_status"))
