"""Analyst questions about calendar, segments and the macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake
from ledgerloom.plans.legal import today

MACRO = {"gdp": "gdp_growth_idx", "inflation": "inflation_idx", "demand_sales": "demand_idx_sales",
         "demand_mfg": "demand_idx_mfg", "supply_stress": "supply_chain_stress_idx"}


def q_rf1(lake: Lake) -> DataFrame:
    return lake.pick("dim_date", "date_key", "fiscal_year", "is_weekend").agg(
        F.min("date_key").alias("earliest_date"), F.max("date_key").alias("latest_date"),
        F.count("*").alias("total_days"), F.count_distinct("fiscal_year").alias("fiscal_years_covered"),
        F.count_if("is_weekend").alias("weekend_days"))


def q_rf2(lake: Lake) -> DataFrame:
    by = ["fiscal_year", "fiscal_quarter"]
    return lake.pick("dim_date", *by, "date_key").groupBy(*by).agg(
        F.count("*").alias("days"), F.min("date_key").alias("quarter_start"),
        F.max("date_key").alias("quarter_end")).orderBy(*by)


def q_rf3(lake: Lake) -> DataFrame:
    return lake["dim_segment"].orderBy("sort_order")


def q_rf4(lake: Lake, as_of=None, months: int = 18) -> DataFrame:
    """The macro series of the last months."""
    shown = {**MACRO, "seasonality": "seasonality_idx"}
    return lake["dim_macro_environment"].where(F.col("period_month") >= F.add_months(today(as_of), -months)) \
        .select("period_month", *[F.round(c, 3).alias(name) for name, c in shown.items()]).orderBy("period_month")


def q_rf5(lake: Lake) -> DataFrame:
    return lake["dim_macro_environment"].groupBy(
        F.year("period_month").alias("yr"), F.quarter("period_month").alias("qtr")).agg(
        *[F.round(R.mean(c), 3).alias(name) for name, c in MACRO.items()]).orderBy("yr", "qtr")
