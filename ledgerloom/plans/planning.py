"""Analyst questions about actuals, budgets, forecasts and headcount."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake

PERIOD = ["fiscal_year", "fiscal_quarter"]
KEYS = [*PERIOD, "segment_code", "account_type"]


def q_fp1(lake: Lake) -> DataFrame:
    return lake.pick("fact_fpa_actuals", *KEYS, "amount_usd", "entry_count") \
        .select(*KEYS, R.in_units("amount_usd").alias("amount_mm"), "entry_count").orderBy(*KEYS)


def q_fp2(lake: Lake) -> DataFrame:
    """Actual, budget and forecast of the latest quarter with their gaps."""
    actuals = lake.pick("fact_fpa_actuals", *KEYS, _a="amount_usd")
    latest = actuals.agg(F.max(R.period_key())).scalar()
    budgets = lake.pick("fact_fpa_budgets", *KEYS, _b="amount_usd")
    forecasts = lake.pick("fact_fpa_forecasts", *KEYS, _f="amount_usd")
    joined = actuals.where(R.period_key() == latest).join(budgets, KEYS, "left").join(forecasts, KEYS, "left")
    gap = lambda other: R.percent(F.col("_a") - F.col(other), other)
    return joined.select(
        *KEYS, R.in_units("_a").alias("actual_mm"), R.in_units("_b").alias("budget_mm"),
        R.in_units("_f").alias("forecast_mm"), gap("_b").alias("var_act_vs_bud_pct"),
        gap("_f").alias("var_act_vs_fcst_pct")).orderBy("segment_code", "account_type")


def q_fp3(lake: Lake) -> DataFrame:
    """Revenue per segment and year against the year before."""
    yearly = lake.pick("fact_fpa_actuals", "fiscal_year", "segment_code", "account_type", "amount_usd") \
        .where(F.col("account_type") == "REVENUE").groupBy("fiscal_year", "segment_code") \
        .agg(F.sum("amount_usd").alias("_now"))
    before = yearly.withColumn("_was", F.lag("_now").over(Window.partitionBy("segment_code").orderBy("fiscal_year")))
    return before.select(
        "fiscal_year", "segment_code", R.in_units("_now").alias("revenue_mm"),
        R.in_units("_was").alias("prior_year_mm"),
        R.percent(F.col("_now") - F.col("_was"), "_was").alias("yoy_pct")).orderBy("segment_code", "fiscal_year")


def q_fp4(lake: Lake) -> DataFrame:
    """Operating margin per segment and quarter.

    op_income_mm is revenue less all three cost types. op_income_ref_mm subtracts only the largest
    of them, which is what the established report shows; it is kept for comparison.
    """
    kinds = ["REVENUE", "COGS", "SGA", "RD"]
    wide = lake.pick("fact_fpa_actuals", *KEYS, "amount_usd").groupBy(*PERIOD, "segment_code") \
        .pivot("account_type", kinds).agg(F.max("amount_usd"))
    zero = F.lit(0).cast("decimal(28,2)")
    costs = sum((F.coalesce(c, zero) for c in kinds[2:]), F.coalesce("COGS", zero))
    return wide.select(
        *PERIOD, "segment_code", *[R.in_units(k).alias(f"{k.lower()}_mm") for k in kinds],
        R.in_units(F.col("REVENUE") - costs).alias("op_income_mm"),
        R.in_units(F.col("REVENUE") - F.greatest("COGS", "SGA", "RD")).alias("op_income_ref_mm")) \
        .orderBy(*PERIOD, "segment_code")


def q_hr1(lake: Lake) -> DataFrame:
    return lake.pick("fact_emp_quarterly_cost", *PERIOD, "segment_code", "headcount", "quarterly_cost_usd") \
        .select(*PERIOD, "segment_code", "headcount", R.in_units("quarterly_cost_usd").alias("quarterly_cost_mm")) \
        .orderBy(*PERIOD, "segment_code")


def q_hr2(lake: Lake) -> DataFrame:
    """Headcount and cost over all quarters of a segment."""
    return lake.pick("fact_emp_quarterly_cost", *PERIOD, "segment_code", "headcount", "quarterly_cost_usd") \
        .groupBy("segment_code").agg(
            F.count("*").alias("quarters_observed"), F.min(R.period_key()).alias("first_fyq"),
            F.max(R.period_key()).alias("last_fyq"), F.min("headcount").alias("min_headcount"),
            F.max("headcount").alias("max_headcount"), F.round(R.mean("headcount"), 0).alias("avg_headcount"),
            R.total("quarterly_cost_usd").alias("total_cost_mm"), F.sum("quarterly_cost_usd").alias("_sum")) \
        .orderBy(F.desc("_sum"), "segment_code").drop("_sum")


def q_hr3(lake: Lake) -> DataFrame:
    """Headcount against the previous quarter on record."""
    w = Window.partitionBy("segment_code").orderBy(*PERIOD)
    before = lake.pick("fact_emp_quarterly_cost", *PERIOD, "segment_code", "headcount") \
        .withColumn("prior_qtr_headcount", F.lag("headcount").over(w))
    delta = F.col("headcount") - F.col("prior_qtr_headcount")
    return before.withColumn("delta", delta) \
        .withColumn("pct_change", R.percent("delta", "prior_qtr_headcount", 2)).orderBy("segment_code", *PERIOD)
