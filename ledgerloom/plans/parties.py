"""Analyst questions about suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fixed
from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake
from ledgerloom.operators.keyed import share_of_total
from ledgerloom.plans.revenue import CUSTOMER, top_by_party


def q_pa1(lake: Lake) -> DataFrame:
    return lake.pick("dim_supplier", "region", "category_primary", "maverick_propensity") \
        .where(F.col("category_primary").isNotNull()).groupBy("region", "category_primary").agg(
            F.count("*").alias("suppliers"), F.round(R.mean("maverick_propensity"), 3).alias("avg_maverick")) \
        .orderBy("region", F.desc("suppliers"), "category_primary")


def q_pa2(lake: Lake) -> DataFrame:
    """Histogram of supplier propensity."""
    rated = lake.pick("dim_supplier", "maverick_propensity").where(F.col("maverick_propensity").isNotNull())
    bin_of = R.bucket("maverick_propensity", fixed.PROPENSITY_BINS, fixed.PROPENSITY_REST)
    grouped = rated.groupBy(bin_of.alias("maverick_bin")).agg(F.count("*").alias("suppliers"))
    return share_of_total(grouped, "suppliers", "pct").orderBy("maverick_bin")


def q_pa3(lake: Lake, n: int = 25) -> DataFrame:
    lines = lake.pick("fact_invoices", "supplier_id", "amount", "invoice_id", "fiscal_year", "fiscal_quarter")
    suppliers = lake.pick("dim_supplier", "supplier_id", "supplier_name", "region", "country_code",
                          "category_primary", "maverick_propensity")
    return top_by_party(lines, suppliers, "supplier_id", "amount", {
        "invoices": F.count_distinct("invoice_id"),
        "active_quarters": F.count_distinct(R.period_key())}, n, "spend_mm")


def q_pa4(lake: Lake) -> DataFrame:
    return lake.pick("dim_customer", "region", "primary_segment_code") \
        .where(F.col("primary_segment_code").isNotNull()).groupBy("region", "primary_segment_code") \
        .agg(F.count("*").alias("customers")).orderBy("region", F.desc("customers"), "primary_segment_code")


def q_pa5(lake: Lake, n: int = 25) -> DataFrame:
    events = lake.pick("fact_revenue", "customer_id", "amount", "contract_id", "fiscal_year", "fiscal_quarter")
    return top_by_party(events, lake.pick("dim_customer", *CUSTOMER), "customer_id", "amount", {
        "contracts": F.count_distinct("contract_id"),
        "active_quarters": F.count_distinct(R.period_key())}, n, "revenue_mm")


def q_pa6(lake: Lake) -> DataFrame:
    """Supplier scorecard averages per quarter."""
    average = lambda c, digits: F.round(R.mean(c), digits)
    return lake["ARIBA_SUPPLIER_PERFORMANCE"].groupBy("EvaluationQuarter").agg(
        average("OnTimeDeliveryPct", 1).alias("avg_ontime_pct"), average("QualityScore", 2).alias("avg_quality"),
        average("ResponsivenessScore", 2).alias("avg_responsiveness"),
        average("OverallRating", 2).alias("avg_overall"),
        F.count("*").alias("suppliers_scored")).orderBy("EvaluationQuarter")
