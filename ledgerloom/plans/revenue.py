"""Analyst questions about revenue, billing and customer contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake
from ledgerloom.operators.keyed import share_of_total, top_k

QUARTER = ["fiscal_year", "fiscal_quarter"]
CUSTOMER = ["customer_id", "customer_name", "region", "primary_segment_code"]


def q_rv1(lake: Lake) -> DataFrame:
    """Revenue, events, customers and contracts by segment and quarter."""
    by = [*QUARTER, "segment_code"]
    return lake.pick("fact_revenue", *by, "amount", "customer_id", "contract_id").groupBy(*by).agg(
        R.total("amount").alias("revenue_mm"), F.count("*").alias("billing_events"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("contract_id").alias("contracts")).orderBy(*by)


def top_by_party(lines: DataFrame, parties: DataFrame, key: str, amount: str, aggregates: dict,
                 n: int, name: str) -> DataFrame:
    """Largest parties; everything without a master record forms one NULL party.

    Only the key of the master is joined to the lines; its attributes meet the n result rows.
    """
    known = parties.select(key, F.col(key).alias("_party"))
    grouped = lines.join(known, key, "left").groupBy("_party").agg(
        F.sum(amount).alias("_sum"), *[a.alias(alias) for alias, a in aggregates.items()])
    best = top_k(grouped, [F.desc("_sum"), F.col("_party")], n).withColumnRenamed("_party", key)
    return best.join(parties, key, "left").withColumn(name, R.in_units("_sum")) \
        .orderBy(F.desc("_sum"), key).drop("_sum")


def q_rv2(lake: Lake, n: int = 20) -> DataFrame:
    return top_by_party(
        lake.pick("fact_revenue", "customer_id", "amount", "contract_id"),
        lake.pick("dim_customer", *CUSTOMER), "customer_id", "amount",
        {"contracts": F.count_distinct("contract_id"), "billing_events": F.count("*")}, n, "revenue_mm")


def q_rv3(lake: Lake) -> DataFrame:
    return lake.pick("fact_revenue", "status", *QUARTER, "amount").groupBy("status", *QUARTER).agg(
        F.count("*").alias("events"), R.total("amount").alias("amount_mm")).orderBy(*QUARTER, "status")


def q_rv4(lake: Lake, accuracy: int = 10_000) -> DataFrame:
    """Contract value distribution. The percentile sketch is of bounded size and merges map-side."""
    value = F.col("effective_contract_value")
    nth = lambda p: F.round(F.percentile_approx(value, p, accuracy).cast("double") / R.THOUSAND, 1)
    return lake.pick("contract_outbound", "segment_code", "status", "effective_contract_value") \
        .groupBy("segment_code", "status").agg(
            F.count("*").alias("contracts"), R.total(value).alias("total_value_mm"),
            F.round(R.mean(value) / R.THOUSAND, 1).alias("avg_value_k"),
            nth(0.50).alias("p50_value_k"), nth(0.95).alias("p95_value_k")).orderBy("segment_code", "status")


def q_rv5(lake: Lake) -> DataFrame:
    """Currency mix. Amounts are added as they stand; there is no conversion."""
    grouped = lake.pick("fact_revenue", "currency", "amount").groupBy("currency").agg(
        F.count("*").alias("events"), F.sum("amount").alias("_sum"))
    return share_of_total(grouped, "_sum", "pct_of_revenue").withColumn("revenue_mm", R.in_units("_sum")) \
        .orderBy(F.desc("_sum"), "currency").drop("_sum")


def q_rv6(lake: Lake) -> DataFrame:
    return lake.pick("invoice_ar", *QUARTER, "status", "total_amount").groupBy(*QUARTER, "status").agg(
        F.count("*").alias("invoices"), R.total("total_amount").alias("amount_mm")).orderBy(*QUARTER, "status")
