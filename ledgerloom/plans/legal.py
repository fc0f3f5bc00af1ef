"""Analyst questions about contracts, inbound and outbound."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake
from ledgerloom.operators.keyed import share_of_total, top_k


def today(as_of) -> "F.Column":
    """The reporting date: a given date, else the current one."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def q_lg1(lake: Lake) -> DataFrame:
    value = F.col("effective_contract_value")
    return lake.pick("contract_outbound", "segment_code", "status", "effective_contract_value",
                     "start_date", "end_date").groupBy("segment_code", "status").agg(
        F.count("*").alias("contracts"), R.total(value).alias("total_value_mm"),
        F.round(R.mean(value) / R.THOUSAND, 1).alias("avg_value_k"),
        F.min("start_date").alias("earliest_start"), F.max("end_date").alias("latest_end")) \
        .orderBy("segment_code", "status")


def q_lg2(lake: Lake) -> DataFrame:
    """Use of inbound commitments."""
    by = ["contract_type", "region", "status"]
    return lake.pick("contract_inbound", *by, "total_committed_spend", "actual_spend_to_date").groupBy(*by).agg(
        F.count("*").alias("contracts"), R.total("total_committed_spend").alias("committed_mm"),
        R.total("actual_spend_to_date").alias("actual_mm"),
        R.percent(F.sum("actual_spend_to_date"), F.sum("total_committed_spend")).alias("utilization_pct")) \
        .orderBy(*by)


def q_lg3(lake: Lake) -> DataFrame:
    amendments = lake["contract_amendment"].select(
        F.year(R.cast("effective_date", "date")).alias("amendment_year"), "amendment_type", R.money("value_delta"))
    return amendments.groupBy("amendment_year", "amendment_type").agg(
        F.count("*").alias("amendments"), R.total("value_delta").alias("value_delta_mm")) \
        .orderBy("amendment_year", "amendment_type")


def q_lg4(lake: Lake, as_of: datetime.date | str | None = None) -> DataFrame:
    """Outbound contracts ending in the next twelve months."""
    start = today(as_of)
    return lake.pick("contract_outbound", "end_date", "segment_code", "effective_contract_value") \
        .where(F.col("end_date").between(start, F.add_months(start, 12))) \
        .groupBy(F.date_trunc("month", "end_date").alias("expiration_month"), "segment_code").agg(
            F.count("*").alias("contracts_expiring"),
            R.total("effective_contract_value").alias("expiring_value_mm")) \
        .orderBy("expiration_month", "segment_code")


def q_lg5(lake: Lake) -> DataFrame:
    grouped = lake.pick("contract_outbound", "commercial_terms", "effective_contract_value") \
        .groupBy("commercial_terms").agg(
            F.count("*").alias("contracts"), R.total("effective_contract_value").alias("total_value_mm"))
    return share_of_total(grouped, "contracts", "pct_of_contracts").orderBy(F.desc("contracts"), "commercial_terms")


def without_contract(lines: DataFrame, contracts: DataFrame) -> DataFrame:
    """Lines of suppliers that have no active inbound contract, whatever its dates.

    An anti join on distinct suppliers: several contracts of one supplier cannot repeat lines.
    """
    covered = contracts.where(F.col("status") == "Active").select("supplier_id").distinct()
    return lines.join(covered, "supplier_id", "left_anti")


def q_lg6(lake: Lake, n: int = 20) -> DataFrame:
    by = ["segment_code", "fiscal_year", "fiscal_quarter"]
    # Summed per supplier first: the anti join then sees one row per supplier and group.
    spend = lake.pick("fact_invoices", *by, "supplier_id", "amount").groupBy(*by, "supplier_id").agg(
        F.count("*").alias("lines"), F.sum("amount").alias("amount"))
    open_spend = without_contract(spend, lake.pick("contract_inbound", "supplier_id", "status"))
    grouped = open_spend.groupBy(*by).agg(
        F.sum("lines").alias("invoice_lines"), R.total("amount").alias("off_contract_mm"),
        F.sum("amount").alias("_sum"))
    return top_k(grouped, [F.desc("_sum"), *[F.col(c) for c in by]], n).drop("_sum")
