"""Analyst questions about journals, accounts and the trial balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake
from ledgerloom.operators.keyed import top_k


def q_ac1(lake: Lake) -> DataFrame:
    return lake.pick("gl_journal_header", "period_name", "je_source").groupBy("period_name", "je_source") \
        .agg(F.count("*").alias("je_headers")).orderBy("period_name", "je_source")


def journal_nets(lines: DataFrame) -> DataFrame:
    return lines.groupBy("je_header_id").agg(
        R.exact_sum(F.col("accounted_dr") - F.col("accounted_cr")).alias("net"))


def q_ac2(lake: Lake, tolerance: str = "0.01") -> DataFrame:
    """How many journals do not balance, and by how much at worst."""
    gap = F.abs("net")
    limit = F.lit(tolerance).cast("decimal(18,2)")
    return journal_nets(lake.pick("gl_journal_line", "je_header_id", "accounted_dr", "accounted_cr")).agg(
        F.count("*").alias("total_jes"), F.count_if(gap > limit).alias("unbalanced_jes"),
        F.max(gap).alias("worst_imbalance"))


def q_ac3(lake: Lake) -> DataFrame:
    """Trial balance of the latest period (names sort as YYYY-MM)."""
    latest = lake.pick("gl_journal_header", "period_name").agg(F.max("period_name")).scalar()
    by = ["period_name", "segment_code", "account_type"]
    entries = lake.pick("fact_gl_entries", *by, "accounted_dr", "accounted_cr", "net_amount")
    return entries.where((F.col("period_name") == latest) & F.col("account_type").isNotNull()) \
        .groupBy(*by).agg(
            F.count("*").alias("lines"), R.total("accounted_dr").alias("dr_mm"),
            R.total("accounted_cr").alias("cr_mm"), R.total("net_amount").alias("net_mm")) \
        .orderBy("segment_code", "account_type")


def q_ac4(lake: Lake) -> DataFrame:
    """Enabled account combinations per segment and account type."""
    accounts = lake["coa_account"].where(F.col("enabled_flag") == "Y")
    return accounts.groupBy("segment_code", F.col("natural_account_type").alias("account_type")).agg(
        F.count("*").alias("code_combinations"),
        F.count_distinct("cost_center_code").alias("cost_centers"),
        F.count_distinct("natural_account_code").alias("natural_accounts")).orderBy("segment_code", "account_type")


def q_ac5(lake: Lake) -> DataFrame:
    """Totals per account type, largest absolute net first."""
    balance = lake.pick("fact_trial_balance", "account_type", "period_name", "period_dr", "period_cr", "period_net")
    return balance.where(F.col("account_type").isNotNull()).groupBy("account_type").agg(
        F.count_distinct("period_name").alias("periods"), R.total("period_dr").alias("period_dr_mm"),
        R.total("period_cr").alias("period_cr_mm"), R.total("period_net").alias("period_net_mm"),
        F.abs(F.sum("period_net")).alias("_size")).orderBy(F.desc("_size"), "account_type").drop("_size")


def q_ac6(lake: Lake, n: int = 15) -> DataFrame:
    """Busiest natural accounts: entries are summed per account code before the description joins."""
    code = F.col("natural_account_code")
    busy = lake.pick("fact_gl_entries", "natural_account_code", "accounted_dr") \
        .groupBy(code.alias("_code")).agg(F.count("*").alias("entries"), F.sum("accounted_dr").alias("_dr"))
    accounts = lake["dim_account"]
    named = busy.join(accounts, busy["_code"] == accounts["account_code"], "left")
    # Codes without a description share one NULL row.
    grouped = named.groupBy("account_code", "account_description", "account_type").agg(
        F.sum("entries").alias("entries"), R.total("_dr").alias("total_dr_mm"))
    return top_k(grouped, [F.desc("entries"), F.col("account_code"), F.col("account_description"),
                           F.col("account_type")], n)
