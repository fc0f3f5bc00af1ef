"""Analyst questions about spend: requests, orders, invoices, suppliers, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake
from ledgerloom.operators.keyed import share_of_total, top_k

QUARTER = ["fiscal_year", "fiscal_quarter"]


def q_sp1(lake: Lake) -> DataFrame:
    """Realised spend, lines, invoices and suppliers by segment and quarter."""
    lines = lake.pick("fact_invoices", *QUARTER, "segment_code", "amount", "invoice_id", "supplier_id")
    return lines.groupBy(*QUARTER, "segment_code").agg(
        R.total("amount").alias("spend_mm"), F.count("*").alias("invoice_lines"),
        F.count_distinct("invoice_id").alias("invoices"),
        F.count_distinct("supplier_id").alias("suppliers")).orderBy(*QUARTER, "segment_code")


def _mix(lines: DataFrame, by: str, *extra, amount: str = "amount", name: str = "spend_mm",
         share: str = "pct_of_total") -> DataFrame:
    """Amount per class with its share of the whole, largest first."""
    grouped = lines.groupBy(by).agg(F.sum(amount).alias("_sum"), *extra)
    return share_of_total(grouped, "_sum", share).withColumn(name, R.in_units("_sum")) \
        .orderBy(F.desc("_sum"), by).drop("_sum")


def q_sp2a(lake: Lake) -> DataFrame:
    lines = lake.pick("fact_invoices", "true_category_primary", "amount", "supplier_id")
    return _mix(lines, "true_category_primary", F.count("*").alias("lines"),
                F.count_distinct("supplier_id").alias("suppliers"))


def q_sp2b(lake: Lake) -> DataFrame:
    """Spend and average line by leaf category."""
    by = ["true_category_primary", "true_category_secondary"]
    return lake.pick("fact_invoices", *by, "amount", "supplier_id").groupBy(*by).agg(
        F.count("*").alias("lines"), R.total("amount").alias("spend_mm"),
        F.round(R.mean("amount"), 0).alias("avg_line_amount"),
        F.count_distinct("supplier_id").alias("suppliers"),
        F.sum("amount").alias("_sum")).orderBy(by[0], F.desc("_sum"), by[1]).drop("_sum")


def q_sp2c(lake: Lake) -> DataFrame:
    """Taxonomy listing; the leaf array is sorted so that it repeats."""
    return lake.pick("dim_spend_category", "primary_code", "primary_name", "secondary_code") \
        .groupBy("primary_code", "primary_name").agg(
            F.count("*").alias("n_leaves"), F.array_sort(F.collect_list("secondary_code")).alias("leaves")) \
        .orderBy(F.desc("n_leaves"), "primary_code")


def q_sp3(lake: Lake) -> DataFrame:
    return _mix(lake.pick("fact_invoices", "direct_indirect", "amount"), "direct_indirect",
                F.count("*").alias("lines"))


def q_sp4(lake: Lake) -> DataFrame:
    lines = lake.pick("fact_invoices", "addressability", "amount", "supplier_id")
    return _mix(lines, "addressability", F.count("*").alias("lines"),
                F.count_distinct("supplier_id").alias("suppliers"))


def q_sp5(lake: Lake) -> DataFrame:
    """Request -> order -> invoice funnel by quarter; a quarter seen in any stage appears."""
    status = lambda s: F.count_if(F.col("pr_status") == s)
    requests = lake.pick("fact_purchase_requests", *QUARTER, "pr_status", "estimated_extended_amount") \
        .groupBy(*QUARTER).agg(
            F.count("*").alias("pr_lines"), status("released").alias("pr_released"),
            status("cancelled").alias("pr_cancelled"),
            R.total("estimated_extended_amount").alias("pr_estimated_mm"))
    orders = lake.pick("fact_purchase_orders", *QUARTER, "extended_amount").groupBy(*QUARTER).agg(
        F.count("*").alias("po_lines"), R.total("extended_amount").alias("po_committed_mm"))
    invoices = lake.pick("fact_invoices", *QUARTER, "amount").groupBy(*QUARTER).agg(
        F.count("*").alias("inv_lines"), R.total("amount").alias("inv_realized_mm"))
    return requests.join(orders, QUARTER, "full").join(invoices, QUARTER, "full").orderBy(*QUARTER)


def q_sp6(lake: Lake, n: int = 20) -> DataFrame:
    """Largest suppliers. Lines are summed before the supplier attributes are looked up."""
    facts = lake.pick("fact_invoices", "supplier_id", "amount").groupBy("supplier_id").agg(
        F.sum("amount").alias("_sum"), F.count("*").alias("invoice_lines"))
    best = top_k(facts, [F.desc("_sum"), F.col("supplier_id")], n)
    named = lake.pick("dim_supplier", "supplier_id", "supplier_name", "is_regulated_supplier",
                      supplier_region="region", supplier_country="country_code",
                      supplier_maverick_propensity="maverick_propensity")
    return best.join(named, "supplier_id", "left").withColumn("spend_mm", R.in_units("_sum")) \
        .orderBy(F.desc("_sum"), "supplier_id").drop("_sum")


def q_sp7(lake: Lake) -> DataFrame:
    """Order-matched invoices against direct vouchers."""
    return lake.pick("fact_invoices", "po_matched_flag", *QUARTER, "invoice_id", "amount") \
        .groupBy("po_matched_flag", *QUARTER).agg(
            F.count_distinct("invoice_id").alias("invoices"), R.total("amount").alias("amount_mm")) \
        .orderBy(*QUARTER, "po_matched_flag")


def q_sp8(lake: Lake) -> DataFrame:
    """Payment status, on-time rate of paid lines, average days to pay."""
    lines = lake.pick("fact_invoices", *QUARTER, "payment_status", "invoice_id", "amount",
                      "is_on_time_payment", "days_to_pay")
    return lines.groupBy(*QUARTER, "payment_status").agg(
        F.count_distinct("invoice_id").alias("invoices"), R.total("amount").alias("amount_mm"),
        R.percent(F.count_if("is_on_time_payment"), F.count("is_on_time_payment")).alias("on_time_pct"),
        F.round(R.mean("days_to_pay"), 1).alias("avg_days_to_pay")).orderBy(*QUARTER, "payment_status")


def q_sp9(lake: Lake) -> DataFrame:
    lines = lake.pick("fact_invoices", "payment_terms", "supplier_id", "invoice_id", "amount")
    return _mix(lines, "payment_terms", F.count_distinct("supplier_id").alias("suppliers"),
                F.count_distinct("invoice_id").alias("invoices"), name="amount_mm", share="pct_of_spend")


def q_sp10(lake: Lake) -> DataFrame:
    """Sourcing events: the response rate is the average of the events' own rates."""
    events = lake["sourcing_event"]
    rate = R.ratio("suppliers_responded", "suppliers_invited")
    return events.groupBy(*QUARTER, "event_type").agg(
        F.count("*").alias("events"), F.round(R.mean("suppliers_invited"), 1).alias("avg_invited"),
        F.round(R.mean(rate.cast("decimal(24,12)")) * 100, 1).alias("response_pct"),
        R.total("awarded_amount").alias("awarded_mm")).orderBy(*QUARTER, "event_type")


def q_sp11(lake: Lake) -> DataFrame:
    """Released requests and the orders they led to.

    Both sides are reduced to distinct document pairs before they meet, so that a request with
    many lines does not multiply with an order of many lines.
    """
    by = [*QUARTER, "segment_code"]
    released = lake.pick("fact_purchase_requests", *by, "pr_number", "pr_status") \
        .where(F.col("pr_status") == "released").select(*by, "pr_number").distinct()
    orders = lake.pick("fact_purchase_orders", "po_number", pr_number="source_pr_number").distinct()
    return released.join(orders, "pr_number", "left").groupBy(*by).agg(
        F.count_distinct("pr_number").alias("released_prs"),
        F.count_distinct("po_number").alias("resulting_pos")) \
        .withColumn("conversion_pct", R.percent("resulting_pos", "released_prs")).orderBy(*by)


def q_sp12(lake: Lake) -> DataFrame:
    """Prediction coverage and accuracy; lines without a prediction count as wrong."""
    lines = lake.pick("fact_invoices", "predicted_secondary_category", "predicted_primary_category",
                      "secondary_confidence", "primary_confidence", "true_category_secondary",
                      "true_category_primary")
    hit = lambda tier: F.count_if(F.col(f"predicted_{tier}_category") == F.col(f"true_category_{tier}"))
    return lines.groupBy(F.col("predicted_secondary_category").isNotNull().alias("has_prediction")).agg(
        F.count("*").alias("lines"), F.round(R.mean("secondary_confidence"), 3).alias("avg_leaf_confidence"),
        F.round(R.mean("primary_confidence"), 3).alias("avg_parent_confidence"),
        R.percent(hit("secondary"), F.count("*")).alias("leaf_accuracy_pct"),
        R.percent(hit("primary"), F.count("*")).alias("parent_accuracy_pct")).orderBy(F.desc("has_prediction"))


def q_sp13(lake: Lake, n: int = 20) -> DataFrame:
    """Parent categories mixed up most."""
    truth, guess = F.col("true_category_primary"), F.col("predicted_primary_category")
    wrong = lake.pick("fact_invoices", "true_category_primary", "predicted_primary_category", "amount") \
        .where(truth != guess)
    pairs = wrong.groupBy(truth.alias("truth_parent"), guess.alias("pred_parent")).agg(
        F.count("*").alias("lines"), R.total("amount").alias("spend_mm"), F.sum("amount").alias("_sum"))
    return top_k(pairs, [F.desc("_sum"), F.col("truth_parent"), F.col("pred_parent")], n).drop("_sum")


def stage_counts(lake: Lake) -> DataFrame:
    """Rows per stage of the funnel."""
    stages = [("PR", "fact_purchase_requests"), ("PO", "fact_purchase_orders"), ("Invoice", "fact_invoices")]
    frames = [lake.pick(table, "segment_code").agg(F.count("*").alias("row_count"))
              .select(F.lit(stage).alias("stage"), "row_count") for stage, table in stages]
    return frames[0].union(frames[1]).union(frames[2])
