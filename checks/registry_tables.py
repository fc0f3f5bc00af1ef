"""Driver queries for conformed tables, facts, postings, history, allocation and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import query
from ledgerloom.adapters.retail import Retail
from ledgerloom.functions import rules as R
from ledgerloom.lake import settled
from ledgerloom.operators import allocate, posting, series
from ledgerloom.operators.history import scd2, snapshot
from ledgerloom.operators.keyed import sample_rows
from ledgerloom.sinks.tables import merged
from ledgerloom.sources.files import period_calendar
from ledgerloom.tables import gold

GROUP = ["fiscal_year", "fiscal_quarter", "segment_code"]


def conformed(name: str, table: str, *columns: str):
    """A builder's result over raw-shaped tables, all or the named columns."""
    def run(retail: Retail) -> DataFrame:
        frame = retail.conforming_lake()[table]
        return frame.select(*columns) if columns else frame
    query(name)(run)


conformed("silver_supplier", "supplier")
conformed("dim_supplier_dedup", "dim_supplier")
conformed("customer_master", "customer")
conformed("dim_customer", "dim_customer")
conformed("purchase_requests", "purchase_request", "source_primary_key", "pr_number", "pr_line_num", "company_code",
          "segment_code", "pr_created_date", "requested_delivery_date", "pr_status_code", "pr_status", "intended_supplier_id",
          "material_number", "quantity", "estimated_unit_price", "price_unit", "true_category_primary", "fiscal_year", "fiscal_quarter")
conformed("purchase_orders", "purchase_order", "po_line_id", "po_number", "po_line_num", "supplier_id", "po_created_date",
          "po_approved_date", "fiscal_year", "fiscal_quarter", "segment_code", "quantity", "unit_price", "extended_amount",
          "source_pr_number", "source_pr_line_num")
conformed("ap_invoice_lines", "invoice_ap", "source_primary_key", "invoice_line_id", "invoice_id", "invoice_number", "supplier_id",
          "po_matched_flag", "source_po_header_id", "po_line_id", "invoice_date", "period_name", "payment_terms", "due_date",
          "payment_date", "payment_status", "is_on_time_payment", "days_to_pay", "quantity", "amount", "segment_code",
          "true_category_secondary", "fiscal_year", "fiscal_quarter")
conformed("sourcing_events", "sourcing_event", "event_id", "event_type", "created_on", "closed_on", "suppliers_invited",
          "suppliers_responded", "awarded_supplier_id", "awarded_amount", "fiscal_year", "fiscal_quarter")
conformed("ar_invoices", "invoice_ar", "source_primary_key", "invoice_number", "customer_id", "invoice_date", "period_name",
          "currency", "total_amount", "status", "fiscal_year", "fiscal_quarter")
conformed("inbound_contract_master", "contract_inbound")
conformed("contract_effective_value", "contract_outbound", "contract_id", "customer_id", "segment_code", "start_date", "end_date",
          "total_contract_value", "amendment_value_delta", "effective_contract_value", "status")
conformed("coa_accounts", "coa_account", "code_combination_id", "entity_code", "cost_center_code", "natural_account_code",
          "intercompany_code", "segment6_future1", "natural_account_type", "segment_code", "enabled_flag")
conformed("journal_headers", "gl_journal_header", "source_primary_key", "je_header_id", "period_name", "je_source", "je_category",
          "posted_date", "currency_code", "fiscal_year", "fiscal_quarter")
conformed("journal_lines_conformed", "gl_journal_line", "source_primary_key", "je_header_id", "code_combination_id",
          "accounted_dr", "accounted_cr", "net_amount")
conformed("dim_employees", "dim_employees", "employee_id", "version_seq", "effective_from", "effective_to", "is_current",
          "employment_status", "segment_code", "annual_base_salary_usd", "quarterly_loaded_cost_usd")
conformed("classification_rows", "invoice_classification", "predicted_primary_category", "predicted_secondary_category",
          "primary_confidence", "secondary_confidence", "model_version")


def from_lake(name: str, table: str, *columns: str):
    query(name)(lambda retail: retail.lake().pick(table, *columns) if columns else retail.lake()[table])


from_lake("dim_account", "dim_account")
from_lake("dim_cost_center", "dim_cost_center")
from_lake("dim_spend_category", "dim_spend_category", "primary_code", "secondary_code", "gl_account", "gl_account_type", "is_direct")
from_lake("fact_invoices", "fact_invoices", "invoice_line_id", "invoice_id", "fiscal_year", "fiscal_quarter", "segment_code",
          "supplier_id", "supplier_name", "supplier_region", "supplier_country", "supplier_maverick_propensity",
          "is_regulated_supplier", "amount", "quantity", "gl_account", "gl_account_type", "direct_indirect", "addressability",
          "true_category_secondary", "predicted_primary_category", "predicted_secondary_category", "secondary_confidence")
from_lake("fact_purchase_orders", "fact_purchase_orders", "po_number", "supplier_id", "supplier_name", "supplier_region",
          "supplier_segment_affinity", "extended_amount", "segment_code", "fiscal_year", "fiscal_quarter")
from_lake("fact_purchase_requests", "fact_purchase_requests", "pr_number", "supplier_id", "supplier_name", "supplier_country",
          "pr_status", "estimated_extended_amount", "price_unit_adjusted", "segment_code")
from_lake("fact_revenue", "fact_revenue", "schedule_id", "contract_id", "amount", "fiscal_year", "fiscal_quarter",
          "contract_start_date", "contract_end_date", "effective_contract_value")
from_lake("gl_entries", "fact_gl_entries", "je_header_id", "period_name", "je_category", "code_combination_id", "segment_code",
          "account_type", "natural_account_code", "cost_center_code", "accounted_dr", "accounted_cr", "net_amount")
from_lake("trial_balance", "fact_trial_balance")
from_lake("journal_lines", "gl_journal_line", "je_header_id", "je_line_num", "code_combination_id", "accounted_dr", "accounted_cr")
from_lake("headcount_snapshot", "fact_emp_quarterly_cost")


@query("period_balances")
def _balances(retail: Retail) -> DataFrame:
    entries = retail.lake().pick("fact_gl_entries", "fiscal_year", "code_combination_id", "accounted_dr", "accounted_cr")
    period = F.concat(F.col("fiscal_year").cast("string"), F.lit("-12"))
    return posting.period_balances(entries, period, ("code_combination_id", "fiscal_year")).drop("fiscal_year")


@query("derived_orders")
def _orders(retail: Retail) -> DataFrame:
    requests = retail.conforming_lake()["purchase_request"]
    return posting.derive_orders(requests, F.concat(F.lit("PO-"), "pr_number")).select(
        "po_number", "po_line_num", "supplier_id", "segment_code", "quantity", "unit_price", "extended_amount",
        "source_pr_number")


@query("due_dates")
def _due(retail: Retail) -> DataFrame:
    invoices = retail.conforming_lake()["ap_invoices_all"]
    return invoices.select("invoice_id", R.due_date("invoice_date", "payment_terms_name").alias("due_date"))


@query("dim_date")
def _dates(retail: Retail) -> DataFrame:
    days = retail.read("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return gold.calendar(days).withColumn("first_of_month", F.to_date("first_of_month"))


@query("period_calendar")
def _periods(retail: Retail) -> DataFrame:
    return period_calendar(retail.read("orders").select(
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period_month")).distinct())


@query("period_anchors")
def _anchors(retail: Retail) -> DataFrame:
    orders = retail.read("orders").groupBy(*R.fiscal("o_orderdate")).agg(
        F.sum(R.money("o_totalprice")).cast("double").alias("_t"), F.count("*").alias("_n"))
    million = lambda part: F.round(F.col("_t") / 1e6 * part, 1)
    measures = {"revenue": 1.0, "cogs": 0.6, "sga": 0.15, "rd": 0.05, "operating_income": 0.2}
    zeros = ["interest_expense", "tax_provision", "net_income", "cash", "ar", "inventory", "ap", "lt_debt",
             "total_assets", "total_equity", "operating_cash_flow", "capex", "free_cash_flow"]
    periods = orders.select("fiscal_year", "fiscal_quarter", F.lit("Q").alias("period_type"),
                            *[million(v).alias(k) for k, v in measures.items()],
                            *[F.lit(0.0).alias(z) for z in zeros], F.col("_n").cast("int").alias("headcount_total"))
    mix = [("A", "Alpha", 0.503, 0.203), ("B", "Beta", 0.297, 0.107), ("C", "Gamma", 0.2, 0.153)]
    return gold.dim_period_anchors(periods, mix).select(
        "fiscal_year", "fiscal_quarter", "segment_code", "revenue", "cogs", "gross_profit", "operating_income",
        "headcount_total", "cash")


@query("scd2_history")
def _history(retail: Retail) -> DataFrame:
    versions = retail.lake()["dim_employees"]
    return versions.select("employee_id", "version_seq", "effective_from",
                           F.when(~F.col("is_current"), F.col("effective_to")).alias("effective_to"),
                           "is_current", "segment_code")


@query("scd2_snapshot")
def _snapshot(retail: Retail) -> DataFrame:
    days = retail.event_days()
    active = retail.lake()["dim_employees"].where("employment_status = 'active'")
    return snapshot(active, days).groupBy("snapshot_date", "segment_code").agg(
        F.count_distinct("employee_id").alias("headcount"))


@query("allocate_monthly")
def _allocate(retail: Retail) -> DataFrame:
    """Quarterly spend per segment spread over its months by the number of lines."""
    lines = retail.lake().pick("fact_invoices", *GROUP, "period_name", "amount")
    months = lines.groupBy(*GROUP, "period_name").agg(F.count("*").alias("weight"))
    quarters = lines.groupBy(*GROUP).agg(F.sum("amount").alias("total"))
    out = allocate.allocate(months.join(quarters, GROUP), GROUP, "total", "weight", "allocated")
    return out.select(*GROUP, "period_name", F.round("allocated", 4).alias("allocated"))


@query("rescale_to_target")
def _rescale(retail: Retail) -> DataFrame:
    lake = retail.lake()
    targets = retail.anchors(lake).withColumn("target", F.col("target_mm") * 1e6)
    lines = lake.pick("fact_invoices", "invoice_line_id", "invoice_id", *GROUP, "amount")
    return allocate.rescale(lines, targets, GROUP, "amount", "target").groupBy("invoice_id").agg(
        R.exact_sum("amount").alias("invoice_amount"))


@query("residual_last_line")
def _residual(retail: Retail) -> DataFrame:
    """Order totals spread over lines by quantity, rounded, the last line taking the rest."""
    lake = retail.lake()
    lines = lake.pick("invoice_ap", "invoice_id", "line_number", "invoice_line_id", "quantity")
    totals = retail.read("orders").select(F.col("o_orderkey").alias("invoice_id"), R.money("o_totalprice", "total"))
    spread = allocate.allocate(lines.join(totals, "invoice_id"), ["invoice_id"], "total", "quantity", "part")
    return allocate.settle_residual(spread, "invoice_id", ["line_number", "invoice_line_id"], "part",
                                    totals, "total", "amount") \
        .select("invoice_line_id", "amount")


def _monthly(retail: Retail) -> DataFrame:
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return retail.read("orders").groupBy(month.alias("m")).agg(F.count("*").alias("n"))


@query("interpolate_series")
def _interpolate(retail: Retail) -> DataFrame:
    """Counts known in the first month of each quarter only."""
    spine = _monthly(retail).withColumn("known", F.when(F.month("m") % 3 == 1, F.col("n")))
    return series.interpolate(spine, [], "m", "known", "v").select("m", F.round("v", 6).alias("value"))


@query("compound_index")
def _compound(retail: Retail) -> DataFrame:
    rate = series.monthly_rate(F.col("n") / 10000.0, 0.03, 0.08)
    return series.compound(_monthly(retail), [], "m", rate, "v").select("m", F.round("v", 6).alias("idx"))


@query("secondary_categories")
def _codes(retail: Retail) -> DataFrame:
    """JSON code lists of suppliers unpacked to one row per code."""
    rows = retail.read("part").select("p_partkey", F.to_json(F.array("p_type", "p_brand")).alias("codes"))
    return rows.select("p_partkey", F.explode(R.code_list("codes")).alias("code"))


@query("lagged_series")
def _lagged(retail: Retail) -> DataFrame:
    return series.lag_clamped(_monthly(retail), [], "m", "n", 2, "lagged")


@query("standardised_series")
def _standard(retail: Retail) -> DataFrame:
    return series.standardise(_monthly(retail), "n", "v", beta=1.3).select("m", F.round("v", 6).alias("z"))


@query("split_by_mix")
def _mix(retail: Retail) -> DataFrame:
    """Yearly totals split by each segment's share of customers."""
    customers = retail.read("customer").groupBy(F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("k"))
    every = customers.agg(F.sum("k")).scalar()
    mix = customers.select("s", (F.col("k") / every).alias("mix")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("s").alias("segment_code"), F.col("s").alias("segment_name"), F.col("mix")))).alias("segments"))
    yearly = retail.read("orders").groupBy(F.year("o_orderdate").alias("fiscal_year")).agg(
        (F.sum(R.money("o_totalprice")).cast("double") / 1e6).alias("revenue"))
    return allocate.split_by_mix(yearly, mix, ["revenue"]).drop("segment_name")


@query("scaled_estimates")
def _scaled(retail: Retail) -> DataFrame:
    """Request estimates scaled so that each quarter reaches 1.25 times its invoiced spend."""
    lake = retail.lake()
    spend = lake.pick("fact_invoices", "fiscal_year", "fiscal_quarter", "amount").groupBy("fiscal_year", "fiscal_quarter") \
        .agg(F.sum("amount").cast("double").alias("spend"))
    requests = lake.pick("fact_purchase_requests", "pr_number", "fiscal_year", "fiscal_quarter", "estimated_extended_amount") \
        .join(spend, ["fiscal_year", "fiscal_quarter"])
    out = allocate.scale_to_target(requests, ["fiscal_year", "fiscal_quarter"], "estimated_extended_amount",
                                   F.col("spend") * 1.25, "scaled")
    return out.select("pr_number", F.round("scaled", 4).alias("scaled"))


@query("upsert_predictions")
def _upsert(retail: Retail) -> DataFrame:
    """A second model run over all lines: later lines of a document are updated, the first two come under new ids."""
    lines = retail.lake().pick("invoice_ap", "invoice_line_id", "line_number", "true_category_secondary")
    lines = settled(lines, "lines", rebalance=False)  # target, source and the check of its keys read them
    new_id = F.when(F.col("line_number") <= 2, F.concat(F.lit("new-"), "invoice_line_id")).otherwise(F.col("invoice_line_id"))
    target = lines.select("invoice_line_id", "true_category_secondary", F.lit("1").alias("model_version"))
    source = lines.select(new_id.alias("invoice_line_id"), "true_category_secondary", F.lit("2").alias("model_version"))
    return merged(target, source, ["invoice_line_id"])


@query("upsert_in_place")
def _upsert_in_place(retail: Retail) -> DataFrame:
    """The same through a stored table in buckets: only lines of every hundredth order change, all lines are read back."""
    from ledgerloom.session import scratch
    from ledgerloom.sinks.tables import Store

    lines = retail.lake().pick("invoice_ap", "invoice_line_id", "invoice_id", "true_category_secondary")
    columns = ["invoice_line_id", "true_category_secondary", "model_version"]
    store = Store(retail.spark, scratch(retail.spark, "published"))
    store.create_bucketed("predictions", lines.withColumn("model_version", F.lit("1")).select(*columns), ["invoice_line_id"])
    changed = lines.where(F.col("invoice_id").cast("bigint") % 100 == 0).withColumn("model_version", F.lit("2"))
    return store.upsert("predictions", changed.select(*columns), ["invoice_line_id"])


@query("hash_sample")
def _sample(retail: Retail) -> DataFrame:
    return sample_rows(retail.read("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("large_hash_sample")
def _large_sample(retail: Retail) -> DataFrame:
    """Two thirds of all lines, of which whole orders share a key."""
    lines = retail.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    share = lines.count() * 2 // 3
    return sample_rows(lines, "l_orderkey", share).select("l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("stream_ingest_events")
def _stream(retail: Retail) -> DataFrame:
    """The event file ingested as a stream; a second run must add nothing."""
    from ledgerloom.session import scratch
    from ledgerloom.streaming.ingest import ingest_folder

    home = scratch(retail.spark, "stream")
    schema = retail.read("events").schema
    for _ in range(2):
        table = ingest_folder(retail.spark, retail.folder, "events.parquet", schema, f"{home}/data", f"{home}/checkpoint")
    return table.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
