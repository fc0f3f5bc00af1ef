"""Facts and dimensions for analysts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fixed
from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake
from ledgerloom.operators.history import snapshot
from ledgerloom.operators.keyed import null_safe_join, one_per_key
from pyspark.sql import Window

MONEY = "decimal(18,2)"


def enrich(base: DataFrame, want: set[str] | None, dimension, key: str, columns: dict[str, str]) -> DataFrame:
    """Left-join a dimension that is unique on `key`, unless none of its columns are wanted.

    No broadcast hint: Spark compares the measured size of the dimension with its threshold, and
    beyond that AQE splits hot keys of the sort-merge join.
    """
    used = {new: old for new, old in columns.items() if want is None or new in want}
    if not used:
        return base
    side = dimension().select(key, *[F.col(old).alias(new) for new, old in used.items()])
    return base.join(side, key, "left")


# -- dimensions --------------------------------------------------------------------------

def dim_supplier(lake: Lake) -> DataFrame:
    """One row per supplier; a source that knows the name wins, then system and key decide."""
    columns = ["supplier_id", "supplier_name", "country_code", "region", "language_code",
               "created_date", "category_primary", "category_secondary_json", "maverick_propensity",
               "segment_affinity", "payment_terms", "is_regulated_supplier",
               "supplier_canonical_id", "entity_resolution_cluster_id", "source_system", "source_primary_key"]
    best = one_per_key(lake["supplier"].select(*columns), ["supplier_id"], [
        F.col("supplier_name").isNull(), F.col("source_system"), F.col("source_primary_key")])
    return best.select(*columns[:-4], F.coalesce("supplier_canonical_id", "supplier_id").alias("canonical_supplier_id"),
                       "entity_resolution_cluster_id")


def dim_customer(lake: Lake) -> DataFrame:
    return lake.pick("customer", "customer_id", "customer_name", "country_code", "region",
                     "primary_segment_code")


def dim_account(lake: Lake) -> DataFrame:
    return lake["coa_account"].select(
        F.col("natural_account_code").alias("account_code"),
        F.col("natural_account_description").alias("account_description"),
        F.col("natural_account_type").alias("account_type")).distinct()


def dim_cost_center(lake: Lake) -> DataFrame:
    known = lake["coa_account"].where(F.col("cost_center_code").isNotNull())
    return known.select("cost_center_code", "segment_code", "entity_code").distinct() \
        .withColumn("cost_center_key", F.concat("segment_code", F.lit("-"), "cost_center_code"))


def dim_segment(spark: SparkSession) -> DataFrame:
    schema = "segment_code string, segment_name string, company_code string, sort_order int"
    return spark.createDataFrame(fixed.SEGMENTS, schema)


def dim_spend_category(spark: SparkSession) -> DataFrame:
    rows = [(parent, parent_name, leaf, leaf_name, account, kind, affinity)
            for parent, parent_name, leaves in fixed.SPEND_TAXONOMY
            for leaf, leaf_name, account, kind, affinity in leaves]
    table = spark.createDataFrame(
        rows, "primary_code string, primary_name string, secondary_code string, secondary_name string,"
              " gl_account string, gl_account_type string, segment_affinity string")
    return table.select("primary_code", "primary_name", "secondary_code", "secondary_name",
                        "gl_account", "gl_account_type",
                        (F.col("gl_account_type") == "COGS").alias("is_direct"), "segment_affinity")


def calendar(days: DataFrame, day: str = "d") -> DataFrame:
    """Calendar attributes of each day."""
    d = F.col(day)
    return days.select(
        d.alias("date_key"), F.year(d).alias("calendar_year"), F.year(d).alias("fiscal_year"),
        F.quarter(d).alias("fiscal_quarter"), F.month(d).alias("calendar_month"),
        F.date_format(d, "MMM").alias("month_short_name"), F.date_format(d, "MMMM").alias("month_long_name"),
        F.date_trunc("month", d).alias("first_of_month"), F.dayofmonth(d).alias("day_of_month"),
        F.dayofweek(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"))


def dim_date(spark: SparkSession, start: str = fixed.CALENDAR_START, end: str = fixed.CALENDAR_END) -> DataFrame:
    span = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return calendar(spark.range(1).select(F.explode(span).alias("d")))


# -- spend facts -------------------------------------------------------------------------

INVOICE_BASE = [
    "invoice_line_id", "invoice_id", "invoice_number", "line_number", "line_type", "invoice_date",
    "gl_date", "period_name", "fiscal_year", "fiscal_quarter", "segment_code", "supplier_id",
    "po_matched_flag", "source_po_header_id", "po_line_id", "payment_terms", "due_date", "payment_date",
    "payment_status", "is_on_time_payment", "days_to_pay", "line_description", "quantity", "unit_price",
    "amount", "currency", "code_combination_id", "true_category_primary", "true_category_secondary"]
SUPPLIER_PART = {
    "supplier_name": "supplier_name", "supplier_region": "region", "supplier_country": "country_code",
    "supplier_maverick_propensity": "maverick_propensity", "is_regulated_supplier": "is_regulated_supplier",
    "supplier_category_primary": "category_primary"}
ACCOUNT_PART = {"gl_account": "natural_account_code", "gl_account_type": "natural_account_type"}
PREDICTION_PART = {c: c for c in (
    "predicted_primary_category", "predicted_secondary_category", "primary_confidence",
    "secondary_confidence", "model_version", "scored_at")}


def fact_invoices(lake: Lake, want: set[str] | None = None) -> DataFrame:
    """Invoice lines with supplier, account and prediction attributes; never drops a line."""
    need = set(want) if want is not None else None
    if need is not None:
        # Derived columns pull in what they are computed from, and joins their keys.
        if "direct_indirect" in need:
            need.add("gl_account_type")
        if "addressability" in need:
            need.add("is_regulated_supplier")
        for part, key in ((SUPPLIER_PART, "supplier_id"), (ACCOUNT_PART, "code_combination_id"),
                          (PREDICTION_PART, "invoice_line_id")):
            if need & set(part):
                need.add(key)
    base = lake.pick("invoice_ap", *[c for c in INVOICE_BASE if need is None or c in need])
    out = enrich(base, need, lambda: lake["dim_supplier"], "supplier_id", SUPPLIER_PART)
    out = enrich(out, need, lambda: lake["coa_account"], "code_combination_id", ACCOUNT_PART)
    out = enrich(out, need, lambda: lake["invoice_classification"], "invoice_line_id", PREDICTION_PART)
    if need is None or "direct_indirect" in need:
        out = out.withColumn("direct_indirect", R.direct_or_indirect("gl_account_type"))
    if need is None or "addressability" in need:
        out = out.withColumn("addressability", R.addressability("is_regulated_supplier"))
    return out


def fact_purchase_orders(lake: Lake, want: set[str] | None = None) -> DataFrame:
    base = lake["purchase_order"]
    out = enrich(base, want, lambda: lake["dim_supplier"], "supplier_id", {
        "supplier_name": "supplier_name", "supplier_region": "region", "supplier_country": "country_code",
        "supplier_maverick_propensity": "maverick_propensity", "supplier_segment_affinity": "segment_affinity"})
    return out.drop("source_system", "source_table", "source_primary_key", "po_header_id", "po_line_id")


def fact_purchase_requests(lake: Lake, want: set[str] | None = None) -> DataFrame:
    """Request lines. The estimate ignores the price unit; the adjusted one divides by it."""
    base = lake["purchase_request"].withColumnRenamed("intended_supplier_id", "supplier_id")
    value = F.col("quantity") * F.col("estimated_unit_price")
    out = enrich(base, want, lambda: lake["dim_supplier"], "supplier_id", {
        "supplier_name": "supplier_name", "supplier_region": "region", "supplier_country": "country_code"})
    return out.withColumn("estimated_extended_amount", value.cast(MONEY)) \
        .withColumn("price_unit_adjusted", (value / F.nullif("price_unit", F.lit(0))).cast(MONEY)) \
        .drop("source_system", "source_table", "source_primary_key")


# -- revenue -----------------------------------------------------------------------------

def fact_revenue(lake: Lake, want: set[str] | None = None) -> DataFrame:
    """Billing events with their contract; an event without a known contract stays."""
    bills = lake["billing_schedule"]
    base = bills.select(
        "schedule_id", "contract_id", "customer_id", "segment_code", R.cast("bill_date", "date"),
        *R.fiscal("bill_date"), R.money("amount"), "currency", "status")
    out = enrich(base, want, lambda: lake["contract_outbound"], "contract_id", {
        "contract_number": "contract_number", "signed_date": "signed_date",
        "contract_start_date": "start_date", "contract_end_date": "end_date",
        "effective_contract_value": "effective_contract_value"})
    return out.select("*", R.null("boolean", "contract_leakage_flag"),
                      R.null(MONEY, "savings_realized_usd"))


# -- ledger ------------------------------------------------------------------------------

LEDGER_PART = {
    "entity_code": "entity_code", "cost_center_code": "cost_center_code",
    "natural_account_code": "natural_account_code", "account_type": "natural_account_type",
    "product_code": "product_code", "intercompany_code": "intercompany_code", "segment_code": "segment_code"}


def fact_gl_entries(lake: Lake, want: set[str] | None = None) -> DataFrame:
    """Journal lines with their header and account attributes."""
    header = lake["gl_journal_header"].select(
        "je_header_id", "period_name", "posted_date", "fiscal_year", "fiscal_quarter",
        "je_source", "je_category", "currency_code")
    lines = lake["gl_journal_line"].drop("source_system", "source_table", "source_primary_key")
    return enrich(lines.join(header, "je_header_id"), want, lambda: lake["coa_account"],
                  "code_combination_id", LEDGER_PART)


TRIAL_BALANCE_KEYS = ["code_combination_id", "fiscal_year", "fiscal_quarter", "period_name",
                      "segment_code", "account_type", "natural_account_code", "cost_center_code"]


def fact_trial_balance(lake: Lake) -> DataFrame:
    entries = lake.pick("fact_gl_entries", *TRIAL_BALANCE_KEYS, "accounted_dr", "accounted_cr", "net_amount")
    return entries.where(F.col("code_combination_id").isNotNull()).groupBy(*TRIAL_BALANCE_KEYS).agg(
        R.exact_sum("accounted_dr").alias("period_dr"), R.exact_sum("accounted_cr").alias("period_cr"),
        R.exact_sum("net_amount").alias("period_net"))


# -- planning ----------------------------------------------------------------------------

PLAN_KEYS = ["fiscal_year", "fiscal_quarter", "segment_code", "account_type"]


def fact_fpa_actuals(lake: Lake) -> DataFrame:
    """Income-statement amounts, positive on their natural side."""
    entries = lake.pick("fact_gl_entries", *PLAN_KEYS, "accounted_dr", "accounted_cr").where(
        F.col("segment_code").isNotNull() & F.col("account_type").isin(fixed.INCOME_ACCOUNT_TYPES))
    debit = R.exact_sum(F.col("accounted_dr") - F.col("accounted_cr"))
    return entries.groupBy(*PLAN_KEYS).agg(
        F.when(F.col("account_type") == "REVENUE", -debit).otherwise(debit).cast("decimal(28,2)").alias("amount_usd"),
        F.count("*").alias("entry_count"))


def _previous(frame: DataFrame, value: str, strict_quarter: bool) -> "F.Column":
    """Value of the previous row per segment and account type (a calendar-bounded window).

    With strict_quarter the previous row counts only if it is the previous calendar quarter.
    """
    w = Window.partitionBy("segment_code", "account_type").orderBy("fiscal_year", "fiscal_quarter")
    index = F.col("fiscal_year") * 4 + F.col("fiscal_quarter")
    before = F.lag(value).over(w)
    return F.when(F.lag(index).over(w) == index - 1, before) if strict_quarter else before


def fact_fpa_budgets(lake: Lake, strict_quarter: bool = False) -> DataFrame:
    """Previous actual plus growth; the first quarter of a series has no budget."""
    actuals = lake.pick("fact_fpa_actuals", *PLAN_KEYS, "amount_usd")
    growth = F.when(F.col("account_type") == "REVENUE", F.lit(fixed.REVENUE_GROWTH).cast("decimal(3,2)")) \
        .otherwise(F.lit(fixed.OTHER_GROWTH).cast("decimal(3,2)"))
    return actuals.select(
        *PLAN_KEYS, (_previous(actuals, "amount_usd", strict_quarter) * growth).cast(MONEY).alias("amount_usd"))


def fact_fpa_forecasts(lake: Lake, strict_quarter: bool = False) -> DataFrame:
    """Half budget, half previous actual; a missing part falls back on the budget, then on 0."""
    actuals = lake.pick("fact_fpa_actuals", *PLAN_KEYS, "amount_usd")
    prior = actuals.select(*PLAN_KEYS, _previous(actuals, "amount_usd", strict_quarter).alias("_prior"))
    budget = lake.pick("fact_fpa_budgets", *PLAN_KEYS, "amount_usd").withColumnRenamed("amount_usd", "_budget")
    zero = F.lit(0).cast(MONEY)
    blend = (F.coalesce("_budget", zero) + F.coalesce("_prior", "_budget", zero)) / 2
    return budget.join(prior, PLAN_KEYS, "full").select(*PLAN_KEYS, blend.cast(MONEY).alias("amount_usd"))


# -- people ------------------------------------------------------------------------------

def dim_employees(lake: Lake) -> DataFrame:
    base = R.cast("annual_base_salary_amount", MONEY)
    loaded = F.col("annual_base_salary_amount").cast(MONEY) * F.lit(fixed.SALARY_LOADING).cast("decimal(3,2)") / 4
    return lake["workers"].select(
        F.col("worker_id").alias("employee_id"), R.cast("version_seq", "int"),
        R.cast("effective_date", "date", "effective_from"), R.cast("effective_through", "date", "effective_to"),
        R.cast("is_current_row", "boolean", "is_current"),
        F.col("worker_name_first").alias("first_name"), F.col("worker_name_last").alias("last_name"),
        F.col("work_email").alias("email"), R.cast("hire_date", "date"), R.cast("termination_date", "date"),
        F.lower("worker_status").alias("employment_status"), F.col("organization_id").alias("segment_code"),
        F.col("cost_center_id").alias("cost_center_code"), "country_code", "region", "job_family",
        F.col("compensation_grade").alias("seniority_band"), base.alias("annual_base_salary_usd"),
        loaded.cast(MONEY).alias("quarterly_loaded_cost_usd"), "currency_code")


def quarter_ends(anchors: DataFrame) -> DataFrame:
    return anchors.where(F.col("period_type") == "Q").select("fiscal_year", "fiscal_quarter").distinct() \
        .withColumn("snapshot_date", R.quarter_end())


def employee_cost(employees: DataFrame, periods: DataFrame, step: str = "quarter") -> DataFrame:
    """Headcount and loaded cost of the employees active on each period's snapshot date."""
    active = employees.where(F.col("employment_status") == "active").select(
        "employee_id", "segment_code", "effective_from", "effective_to", "quarterly_loaded_cost_usd")
    valid = snapshot(active, periods, step=step)
    return valid.groupBy("fiscal_year", "fiscal_quarter", "segment_code").agg(
        F.count_distinct("employee_id").alias("headcount"),
        F.sum("quarterly_loaded_cost_usd").cast(MONEY).alias("quarterly_cost_usd"),
        F.avg("quarterly_loaded_cost_usd").cast(MONEY).alias("avg_quarterly_cost_per_head"))


def fact_emp_quarterly_cost(lake: Lake) -> DataFrame:
    return employee_cost(lake["dim_employees"], quarter_ends(lake["dim_period_anchors"]))


# -- period anchors ----------------------------------------------------------------------

def dim_period_anchors(periods: DataFrame, mix: list[tuple[str, str, float, float]]) -> DataFrame:
    """Consolidated period totals plus their split over segments.

    `mix` lists (segment code, segment name, share, operating margin). Each split amount is
    rounded to 0.1 by itself, headcount is cut to whole people, and balance-sheet figures exist
    on the consolidated row only.
    """
    flow = ["revenue", "cogs", "sga", "rd"]
    only_group = ["interest_expense", "tax_provision", "net_income", "cash", "ar", "inventory", "ap",
                  "lt_debt", "total_assets", "total_equity", "operating_cash_flow", "capex", "free_cash_flow"]
    gross = F.col("revenue") - F.col("cogs")
    group = periods.withColumn("segment_code", F.lit("CONSOL")) \
        .withColumn("segment_name", F.lit("Group (Consolidated)")).withColumn("gross_profit", gross)
    segments = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"),
                                  F.lit(share).alias("share"), F.lit(margin).alias("margin"))
                         for code, name, share, margin in mix])
    split = periods.withColumn("_s", F.explode(segments))
    for c in flow:
        split = split.withColumn(c, F.round(F.col(c) * F.col("_s.share"), 1))
    split = split.withColumn("gross_profit", F.round(gross, 1)) \
        .withColumn("operating_income", F.round(F.col("revenue") * F.col("_s.margin"), 1)) \
        .withColumn("headcount_total", F.floor(F.col("headcount_total") * F.col("_s.share")).cast("int"))
    for c in only_group:
        split = split.withColumn(c, F.lit(None).cast("double"))
    split = split.withColumn("segment_code", F.col("_s.code")).withColumn("segment_name", F.col("_s.name")).drop("_s")
    return group.unionByName(split.select(*group.columns))


BUILDERS = {f.__name__: f for f in (
    dim_supplier, dim_customer, dim_account, dim_cost_center, fact_invoices, fact_purchase_orders,
    fact_purchase_requests, fact_revenue, fact_gl_entries, fact_trial_balance, fact_fpa_actuals,
    fact_fpa_budgets, fact_fpa_forecasts, dim_employees, fact_emp_quarterly_cost)}
PRUNING = {"fact_invoices", "fact_purchase_orders", "fact_purchase_requests", "fact_revenue", "fact_gl_entries"}


def derived() -> dict:
    """All silver and gold builders as lake entries, computed on demand."""
    from ledgerloom.tables import silver

    def entry(name, build):
        return (lambda lake, want: build(lake, want)) if name in PRUNING else (lambda lake, want: build(lake))

    return {name: entry(name, build) for name, build in {**silver.BUILDERS, **BUILDERS}.items()}
