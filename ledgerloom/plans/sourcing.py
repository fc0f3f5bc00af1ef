"""Sourcing marts and reports: concentration, maverick and tail spend, contracts, scorecards, savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fixed
from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake, settled
from ledgerloom.operators.sweep import sums_within, under_cover
from ledgerloom.operators.keyed import null_safe_join, one_per_key, top_k, with_total
from ledgerloom.plans.legal import today, without_contract

QUARTER = ["fiscal_year", "fiscal_quarter"]
GROUP = [*QUARTER, "segment_code"]
PARENT, LEAF = "predicted_primary_category", "predicted_secondary_category"


def classified(lake: Lake) -> DataFrame:
    """Addressable, classified spend per group, leaf and supplier: the marts' common base.

    All marts are sums over this aggregate, so the lines are read and shuffled once.
    """
    lines = lake.pick("fact_invoices", *GROUP, PARENT, LEAF, "supplier_id", "addressability", "amount")
    return lines.where(F.col(LEAF).isNotNull() & (F.col("addressability") == "Addressable")) \
        .groupBy(*GROUP, PARENT, LEAF, "supplier_id").agg(F.sum("amount").alias("spend"))


def _base(lake: Lake, base: DataFrame | None) -> DataFrame:
    return classified(lake) if base is None else base


def parent_rollup(lake: Lake, base: DataFrame | None = None) -> DataFrame:
    """Spend and suppliers per parent category, segment and quarter."""
    return _base(lake, base).groupBy(*GROUP, PARENT).agg(
        R.exact_sum("spend").alias("parent_spend"), F.count_distinct("supplier_id").alias("suppliers_in_parent"))


def leaf_concentration(lake: Lake, base: DataFrame | None = None) -> DataFrame:
    """Herfindahl index of supplier shares within each leaf (1 = a single supplier).

    The sum of squares over the square of the sum: two plain sums, no join back to the total.
    """
    sums = _base(lake, base)
    squares = F.sum((F.col("spend") * F.col("spend")).cast("decimal(38,4)")).cast("double")
    total = F.sum("spend").cast("double")
    return sums.groupBy(*GROUP, PARENT, LEAF).agg(
        R.exact_sum("spend").alias("leaf_spend"), F.count("*").alias("suppliers"),
        F.round(squares / F.nullif(total * total, F.lit(0.0)), 6).alias("hhi"))


def supplier_shares(lake: Lake) -> DataFrame:
    """Each supplier's share of its leaf and its squared contribution to the index."""
    shares = with_total(classified(lake), [*GROUP, LEAF], "spend", "leaf_total")
    share = R.ratio("spend", "leaf_total")
    return shares.select(*GROUP, PARENT, LEAF, "supplier_id", F.col("spend").cast("decimal(28,2)").alias("spend"),
                         F.round(share, 6).alias("share"), F.round(share * share, 6).alias("hhi_contribution"))


def concentration_over_time(lake: Lake) -> DataFrame:
    """Leaf index per quarter over all segments."""
    sums = classified(lake).groupBy(*QUARTER, LEAF, "supplier_id").agg(F.sum("spend").alias("spend"))
    squares = F.sum((F.col("spend") * F.col("spend")).cast("decimal(38,4)")).cast("double")
    total = F.sum("spend").cast("double")
    return sums.groupBy(*QUARTER, LEAF).agg(
        R.exact_sum("spend").alias("leaf_spend"),
        F.round(squares / F.nullif(total * total, F.lit(0.0)), 6).alias("hhi"))


def _with_hint(base: DataFrame, lake: Lake) -> DataFrame:
    hint = lake.pick("dim_supplier", "supplier_id", _hint="category_primary")
    return base.join(hint, "supplier_id", "left")


def maverick_spend(lake: Lake, hint_tier: str = LEAF, base: DataFrame | None = None) -> DataFrame:
    """Spend outside the supplier's own category; a supplier without one is not counted as maverick."""
    off = F.when(F.col("_hint") != F.col(hint_tier), F.col("spend")).otherwise(0)
    return _with_hint(_base(lake, base), lake).groupBy(*GROUP, PARENT, LEAF).agg(
        R.exact_sum(off).alias("maverick_spend"), R.exact_sum("spend").alias("total_spend"))


def maverick_suppliers(lake: Lake, hint_tier: str = LEAF) -> DataFrame:
    """The mart of maverick spend by supplier, with all suppliers; a report orders and cuts it."""
    off = F.when(F.col("_hint") != F.col(hint_tier), F.col("spend")).otherwise(0)
    return _with_hint(classified(lake), lake).groupBy("supplier_id").agg(
        R.exact_sum(off).alias("maverick_spend"), R.exact_sum("spend").alias("total_spend"))


def top_maverick_suppliers(lake: Lake, n: int = 50, hint_tier: str = LEAF) -> DataFrame:
    """Report: the n suppliers with the largest maverick spend."""
    return top_k(maverick_suppliers(lake, hint_tier), [F.desc("maverick_spend"), F.col("supplier_id")], n)


def off_contract_by_leaf(lake: Lake, base: DataFrame | None = None) -> DataFrame:
    open_spend = without_contract(_base(lake, base), lake.pick("contract_inbound", "supplier_id", "status"))
    return open_spend.groupBy(*GROUP, PARENT, LEAF).agg(R.exact_sum("spend").alias("off_contract_spend"))


def tail_spend(lake: Lake, threshold: float = 0.05) -> DataFrame:
    """Per segment, spend in leaves of which it buys less than 5% of the company total."""
    base = classified(lake).groupBy("segment_code", LEAF).agg(F.sum("spend").alias("spend"))
    shares = with_total(base, [LEAF], "spend", "company")
    small = shares.where(R.ratio("spend", "company") < threshold)
    return small.groupBy("segment_code").agg(
        F.count("*").alias("tail_leaves"), R.exact_sum("spend").alias("tail_spend"))


def sourcing_strategy(lake: Lake, hint_tier: str = LEAF) -> DataFrame:
    """The mart: per leaf, segment and quarter with its parent's totals, index, maverick and off-contract."""
    keys = [*GROUP, PARENT, LEAF]
    # Four sums over one aggregate: it is written once, so the lines are not read four times.
    base = settled(classified(lake), "classified")
    out = leaf_concentration(lake, base)
    out = null_safe_join(out, maverick_spend(lake, hint_tier, base).drop("total_spend"), keys, "left")
    out = null_safe_join(out, off_contract_by_leaf(lake, base), keys, "left")
    out = null_safe_join(out, parent_rollup(lake, base), [*GROUP, PARENT], "left")
    zero = F.lit(0).cast("decimal(28,2)")
    return out.withColumn("off_contract_spend", F.coalesce("off_contract_spend", zero)) \
        .withColumn("leaf_share_of_parent", R.percent("leaf_spend", "parent_spend", 2))


# -- contracts ---------------------------------------------------------------------------

def contract_burn_down(lake: Lake, as_of=None, kinds: tuple[str, ...] = ("SOW", "PRICING_AGREEMENT")) -> DataFrame:
    """Spend of the supplier since the contract began against its commitment, for active contracts.

    Spend is summed per supplier and day; days and contracts then meet in one sweep, without a row per day and contract.
    """
    active = lake["contract_inbound"].where((F.col("status") == "Active") & F.col("contract_type").isin(*kinds))
    daily = lake.pick("fact_invoices", "supplier_id", "invoice_date", "amount") \
        .groupBy("supplier_id", "invoice_date").agg(F.sum("amount").alias("spend"))
    terms = active.select("contract_workspace_id", "supplier_id", "effective_date", F.least("expiration_date", today(as_of)).alias("_until"))
    spent = sums_within(terms.where(F.col("supplier_id").isNotNull()), daily.where(F.col("supplier_id").isNotNull()),
                        "supplier_id", "contract_workspace_id", "effective_date", "_until", "invoice_date", "spend", "_spent")
    joined = active.join(spent, "contract_workspace_id", "left")
    used = F.coalesce("_spent", F.lit(0)).cast("decimal(28,2)")
    return joined.select(
        "contract_workspace_id", "supplier_id", "contract_type", "total_committed_spend",
        used.alias("spend_to_date"), R.percent(used, "total_committed_spend", 2).alias("pct_consumed"),
        F.datediff("expiration_date", today(as_of)).alias("days_left"))


def trailing_spend(lake: Lake, as_of, months: int = 12) -> DataFrame:
    day = today(as_of)
    recent = lake.pick("fact_invoices", "supplier_id", "invoice_date", "amount") \
        .where((F.col("invoice_date") > F.add_months(day, -months)) & (F.col("invoice_date") <= day))
    return recent.groupBy("supplier_id").agg(F.sum("amount").cast("decimal(28,2)").alias("trailing_spend"))


def renewal_queue(lake: Lake, as_of=None, days: int = 180) -> DataFrame:
    """Contracts that end soon, the supplier's last twelve months of spend deciding the order."""
    day = today(as_of)
    ending = lake["contract_inbound"].where(F.col("expiration_date").between(day, F.date_add(day, days)))
    return ending.join(trailing_spend(lake, as_of), "supplier_id", "left").select(
        "contract_workspace_id", "supplier_id", "expiration_date",
        F.datediff("expiration_date", day).alias("days_left"),
        F.coalesce("trailing_spend", F.lit(0)).cast("decimal(28,2)").alias("trailing_spend")) \
        .orderBy(F.desc("trailing_spend"), "contract_workspace_id")


def contract_leakage(lake: Lake) -> DataFrame:
    """Lines of a supplier that has an active contract, but dated outside all of its contracts.

    A busy supplier contributes one row per day and segment. A day is covered if any contract covers it: contracts
    begin and end in the same stream as the days, and the number of open ones says so.
    """
    active = lake["contract_inbound"].where(F.col("status") == "Active")
    contracts = active.select("contract_workspace_id", "supplier_id", "effective_date", "expiration_date")
    daily = lake.pick("fact_invoices", "supplier_id", "invoice_date", "segment_code", "amount") \
        .groupBy("supplier_id", "segment_code", "invoice_date").agg(
            F.count("*").alias("lines"), F.sum("amount").alias("amount"))
    known = daily.join(contracts.select("supplier_id").distinct(), "supplier_id", "left_semi")
    status = under_cover(known, contracts, "supplier_id", "effective_date", "expiration_date", "invoice_date", "_covered")
    return status.where(~F.col("_covered")).groupBy("segment_code", "supplier_id").agg(
        F.sum("lines").alias("leaked_lines"), R.exact_sum("amount").alias("leaked_amount"))


# -- suppliers ---------------------------------------------------------------------------

def supplier_scorecard(lake: Lake) -> DataFrame:
    """Spend, invoices, on-time rate, days to pay and leading category per supplier."""
    lines = lake.pick("fact_invoices", "supplier_id", "invoice_id", "amount", "is_on_time_payment", "days_to_pay",
                      "true_category_primary")
    totals = lines.groupBy("supplier_id").agg(
        R.exact_sum("amount").alias("spend"), F.count_distinct("invoice_id").alias("invoices"),
        R.percent(F.count_if("is_on_time_payment"), F.count("is_on_time_payment")).alias("on_time_pct"),
        F.round(R.mean("days_to_pay"), 1).alias("avg_days_to_pay"))
    mix = lines.groupBy("supplier_id", "true_category_primary").agg(F.sum("amount").alias("_s"))
    lead = one_per_key(mix, ["supplier_id"], [-F.col("_s"), F.col("true_category_primary")]) \
        .select("supplier_id", F.col("true_category_primary").alias("top_category"), F.col("_s"))
    known = lake.pick("dim_supplier", "supplier_id", "payment_terms", "maverick_propensity", "is_regulated_supplier")
    return totals.join(lead, "supplier_id", "left").join(known, "supplier_id", "left") \
        .withColumn("top_category_pct", R.percent("_s", "spend")).drop("_s")


def supplier_category_mix(lake: Lake) -> DataFrame:
    """Spend of each supplier by parent and leaf."""
    return lake.pick("fact_invoices", "supplier_id", "true_category_primary", "true_category_secondary", "amount") \
        .groupBy("supplier_id", "true_category_primary", "true_category_secondary") \
        .agg(R.exact_sum("amount").alias("spend"))


def terms_targets(lake: Lake, target_days: int = 60, n: int = 50) -> DataFrame:
    """Suppliers whose longer payment terms would free most working capital; regulated ones excluded."""
    spend = lake.pick("fact_invoices", "supplier_id", "amount").groupBy("supplier_id") \
        .agg(F.sum("amount").cast("decimal(28,2)").alias("spend"))
    suppliers = lake.pick("dim_supplier", "supplier_id", "payment_terms", "is_regulated_supplier") \
        .where(~F.coalesce("is_regulated_supplier", F.lit(False)))
    days = R.coded("payment_terms", {t: str(d) for t, d in fixed.PAYMENT_TERMS_DAYS.items()}, None).cast("int")
    open_days = suppliers.withColumn("current_days", days).where(F.col("current_days") < target_days)
    gain = (F.col("spend") * (target_days - F.col("current_days"))).cast("decimal(38,2)")
    rows = spend.join(open_days, "supplier_id").select(
        "supplier_id", "payment_terms", "current_days", "spend", gain.alias("opportunity"))
    return top_k(rows, [F.desc("opportunity"), F.col("supplier_id")], n)


def suggest_suppliers(lake: Lake, n: int = 3) -> DataFrame:
    """Per segment and leaf, the n addressable suppliers with the largest spend.

    The rank is taken over the supplier sums, and Spark keeps n rows of a leaf in each task before the shuffle, so
    no task ranks all suppliers of a leaf.
    """
    by = ["segment_code", "true_category_secondary"]
    sums = lake.pick("fact_invoices", *by, "supplier_id", "amount", "addressability") \
        .where(F.col("addressability") == "Addressable").groupBy(*by, "supplier_id") \
        .agg(F.sum("amount").cast("decimal(28,2)").alias("spend"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("spend"), "supplier_id"))
    return sums.withColumn("position", place).where(F.col("position") <= n).select(*by, "position", "supplier_id", "spend")


def price_history(lake: Lake) -> DataFrame:
    """Unit price per material and quarter: lowest, highest, volume-weighted, and the latest price."""
    orders = lake.pick("fact_purchase_orders", "material_number", *QUARTER, "unit_price", "quantity",
                       "extended_amount", "po_approved_date", "po_number", "po_line_num")
    return orders.groupBy("material_number", *QUARTER).agg(
        F.count("*").alias("order_lines"), F.min("unit_price").alias("lowest_price"),
        F.max("unit_price").alias("highest_price"),
        F.round(R.ratio(F.sum("extended_amount"), F.sum("quantity")), 4).alias("average_price"),
        F.max_by("unit_price", F.struct("po_approved_date", "po_number", "po_line_num")).alias("latest_price"))


# -- savings -----------------------------------------------------------------------------

def savings_ledger(reductions: DataFrame, avoidances: DataFrame | None = None) -> DataFrame:
    """Savings per event: negotiated baseline less award, plus avoidances entered by hand.

    `reductions` needs event_id, segment_code, fiscal_year, fiscal_quarter, baseline_amount and
    awarded_amount; `avoidances` event_id, segment_code, fiscal_year, fiscal_quarter, amount_usd.
    """
    ledger = reductions.select(
        F.col("event_id"), *GROUP, F.lit("reduction").alias("savings_type"),
        (F.col("baseline_amount") - F.col("awarded_amount")).cast("decimal(18,2)").alias("amount_usd")) \
        .where(F.col("amount_usd") > 0)
    if avoidances is None:
        return ledger
    return ledger.unionByName(avoidances.select(
        "event_id", *GROUP, F.lit("avoidance").alias("savings_type"), R.money("amount_usd")))


def savings_against_budget(ledger: DataFrame, budgets: DataFrame) -> DataFrame:
    """Savings per segment and quarter as a share of the cost budget."""
    saved = ledger.groupBy(*GROUP).pivot("savings_type", ["reduction", "avoidance"]).agg(F.sum("amount_usd")) \
        .na.fill(0)
    cost = budgets.where(F.col("account_type") != "REVENUE").groupBy(*GROUP) \
        .agg(F.sum("amount_usd").alias("budget"))
    both = saved.join(cost, GROUP, "left").withColumn("total_savings", F.col("reduction") + F.col("avoidance"))
    return both.select(
        *GROUP, *[F.col(c).cast("decimal(28,2)").alias(c) for c in ("reduction", "avoidance", "total_savings", "budget")],
        R.percent("total_savings", "budget", 2).alias("savings_pct_of_budget"))


# -- classification monitor and metric set ------------------------------------------------

def label_coverage(lake: Lake) -> DataFrame:
    """Share of lines with a prediction by quarter and segment."""
    return lake.pick("fact_invoices", *GROUP, LEAF).groupBy(*GROUP).agg(
        F.count("*").alias("lines"), F.count(LEAF).alias("predicted_lines"),
        R.percent(F.count(LEAF), F.count("*"), 2).alias("coverage_pct"))


def confidence_histogram(lake: Lake, bins: int = 10) -> DataFrame:
    """Lines per confidence bin for both tiers."""
    both = F.array(*[F.struct(F.lit(tier).alias("tier"), F.col(f"{tier}_confidence").alias("c"))
                     for tier in ("primary", "secondary")])
    scores = lake.pick("fact_invoices", "primary_confidence", "secondary_confidence").select(
        F.explode(both).alias("_b")).where(F.col("_b.c").isNotNull())
    # Bins by decimal arithmetic, so that an exact edge always falls on the same side.
    edge = F.floor(F.col("_b.c").cast("decimal(12,9)") * bins).cast("int")
    return scores.groupBy(F.col("_b.tier").alias("tier"), F.least(edge, F.lit(bins - 1)).alias("bin")) \
        .agg(F.count("*").alias("lines"))


def disagreements(lake: Lake) -> DataFrame:
    """Where prediction and recorded leaf differ: the table to look for miscoded purchases in."""
    lines = lake.pick("fact_invoices", "true_category_secondary", LEAF, "amount")
    return lines.where(F.col("true_category_secondary") != F.col(LEAF)) \
        .groupBy("true_category_secondary", LEAF).agg(
            F.count("*").alias("lines"), R.exact_sum("amount").alias("amount"))


def model_trend(eval_runs: DataFrame) -> DataFrame:
    """Leaf accuracy of each model alias and slice, run by run, with the change to its last run."""
    from pyspark.sql import Window

    runs = Window.partitionBy("model_alias", "slice").orderBy("evaluated_at")
    now = F.col("secondary_top1_accuracy")
    return eval_runs.select("model_alias", "slice", "evaluated_at", "secondary_top1_accuracy",
                            (now - F.lag(now).over(runs)).alias("change"))


def metric_set(lake: Lake) -> DataFrame:
    """Managed spend, category coverage and order compliance per segment and quarter."""
    lines = lake.pick("fact_invoices", *GROUP, "amount", "po_matched_flag", LEAF, "secondary_confidence")
    managed = F.when(R.is_managed("secondary_confidence"), F.col("amount"))
    return lines.groupBy(*GROUP).agg(
        R.total("amount").alias("spend_mm"), R.percent(F.sum(managed), F.sum("amount")).alias("managed_spend_pct"),
        R.percent(F.count(LEAF), F.count("*")).alias("category_coverage_pct"),
        R.percent(F.sum(F.when(F.col("po_matched_flag") == "Y", F.col("amount"))), F.sum("amount"))
         .alias("po_compliance_pct"))
