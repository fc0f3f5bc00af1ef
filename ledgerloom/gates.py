"""Reconciliation and data-quality gates. Each returns rows gate, key, actual, target, drift, level.

level is "ok", "warn" or "breach". `enforce` raises once, after all gates, with every breach counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import fixed_values as fixed
from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake
from ledgerloom.operators.history import snapshot
from ledgerloom.plans.accounting import journal_nets
from ledgerloom.sources.files import CORRUPT

QUARTER_SEGMENT = ["fiscal_year", "fiscal_quarter", "segment_code"]


def drift(actual, target) -> Column:
    """Relative distance; 0 where the target is 0."""
    actual, target = R.col(actual), R.col(target)
    return F.when(target == 0, 0.0).otherwise((actual - target).cast("double") / F.nullif(target, F.lit(0)).cast("double"))


def within(actual, target, tolerance: float) -> Column:
    """|actual - target| <= tolerance * |target|; against a target of 0 at most 1 is allowed.

    Computed by multiplication in decimals, so a drift of exactly the tolerance passes.
    """
    a, t = (R.col(c).cast("decimal(28,6)") for c in (actual, target))
    limit = F.abs(t) * F.lit(str(tolerance)).cast("decimal(6,4)")
    return F.when(t == 0, F.abs(a) <= 1).otherwise(F.abs(a - t) <= limit)


def key_text(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])


def _report(df: DataFrame, gate: str, key: Column, actual, target, tolerance: float, warn_only: bool) -> DataFrame:
    level = F.when(within(actual, target, tolerance), "ok").otherwise("warn" if warn_only else "breach")
    return df.select(F.lit(gate).alias("gate"), key.alias("key"), R.col(actual).cast("double").alias("actual"),
                     R.col(target).cast("double").alias("target"), drift(actual, target).alias("drift"),
                     level.alias("level"))


def compare_totals(gate: str, actuals: DataFrame, targets: DataFrame, keys: list[str], actual: str, target: str,
                   tolerance: float = fixed.HARD_TOLERANCE, warn_only: bool = False, surplus: bool = True) -> DataFrame:
    """Totals against targets. A target without any data counts as actual 0, and a total without a target as target 0,
    so that what nobody planned is reported; without `surplus` such totals are left out."""
    joined = targets.select(*keys, target).join(actuals.select(*keys, actual), keys, "full" if surplus else "left")
    joined = joined.withColumns({actual: F.coalesce(actual, F.lit(0)), target: F.coalesce(target, F.lit(0))})
    return _report(joined, gate, key_text(keys), actual, target, tolerance, warn_only)


def count_gate(gate: str, counts: DataFrame, allowed: int = 0) -> DataFrame:
    """Rows (key, n) that should not be there: a breach above the allowed number."""
    n, level = F.col("n").cast("double"), F.when(F.col("n") > allowed, "breach").otherwise("ok")
    return counts.select(F.lit(gate).alias("gate"), "key", n.alias("actual"), F.lit(float(allowed)).alias("target"),
                         F.when(n > allowed, n - allowed).otherwise(0.0).alias("drift"), level.alias("level"))


def unreadable_gate(name: str, stored: DataFrame, allowed: int = 0) -> DataFrame:
    """Stored rows of a source that did not fit their schema, and so are in no table downstream."""
    bad = F.count(F.col(CORRUPT)) if CORRUPT in stored.columns else F.lit(0).cast("long")
    return count_gate("unreadable rows", stored.agg(F.lit(name).alias("key"), bad.alias("n")), allowed)


def cast_loss_gate(name: str, rows: DataFrame, casts: dict[str, str], allowed: int = 0) -> DataFrame:
    """Values that are there and that a cast turns into NULL, by column."""
    lost = [F.struct(F.lit(f"{name}.{c}").alias("key"), F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(), 1)).alias("n"))
            for c, kind in casts.items()]
    return count_gate("cast loss", rows.agg(F.array(*lost).alias("a")).select(F.explode("a").alias("a")).select("a.key", "a.n"), allowed)


def absent_gate(name: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that have no value in any row of a table that has rows: the files lack the field, or name it otherwise."""
    empty = [F.struct(F.lit(f"{name}.{c}").alias("key"), ((F.count("*") > 0) & (F.count(c) == 0)).cast("long").alias("n")) for c in columns]
    return count_gate("absent field", rows.agg(F.array(*empty).alias("a")).select(F.explode("a").alias("a")).select("a.key", "a.n"))


def anchor_targets(anchors: DataFrame, *measures: str) -> DataFrame:
    """Quarterly segment targets in currency units from anchors in millions."""
    value = reduce(lambda a, b: a + b, [F.col(m).cast("decimal(18,6)") for m in measures]) * 1000000
    quarters = anchors.where((F.col("period_type") == "Q") & (F.col("segment_code") != "CONSOL"))
    return quarters.select(*QUARTER_SEGMENT, value.alias("target"))


def spend_gate(lines: DataFrame, targets: DataFrame, tolerance: float = fixed.HARD_TOLERANCE) -> DataFrame:
    totals = lines.groupBy(*QUARTER_SEGMENT).agg(F.sum("amount").alias("actual"))
    return compare_totals("invoice_spend", totals, targets, QUARTER_SEGMENT, "actual", "target", tolerance)


def revenue_gate(bills: DataFrame, targets: DataFrame, tolerance: float = fixed.HARD_TOLERANCE) -> DataFrame:
    totals = bills.groupBy(*QUARTER_SEGMENT).agg(F.sum("amount").alias("actual"))
    return compare_totals("billing_revenue", totals, targets, QUARTER_SEGMENT, "actual", "target", tolerance)


def by_file_quarter(frame: DataFrame, path: str = "_source_file") -> DataFrame:
    """Fiscal year and quarter from the landing file's name instead of the document date.

    A document dated after the quarter of its file belongs to the file's quarter for the tie-out.
    """
    label = R.file_quarter(path)
    return frame.withColumn("fiscal_year", F.substring(label, 1, 4).try_cast("int")) \
        .withColumn("fiscal_quarter", F.substring(label, 6, 1).try_cast("int"))


def timing_differences(lines: DataFrame, path: str = "_source_file") -> DataFrame:
    """Amounts whose document date falls outside the quarter of their file."""
    dated = lines.withColumn("_doc", R.quarter_label()).withColumn("_file", R.file_quarter(path))
    return dated.where(F.col("_doc") != F.col("_file")).groupBy(
        F.col("_file").alias("file_quarter"), F.col("_doc").alias("document_quarter")).agg(
        F.count("*").alias("lines"), R.exact_sum("amount").alias("amount"))


def journal_gate(lines: DataFrame, tolerance: str = fixed.JOURNAL_TOLERANCE) -> DataFrame:
    """Only journals out of balance are reported."""
    off = journal_nets(lines).where(F.abs("net") > F.lit(tolerance).cast("decimal(18,2)"))
    return off.select(F.lit("journal_balance").alias("gate"), F.col("je_header_id").cast("string").alias("key"),
                      F.col("net").cast("double").alias("actual"), F.lit(0.0).alias("target"),
                      F.lit(0.0).alias("drift"), F.lit("breach").alias("level"))


def funnel_gate(requests: DataFrame, orders: DataFrame, invoices: DataFrame,
                tolerance: float = fixed.LOOSE_TOLERANCE) -> DataFrame:
    """Orders against invoices / 0.80 and released requests against orders / 0.80; warnings only."""
    total = lambda df, value, name: df.groupBy(*QUARTER_SEGMENT).agg(F.sum(value).cast("decimal(28,6)").alias(name))
    released = requests.where(F.col("pr_status") == "released")
    joined = total(invoices, "amount", "inv") \
        .join(total(orders, "extended_amount", "po"), QUARTER_SEGMENT, "full") \
        .join(total(released, "estimated_extended_amount", "pr"), QUARTER_SEGMENT, "full") \
        .na.fill(0, ["inv", "po", "pr"])
    scale = lambda c, r: (F.col(c) / F.lit(str(r)).cast("decimal(4,2)")).cast("decimal(28,6)")
    key = key_text(QUARTER_SEGMENT)
    return _report(joined.withColumn("t", scale("inv", fixed.ORDER_TO_INVOICE)), "orders_vs_invoices", key,
                   "po", "t", tolerance, True).unionByName(
        _report(joined.withColumn("t", scale("po", fixed.REQUEST_TO_ORDER)), "requests_vs_orders", key,
                "pr", "t", tolerance, True))


def payables_control(entries: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per period: payables created, paid and open, with running balances. For information.

    `entries` needs je_category, period_name, accounted_dr, accounted_cr; `invoices` period_name,
    amount, payment_status. The running sums go over the calendar, one row per period.
    """
    posted = entries.groupBy("period_name").agg(
        F.sum(F.when(F.col("je_category") == "Purchase Invoices", F.col("accounted_cr"))).alias("created"),
        F.sum(F.when(F.col("je_category") == "Payments", F.col("accounted_dr"))).alias("paid"))
    unpaid = invoices.where(F.col("payment_status") != "PAID").groupBy("period_name") \
        .agg(F.sum("amount").alias("open_invoices"))
    both = posted.join(unpaid, "period_name", "full").na.fill(0, ["created", "paid", "open_invoices"])
    # One row per calendar month is left here, so an unpartitioned running sum stays small.
    upto = Window.orderBy("period_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    money = lambda c, name: c.cast("decimal(28,2)").alias(name)
    return both.select(
        "period_name", *[money(F.col(c), c) for c in ("created", "paid", "open_invoices")],
        money(F.sum(F.col("created") - F.col("paid")).over(upto), "implied_balance"),
        money(F.sum("open_invoices").over(upto), "open_balance"))


def taxonomy_gate(gate: str, rows: DataFrame, taxonomy: DataFrame,
                  parent: str = "true_category_primary", leaf: str = "true_category_secondary") -> DataFrame:
    """Every (parent, leaf) pair in use must exist; rows without a leaf are not checked."""
    seen = rows.where(F.col(leaf).isNotNull()).groupBy(parent, leaf).agg(F.count("*").alias("rows"))
    legal = taxonomy.select(F.col("primary_code").alias("_p"), F.col("secondary_code").alias("_l")).distinct()
    illegal = seen.join(legal, F.col(parent).eqNullSafe(F.col("_p")) & (F.col(leaf) == F.col("_l")), "left_anti")
    return illegal.select(F.lit(gate).alias("gate"), key_text([parent, leaf]).alias("key"),
                          F.col("rows").cast("double").alias("actual"), F.lit(0.0).alias("target"),
                          F.lit(0.0).alias("drift"), F.lit("breach").alias("level"))


def hierarchy_gate(taxonomy: DataFrame) -> DataFrame:
    """A leaf belongs to exactly one parent and is listed once."""
    repeated = taxonomy.groupBy("secondary_code").agg(F.count("*").alias("n")).where("n > 1")
    return repeated.select(F.lit("leaf_unique").alias("gate"), F.col("secondary_code").alias("key"),
                           F.col("n").cast("double").alias("actual"), F.lit(1.0).alias("target"),
                           F.lit(0.0).alias("drift"), F.lit("breach").alias("level"))


def label_gate(train: DataFrame, taxonomy: DataFrame, label: str = "label") -> DataFrame:
    """Training labels must be leaves of the taxonomy."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    unknown = counts.join(taxonomy.select(F.col("secondary_code").alias(label)).distinct(), label, "left_anti")
    return unknown.select(F.lit("labels_known").alias("gate"), F.col(label).alias("key"),
                          F.col("n").cast("double").alias("actual"), F.lit(0.0).alias("target"),
                          F.lit(0.0).alias("drift"), F.lit("breach").alias("level"))


def actuals_gate(actuals: DataFrame, anchors: DataFrame, tolerance: float = fixed.HARD_TOLERANCE) -> DataFrame:
    """Planning actuals against the anchors, one row per quarter, segment and account type."""
    keys = [*QUARTER_SEGMENT, "account_type"]
    kinds = {"REVENUE": "revenue", "COGS": "cogs", "SGA": "sga", "RD": "rd"}
    quarters = anchors.where((F.col("period_type") == "Q") & (F.col("segment_code") != "CONSOL"))
    pairs = F.array(*[F.struct(F.lit(kind).alias("account_type"),
                               (F.col(c).cast("decimal(18,6)") * 1000000).alias("target"))
                      for kind, c in kinds.items()])
    targets = quarters.select(*QUARTER_SEGMENT, F.explode(pairs).alias("_t")).select(*QUARTER_SEGMENT, "_t.*")
    return compare_totals("planning_actuals", actuals, targets, keys, "amount_usd", "target", tolerance)


def headcount_gate(employees: DataFrame, anchors: DataFrame, tolerance: float = fixed.HARD_TOLERANCE) -> DataFrame:
    """Active employees at each quarter end against the anchor headcount; warnings only."""
    segments = anchors.where((F.col("period_type") == "Q") & (F.col("segment_code") != "CONSOL"))
    ends = segments.select("fiscal_year", "fiscal_quarter").distinct().withColumn("snapshot_date", R.quarter_end())
    active = employees.where(F.col("employment_status") == "active")
    heads = snapshot(active, ends, step="quarter").groupBy(*QUARTER_SEGMENT).agg(
        F.count_distinct("employee_id").alias("actual"))
    return compare_totals("headcount", heads, segments.withColumn("target", F.col("headcount_total")),
                          QUARTER_SEGMENT, "actual", "target", tolerance, warn_only=True)


def split_gate(train: DataFrame, holdout: DataFrame, maverick: DataFrame, source_rows: int,
               small_class: int = 50, small_slice: int = 100) -> DataFrame:
    """Split sanity: parts add up to the source, no class is missing on either side, none is tiny."""
    parts = train.select("label", F.lit("train").alias("part")) \
        .unionByName(holdout.select("label", F.lit("holdout").alias("part"))) \
        .unionByName(maverick.select("label", F.lit("maverick").alias("part")))
    per_label = parts.groupBy("label").pivot("part", ["train", "holdout", "maverick"]).agg(F.count(F.lit(1))) \
        .na.fill(0)
    row = lambda gate, key, actual, target, level: [
        F.lit(gate).alias("gate"), key.alias("key"), actual.cast("double").alias("actual"),
        target.cast("double").alias("target"), F.lit(0.0).alias("drift"), level.alias("level")]
    labels = per_label.where((F.col("train") > 0) | (F.col("holdout") > 0))
    missing = labels.select(*row(
        "labels_in_both", F.col("label"), F.least("train", "holdout"), F.lit(1),
        F.when((F.col("train") > 0) & (F.col("holdout") > 0), "ok").otherwise("warn")))
    small = labels.select(*row("class_size", F.col("label"), F.col("train"), F.lit(small_class),
                               F.when(F.col("train") >= small_class, "ok").otherwise("warn")))
    sums = per_label.agg(F.sum(F.col("train") + F.col("holdout") + F.col("maverick")).alias("n"),
                         F.sum("maverick").alias("m"))
    complete = sums.select(*row("split_complete", F.lit("rows"), F.coalesce("n", F.lit(0)), F.lit(source_rows),
                                F.when((F.col("n") == source_rows) & (F.lit(source_rows) > 0), "ok").otherwise("breach")))
    slice_size = sums.select(*row("maverick_size", F.lit("rows"), F.coalesce("m", F.lit(0)), F.lit(small_slice),
                                  F.when(F.col("m") >= small_slice, "ok").otherwise("warn")))
    return missing.unionByName(small).unionByName(complete).unionByName(slice_size)


def forbidden_terms(table: str, df: DataFrame, terms: list[str]) -> DataFrame:
    """Count per text column of the rows that contain any of the terms, ignoring case."""
    import re

    pattern = "(?i)(" + "|".join(re.escape(t) for t in terms) + ")"
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    counted = df.agg(*[F.count_if(F.col(c).rlike(pattern)).alias(c) for c in text])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in text])
    return counted.select(F.explode(pairs).alias("_p")).select(
        F.lit("forbidden_terms").alias("gate"), F.concat(F.lit(f"{table}."), "_p.column").alias("key"),
        F.col("_p.n").cast("double").alias("actual"), F.lit(0.0).alias("target"), F.lit(0.0).alias("drift"),
        F.when(F.col("_p.n") > 0, "breach").otherwise("ok").alias("level"))


class GateFailure(AssertionError):
    pass


def enforce(*reports: DataFrame, shown: int = 20) -> dict[str, int]:
    """Run all gates, then raise if anything is in breach. Returns the number of rows per level."""
    rows = reduce(lambda a, b: a.unionByName(b), reports)
    levels = {r["level"]: r["count"] for r in rows.groupBy("level").count().collect()}
    if levels.get("breach"):
        worst = rows.where("level = 'breach'").orderBy(F.desc(F.abs("drift")), "gate", "key").limit(shown).collect()
        listed = "; ".join(f"{r['gate']} {r['key']}: {r['actual']:,.2f} vs {r['target']:,.2f}" for r in worst)
        raise GateFailure(f"{levels['breach']} breach(es): {listed}")
    return levels


def lakehouse_gates(lake: Lake, tolerance: float = fixed.HARD_TOLERANCE) -> list[DataFrame]:
    """The gates over stored tables: spend, revenue, journals, taxonomy, actuals, headcount, funnel."""
    anchors = lake["dim_period_anchors"]
    spend_lines = lake.pick("fact_invoices", *QUARTER_SEGMENT, "amount")
    revenue_lines = lake.pick("fact_revenue", *QUARTER_SEGMENT, "amount")
    taxonomy = lake["dim_spend_category"]
    pairs = ["true_category_primary", "true_category_secondary"]
    return [
        spend_gate(spend_lines, anchor_targets(anchors, "cogs", "sga", "rd"), tolerance),
        revenue_gate(revenue_lines, anchor_targets(anchors, "revenue"), tolerance),
        journal_gate(lake.pick("gl_journal_line", "je_header_id", "accounted_dr", "accounted_cr")),
        *[taxonomy_gate(f"taxonomy {t}", lake.pick(t, *pairs), taxonomy)
          for t in ("purchase_request", "purchase_order", "invoice_ap")],
        hierarchy_gate(taxonomy), actuals_gate(lake["fact_fpa_actuals"], anchors, tolerance),
        headcount_gate(lake["dim_employees"], anchors),
        funnel_gate(lake["fact_purchase_requests"], lake["fact_purchase_orders"], spend_lines)]
