"""Driver queries for gates, classification, sourcing marts and supplier resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import on_lake, query
from ledgerloom import gates
from ledgerloom.adapters.retail import Retail
from ledgerloom.classify import boost, encode
from ledgerloom.classify import evaluate as E
from ledgerloom.classify import features as X
from ledgerloom.classify import model as M
from ledgerloom.functions import rules as R
from ledgerloom.lake import settled
from ledgerloom.operators.keyed import coverage, missing_keys
from ledgerloom.operators.resolve import Entities, resolve_suppliers, update_entities, with_entities
from ledgerloom.plans import sourcing

GROUP = ["fiscal_year", "fiscal_quarter", "segment_code"]


def add(name, f):
    query(name)(f)


# -- gates -------------------------------------------------------------------------------

@query("reconcile_spend")
def _spend(retail: Retail) -> DataFrame:
    lake = retail.lake()
    targets = retail.anchors(lake).select(*GROUP, (F.col("target_mm").cast("decimal(18,6)") * 1000000).alias("target"))
    return gates.spend_gate(lake.pick("fact_invoices", *GROUP, "amount"), targets)


@query("reconcile_revenue")
def _revenue(retail: Retail) -> DataFrame:
    """Against a fixed target per group, so that groups of all three outcomes occur."""
    lake = retail.lake()
    bills = lake.pick("fact_revenue", *GROUP, "amount")
    targets = bills.groupBy(*GROUP).agg((F.floor(F.sum("amount") / 100000) * 100000).cast("decimal(18,2)").alias("target"))
    return gates.revenue_gate(bills, targets)


@query("funnel_cone")
def _funnel(retail: Retail) -> DataFrame:
    lake = retail.lake()
    return gates.funnel_gate(lake.pick("fact_purchase_requests", *GROUP, "pr_status", "estimated_extended_amount"),
                             lake.pick("fact_purchase_orders", *GROUP, "extended_amount"),
                             lake.pick("fact_invoices", *GROUP, "amount"))


@query("unbalanced_journals")
def _unbalanced(retail: Retail) -> DataFrame:
    """The journal gate over all lines, of which the credits of some journals are a unit too high."""
    lines = retail.lake().pick("gl_journal_line", "je_header_id", "accounted_dr", "accounted_cr")
    wrong = F.when((F.col("je_header_id") % 7 == 0) & (F.col("accounted_cr") > 0), 1).otherwise(0)
    return gates.journal_gate(lines.withColumn("accounted_cr", (F.col("accounted_cr") + wrong).cast("decimal(18,2)")))


@query("ap_control_account")
def _control(retail: Retail) -> DataFrame:
    lake = retail.lake()
    return gates.payables_control(
        lake.pick("fact_gl_entries", "period_name", "je_category", "accounted_dr", "accounted_cr"),
        lake.pick("invoice_ap", "period_name", "amount", "payment_status"))


@query("taxonomy_parity")
def _parity(retail: Retail) -> DataFrame:
    """Predicted pairs are the ones that can break the taxonomy."""
    lake = retail.lake()
    rows = lake.pick("fact_invoices", "predicted_primary_category", "true_category_secondary")
    return gates.taxonomy_gate("taxonomy", rows, lake["dim_spend_category"], "predicted_primary_category") \
        .select("gate", "key", "actual", "level")


@query("leaf_hierarchy")
def _hierarchy(retail: Retail) -> DataFrame:
    """Brands as leaves: most of them sit under several parents, which the gate must report."""
    taxonomy = retail.read("part").select(F.col("p_type").alias("primary_code"), F.col("p_brand").alias("secondary_code"))
    return gates.hierarchy_gate(taxonomy.distinct()).select("key", "actual", "level")


@query("labels_known")
def _labels(retail: Retail) -> DataFrame:
    lake = retail.lake()
    old = F.when(~F.col("label").endswith("1"), F.concat("label", F.lit("-old"))).otherwise(F.col("label"))
    train = lake.pick("fact_invoices", label="predicted_secondary_category").where(F.col("label").isNotNull())
    return gates.label_gate(train.withColumn("label", old), lake["dim_spend_category"]).select("key", "actual", "level")


@query("split_sanity")
def _split_gate(retail: Retail) -> DataFrame:
    rows = settled(X.features(retail.lake()).select("label", X.KEY, "is_maverick_supplier"), "features")
    count = retail.read("lineitem").count()
    return gates.split_gate(*X.split(rows), source_rows=count).select("gate", "key", "actual", "target", "level")


@query("forbidden_terms")
def _terms(retail: Retail) -> DataFrame:
    return gates.forbidden_terms("documents", retail.read("documents"), ["confidential", "license", "src1"])


@query("headcount_gate")
def _heads(retail: Retail) -> DataFrame:
    """Daily headcount against the headcount of the day before, as a tolerance test."""
    snap = retail.lake()["fact_emp_quarterly_cost"].select(*GROUP, F.col("headcount").alias("actual"))
    before = snap.select("fiscal_year", (F.col("fiscal_quarter") + 1).alias("fiscal_quarter"), "segment_code",
                         F.col("actual").alias("target"))
    return gates.compare_totals("headcount", snap, before, GROUP, "actual", "target", 0.10, warn_only=True, surplus=False)


@query("planning_gate")
def _planning(retail: Retail) -> DataFrame:
    lake = retail.lake().settle("fact_fpa_actuals")
    actuals = lake["fact_fpa_actuals"]
    target = lambda kind: F.round(F.sum(F.when(F.col("account_type") == kind, F.col("amount_usd"))).cast("double") / 1e6, 2)
    anchors = actuals.groupBy(*GROUP).agg(target("REVENUE").alias("revenue"), target("COGS").alias("cogs"),
                                          target("SGA").alias("sga"), target("RD").alias("rd")) \
        .withColumn("period_type", F.lit("Q"))
    return gates.actuals_gate(actuals, anchors, 0.01)


@query("prediction_coverage")
def _coverage(retail: Retail) -> DataFrame:
    lake = retail.lake()
    return coverage(lake.pick("invoice_ap", "invoice_line_id"), "invoice_line_id",
                    lake.pick("invoice_classification", "invoice_line_id"))


@query("prediction_summary")
def _summary(retail: Retail) -> DataFrame:
    return M.prediction_summary(retail.lake()["invoice_classification"], accuracy=100_000)


@query("missing_labels")
def _missing(retail: Retail) -> DataFrame:
    """Leaves nobody buys from supplier 1."""
    pairs = retail.lake().pick("fact_invoices", "supplier_id", "true_category_secondary")
    return missing_keys(pairs, pairs.where("supplier_id = '1'"), ["true_category_secondary"])


# -- classification ----------------------------------------------------------------------

@query("clf_features")
def _features(retail: Retail) -> DataFrame:
    rows = X.with_markers(X.features(retail.lake()))
    for c in X.NUMBERS[:3]:
        rows = rows.withColumn(c, F.round(c, 6))
    return rows.select(X.KEY, X.TEXT, *X.CATEGORIES, *X.NUMBERS, "label", "label_primary", "is_maverick_supplier")


@query("clf_split")
def _split(retail: Retail) -> DataFrame:
    rows = X.features(retail.lake())
    return rows.groupBy(X.part_of().alias("part"), "label_primary").agg(F.count("*").alias("n"))


@query("label_distribution")
def _distribution(retail: Retail) -> DataFrame:
    return X.label_distribution(X.features(retail.lake()))


@query("gl_floor_model")
def _floor(retail: Retail) -> DataFrame:
    train, _, _ = X.split(X.features(retail.lake()))
    return E.floor_table(train)


@query("clf_metrics")
def _metrics(retail: Retail) -> DataFrame:
    """The stand-in predictions and the account lookup on both evaluation slices."""
    lake = retail.lake()
    predictions = lake.pick("invoice_classification", X.KEY, "predicted_primary_category", "predicted_secondary_category")
    # Written once, like the split tables of the training workflow: six steps read it.
    rows = settled(X.features(lake).select(X.KEY, "gl_account", "label", "label_primary", "is_maverick_supplier"), "features")
    train, holdout, maverick = X.split(rows)
    slices = holdout.withColumn("slice", F.lit("holdout")).unionByName(maverick.withColumn("slice", F.lit("maverick_holdout")))
    model = slices.join(predictions, X.KEY, "left").withColumn("model_alias", F.lit("challenger"))
    floor = E.floor_predict(slices, train, lake["dim_spend_category"]).withColumn("model_alias", F.lit("gl_account_baseline"))
    columns = ["model_alias", "slice", "label", "label_primary", "predicted_secondary_category", "predicted_primary_category"]
    out = E.evaluate(model.select(*columns).unionByName(floor.select(*columns)))
    return out.select("model_alias", "slice", "n_rows", *[F.round(c, 6).alias(c) for c in (
        "secondary_top1_accuracy", "primary_top1_accuracy", "secondary_macro_f1", "primary_macro_f1")])


@query("class_report")
def _report(retail: Retail) -> DataFrame:
    rows = retail.lake().pick("fact_invoices", "true_category_primary", "predicted_primary_category") \
        .where(F.col("predicted_primary_category").isNotNull())
    report = E.class_report(rows, "true_category_primary", "predicted_primary_category")
    return report.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("category_levels")
def _levels(retail: Retail) -> DataFrame:
    """Category values with at least 50 rows, over all category columns at once."""
    return M.frequent_values(X.scoring_rows(retail.lake()), X.CATEGORIES, 50)


@query("class_weights")
def _weights(retail: Retail) -> DataFrame:
    return M.class_weights(X.features(retail.lake()), "label_primary").withColumn("weight", F.round("weight", 9))


@query("embedding_cache_diff")
def _cache(retail: Retail) -> DataFrame:
    texts = retail.read("documents")
    cache = texts.where("doc_id % 2 = 0").select(R.text_key("text").alias("text_hash"))
    return M.texts_to_embed(texts, cache, "text").select("text_hash", F.length("text").alias("chars"))


@query("tfidf_vocabulary")
def _vocabulary(retail: Retail) -> DataFrame:
    rows = retail.read("documents")
    words = encode.fit(rows, "doc_id", "text", [], [], terms_at_most=5000).terms
    return words.select("term", "index", "rows", F.round("idf", 9).alias("idf"))


@query("tfidf_rows")
def _weighted(retail: Retail) -> DataFrame:
    """The term weights of every document, summed up."""
    rows = retail.read("documents")
    found = encode.fit(rows, "doc_id", "text", [], [], terms_at_most=5000).encoded(rows, "doc_id")
    total = F.aggregate("vals", F.lit(0.0), lambda a, v: a + v)
    return found.select("doc_id", F.size("indices").cast("long").alias("n_terms"), F.round(total, 6).alias("weight"),
                        F.round(F.coalesce(F.array_max("vals"), F.lit(0.0)), 6).alias("largest"))


@query("category_index")
def _index(retail: Retail) -> DataFrame:
    return encode.level_index(X.scoring_rows(retail.lake()), X.KEY, X.CATEGORIES, 50)


@query("encoded_rows")
def _encoded(retail: Retail) -> DataFrame:
    """All nine category columns of every line as indexes."""
    lake = retail.lake().settle("dim_supplier")
    rows = settled(X.scoring_rows(lake).select(X.KEY, *X.CATEGORIES), "lines", rebalance=False)
    return encode.fit(rows, X.KEY, None, X.CATEGORIES, []).encoded(rows, X.KEY).select(X.KEY, "indices")


@query("boosted_first_trees")
def _first_trees(retail: Retail) -> DataFrame:
    """One split a class on all lines: quantity, discount, tax, and a flag that is stored only where set."""
    rows = retail.read("lineitem")
    percent = lambda c: F.round(F.col(c) * 100).cast("double")
    dense = F.array(F.col("l_quantity").cast("double"), percent("l_discount"), percent("l_tax"))
    closed = F.col("l_linestatus") == "F"
    sparse = rows.select(
        F.when(closed, F.array(*map(F.lit, range(4)))).otherwise(F.array(*map(F.lit, range(3)))).alias("indices"),
        F.when(closed, F.concat(dense, F.array(F.lit(1.0)))).otherwise(dense).alias("vals"),
        F.when(F.col("l_quantity") <= 10, 0).when(percent("l_discount") >= 6, 1).otherwise(2).alias("label"), F.lit(1.0).alias("weight"))
    forest = boost.fit(sparse, 3, boost.Settings(rounds=1, depth=1, rate=0.5, bins=100, l2=1.0))
    return forest.table(retail.spark).select("class", "node", "feature", "threshold", F.round("value", 9).alias("value"))


@query("boosted_interaction")
def _interaction(retail: Retail) -> DataFrame:
    """Labels that depend on two columns together: trees learn them all, a regression cannot."""
    rows = retail.read("lineitem").select(
        F.monotonically_increasing_id().alias(X.KEY), F.col("l_quantity").cast("double").alias("quantity"),
        F.round(F.col("l_discount") * 100).cast("double").alias("discount"))
    rows = settled(rows.withColumn("label", F.when((F.col("quantity") <= 15) == (F.col("discount") <= 3), "same").otherwise("cross")), "lines")
    taxonomy = rows.select(F.col("label").alias("secondary_code"), F.lit("all").alias("primary_code")).distinct()

    def right(linear: bool) -> DataFrame:
        settings = M.Settings(trees=boost.Settings(rounds=2, depth=2, rate=0.5, bins=64), linear=linear, max_iter=10)
        model = M.fit(rows, taxonomy, settings, [], ["quantity", "discount"], text=None)
        return M.score(rows, model, "1").join(rows, X.KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted_secondary_category") == F.col("label")).alias("k"))
    trees, linear = right(False), right(True).select(F.col("n").alias("n2"), F.col("k").alias("k2"))
    both = trees.crossJoin(linear)  # one row each
    return both.select(F.col("n").alias("lines"), F.col("k").alias("right"), (F.col("k") > F.col("k2") * 1.1).alias("beats_regression"))


@query("clf_train_predict")
def _train(retail: Retail) -> DataFrame:
    """Trees on text, all nine categories and all numbers of the training lines; the held-out lines are scored.

    All of the model's own settings: 300 rounds of a tree a class, 8 levels, 63 leaves, 20,000 terms.
    """
    lake = retail.lake().settle("dim_supplier")
    rows = settled(X.with_markers(X.features(lake)), "features", rebalance=False)  # the split reads it, and no other column
    train, holdout, maverick = X.split(rows)
    fitted = M.fit(train, lake["dim_spend_category"])
    return M.score(holdout.unionByName(maverick), fitted, "1", "2024-01-01 00:00:00")


@query("embedding_head")
def _head(retail: Retail) -> DataFrame:
    rows = retail.read("embeddings")
    head = M.fit_head(rows, "label", max_iter=10)
    return head.transform(M.with_vector(rows)).select("vec_id", "label", F.col("prediction").cast("int").alias("predicted"))


@query("supplier_resolution")
def _resolution(retail: Retail) -> DataFrame:
    """Part names with their brand as one block each: names one edit apart join one entity."""
    parts = retail.read("part").select(
        F.col("p_partkey").alias("supplier_id"), F.concat("p_name", F.lit(" "), "p_brand").alias("supplier_name"))
    return resolve_suppliers(parts).select("supplier_id", "canonical_supplier_id")


def entities_after_runs(retail: Retail) -> tuple[DataFrame, Entities]:
    """Part names as above, delivered in three runs, of which the last also renames some keys of the first.

    Each run sees its own rows and what is stored, no more.
    """
    parts = retail.read("part").select(
        F.col("p_partkey").cast("long").alias("supplier_id"), F.concat("p_name", F.lit(" "), "p_brand").alias("supplier_name"),
        (F.col("p_partkey") % 3 + 1).alias("run"))
    noun, brand = F.split("supplier_name", " ")[1], F.split("supplier_name", " ")[2]
    again = parts.where("supplier_id % 30 = 0").select("supplier_id", F.concat_ws(" ", F.lit("cold"), noun, brand).alias("supplier_name"), F.lit(3).alias("run"))
    rows, known = parts.unionByName(again), None
    for run in (1, 2, 3):
        found = update_entities(rows.where(F.col("run") == run), known, run)
        known = Entities(settled(found.spellings, "spellings"), settled(found.members, "members"), settled(found.merges, "merges"))
    return parts, known


@query("entity_merges")
def _entity_merges(retail: Retail) -> DataFrame:
    _, known = entities_after_runs(retail)
    return known.merges.select("run", F.col("entity.since").alias("since"), F.col("entity.id").cast("string").alias("entity_id"),
                               F.col("into.id").cast("string").alias("into_id"))


@query("dim_supplier_resolved")
def _dim_resolved(retail: Retail) -> DataFrame:
    """The supplier dimension with the parts as its named suppliers and their stored entities."""
    parts, known = entities_after_runs(retail)
    lake = retail.conforming_lake()
    raw = lake["LFA1_SUPPLIER_MASTER"]
    given = {"LIFNR": F.col("supplier_id"), "NAME1": F.col("supplier_name")}
    master = parts.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in raw.schema.fields])
    entities = with_entities(parts.select("supplier_id"), known)
    entities = entities.select(*[F.col(c).cast("string").alias(c) for c in entities.columns])
    lake = lake.extend({"LFA1_SUPPLIER_MASTER": master, "ap_supplier_sites_all": lake["ap_supplier_sites_all"].where("false"),
                        "supplier_entities": entities})
    return lake["dim_supplier"].select("supplier_id", "supplier_name", "canonical_supplier_id", "entity_resolution_cluster_id")


# -- marts and planned reports -----------------------------------------------------------

add("parent_rollup", on_lake(sourcing.parent_rollup))
add("hhi", on_lake(sourcing.leaf_concentration))
add("supplier_shares", on_lake(sourcing.supplier_shares))
add("concentration_over_time", on_lake(sourcing.concentration_over_time))
add("maverick_spend", on_lake(sourcing.maverick_spend, hint_tier=sourcing.PARENT))
add("maverick_suppliers", on_lake(sourcing.top_maverick_suppliers, hint_tier=sourcing.PARENT))
add("off_contract_by_leaf", on_lake(sourcing.off_contract_by_leaf))
add("tail_spend", on_lake(sourcing.tail_spend, threshold=0.19))
add("sourcing_strategy", on_lake(sourcing.sourcing_strategy, hint_tier=sourcing.PARENT))
add("contract_burn_down", on_lake(sourcing.contract_burn_down, as_of="1999-07-01"))
add("renewal_queue", on_lake(sourcing.renewal_queue, as_of="1998-01-03"))
add("contract_leakage", on_lake(sourcing.contract_leakage))
add("supplier_scorecard", on_lake(sourcing.supplier_scorecard))
add("supplier_category_mix", on_lake(sourcing.supplier_category_mix))
add("terms_targets", on_lake(sourcing.terms_targets))
add("suggest_suppliers", on_lake(sourcing.suggest_suppliers))
add("price_history", on_lake(sourcing.price_history))
add("label_coverage", on_lake(sourcing.label_coverage))
add("confidence_histogram", on_lake(sourcing.confidence_histogram))
add("disagreements", on_lake(sourcing.disagreements))
add("metric_set", on_lake(sourcing.metric_set))


@query("managed_flag")
def _managed(retail: Retail) -> DataFrame:
    return retail.lake().pick("invoice_classification", "invoice_line_id", "secondary_confidence").select(
        "invoice_line_id", R.is_managed("secondary_confidence").alias("managed"))


@query("savings_against_budget")
def _savings(retail: Retail) -> DataFrame:
    """Orders as sourcing events: baseline and avoidance are mark-ups that depend on the order."""
    lake = retail.lake()
    bills = lake.pick("fact_revenue", *GROUP, "schedule_id", "amount")
    key = F.col("schedule_id").cast("bigint")
    by_order = lambda *rates: F.element_at(F.array(*[F.lit(r).cast("decimal(3,2)") for r in rates]), (key % 3 + 1).cast("int"))
    reductions = bills.select(
        F.col("schedule_id").alias("event_id"), *GROUP, F.col("amount").alias("awarded_amount"),
        (F.col("amount") * by_order("1.10", "1.00", "1.02")).cast("decimal(18,2)").alias("baseline_amount"))
    avoidances = bills.select(
        F.col("schedule_id").alias("event_id"), *GROUP, (F.col("amount") * by_order("0.01", "0.05", "0.02")).cast("decimal(18,2)").alias("amount_usd"))
    return sourcing.savings_against_budget(sourcing.savings_ledger(reductions, avoidances), lake["fact_fpa_budgets"])


@query("model_trend")
def _trend(retail: Retail) -> DataFrame:
    """Yearly accuracy of the stand-in predictions as a model's run history."""
    lines = retail.lake().pick("fact_invoices", "fiscal_year", "segment_code", "true_category_secondary", "predicted_secondary_category")
    hit = F.count_if(F.col("true_category_secondary") == F.col("predicted_secondary_category"))
    runs = lines.groupBy(F.lit("challenger").alias("model_alias"), F.col("segment_code").alias("slice"),
                         F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("evaluated_at")).agg(
        (hit / F.count("*")).alias("secondary_top1_accuracy"))
    trend = sourcing.model_trend(runs)
    return trend.select("model_alias", "slice", "evaluated_at", F.round("secondary_top1_accuracy", 6).alias("secondary_top1_accuracy"),
                        F.round("change", 6).alias("change"))
