"""Model quality from confusion counts: the data is reduced to class pairs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.keyed import most_common

SCHEMA = ("model_alias string, slice string, secondary_top1_accuracy double, primary_top1_accuracy double,"
          " secondary_macro_f1 double, primary_macro_f1 double, n_rows int, evaluated_at timestamp, model_name string")


def _safe(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)))


def class_report(pred: DataFrame, truth: str, guess: str, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class that is true or predicted anywhere."""
    pairs = pred.groupBy(*by, F.coalesce(truth, F.lit("")).alias("_t"), F.coalesce(guess, F.lit("")).alias("_g")) \
        .agg(F.count("*").alias("_n"))
    hit = F.when(F.col("_t") == F.col("_g"), F.col("_n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_t").alias("class"), F.col("_n").alias("support"), none.alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("_g").alias("class"), none.alias("support"), F.col("_n").alias("predicted"), none.alias("tp")))
    sums = pairs.select(*by, F.explode(sides).alias("_s")).select(*by, "_s.*").groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(*by, "class", _safe(tp, predicted).alias("precision"), _safe(tp, support).alias("recall"),
                       _safe(2 * tp, support + predicted).alias("f1"), "support", "tp")


def tier_metrics(pred: DataFrame, truth: str, guess: str, name: str, by: list[str]) -> DataFrame:
    report = class_report(pred, truth, guess, by)
    return report.groupBy(*by).agg(
        _safe(F.sum("tp"), F.sum("support")).alias(f"{name}_top1_accuracy"),
        # Averaged through decimals, so the result does not depend on row order.
        (F.sum(F.col("f1").cast("decimal(24,12)")).cast("double") / F.count("*")).alias(f"{name}_macro_f1"),
        F.sum("support").cast("int").alias("n_rows"))


def evaluate(pred: DataFrame, by: list[str] = ("model_alias", "slice")) -> DataFrame:
    """Accuracy and macro F1 on both tiers per model and slice.

    Needs label, label_primary and the two predicted columns, plus the `by` columns.
    """
    by = list(by)
    leaf = tier_metrics(pred, "label", "predicted_secondary_category", "secondary", by)
    parent = tier_metrics(pred, "label_primary", "predicted_primary_category", "primary", by).drop("n_rows")
    return leaf.join(parent, by).select(
        *by, "secondary_top1_accuracy", "primary_top1_accuracy", "secondary_macro_f1", "primary_macro_f1", "n_rows")


def stamped(metrics: DataFrame, model_name: str, at=None) -> DataFrame:
    """Metrics ready to append to the evaluation history."""
    stamp = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return metrics.withColumn("evaluated_at", stamp).withColumn("model_name", F.lit(model_name))


def floor_table(train: DataFrame, account: str = "gl_account", label: str = "label") -> DataFrame:
    """Most common leaf of each account in training: the lookup a model has to beat."""
    return most_common(train, [account], label, "floor_leaf")


def floor_predict(df: DataFrame, train: DataFrame, taxonomy: DataFrame, account: str = "gl_account",
                  label: str = "label") -> DataFrame:
    """Predict by account; an unseen account gets the most common leaf of all training rows."""
    fallback = most_common(train.withColumn("_all", F.lit(1)), ["_all"], label, "_f").select("_f").scalar()
    parents = taxonomy.select(F.col("secondary_code").alias("predicted_secondary_category"),
                              F.col("primary_code").alias("_parent")).distinct()
    return df.join(floor_table(train, account, label), account, "left") \
        .withColumn("predicted_secondary_category", F.coalesce("floor_leaf", fallback)).drop("floor_leaf") \
        .join(parents, "predicted_secondary_category", "left") \
        .withColumn("predicted_primary_category", F.coalesce("_parent", F.lit("UNKNOWN"))).drop("_parent")


def champion(metrics: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """Models ordered best first: leaf accuracy on the maverick slice, then on holdout, then name."""
    rows = metrics if candidates is None else metrics.where(F.col("model_alias").isin(candidates))
    return rows.groupBy("model_alias").pivot("slice", ["maverick_holdout", "holdout"]) \
        .agg(F.max("secondary_top1_accuracy")) \
        .orderBy(F.desc("maverick_holdout"), F.desc("holdout"), "model_alias")


def floor_margin(metrics: DataFrame, winner: str, floor: str = "gl_account_baseline",
                 slice_name: str = "maverick_holdout", wanted: float = 10.0) -> DataFrame:
    """Points by which the winner beats the lookup on the maverick slice."""
    scores = metrics.where((F.col("slice") == slice_name) & F.col("model_alias").isin(winner, floor)) \
        .groupBy("slice").pivot("model_alias", [winner, floor]).agg(F.max("secondary_top1_accuracy"))
    margin = (F.col(f"`{winner}`") - F.col(f"`{floor}`")) * 100
    return scores.select("slice", F.round(margin, 4).alias("margin_pp"),
                         F.when(margin >= wanted, "ok").otherwise("warn").alias("level"))
