"""Features and splits for the spend classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fixed
from ledgerloom.functions import rules as R
from ledgerloom.lake import Lake

KEY, TEXT = "invoice_line_id", "line_description"
CATEGORIES = ["supplier_id", "segment_code", "payment_terms", "currency", "supplier_region", "gl_account",
              "direct_indirect", "addressability", "category_primary_hint"]
NUMBERS = ["log_amount", "log_quantity", "log_unit_price", "supplier_maverick_propensity"]


def _inputs(lake: Lake, *extra: str) -> DataFrame:
    lines = lake.pick("fact_invoices", KEY, TEXT, *CATEGORIES[:-1], "amount", "quantity", "unit_price",
                      "supplier_maverick_propensity", "supplier_category_primary", *extra)
    propensity = F.coalesce(F.col("supplier_maverick_propensity").cast("double"), F.lit(0.0))
    return lines.withColumnRenamed("supplier_category_primary", "category_primary_hint").select(
        KEY, TEXT, *CATEGORIES, *extra,
        R.log_amount("amount").alias("log_amount"), R.log_amount("quantity").alias("log_quantity"),
        R.log_amount("unit_price").alias("log_unit_price"), propensity.alias("supplier_maverick_propensity"))


def features(lake: Lake, maverick_threshold: float = fixed.MAVERICK_THRESHOLD) -> DataFrame:
    """Labelled rows: text, categories, numbers, both labels, and the maverick flag."""
    rows = _inputs(lake, "invoice_number", "line_number", "true_category_secondary", "true_category_primary")
    return rows.where(F.col("true_category_secondary").isNotNull()) \
        .withColumnsRenamed({"true_category_secondary": "label", "true_category_primary": "label_primary"}) \
        .withColumn("is_maverick_supplier", F.col("supplier_maverick_propensity") > maverick_threshold)


def scoring_rows(lake: Lake) -> DataFrame:
    """All lines as the model sees them: missing text and categories replaced by markers."""
    return with_markers(_inputs(lake))


def with_markers(df: DataFrame) -> DataFrame:
    for c in CATEGORIES:
        df = df.withColumn(c, R.or_missing(c))
    for c in NUMBERS:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return df.withColumn(TEXT, F.coalesce(TEXT, F.lit("")))


def split(df: DataFrame, key: str = KEY, train_percent: int = 80,
          maverick: str = "is_maverick_supplier") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, holdout and maverick rows.

    The hash of the row key decides, so the split is the same under any partitioning, needs no
    list of labels, and is stratified in expectation.
    """
    regular = df.where(~F.col(maverick))
    low = R.hash_percent(key) < train_percent
    return regular.where(low), regular.where(~low), df.where(F.col(maverick))


def part_of(key: str = KEY, train_percent: int = 80, maverick: str = "is_maverick_supplier"):
    return F.when(F.col(maverick), "maverick").when(R.hash_percent(key) < train_percent, "train").otherwise("holdout")


def label_distribution(df: DataFrame, label: str = "label", n: int = 5) -> DataFrame:
    """The n most and n least frequent labels."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), label).limit(n).withColumn("end", F.lit("top"))
    bottom = counts.orderBy("n", label).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)
