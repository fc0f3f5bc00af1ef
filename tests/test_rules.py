from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import gates
from ledgerloom.functions import rules as R
from ledgerloom.tables import gold


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], schema) if values else spark.range(1)
    return df.select(expression).first()[0]


@pytest.mark.parametrize("country, region", [("US", "NA"), ("DE", "EMEA"), ("TH", "APAC"), ("CO", "LATAM"),
                                             ("ZZ", "OTHER"), (None, "OTHER")])
def test_region(spark, country, region):
    assert one(spark, R.region_of("c"), c=(country, "string")) == region


@pytest.mark.parametrize("code, status", [("B", "released"), ("L", "cancelled"), ("N", "open"), ("X", "x"), (None, None)])
def test_request_status(spark, code, status):
    assert one(spark, R.request_status("c"), c=(code, "string")) == status


def test_company_and_segment(spark):
    assert one(spark, R.segment_of_company("c"), c=("1100", "string")) == "HAD"
    assert one(spark, R.segment_of_company("c"), c=("7777", "string")) == "OTHER"
    assert one(spark, R.known_segment("c"), c=(None, "string")) == "OTHER"


@pytest.mark.parametrize("part, whole, result", [(1.0, 4.0, 25.0), (1.0, 0.0, None), (1.0, None, None), (None, 2.0, None)])
def test_percent_never_fails(spark, part, whole, result):
    assert one(spark, R.percent("a", "b"), a=(part, "double"), b=(whole, "double")) == result


@pytest.mark.parametrize("actual, target, ok", [
    ("0.5", "0", True), ("2", "0", False), ("102.00", "100.00", True), ("102.10", "100.00", False),
    ("98.00", "100.00", True), ("97.99", "100.00", False), ("-102", "-100", True)])
def test_tolerance_edges(spark, actual, target, ok):
    got = one(spark, gates.within("a", "t", 0.02), a=(Decimal(actual), "decimal(18,2)"), t=(Decimal(target), "decimal(18,2)"))
    assert got is ok


def test_bad_text_becomes_null(spark):
    assert one(spark, R.money("c"), c=("12x", "string")) is None
    assert one(spark, R.money("c"), c=("12.345", "string")) == Decimal("12.35")


def test_quarter_bounds_and_labels(spark):
    assert str(one(spark, R.quarter_end(F.lit(2024), F.lit(1)))) == "2024-03-31"
    assert str(one(spark, R.quarter_start(F.lit(2024), F.lit(4)))) == "2024-10-01"
    assert one(spark, R.file_quarter(F.lit("/x/ap_invoices_all_2025Q3.csv"))) == "2025Q3"


def test_due_date(spark):
    assert str(one(spark, R.due_date(F.lit("2024-01-31").cast("date"), F.lit("Net45")))) == "2024-03-16"
    assert one(spark, R.due_date(F.lit("2024-01-31").cast("date"), F.lit("Net99"))) is None


def test_static_dimensions(spark):
    category = gold.dim_spend_category(spark)
    assert category.count() == 30 and category.select("primary_code").distinct().count() == 8
    assert gates.hierarchy_gate(category).count() == 0
    assert gold.dim_segment(spark).count() == 6
    days = gold.dim_date(spark)
    assert days.count() == 1826
    assert days.where("is_weekend <> (day_name in ('Saturday', 'Sunday'))").count() == 0


def test_hash_percent_ignores_partitioning(spark):
    df = spark.range(1000).select(R.hash_percent("id").alias("h"), "id")
    a = {r.id: r.h for r in df.collect()}
    b = {r.id: r.h for r in spark.range(1000).repartition(7).select(R.hash_percent("id").alias("h"), "id").collect()}
    assert a == b and set(a.values()) == set(range(100))
