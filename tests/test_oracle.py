"""Driver queries against DuckDB on the smallest data. ORACLE_ALL=1 runs every query."""
import os

import pytest

from checks import compare, registry

FOLDER = "/root/testdata/sf0.001"
CORE = ["spend_by_segment_quarter", "spend_by_parent", "funnel", "bridge_conversion", "payment_ops", "top_customers",
        "contract_values", "journal_balance", "trial_balance", "fpa_forecasts", "op_margin", "headcount_change",
        "off_contract", "scd2_history", "scd2_snapshot", "residual_last_line", "rescale_to_target", "clf_metrics",
        "sourcing_strategy", "supplier_resolution", "stream_ingest_events", "ap_invoice_lines", "silver_supplier"]
ORACLE = registry.oracle_sql()
NAMES = list(ORACLE) if os.environ.get("ORACLE_ALL") else CORE


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    assert compare.compare(registry.queries()[name](spark, FOLDER), duck, ORACLE[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(registry.queries())


@pytest.mark.parametrize("name", ["spend_by_segment_quarter", "suggest_suppliers", "residual_last_line", "scd2_history", "customer_master"])
def test_result_does_not_depend_on_partitions(spark, name):
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = registry.queries()[name](spark, FOLDER)
        seen.append(compare.rows_of(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_fact_keeps_the_row_count(spark):
    from ledgerloom.adapters.retail import Retail

    retail = Retail(spark, FOLDER)
    assert retail.lake()["fact_invoices"].count() == retail.read("lineitem").count()
