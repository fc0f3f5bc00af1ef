"""Every query the driver runs, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import oracle_analyst, prelude
from ledgerloom.adapters.retail import Retail, SEGMENT_NUMBER
from ledgerloom.functions import rules as R
from ledgerloom.plans import accounting, legal, parties, planning, reference, revenue, spend
from ledgerloom.tables import gold

QUERIES: dict[str, Callable[[Retail], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types both engines print alike: decimals as double, arrays as text, month stamps as dates."""
    def one(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.concat_ws(",", c).alias(field.name)
        return c
    return df.select(*[one(f) for f in df.schema.fields])


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f
    return add


def on_lake(f, **options):
    return lambda retail: f(retail.lake(), **options)


def on_plan(f):
    """For queries that read the actuals several times: the aggregate is written once."""
    return lambda retail: f(retail.lake().settle("fact_fpa_actuals"))


def calendar_lake(retail: Retail):
    days = retail.read("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    segments = retail.read("customer").select(F.col("c_mktsegment").alias("segment_code")).distinct().select(
        "segment_code", F.col("segment_code").alias("segment_name"), R.null("string", "company_code"),
        R.coded("segment_code", SEGMENT_NUMBER, "9").cast("int").alias("sort_order"))
    return retail.lake().extend({"dim_date": gold.calendar(days), "dim_segment": segments})


QUERIES.update({
    "spend_by_segment_quarter": on_lake(spend.q_sp1), "spend_by_parent": on_lake(spend.q_sp2a),
    "spend_by_leaf": on_lake(spend.q_sp2b), "taxonomy_listing": on_lake(spend.q_sp2c),
    "direct_indirect": on_lake(spend.q_sp3), "addressability": on_lake(spend.q_sp4),
    "funnel": on_lake(spend.q_sp5), "top_suppliers": on_lake(spend.q_sp6),
    "match_rate": on_lake(spend.q_sp7), "payment_ops": on_lake(spend.q_sp8),
    "payment_terms_mix": on_lake(spend.q_sp9), "sourcing_throughput": None,
    "bridge_conversion": on_lake(spend.q_sp11), "prediction_accuracy": on_lake(spend.q_sp12),
    "confusion": on_lake(spend.q_sp13), "stage_counts": on_lake(spend.stage_counts),
    "revenue_by_segment_quarter": on_lake(revenue.q_rv1), "top_customers": on_lake(revenue.q_rv2),
    "billing_status": on_lake(revenue.q_rv3), "contract_values": on_lake(revenue.q_rv4, accuracy=100_000),
    "currency_mix": on_lake(revenue.q_rv5), "ar_flow": on_lake(revenue.q_rv6),
    "journal_volume": on_lake(accounting.q_ac1), "journal_balance": on_lake(accounting.q_ac2),
    "latest_trial_balance": on_lake(accounting.q_ac3), "coa_coverage": on_lake(accounting.q_ac4),
    "account_type_totals": on_lake(accounting.q_ac5), "top_accounts": on_lake(accounting.q_ac6),
    "outbound_contracts": on_lake(legal.q_lg1), "inbound_utilisation": on_lake(legal.q_lg2),
    "amendments_by_year": on_lake(legal.q_lg3), "outbound_terms": on_lake(legal.q_lg5),
    "off_contract": on_lake(legal.q_lg6), "supplier_regions": on_lake(parties.q_pa1),
    "propensity_histogram": on_lake(parties.q_pa2), "top_suppliers_active": on_lake(parties.q_pa3),
    "customer_regions": on_lake(parties.q_pa4), "top_customers_active": on_lake(parties.q_pa5),
    "scorecard_by_quarter": on_lake(parties.q_pa6), "fpa_actuals": on_lake(planning.q_fp1),
    "fpa_budgets": on_lake(gold.fact_fpa_budgets), "fpa_forecasts": on_plan(gold.fact_fpa_forecasts),
    "fpa_variance": on_plan(planning.q_fp2), "yoy_revenue": on_lake(planning.q_fp3),
    "op_margin": on_lake(planning.q_fp4), "headcount_cost": on_lake(planning.q_hr1),
    "headcount_trend": on_lake(planning.q_hr2), "headcount_change": on_lake(planning.q_hr3),
    "calendar_sanity": lambda r: reference.q_rf1(calendar_lake(r)),
    "calendar_quarters": lambda r: reference.q_rf2(calendar_lake(r)),
    "segment_listing": lambda r: reference.q_rf3(calendar_lake(r)),
    "macro_recent": on_lake(reference.q_rf4, as_of="2000-07-01"), "macro_quarterly": on_lake(reference.q_rf5),
})
QUERIES["sourcing_throughput"] = on_lake(spend.q_sp10)


@query("expiring_contracts")
def _expiring(retail: Retail) -> DataFrame:
    out = legal.q_lg4(retail.lake(), as_of="1999-07-01")
    return out.withColumn("expiration_month", F.to_date("expiration_month"))


# The other registries add their queries on import.
from checks import oracle_sources, oracle_sourcing, oracle_tables, registry_sources, registry_sourcing, registry_tables  # noqa: E402,F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        return lambda spark, folder: plain(f(Retail(spark, folder)))
    return {name: bind(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    every = {**oracle_analyst.SQL, **oracle_tables.SQL, **oracle_sourcing.SQL, **oracle_sources.SQL}
    return {name: prelude.with_ctes(sql) for name, sql in every.items()}
