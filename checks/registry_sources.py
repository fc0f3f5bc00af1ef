"""Driver queries for file sources, ingestion, sinks and fixed dimensions: given tables are landed as files and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query
from ledgerloom import gates
from ledgerloom.adapters.retail import Retail, exact_money, pick_from
from ledgerloom.functions import rules as R
from ledgerloom.session import scratch
from ledgerloom.sinks import tables as sinks
from ledgerloom.sources.files import CORRUPT, month_spine, read_raw, schema_of
from ledgerloom.sources.schemas import SOURCES
from ledgerloom.streaming.ingest import Bronze
from ledgerloom.tables import gold

SEGMENT_CODES = ["HAD", "HPA", "HSB", "HET", "CORP"]


def land(frame: DataFrame, root: str, name: str, quarter: str = "", mode: str = "errorifexists", **values: Column) -> None:
    """Write rows as the files of a source; columns without a value are empty."""
    source = SOURCES[name]
    fields = [f for f in schema_of(source).fields if f.name != CORRUPT]
    rows = frame.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    writer = rows.write.mode(mode).format(source.kind).option("ignoreNullFields", "false")
    writer.option("header", "true").save(f"{root}/{source.pattern.replace('_*', f'_{quarter}')}")


def invoices(orders: DataFrame, root: str, quarter: str, mode: str = "errorifexists", factor: int = 1) -> None:
    day = F.col("o_orderdate").cast("date")
    land(orders, root, "ar_invoices_all", quarter, mode, customer_trx_id=F.col("o_orderkey"), trx_number=F.concat(F.lit("AR-"), "o_orderkey"),
         cust_account_id_ext=F.concat(F.lit("C"), "o_custkey"), trx_date=day, gl_date=day, period_name=R.month_name(day),
         invoice_currency_code=F.lit("USD"), total_amount=exact_money("o_totalprice") * factor, status=F.col("o_orderstatus"))


def schedules(orders: DataFrame, root: str, quarter: str) -> None:
    land(orders, root, "billing_schedule", quarter, schedule_id=F.col("o_orderkey"), contract_id=F.concat(F.lit("K"), "o_custkey"),
         customer_id=F.concat(F.lit("C"), "o_custkey"), bill_date=F.col("o_orderdate").cast("date"), amount=exact_money("o_totalprice"),
         segment_code=pick_from(SEGMENT_CODES, F.col("o_custkey") % 5), currency=F.lit("USD"), status=F.col("o_orderstatus"))


def halves(retail: Retail) -> tuple[DataFrame, DataFrame]:
    orders = retail.read("orders")
    return orders.where("o_orderdate < '1998-01-01'"), orders.where("o_orderdate >= '1998-01-01'")


@query("csv_full_scan")
def _csv(retail: Retail) -> DataFrame:
    """Customers as a CSV master; codes keep their leading zeros."""
    root = scratch(retail.spark, "landing")
    land(retail.read("customer"), root, "ar_customer_sites_all", cust_acct_site_id=F.col("c_custkey"),
         cust_account_id_ext=F.lpad(F.col("c_custkey").cast("string"), 8, "0"), customer_name=F.concat("c_name", F.lit(', "Ltd"')),
         site_use_code=F.lit("BILL"), country=F.col("c_nationkey"))
    rows = read_raw(retail.spark, root, "ar_customer_sites_all")
    return rows.select("cust_acct_site_id", "cust_account_id_ext", "customer_name", "country", "city",
                       F.col("_source_file").contains("oracle_fusion/ar_customer_sites_all.csv").alias("has_source"),
                       F.col("_ingested_at").isNotNull().alias("has_time"))


@query("json_full_scan")
def _json(retail: Retail) -> DataFrame:
    """Orders as JSON contracts whose segment field has another name in the files."""
    root = scratch(retail.spark, "landing")
    orders, day = retail.read("orders"), F.col("o_orderdate").cast("date")
    source = SOURCES["contract"]
    orders.select(
        F.concat(F.lit("K"), "o_orderkey").alias("contract_id"), pick_from(SEGMENT_CODES, F.col("o_custkey") % 5).alias("owner"),
        day.alias("signed_date"), exact_money("o_totalprice").alias("total_contract_value"), F.col("o_orderstatus").alias("status")).write.json(
            f"{root}/{source.pattern}")
    rows = read_raw(retail.spark, root, "contract", {"entity_segment": "owner"})
    return rows.groupBy("entity_segment", R.quarter_end(F.year("signed_date"), F.quarter("signed_date")).alias("quarter_end"), "status").agg(
        F.count("*").alias("contracts"), F.sum("total_contract_value").alias("value"), F.count("customer_id").alias("customers"))


def ingested(retail: Retail, name: str, write) -> tuple[Bronze, str, list[int]]:
    """A source in two deliveries, each ingested when it is there; a third run must add nothing."""
    root, spark = scratch(retail.spark, "landing"), retail.spark
    bronze, added = Bronze(spark, scratch(spark, "bronze")), []
    for quarter, part in zip(("1997Q4", "2001Q3"), halves(retail)):
        write(part, root, quarter)
        added.append(bronze.ingest(root, name))
    return bronze, root, [*added, bronze.ingest(root, name)]


@query("csv_incremental")
def _csv_stream(retail: Retail) -> DataFrame:
    bronze, _, added = ingested(retail, "ar_invoices_all", invoices)
    rows = gates.by_file_quarter(bronze.read("ar_invoices_all"))
    return rows.groupBy("fiscal_year", "fiscal_quarter", "status").agg(
        F.count("*").alias("invoices"), F.sum("total_amount").alias("amount"), F.max("trx_date").alias("last_day")).withColumns(
            {f"added_{i}": F.lit(n).cast("long") for i, n in enumerate(added, 1)})


@query("json_incremental")
def _json_stream(retail: Retail) -> DataFrame:
    bronze, _, added = ingested(retail, "billing_schedule", schedules)
    return bronze.read("billing_schedule").groupBy("segment_code", R.month_name("bill_date").alias("month")).agg(
        F.count("*").alias("bills"), F.sum("amount").alias("amount")).withColumn("added_again", F.lit(added[2]).cast("long"))


@query("full_refresh")
def _refresh(retail: Retail) -> DataFrame:
    """The first delivery is corrected in place: unseen by a further run, taken by a full refresh."""
    bronze, root, _ = ingested(retail, "ar_invoices_all", invoices)
    invoices(halves(retail)[0], root, "1997Q4", "overwrite", factor=2)
    bronze.ingest(root, "ar_invoices_all", full_refresh=True)
    return gates.by_file_quarter(bronze.read("ar_invoices_all")).groupBy("fiscal_year").agg(
        F.count("*").alias("invoices"), F.sum("total_amount").alias("amount"))


@query("store_versions")
def _store(retail: Retail) -> DataFrame:
    """A typed empty table, replaced by one with another schema, then appended to with a new column."""
    store = sinks.Store(retail.spark, scratch(retail.spark, "store"))
    first, second = halves(retail)
    empty = store.create_empty("orders", "o_orderkey string").count()
    store.overwrite("orders", first.select("o_orderkey", "o_orderstatus"))
    store.append("orders", second.select("o_orderkey", "o_orderstatus", exact_money("o_totalprice").alias("price")))
    rows = store.create_empty("orders", "o_orderkey string")  # there is one: nothing happens
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.count("price").alias("priced"), F.sum("price").alias("price"),
                                             F.max("o_orderkey").alias("last_key")).withColumn("empty_rows", F.lit(empty).cast("long"))


@query("replaced_view")
def _view(retail: Retail) -> DataFrame:
    first, second = halves(retail)
    sinks.replace_view("ledgerloom_orders", first)
    sinks.replace_view("ledgerloom_orders", second)
    return retail.spark.sql("SELECT o_orderstatus, count(*) AS orders, min(o_orderkey) AS first_key FROM ledgerloom_orders GROUP BY 1")


@query("export_kinds")
def _export(retail: Retail) -> DataFrame:
    """Customers exported in each format and read back as text."""
    root, spark = scratch(retail.spark, "export"), retail.spark
    rows = retail.read("customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"),
                                          exact_money("c_acctbal").alias("balance"))
    out = []
    for kind in ("csv", "json", "parquet"):
        sinks.export(rows, f"{root}/{kind}", kind)
        back = spark.read.schema(rows.schema).option("header", "true").format(kind).load(f"{root}/{kind}")
        out.append(back.groupBy("segment").agg(F.count("*").alias("customers"), F.sum("balance").alias("balance"), F.max("c_name").alias("last_name"))
                   .withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, out)


@query("segment_names")
def _segments(retail: Retail) -> DataFrame:
    """Customers by the fixed segments; the consolidated one has none."""
    owners = retail.read("customer").select(pick_from(SEGMENT_CODES, F.col("c_custkey") % 5).alias("segment_code"), "c_custkey")
    return gold.dim_segment(retail.spark).join(owners, "segment_code", "left").groupBy(
        "segment_code", "segment_name", "company_code", "sort_order").agg(F.count("c_custkey").alias("customers"))


@query("category_names")
def _categories(retail: Retail) -> DataFrame:
    """Parts under the leaf whose place in text order their key names: what the taxonomy says of each."""
    spark: SparkSession = retail.spark
    taxonomy = gold.dim_spend_category(spark)
    leaves = sorted(r[0] for r in taxonomy.select("secondary_code").collect())  # the fixed taxonomy
    parts = retail.read("part").select("p_partkey", pick_from(leaves, F.col("p_partkey") % len(leaves)).alias("secondary_code"))
    return parts.join(taxonomy, "secondary_code", "left").groupBy("primary_code", "secondary_code", "gl_account", "gl_account_type", "is_direct").agg(
        F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


@query("order_calendar")
def _calendar(retail: Retail) -> DataFrame:
    """The generated calendar against order days; days outside it would show NULLs."""
    days = retail.read("orders").select(F.col("o_orderdate").cast("date").alias("date_key"))
    calendar = gold.dim_date(retail.spark, "1995-01-01", "2001-12-31")
    return days.join(calendar, "date_key", "left").groupBy("calendar_year", "month_short_name", "day_name", "is_weekend").agg(F.count("*").alias("orders"))


@query("month_spine")
def _spine(retail: Retail) -> DataFrame:
    """Every month, with or without orders of the rarest kind."""
    orders = retail.read("orders").where("o_orderkey % 97 = 0").select(F.trunc("o_orderdate", "month").alias("period_month"), "o_orderkey")
    return month_spine(retail.spark, "1994-11-15", "2002-02-01").join(orders, "period_month", "left").groupBy("period_month").agg(
        F.count("o_orderkey").alias("orders"))
