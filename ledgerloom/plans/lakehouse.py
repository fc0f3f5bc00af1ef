"""Build the whole lakehouse: ingest landing files, conform, derive facts, check.

A plain ordered list of steps. Every stored table is written once and read by its successors;
the large facts are partitioned by fiscal year and quarter so that reports prune to their periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import gates
from ledgerloom.lake import Lake
from ledgerloom.operators.resolve import Entities, update_entities, with_entities
from ledgerloom.sinks.tables import Store
from ledgerloom.sources.files import quarantined, read_raw, readable
from ledgerloom.sources.schemas import SOURCES
from ledgerloom.streaming.ingest import Bronze
from ledgerloom.tables import gold, silver

PERIOD = ["fiscal_year", "fiscal_quarter"]
PARTITIONED = {"invoice_ap", "fact_invoices", "fact_gl_entries", "fact_revenue"}

CLASSIFICATIONS = ("invoice_line_id bigint, predicted_primary_category string, predicted_secondary_category string,"
                   " primary_confidence double, secondary_confidence double, model_version string, scored_at timestamp")

# Order matters only in that a table comes after those it reads.
SILVER = list(silver.BUILDERS)
GOLD = ["dim_supplier", "dim_customer", "dim_account", "dim_cost_center", "dim_employees", "fact_invoices",
        "fact_purchase_orders", "fact_purchase_requests", "fact_revenue", "fact_gl_entries", "fact_trial_balance",
        "fact_fpa_actuals", "fact_fpa_budgets", "fact_fpa_forecasts", "fact_emp_quarterly_cost"]


def ingest(spark: SparkSession, landing: str, root: str, full_refresh: bool = False,
           aliases: dict[str, dict[str, str]] | None = None) -> dict[str, int]:
    """Bring bronze up to date: new files of the quarterly sources, all files of the stable ones.

    Returns rows added per incremental source and -1 for a full scan.
    """
    aliases, added = aliases or {}, {}
    bronze, store = Bronze(spark, f"{root}/bronze"), Store(spark, f"{root}/bronze")
    for name, source in SOURCES.items():
        if source.incremental:
            added[name] = bronze.ingest(landing, name, full_refresh, aliases.get(name))
        else:
            store.overwrite(name, read_raw(spark, landing, name, aliases.get(name)))
            added[name] = -1
    return added


def bronze_tables(spark: SparkSession, root: str, unreadable: bool = False) -> dict[str, DataFrame]:
    bronze, store = Bronze(spark, f"{root}/bronze"), Store(spark, f"{root}/bronze")
    pick = quarantined if unreadable else readable
    return {name: pick(bronze.read(name, True) if source.incremental else store.read(name))
            for name, source in SOURCES.items()}


def bronze_gates(spark: SparkSession, root: str, allowed: int = 0, fields: bool = True) -> list[DataFrame]:
    """Unreadable rows, amounts that do not fit the money type, and with `fields` those that no JSON or Parquet file has."""
    bronze, store = Bronze(spark, f"{root}/bronze"), Store(spark, f"{root}/bronze")
    out = []
    for name, source in SOURCES.items():
        rows = bronze.read(name, True) if source.incremental else store.read(name)
        types = dict(rows.dtypes)
        out.append(gates.unreadable_gate(name, rows, allowed))
        amounts = {c: "decimal(18,2)" for c, kind in types.items() if kind.startswith(("decimal", "double")) and not c.startswith("_")}
        if amounts:
            out.append(gates.cast_loss_gate(name, rows, amounts, allowed))
        if fields and source.kind != "csv":
            out.append(gates.absent_gate(name, rows, [c for c in types if not c.startswith("_")]))
    return out


def supplier_entities(spark: SparkSession, root: str, master: DataFrame) -> DataFrame:
    """Bring the stored entities up to date with the supplier master; (supplier_id, canonical_supplier_id, ...) of it.

    The spellings are written last: a run that was broken off has the same number when it is repeated, and so gives
    the same names and the same log.
    """
    store = Store(spark, f"{root}/entities")
    known, run = None, 1
    if store.current("spellings"):
        known = Entities(*[store.read(name) for name in ("spellings", "members", "merges")])
        run = (known.spellings.agg(F.max("entity.since")).first()[0] or 0) + 1
    names = master.select(F.col("LIFNR").alias("supplier_id"), F.col("NAME1").alias("supplier_name"))
    found = update_entities(names, known, run)
    written = {name: store.overwrite(name, getattr(found, name)) for name in ("merges", "members", "spellings")}
    return with_entities(names.select("supplier_id").distinct(), Entities(**written))


def derive(spark: SparkSession, root: str, anchors: DataFrame, macro: DataFrame | None = None) -> Lake:
    """Silver and gold from bronze, each table written and then read back by the next ones."""
    silver_store, gold_store, ml_store = (Store(spark, f"{root}/{part}") for part in ("silver", "gold", "ml"))
    lake = Lake({**bronze_tables(spark, root),
                 "invoice_classifications": predictions_table(ml_store),
                 "dim_period_anchors": anchors, "dim_segment": gold.dim_segment(spark),
                 "dim_spend_category": gold.dim_spend_category(spark), "dim_date": gold.dim_date(spark)})
    if macro is not None:
        lake = lake.extend({"dim_macro_environment": macro})
    lake = lake.extend({"supplier_entities": supplier_entities(spark, root, lake["LFA1_SUPPLIER_MASTER"])})
    builders = gold.derived()
    for store, names in ((silver_store, SILVER), (gold_store, GOLD)):
        for name in names:
            frame = builders[name](lake, None)
            by = PERIOD if name in PARTITIONED else ()
            if by:
                # One shuffle gathers each period's rows into files of even size; AQE splits large periods.
                frame = frame.hint("rebalance", *PERIOD)
            lake = lake.extend({name: store.overwrite(name, frame, by)})
    return lake


def build(spark: SparkSession, landing: str, root: str, anchors: DataFrame, full_refresh: bool = False,
          aliases: dict[str, dict[str, str]] | None = None, macro: DataFrame | None = None,
          check: bool = True, unreadable: int = 0) -> Lake:
    """Ingest, derive and check. Raises if a hard gate is in breach.

    Up to `unreadable` rows of each source may be set aside; whatever `check` says, more than that, or amounts that do
    not fit, stop the build before anything is derived from what is left. `check` also asks for all fields.
    """
    ingest(spark, landing, root, full_refresh, aliases)
    gates.enforce(*bronze_gates(spark, root, unreadable, fields=check))
    lake = derive(spark, root, anchors, macro)
    if check:
        gates.enforce(*gates.lakehouse_gates(lake))
    return lake


def predictions_table(store: Store) -> DataFrame:
    """The published predictions; an empty table in buckets of its key if there is none yet."""
    if store.current("invoice_classifications") is None:
        empty = store.spark.createDataFrame([], CLASSIFICATIONS)
        return store.create_bucketed("invoice_classifications", empty, ["invoice_line_id"])
    return store.read("invoice_classifications")


def publish_predictions(spark: SparkSession, root: str, predictions: DataFrame) -> DataFrame:
    """Upsert scored lines; the next derive shows them on the fact."""
    return Store(spark, f"{root}/ml").upsert("invoice_classifications", predictions, ["invoice_line_id"])
