"""Landing files -> bronze -> silver -> gold, incrementally."""
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom import gates
from ledgerloom.plans import lakehouse
from ledgerloom.sinks.tables import Store
from ledgerloom.sources.files import quarantined, read_raw, schema_of
from ledgerloom.sources.schemas import SOURCES
from ledgerloom.streaming.ingest import Bronze

CSV = {
    "LFA1_SUPPLIER_MASTER": ["S1,One,DE,2020-01-01,DE,Travel,[],0.1,HAD,Net30,false"],
    "ARIBA_CONTRACT_WORKSPACE": ["C1,SOW,Title,S1,2024-01-01,2025-01-01,1000.00,10.00,Active,EMEA"],
    "ARIBA_SOURCING_EVENT": ["E1,RFQ,T,O,2024-01-01,2024-02-01,4,3,S1,900.00,Awarded"],
    "ARIBA_SUPPLIER_PERFORMANCE": ["S1,2024Q1,90.0,4.0,4.5,4.33,O"],
    "EBAN_PR_HEADER": ["P1,1100,u,2024-01-10,NB,B,2024-02-01"],
    "EBAN_PR_LINE": ["P1,10,M,G,text,2.000,EA,50.00,1,USD,S1,Logistics,Logistics_Freight"],
    "gl_periods": ["2024-01,2024,1,2024-01-01,2024-01-31,Closed"],
    "gl_code_combinations": ["500,1100,HAD-CC00,5000,000,0000,0000,0000,Materials,COGS,HAD,Y",
                             "200,1100,HAD-CC00,2000,000,0000,0000,0000,Payables,BS,HAD,Y"],
    "ap_supplier_sites_all": ["7,S1,S1-01,DE,a,b,c,Y,Y"],
    "ar_customer_sites_all": ["8,K1,Customer,BILL,US,a,b,c"],
    "po_headers_all": ["1,PO-1,STANDARD,S1,S1-01,USD,2024-01-12,2024-01-20,OPEN,P1"],
    "ap_invoices_all": ["1,INV-1,S1,100.00,USD,2024-02-01,2024-02-01,2024-02,Net30,2024-03-02,2024-02-20,PAID,Y,1"],
    "ar_invoices_all": ["1,AR-1,K1,2024-02-01,2024-02-01,2024-02,USD,250.00,PAID"],
    "gl_je_headers": ["1,2024-02,1,Payables,Purchase Invoices,Y,2024-02-01,USD"],
    "gl_trial_balance": ["500,100.00,0.00,2024-03,100.00"],
    "workers": ["W1,1,2023-01-01,9999-12-31,true,A,B,a@b,2023-01-01,,Active,HAD,HAD-CC00,US,NA,Ops,G1,100000.00,USD"],
}
JSON = {
    "contract": [{"contract_id": "K", "contract_number": "N", "customer_id": "K1", "seg": "HAD", "signed_date": "2024-01-01",
                  "start_date": "2024-01-01", "end_date": "2025-01-01", "total_contract_value": 500.0, "currency": "USD",
                  "status": "Active", "commercial_terms": "Net30", "governing_law": "X"}],
    "contract_party": [{"contract_id": "K", "party_role": "Customer", "party_id": "K1", "party_name": "C", "segment_code": None}],
    "contract_line_item": [{"contract_id": "K", "line_no": 1}],
    "contract_amendment": [{"contract_id": "K", "amendment_no": 1, "amendment_type": "VALUE", "effective_date": "2024-05-01", "value_delta": -20.5}],
    "performance_obligation": [{"obligation_id": "O", "contract_id": "K"}],
    "billing_schedule": [{"schedule_id": "B1", "contract_id": "K", "customer_id": "K1", "segment_code": "HAD",
                          "bill_date": "2024-02-10", "amount": 300.0, "currency": "USD", "status": "Paid"}],
}
PARQUET = {
    "po_lines_all": (1, 1, 10, "M", "text", 2.0, 50.0, "USD", "G", "EA", "P1", 10, "HAD", "Logistics", "Logistics_Freight"),
    "ap_invoice_lines_all": (1, 1, 1, "ITEM", "text", 2.0, 50.0, 100.0, 1, 500, "HAD", "Logistics", "Logistics_Freight"),
    "gl_je_lines": [(1, 1, 500, 100.0, 0.0, 100.0, 0.0, "d"), (1, 2, 200, 0.0, 100.0, 0.0, 100.0, "c")],
    "gl_balances": (500, 100.0, 0.0, "2024-03", 100.0),
}
ALIASES = {"contract": {"entity_segment": "seg"}}


def land(spark, root, name, content, quarter="2024Q1"):
    source = SOURCES[name]
    folder = os.path.join(root, source.folder)
    os.makedirs(folder, exist_ok=True)
    tail = f"_{quarter}" if source.incremental else ""
    if source.kind == "csv":
        header = ",".join(c.strip().split()[0] for c in source.columns.replace("decimal(18,2)", "d").replace("decimal(18,3)", "d").split(","))
        with open(f"{folder}/{name}{tail}.csv", "w") as f:
            f.write("\n".join([header, *content]) + "\n")
    elif source.kind == "json":
        with open(f"{folder}/{name}{tail}.jsonl", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in content)
    else:
        import pyarrow.parquet as pq
        content = content if isinstance(content, list) else [content]
        pq.write_table(spark.createDataFrame(content, schema_of(source)).toArrow(), f"{folder}/{name}{tail}.parquet")


@pytest.fixture
def landing(spark, tmp_path):
    root = str(tmp_path / "landing")
    for group in (CSV, JSON, PARQUET):
        for name, content in group.items():
            land(spark, root, name, content)
    assert set(CSV) | set(JSON) | set(PARQUET) == set(SOURCES)
    return root


def anchors(spark):
    return spark.createDataFrame([("Q", 2024, 1, "HAD", 0.0003, 0.0001, 0.0, 0.0, 1)],
                                 "period_type string, fiscal_year int, fiscal_quarter int, segment_code string, revenue double,"
                                 " cogs double, sga double, rd double, headcount_total int")


def test_build_end_to_end(spark, landing, tmp_path):
    root = str(tmp_path / "lake")
    lake = lakehouse.build(spark, landing, root, anchors(spark), aliases=ALIASES, check=False)
    assert lake["coa_account"].select("intercompany_code").first()[0] == "0000"
    assert lake["fact_invoices"].count() == lake["invoice_ap"].count() == 1
    row = lake["fact_invoices"].first()
    assert row.direct_indirect == "Direct" and row.is_on_time_payment and row.supplier_region == "EMEA"
    assert str(lake["contract_outbound"].first().effective_contract_value) == "479.50"
    assert lake["customer"].first().primary_segment_code == "HAD"
    assert lake["fact_emp_quarterly_cost"].first().headcount == 1
    assert str(lake["fact_emp_quarterly_cost"].first().quarterly_cost_usd) == "32500.00"
    reports = {r.gate: r.level for g in gates.lakehouse_gates(lake) for r in g.collect()}
    assert reports["invoice_spend"] == "ok" and reports["billing_revenue"] == "ok" and "journal_balance" not in reports

    # A second run adds nothing; predictions reach the fact on the next derive.
    again = lakehouse.ingest(spark, landing, root, aliases=ALIASES)
    assert {n: v for n, v in again.items() if v > 0} == {}
    predictions = spark.createDataFrame([(1, "Logistics", "Logistics_Freight", 0.9, 0.8, "1", None)], lakehouse.CLASSIFICATIONS)
    lakehouse.publish_predictions(spark, root, predictions)
    assert lakehouse.derive(spark, root, anchors(spark))["fact_invoices"].first().secondary_confidence == 0.8

    # A new spelling of a known supplier comes under its entity, although its id is smaller.
    master = CSV["LFA1_SUPPLIER_MASTER"]
    land(spark, landing, "LFA1_SUPPLIER_MASTER", ["A0" + master[0][2:].replace(",One,", ",ONE Inc.,"), *master])
    lake = lakehouse.build(spark, landing, root, anchors(spark), aliases=ALIASES, check=False)
    found = {r.supplier_id: (r.canonical_supplier_id, r.entity_resolution_cluster_id) for r in lake["dim_supplier"].collect()}
    assert found["A0"] == found["S1"] and found["S1"][0] == "S1" and found["S1"][1]
    assert {r.supplier_canonical_id for r in lake["supplier"].collect()} == {"S1"}


def test_incremental_refresh_and_quarantine(spark, tmp_path):
    root, name = str(tmp_path / "landing"), "ap_invoices_all"
    land(spark, root, name, CSV[name])
    bronze = Bronze(spark, str(tmp_path / "bronze"))
    assert bronze.ingest(root, name) == 1
    assert bronze.ingest(root, name) == 0
    land(spark, root, name, [CSV[name][0].replace("1,INV-1", "2,INV-2"), CSV[name][0].replace("1,INV-1", "notanumber,INV-3")], "2024Q2")
    assert bronze.ingest(root, name) == 2
    assert bronze.read(name).count() == 2
    bad = quarantined(bronze.read(name, with_unreadable=True))
    assert bad.count() == 1 and "INV-3" in bad.first()[0] and bad.first()._source_file.endswith("2024Q2.csv")

    # A corrected file is not read again until a full refresh.
    land(spark, root, name, [CSV[name][0].replace("INV-1", "INV-9")], "2024Q1")
    bronze.ingest(root, name, full_refresh=True)
    assert sorted(r[0] for r in bronze.read(name).select("invoice_num").collect()) == ["INV-2", "INV-9"]

    # Streamed rows equal one batch read.
    batch = read_raw(spark, root, name).where("_corrupt_record is null").cache()
    assert batch.select("invoice_num").subtract(bronze.read(name).select("invoice_num")).count() == 0


def test_store_versions_upsert_and_append(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create_empty("t", "k bigint, v string")
    assert store.read("t").count() == 0
    old = store.overwrite("t", spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string"))
    new = store.upsert("t", spark.createDataFrame([(2, "B"), (3, "C")], "k bigint, v string"), ["k"])
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, old.collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="duplicate keys"):
        store.upsert("t", spark.createDataFrame([(1, "x"), (1, "y")], "k bigint, v string"), ["k"])
    wide = store.append("t", spark.createDataFrame([(4, "d", 1.0)], "k bigint, v string, w double"))
    assert wide.count() == 4 and wide.where("w is null").count() == 3
    store.drop_old("t", keep=1)
    assert store.read("t").count() == 4 and store.read("t").where("w = 1").count() == 1


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create_bucketed("t", spark.createDataFrame([(i, "old") for i in range(200)], "k bigint, v string"), ["k"], buckets=16)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet") if "_bucket=" in str(p)}
    before = files()
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b
    source = spark.createDataFrame([(3, "new"), (500, "new"), (None, "none")], "k bigint, v string").mapInArrow(counted, "k bigint, v string")
    got = {r["k"]: r["v"] for r in store.upsert("t", source, ["k"]).collect()}
    calls_once = calls.value
    assert got == {**{i: "old" for i in range(200)}, 3: "new", 500: "new", None: "none"} and calls_once == 3
    after = files()
    folder = lambda path: path.rsplit("/", 1)[0]
    touched = {folder(p) for p in after.keys() - before.keys()}
    assert 1 <= len(touched) <= 3 and all(after[p] == t for p, t in before.items() if folder(p) not in touched)
    assert store.upsert("t", source, ["k"]).where("k is null").count() == 1  # repeating it changes nothing
    assert store.upsert("t", source.limit(0), ["k"]).count() == 202
    empty = store.create_bucketed("e", source.limit(0), ["k"])
    assert empty.collect() == [] and store.upsert("e", source, ["k"]).count() == 3
    with pytest.raises(ValueError, match="bucketed by"):
        store.upsert("t", source.limit(1), ["v"])
    with pytest.raises(ValueError, match="duplicate keys"):
        store.upsert("t", source.union(source), ["k"])


def test_streamed_events_equal_batch(spark, tmp_path):
    from ledgerloom.streaming.ingest import ingest_folder

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "days")
    halves = [events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")]
    for i, part in enumerate(halves):
        part.write.mode("append").parquet(folder)
        table = ingest_folder(spark, folder, "*.parquet", events.schema, str(tmp_path / "data"), str(tmp_path / "ck"))
        assert table.count() == sum(h.count() for h in halves[: i + 1])
    assert table.drop("_source_file", "_ingested_at").exceptAll(events).count() == 0
    assert table.where(F.col("_source_file").isNull()).count() == 0
