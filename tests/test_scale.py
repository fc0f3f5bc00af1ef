"""Steps whose rows must not be exploded, gathered or stored more often than needed."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.adapters.retail import Retail
from ledgerloom.classify import boost, encode
from ledgerloom.operators import posting
from ledgerloom.sinks.tables import Store

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_encoded_in_place_and_only_shared_keys_are_gathered(spark):
    texts = ["red car red", "blue car", None, "red car", "blue sea"]
    df = spark.createDataFrame([(i, t, "ab"[i % 2], float(i)) for i, t in enumerate(texts)], "k int, t string, c string, n double")
    model = encode.fit(df, "k", "t", ["c"], ["n"], least_rows=1, least_category_rows=1)
    alone = model.encoded(df, "k")
    assert "collect_list" not in plan(alone)
    doubled = model.encoded(df.unionByName(df.withColumn("k", F.lit(9))), "k")
    assert "collect_list" in plan(doubled)
    got = {r.k: r for r in doubled.collect()}
    for r in alone.collect():
        assert r.indices == got[r.k].indices and r.vals == pytest.approx(got[r.k].vals)
    assert len(got) == 6 and got[9].indices.count(model.width - 1) == 5


def test_bins_are_found_without_exploding_rows(spark):
    rows = spark.createDataFrame([([0, 1], [float(i), 1.0], i % 2, 1.0) for i in range(10)], "indices array<int>, vals array<double>, label int, weight double")
    cuts = boost.thresholds(rows, 4)
    assert {r["index"]: len(r.cuts) > 1 for r in cuts.collect()} == {0: True, 1: False}
    binned = boost._binned(rows, cuts)
    assert "Generate" not in plan(binned)
    own = {r["index"]: r.cuts for r in cuts.collect()}
    for r in binned.collect():
        assert r.bins == [sum(c < v for c in own[i]) for i, v in zip(r.indices, r.vals)]


def test_headers_and_short_documents_need_no_slices(spark, monkeypatch):
    calls = []
    along = posting.along
    monkeypatch.setattr(posting, "along", lambda *a, **k: calls.append(1) or along(*a, **k))
    lake = Retail(spark, SMALL).lake()
    assert lake["gl_journal_header"].count() > 0
    assert lake.pick("gl_journal_line", "je_line_num").count() > 0 and not calls
    lines = spark.createDataFrame([(d, n, f"{d}-{n}") for d, size in ((1, 9), (2, 2), (None, 5)) for n in range(size)],
                                  "invoice_id int, line_number int, invoice_line_id string")
    documents = lines.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("lines"))
    got = posting._numbered(lines, documents, ["line_number", "invoice_line_id"], 4).collect()
    assert calls and len(got) == 16 and all(r._no == r.line_number + 1 for r in got)


def test_upsert_gathers_its_buckets_once(spark, tmp_path, monkeypatch):
    store, seen, write = Store(spark, str(tmp_path)), [], Store._write_buckets
    store.create_bucketed("t", spark.range(50).withColumn("v", F.lit("a")), ["id"], 4)
    monkeypatch.setattr(Store, "_write_buckets", lambda self, rows, path, gathered=False: seen.append(gathered) or write(self, rows, path, gathered))
    out = store.upsert("t", spark.range(40, 60).withColumn("v", F.lit("b")), ["id"])
    assert seen == [False, True]
    assert {(r.id, r.v) for r in out.collect()} == {(i, "a" if i < 40 else "b") for i in range(60)}


def test_upserted_lines_are_derived_once(spark):
    from checks.registry import QUERIES

    assert not any("lineitem" in f for f in QUERIES["upsert_predictions"](Retail(spark, SMALL)).inputFiles())
