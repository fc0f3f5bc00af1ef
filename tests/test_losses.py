"""Rows and values that would be lost silently are counted or refused."""
import json
import sys
from types import SimpleNamespace

import pytest

from ledgerloom import gates
from ledgerloom.operators.resolve import resolve_suppliers
from ledgerloom.sources import files
from ledgerloom.sources.schemas import Source
from ledgerloom.streaming.ingest import run_available

session = sys.modules["ledgerloom.session"]
SHORT = Source("people", "x", "csv", False, "id int, name string, amount double")


def read(spark, path, kind="csv"):
    source = Source("people", "x", kind, False, SHORT.columns)
    return spark.read.format(kind).options(**files.options_of(source)).schema(files.schema_of(source)).load(str(path))


def levels(frame):
    return {r["key"]: (r["actual"], r["level"]) for r in frame.collect()}


def test_unreadable_rows_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,amount\n1,a,2.5\nx,b,3\n3,c,4\n")
    read(spark, tmp_path / "a.csv").write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    assert levels(gates.unreadable_gate("people", stored)) == {"people": (1.0, "breach")}
    assert levels(gates.unreadable_gate("people", stored, allowed=1)) == {"people": (1.0, "ok")}
    assert levels(gates.unreadable_gate("people", files.readable(stored))) == {"people": (0.0, "ok")}
    with pytest.raises(gates.GateFailure):
        gates.enforce(gates.unreadable_gate("people", stored))


def test_reordered_header_is_refused(spark, tmp_path):
    (tmp_path / "b.csv").write_text("name,id,amount\na,1,2.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        read(spark, tmp_path / "b.csv").collect()


def test_values_that_a_cast_loses_are_counted(spark):
    rows = spark.createDataFrame([(1e20, 1.0), (2.0, None), (None, 3.0)], "a double, b double")
    assert levels(gates.cast_loss_gate("t", rows, {"a": "decimal(18,2)", "b": "decimal(18,2)"})) == {"t.a": (1.0, "breach"), "t.b": (0.0, "ok")}


def test_field_that_no_file_has_is_reported(spark, tmp_path):
    (tmp_path / "c.json").write_text("\n".join(json.dumps({"id": i, "amount": 1.0}) for i in range(3)))
    rows = read(spark, tmp_path / "c.json", "json")
    assert levels(gates.absent_gate("people", rows, ["id", "name", "amount"])) == {
        "people.id": (0.0, "ok"), "people.name": (1.0, "breach"), "people.amount": (0.0, "ok")}
    assert {v for _, v in levels(gates.absent_gate("people", rows.limit(0), ["name"])).values()} == {"ok"}


def test_names_of_any_script_are_resolved(spark):
    names = ["华为技术有限公司", "华为技术有限公司", "Газпром Нефть", "газпром нефть", "ibm", "ibn", "!!!", "!!!", "???", None, None]
    rows = resolve_suppliers(spark.createDataFrame(list(enumerate(names)), "supplier_id int, supplier_name string")).collect()
    found = {r["supplier_id"]: r["canonical_supplier_id"] for r in rows}
    assert found == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10}
    short = resolve_suppliers(spark.createDataFrame([(1, "ibm"), (2, "ibn")], "supplier_id int, supplier_name string"), shortest=3)
    assert {r["canonical_supplier_id"] for r in short.collect()} == {1}


def test_rows_of_a_load_are_counted_from_the_table(spark, tmp_path):
    spark.range(40).repartition(8).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    where = (str(tmp_path / "data"), str(tmp_path / "checkpoint"))
    assert run_available(stream(), *where) == 40
    assert run_available(stream(), *where) == 0
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    assert run_available(stream(), *where) == 3


class Context:
    """What the shared folder is looked up in."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


@pytest.mark.parametrize("master", ["local[2]", "spark://host:1", "local-cluster[2,1,1024]"])
@pytest.mark.parametrize("context, named, wanted", [("/c", "/n", "/c"), (None, "/n", "/n"), ("/c", None, "/c"), (None, None, None)])
def test_shared_folder(master, context, named, wanted):
    """The context's folder, else the named one; made up in local mode only."""
    fake = SimpleNamespace(sparkContext=Context(master, context), conf={"spark.checkpoint.dir": named} if named else {})
    if wanted:
        assert session.shared_dir(fake) == wanted
    elif master == "local[2]":
        assert session.shared_dir(fake) == session.shared_dir(fake) == fake.sparkContext.folder
    else:
        with pytest.raises(ValueError):
            session.shared_dir(fake)


def test_scratch_is_removed_at_the_end_of_its_scope(spark):
    import os
    from ledgerloom.lake import settled
    before = set(os.listdir(session.shared_dir(spark).removeprefix("file:").removeprefix("//")))
    with session.scratch_scope(spark):
        assert settled(spark.range(5), "five").count() == 5
        assert set(os.listdir(session.shared_dir(spark).removeprefix("file:").removeprefix("//"))) != before
    assert set(os.listdir(session.shared_dir(spark).removeprefix("file:").removeprefix("//"))) == before
