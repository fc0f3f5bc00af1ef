"""Order-dependent and allocation operators against brute force, with one key holding most rows."""
import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import allocate, keyed, series
from ledgerloom.operators.history import scd2, snapshot
from ledgerloom.operators.ordered import along, cut, numbered
from ledgerloom.operators.sweep import sums_within, under_cover
from ledgerloom.session import cut as cut_lineage
from ledgerloom.operators.resolve import Entities, resolve_suppliers, update_entities, with_entities


def skewed(spark, n=600):
    rnd = random.Random(7)
    rows = [(1 if i % 3 else i % 17, rnd.randrange(200), i, rnd.choice([None, 1, 2, 5])) for i in range(n)]
    return spark.createDataFrame(rows, "k int, t int, id int, x int").repartition(5)


def test_along_equals_plain_window(spark, rows):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("k", "t", "id", "x", F.lag("x").over(w).alias("was"), F.lead("x").over(w).alias("next"),
                     F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("run"),
                     F.row_number().over(w).alias("no"))
    for width in (1, 25, 1000):
        got = along(df, ["k"], ["t", "id"], F.floor(F.col("t") / width), previous={"was": "x"},
                    following={"next": "x"}, running={"run": "x"}, number="no")
        assert rows(got.withColumn("run", F.col("run").cast("bigint"))) == rows(want)


def test_slices_are_cut_from_the_rows(spark, rows):
    """One key with 90 % of all rows, all of them on one instant or without one; NULL keys; rows told apart by nothing."""
    data = [(1, 5 if i % 3 else None, i % 4) for i in range(900)] + [(None if i % 2 else i % 7, i % 5, i) for i in range(100)]
    df = spark.createDataFrame(data, "k int, t int, x int").repartition(5)
    got = along(df, ["k"], ["t", "x"], previous={"was": "x"}, following={"next": "x"}, running={"run": "x"}, number="no", rows=50)
    w = Window.partitionBy("k").orderBy("t", "x")
    want = df.select("k", "t", "x", F.lag("x").over(w).alias("was"), F.lead("x").over(w).alias("next"),
                     F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.row_number().over(w).alias("no"))
    assert rows(got.withColumn("run", F.col("run").cast("bigint"))) == rows(want)
    sizes = [r["count"] for r in cut(df, ["k", "t"], 50).groupBy("_slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 100 and sum(sizes) == 1000
    assert along(df.limit(0), ["k"], ["t"], number="no").collect() == []


def test_numbers_over_the_whole_table(spark):
    df = skewed(spark)
    got = [(r.t, r.id, r.n) for r in numbered(df, ["t", "id"], "n", start=7, rows=40).orderBy("n").collect()]
    assert got == [(t, i, 7 + n) for n, (t, i) in enumerate(sorted((r.t, r.id) for r in df.collect()))]


def test_versions_of_a_key_whose_changes_share_an_instant(spark, rows):
    day = dt.date(2024, 1, 1)
    changes = spark.createDataFrame([("w", day, i, "AB"[i // 50 % 2]) for i in range(500)] + [("v", day, 500, "A")], "id string, at date, n int, s string")
    got = scd2(changes, "id", "at", ["s"], "n", rows=30)
    assert got.where("id = 'w'").count() == 10 and got.where("is_current").count() == 2
    assert rows(got) == rows(scd2(changes, "id", "at", ["s"], "n", F.lit(0)))


def test_sweep_by_hand(spark):
    """A thousand intervals and most days on one key; open, empty and reversed intervals; days without a date."""
    rnd = random.Random(2)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    spans = [(i, "big" if i < 1000 else f"k{i % 3}", day(a := rnd.randrange(400)), day(a + rnd.randint(-3, 60))) for i in range(1100)]
    spans += [(2000, "big", None, day(5)), (2001, "big", day(5), None), (2002, "none", day(0), day(9))]
    points = [("big" if i % 5 else f"k{i % 4}", None if i % 50 == 0 else day(rnd.randrange(-20, 480)), Decimal(rnd.randint(1, 99))) for i in range(1500)]
    intervals = spark.createDataFrame(spans, "id int, k string, a date, b date").repartition(3)
    days = spark.createDataFrame(points, "k string, d date, v decimal(10,0)").repartition(4)
    got = {r.id: r.s for r in sums_within(intervals, days, "k", "id", "a", "b", "d", "v", "s", rows=100).collect()}
    want = {i: sum(v for p, d, v in points if p == k and d and a <= d <= b) for i, k, a, b in spans if a and b and a <= b}
    assert got == want
    flags = sorted(map(str, map(tuple, under_cover(days, intervals, "k", "a", "b", "d", "c", rows=100).collect())))
    inside = lambda k, d: bool(d) and any(o == k and a and b and a <= d <= b for _, o, a, b in spans)
    assert flags == sorted(str((k, d, v, inside(k, d))) for k, d, v in points)


def test_totals_without_a_target_are_reported(spark):
    from ledgerloom import gates
    targets = spark.createDataFrame([("a", 100), ("b", 50)], "k string, t int")
    actuals = spark.createDataFrame([("a", 100), ("c", 70)], "k string, n int")
    got = {r.key: (r.actual, r.target, r.level) for r in gates.compare_totals("g", actuals, targets, ["k"], "n", "t").collect()}
    assert got == {"a": (100, 100, "ok"), "b": (0, 50, "breach"), "c": (70, 0, "breach")}
    assert gates.compare_totals("g", actuals, targets, ["k"], "n", "t", surplus=False).count() == 2


def test_one_per_key_and_most_common(spark, rows):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 1, None), (None, 5, "n")], "k string, o int, v string")
    first = keyed.one_per_key(df, ["k"], [F.col("v").isNull(), F.col("o")])
    assert rows(first) == [("a", 1, "x"), ("b", 1, None), (None, 5, "n")]
    tie = spark.createDataFrame([("g", "z"), ("g", "y"), ("g", "z"), ("g", "y"), ("g", None)], "g string, v string")
    assert rows(keyed.most_common(tie, ["g"], "v", "m")) == [("g", "y")]


def test_shares_sum_to_hundred(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "k string, n int")
    got = {r.k: r.p for r in keyed.share_of_total(df, "n", "p").collect()}
    assert got == {"a": 25.0, "b": 25.0, "c": 50.0}


def test_scd2_collapses_repeats(spark, rows):
    d = lambda n: dt.date(2024, 1, n)
    changes = spark.createDataFrame([
        ("w", d(1), 1, "A"), ("w", d(3), 2, "A"), ("w", d(5), 3, "B"), ("w", d(9), 4, "A"), ("v", d(2), 5, None),
        ("v", d(4), 6, None), ("v", d(6), 7, "C")], "id string, at date, n int, s string")
    got = scd2(changes, "id", "at", ["s"], "n", F.trunc("at", "month"))
    open_end = dt.date(9999, 12, 31)
    assert rows(got) == sorted([
        ("w", 1, d(1), d(5), False, "A"), ("w", 2, d(5), d(9), False, "B"), ("w", 3, d(9), open_end, True, "A"),
        ("v", 1, d(2), d(6), False, None), ("v", 2, d(6), open_end, True, "C")], key=lambda r: (r[0], r[1]))


def test_snapshot_is_half_open(spark, rows):
    d = dt.date
    history = spark.createDataFrame([
        ("moved", d(2024, 1, 1), d(2024, 3, 31), "A"), ("moved", d(2024, 3, 31), d(9999, 12, 31), "B"),
        ("left", d(2023, 5, 1), d(2024, 3, 31), "A"), ("hired", d(2024, 3, 31), d(9999, 12, 31), "C")],
        "e string, effective_from date, effective_to date, s string")
    ends = spark.createDataFrame([(d(2024, 3, 31),), (d(2023, 12, 31),), (d(2024, 6, 30),)], "snapshot_date date")
    want = [("left", d(2023, 12, 31), "A"), ("moved", d(2024, 3, 31), "B"), ("hired", d(2024, 3, 31), "C"),
            ("moved", d(2024, 6, 30), "B"), ("hired", d(2024, 6, 30), "C")]
    for step in ("day", "quarter"):
        assert rows(snapshot(history, ends, step=step), "e", "snapshot_date", "s") == sorted(want, key=lambda r: tuple(map(str, r)))


def test_zero_weights_split_equally(spark):
    parts = spark.createDataFrame([("q", 90.0, 0), ("q", 90.0, 0), ("q", 90.0, 0), ("r", 10.0, 3), ("r", 10.0, 1)],
                                  "g string, total double, w int")
    got = sorted(r.a for r in allocate.allocate(parts, ["g"], "total", "w", "a").collect())
    assert got == [2.5, 7.5, 30.0, 30.0, 30.0]


def test_last_line_absorbs_residual(spark):
    lines = spark.createDataFrame([("d", i, 33.333) for i in (1, 2, 3)] + [("e", 1, 5.0)], "doc string, n int, a double")
    totals = spark.createDataFrame([("d", 100.0), ("e", 5.0)], "doc string, total double")
    got = {(r.doc, r.n): r.b for r in allocate.settle_residual(lines, "doc", ["n"], "a", totals, "total", "b").collect()}
    assert got[("d", 3)] == Decimal("33.34") and got[("d", 1)] == Decimal("33.33") and got[("e", 1)] == Decimal("5.00")


def test_rescale_hits_target(spark):
    lines = spark.createDataFrame([("a", Decimal("10.00")), ("a", Decimal("20.00")), ("b", Decimal("7.00"))], "g string, amount decimal(18,2)")
    targets = spark.createDataFrame([("a", 60.0)], "g string, target double")
    got = sorted(r.amount for r in allocate.rescale(lines, targets, ["g"], "amount", "target").collect())
    assert got == [Decimal("7.00"), Decimal("20.00"), Decimal("40.00")]


def test_interpolation_holds_the_ends(spark):
    m = lambda n: dt.date(2024, n, 1)
    spine = spark.createDataFrame([(m(1), None), (m(2), 10.0), (m(3), None), (m(4), 40.0), (m(5), None)], "m date, v double")
    got = [round(r.x, 4) for r in series.interpolate(spine, [], "m", "v", "x").orderBy("m").collect()]
    assert got == [10.0, 10.0, round(10 + 30 * 29 / 60, 4), 40.0, 40.0]


def _edit_graph(names):
    forms = {n: {n} | ({n[:i] + n[i + 1:] for i in range(len(n))} if len(n) >= 4 else set()) for n in names}
    root = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if forms[a] & forms[b] and root[a] != root[b]:
                    low = min(root[a], root[b])
                    root[a] = root[b] = low
                    changed = True
    groups = {}
    for n in names:
        groups.setdefault(root[n], set()).add(n)
    return {frozenset(g) for g in groups.values()}


def test_resolution_against_brute_force(spark):
    rnd = random.Random(3)
    base = ["acme tools", "northwind", "globex", "initech", "umbrella parts"]
    names = set(base)
    for word in base:
        for _ in range(6):
            i = rnd.randrange(len(word))
            names.add((word[:i] + rnd.choice("abcxyz") + word[i + 1:]).strip())
            names.add((word[:i] + word[i + 1:]).strip())
    names = sorted(" ".join(n.split()) for n in names)
    df = spark.createDataFrame([(f"S{i:03d}", n) for i, n in enumerate(names)], "supplier_id string, supplier_name string")
    groups = {}
    for r in resolve_suppliers(df).collect():
        groups.setdefault(r.canonical_supplier_id, set()).add(r.supplier_name)
    assert {frozenset(g) for g in groups.values()} == _edit_graph(names)


def test_resolution_rules(spark):
    df = spark.createDataFrame([
        ("1", "Acme Tools, Inc."), ("2", "ACME TOOLS"), ("3", "Acmé Tools GmbH"), ("4", "Acme Tool"), ("5", "Plant 17"),
        ("6", "Plant 18"), ("7", None)], "supplier_id string, supplier_name string")
    got = {r.supplier_id: r.canonical_supplier_id for r in resolve_suppliers(df).collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "4": "1", "5": "5", "6": "6", "7": "7"}


def test_entities_over_runs_equal_one_run_and_keep_their_names(spark):
    rnd = random.Random(11)
    names = ["".join(rnd.choice("abc") for _ in range(rnd.randint(5, 8))) for _ in range(150)]
    delivered = [(i, names[rnd.randrange(150)], 1 + rnd.randrange(4)) for i in range(220)] + [(7, names[3], 3), (8, None, 2), (None, "abcab", 1), (500, "", 4)]
    df = spark.createDataFrame(delivered, "supplier_id int, supplier_name string, run int").cache()
    known, before = None, {}
    for run in (1, 2, 3, 4, 4):  # the last one is repeated
        known = update_entities(df.where(F.col("run") == run), known, run)
        known = Entities(*[cut_lineage(frame) for frame in (known.spellings, known.members, known.merges)])
        now = {r.key: tuple(r.entity) for r in known.members.collect()}
        log = {(r.run, tuple(r.entity)): tuple(r.into) for r in known.merges.collect()}
        for key, entity in before.items():  # a name lives on, or the log says what became of it
            assert now[key] == log.get((run, entity), entity)
        assert all(into < entity for (_, entity), into in log.items())
        before = now
    every = update_entities(df, None, 1)
    want = {}
    for r in every.members.collect():
        want.setdefault(tuple(r.entity), set()).add(r.key)
    got = {}
    for key, entity in before.items():
        got.setdefault(entity, set()).add(key)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert {r.supplier_id: r.canonical_supplier_id for r in with_entities(df.where("supplier_id in (8, 500)"), known).collect()}[500] == 500


def test_sample_of_exact_size(spark, rows):
    """A third of the rows share a key, some have none."""
    df = spark.createDataFrame([(None if i % 50 == 0 else 5 if i % 3 == 0 else i, i) for i in range(2000)], "k int, v int").repartition(6)
    order = df.orderBy(F.md5(F.col("k").cast("string")), "k", "v")
    for n in (0, 1, 30, 700, 1999, 2000, 5000):
        for bins in (1 << 20, 4):
            assert rows(keyed.sample_rows(df, "k", n, bins)) == rows(order.limit(n))
    assert keyed.sample_rows(df.limit(0), "k", 5).collect() == []
