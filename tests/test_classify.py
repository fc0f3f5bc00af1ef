import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.classify import boost, encode, grow
from ledgerloom.classify import evaluate as E
from ledgerloom.classify import features as X
from ledgerloom.classify import model as M


@pytest.fixture(scope="module")
def labelled(spark):
    words = {"bolt": ("Parts", "Bolts"), "gear": ("Parts", "Gears"), "taxi": ("Trips", "Taxis"), "hotel": ("Trips", "Hotels")}
    rows = [(i, f"order of {w} number {w} {i % 5}", "A" if i % 3 else "B", float(i % 4), leaf, parent)
            for i, (w, (parent, leaf)) in enumerate(list(words.items()) * 30)]
    df = spark.createDataFrame(rows, f"{X.KEY} bigint, {X.TEXT} string, kind string, size double, label string, label_primary string")
    taxonomy = spark.createDataFrame([(p, l) for p, l in words.values()], "primary_code string, secondary_code string")
    return df, taxonomy


SMALL = boost.Settings(rounds=2, depth=4, rate=0.5, least_rows=1)


@pytest.mark.parametrize("linear", [False, True])
def test_train_predict_save_load(spark, labelled, tmp_path, linear):
    df, taxonomy = labelled
    model = M.fit(df, taxonomy, M.Settings(vocabulary=100, min_category_rows=10, max_iter=20, trees=SMALL, linear=linear), ["kind"], ["size"])
    scored = M.score(df, model, "7", "2024-01-01")
    assert scored.count() == df.count()
    assert scored.where("primary_confidence < secondary_confidence - 1e-9 or primary_confidence > 1 + 1e-9").count() == 0
    joined = scored.join(df, X.KEY)
    assert joined.where("predicted_secondary_category = label").count() / df.count() > 0.95
    wrong_parent = scored.join(taxonomy, F.col("predicted_secondary_category") == F.col("secondary_code")) \
        .where("primary_code <> predicted_primary_category")
    assert wrong_parent.count() == 0
    model.save(str(tmp_path / "m"))
    again = M.score(df, M.SpendModel.load(spark, str(tmp_path / "m")), "7", "2024-01-01")
    assert again.select(X.KEY, "predicted_secondary_category").exceptAll(scored.select(X.KEY, "predicted_secondary_category")).count() == 0


def test_unknown_category_at_scoring(spark, labelled):
    df, taxonomy = labelled
    model = M.fit(df, taxonomy, M.Settings(vocabulary=100, min_category_rows=10, trees=SMALL), ["kind"], ["size"])
    assert M.score(df.withColumn("kind", F.lit("never seen")), model, "1").count() == df.count()


def test_label_outside_the_taxonomy(spark, labelled):
    df, taxonomy = labelled
    with pytest.raises(ValueError, match="Taxis"):
        M.fit(df, taxonomy.where("secondary_code <> 'Taxis'"), M.Settings(trees=SMALL), ["kind"], [])


def test_terms_by_hand(spark):
    texts = {1: "Steel bolt, steel BOLT x 5", 2: "bolt nut", 3: None, 4: "", 5: "nut nut nut bolt steel", 6: "x y"}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    def words(t):
        w = [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() if len(x) > 1]
        return Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
    counts = {i: words(t) for i, t in texts.items()}
    rows, times = Counter(w for c in counts.values() for w in c), sum(counts.values(), Counter())
    kept = sorted((w for w in rows if rows[w] >= 2), key=lambda w: (-times[w], w))[:4]
    enc = encode.fit(df, "id", "t", [], [], terms_at_most=4, least_rows=2)
    idf = {w: math.log(7 / (1 + rows[w])) + 1 for w in kept}
    assert [(r.term, round(r.idf, 9)) for r in enc.terms.orderBy("index").collect()] == [(w, round(idf[w], 9)) for w in kept]
    got = {r["id"]: dict(zip(r["indices"], r["vals"])) for r in enc.encoded(df, "id").collect()}
    assert got.keys() == texts.keys()
    for i, c in counts.items():
        raw = {kept.index(w): (1 + math.log(n)) * idf[w] for w, n in c.items() if w in kept}
        length = math.sqrt(sum(v * v for v in raw.values())) or 1
        assert got[i] == pytest.approx({k: v / length for k, v in raw.items()})


def test_levels_are_sized_by_the_data(spark):
    """Rare values share one slot per column, unseen ones get none, NULL is a value, no two values share a slot."""
    df = spark.createDataFrame([(i, f"s{i % 40}" if i < 400 else f"rare{i}", None if i % 2 else "EUR", 1.5) for i in range(420)], "id int, a string, b string, n double")
    enc = encode.fit(df, "id", None, ["a", "b"], ["n"], least_category_rows=5)
    assert (enc.n_levels, enc.width) == (40 + 1 + 2, 44)
    by = {(r["column"], r["value"]): r["index"] for r in enc.levels.collect()}
    assert len(by) == 62 and sorted(set(by.values())) == list(range(43)) and len({by["a", f"rare{i}"] for i in range(400, 420)}) == 1
    new = spark.createDataFrame([(1, "s3", "EUR", -2.0), (2, "never", None, None), (3, None, "USD", 0.0)], "id int, a string, b string, n double")
    got = {r["id"]: list(zip(r["indices"], r["vals"])) for r in enc.encoded(new, "id").collect()}
    assert got == {1: sorted([(by["a", "s3"], 1.0), (by["b", "EUR"], 1.0), (43, -2.0)]), 2: [(by["b", None], 1.0), (43, 0.0)], 3: [(43, 0.0)]}


def plain_boost(X, y, w, k, s, cuts):
    """The same trees by loops over a dense matrix."""
    n, margins = len(y), np.tile([math.log(w[y == c].sum() / w.sum()) for c in range(k)], (len(y), 1))
    for _ in range(s.rounds):
        p = boost.softmax(margins)
        steps = np.zeros_like(margins)
        for c in range(k):
            g, h = w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c])
            leaves, level = {1: (np.ones(n, bool), 0.0)}, [1]
            for _ in range(s.depth):
                found = []
                for node in level:
                    inside = leaves[node][0]
                    best = None
                    for f in range(X.shape[1]):
                        for cut in cuts[f]:
                            right = inside & (X[:, f] > cut)
                            left = inside & ~right
                            if min(left.sum(), right.sum()) < s.least_rows or min(h[left].sum(), h[right].sum()) < s.least_curvature:
                                continue
                            q = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.l2)
                            gain = q(left) + q(right) - q(inside)
                            if gain > s.least_gain and (best is None or gain > best[0] + 1e-12):
                                best = (gain, node, left, right)
                    if best:
                        found.append(best)
                level = []
                for _, node, left, right in sorted(found, key=lambda x: (-x[0], x[1])):
                    if len(leaves) < s.leaves:
                        del leaves[node]
                        for child, m in ((2 * node, left), (2 * node + 1, right)):
                            leaves[child] = m, -s.rate * g[m].sum() / (h[m].sum() + s.l2)
                            level.append(child)
            for m, value in leaves.values():
                steps[m, c] += value
        margins += steps
    return boost.softmax(margins)


def test_trees_by_hand(spark):
    rnd = random.Random(5)
    data = [([rnd.choice([0, 0, 1, 2, 3]), rnd.choice([0, 1]), rnd.choice([-2, -1, 0, 4])], rnd.randint(0, 2), rnd.choice([1.0, 2.0])) for _ in range(300)]
    data = [(x, (x[0] > 1) + (x[2] > 0) if rnd.random() < 0.8 else y, w) for x, y, w in data]
    sparse = [([i for i, v in enumerate(x) if v or i == 2], [float(v) for i, v in enumerate(x) if v or i == 2], y, w) for x, y, w in data]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(sparse)], "id int, indices array<int>, vals array<double>, label int, weight double").repartition(5)
    s = boost.Settings(rounds=3, depth=3, leaves=6, rate=0.3, least_rows=5, l2=0.5)
    forest = boost.fit(rows, 3, s)
    X, y, w = (np.array([d[i] for d in data]) for i in (0, 1, 2))
    cuts = [[0, 1, 2, 3], [0, 1], [-2, -1, 0, 4]]  # what is not stored is below the first
    want = plain_boost(X, y, w, 3, s, cuts)
    got = {r["id"]: r["probability"] for r in forest.probabilities(rows).collect()}
    assert np.allclose([got[i] for i in range(len(data))], want, atol=1e-9)


def uneven_rows(spark, n=400):
    """Rows of 1 to 12 entries with repeats among them: terms of several weights, categories, numbers below zero, and two equal features."""
    rnd, data = random.Random(7), []
    for i in range(n):
        x = {f: rnd.choice([0.25, 0.5, 0.75]) for f in rnd.sample(range(8), rnd.choice([0, 1, 2, 7]))}
        x |= {8 + i % 5: 1.0, 20: float(rnd.randint(-4, 4))}
        x |= {30: 1.0, 31: 1.0} if i % 3 else {}
        y = (0.5 in x.values()) + 2 * (x[20] > 0) if rnd.random() < 0.8 else rnd.randint(0, 3)
        data += [(sorted(x), [x[f] for f in sorted(x)], y, rnd.choice([None, 0.5, 2.0]))] * rnd.choice([1, 1, 3])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, indices array<int>, vals array<double>, label int, weight double").repartition(3)


def test_trees_grown_by_class_are_those_of_rows_that_are_spread(spark, monkeypatch, tmp_path):
    rows, seen = uneven_rows(spark).cache(), []
    settings = dict(rounds=2, depth=5, leaves=9, rate=0.3, bins=5, least_rows=4, l2=0.1)
    for held in (10**6, 0):
        forest = boost.fit(rows, 4, boost.Settings(**settings, entries_a_task=held))
        seen.append([tuple(r) for r in forest.table(spark).orderBy("round", "class", "node").collect()])
    by_class, spread = seen
    assert len(by_class) > 100 and [r[:5] for r in by_class] == [r[:5] for r in spread]  # round, class, node, feature, threshold
    assert np.allclose([r[5] or 0 for r in by_class], [r[5] or 0 for r in spread], atol=1e-9)
    assert {r[3] for r in by_class} & {30, 31} <= {30}  # of equal features the first
    forest.save(spark, str(tmp_path / "f"))
    again = boost.Forest.load(spark, str(tmp_path / "f"))
    assert [tuple(r) for r in again.table(spark).orderBy("round", "class", "node").collect()] == spread


def test_sums_do_not_depend_on_how_rows_are_held():
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(0, 6, 500)
    codes = np.array([f << 16 | b for f in range(6) for b in range(1 + 3 * (f > 3))])
    slot = np.concatenate([np.sort([rnd.choice(np.flatnonzero(codes >> 16 == f)) for f in rnd.permutation(6)[:m]]) for m in sizes]).astype(np.int32)
    label, p = rnd.integers(0, 2, 500), rnd.random(500)
    s, trees = boost.Settings(depth=6, leaves=20, least_rows=3), []
    for limit in (grow.SUMS_AT_MOST, 0):
        data = grow.Rows(label, np.ones(500), sizes, slot, codes)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(grow, "SUMS_AT_MOST", limit)
            m.setattr(grow, "SLAB", 1 if limit == 0 else 1000)
            for even in (False, True):
                if even:
                    data.even = np.full((500, 6), data.slots, np.int32)
                    data.even[np.arange(6) < sizes[:, None]] = slot
                splits, leaves = grow.grown(data, p - label, p * (1 - p), s)
                assert sorted(np.concatenate([rows for _, rows in leaves.values()])) == list(range(500))
                trees.append((splits, {k: round(v, 9) for k, (v, _) in leaves.items()}))
    assert len(trees[0][0]) > 8 and all(t == trees[0] for t in trees)


def test_a_round_of_trees_writes_no_table_for_its_levels(spark, monkeypatch):
    made, rows = [], uneven_rows(spark, 100).cache()
    settled = boost.settled
    monkeypatch.setattr(boost, "settled", lambda frame, name="table", **more: made.append(name) or settled(frame, name, **more))
    for rounds in (1, 4):
        made.clear()
        forest = boost.fit(rows, 4, boost.Settings(rounds=rounds, depth=4, least_rows=2))
        assert len(forest.rounds) == rounds and sorted(made) == ["binned", "cuts", "ends", "rows"]
    monkeypatch.setattr(spark.sparkContext, "broadcast", None)  # trees are stored once, not once an executor
    assert forest.probabilities(rows).count() == rows.count()


def test_trees_beat_regression_where_columns_interact(spark):
    rows = [(i, float(i % 10), float(i // 10 % 10), "odd" if (i % 10 < 3) != (i // 10 % 10 < 4) else "even") for i in range(1000)]
    df = spark.createDataFrame(rows, f"{X.KEY} int, a double, b double, label string")
    taxonomy = spark.createDataFrame([("P", "odd"), ("P", "even")], "primary_code string, secondary_code string")
    right = {}
    for linear in (False, True):
        model = M.fit(df, taxonomy, M.Settings(trees=boost.Settings(rounds=2, depth=3, rate=0.5), linear=linear), [], ["a", "b"], text=None)
        right[linear] = M.score(df, model, "1").join(df, X.KEY).where("predicted_secondary_category = label").count()
    assert right[False] == 1000 and right[True] < 800


def test_the_training_query_uses_the_whole_settings(spark, monkeypatch):
    """No fewer rounds, levels, leaves or terms than the model's own, and every line is trained on or scored."""
    from checks import registry
    from ledgerloom.adapters.retail import Retail

    asked = {}

    def fit(train, taxonomy, settings=M.Settings(), categories=X.CATEGORIES, numbers=X.NUMBERS, **more):
        asked.update(settings=settings, categories=categories, numbers=numbers, more=more, train=train)
    monkeypatch.setattr(M, "fit", fit)
    monkeypatch.setattr(M, "score", lambda rows, *_: rows)
    retail = Retail(spark, "/root/testdata/sf0.001")
    scored = registry.QUERIES["clf_train_predict"](retail)
    s = asked["settings"]
    assert (s.vocabulary, s.min_documents, s.min_category_rows, s.linear) == (20_000, 3, 50, False)
    assert s.trees == boost.Settings(rounds=300, depth=8, leaves=63, rate=0.05, bins=32, l2=0.0, least_rows=20)
    assert (asked["categories"], asked["numbers"], asked["more"]) == (X.CATEGORIES, X.NUMBERS, {})
    assert asked["train"].count() + scored.count() == X.features(retail.lake()).count()


def test_odd_training_data(spark):
    rows = spark.createDataFrame([([], [], 0, 1.0), ([0], [1.0], 1, None), ([0], [1.0], None, 1.0), ([0], [1.0], 7, 1.0)], "indices array<int>, vals array<double>, label int, weight double")
    forest = boost.fit(rows, 2, boost.Settings(rounds=2, least_rows=1))
    assert forest.rounds and forest.probabilities(rows).count() == 4
    assert boost.fit(rows.limit(0), 2).rounds == [] and boost.fit(rows.where("label = 0"), 2).rounds == []
    assert forest.probabilities(rows.limit(0)).collect() == []


def test_split_is_complete_and_repeatable(spark):
    df = spark.range(2000).select(F.col("id").alias(X.KEY), (F.col("id") % 10 == 0).alias("is_maverick_supplier"))
    parts = X.split(df)
    assert sum(p.count() for p in parts) == 2000
    again = X.split(df.repartition(9))
    for a, b in zip(parts, again):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert 0.75 < parts[0].count() / 1800 < 0.85


def test_macro_f1_by_hand(spark):
    pred = spark.createDataFrame([("m", "s", "a", "a", "P", "P"), ("m", "s", "a", "b", "P", "P"), ("m", "s", "b", "b", "P", "P"), ("m", "s", "c", None, "Q", None)],
                                 "model_alias string, slice string, label string, predicted_secondary_category string, label_primary string, predicted_primary_category string")
    row = E.evaluate(pred).first()
    # Classes a, b, c and the empty prediction: F1 of 2/3, 2/3, 0 and 0.
    assert row.secondary_top1_accuracy == 0.5 and abs(row.secondary_macro_f1 - (2 / 3 + 2 / 3) / 4) < 1e-9
    assert row.primary_top1_accuracy == 0.75 and row.n_rows == 4


def test_floor_falls_back_and_ties_go_low(spark):
    train = spark.createDataFrame([("5000", "b"), ("5000", "a"), ("6000", "c"), ("6000", "c")], "gl_account string, label string")
    taxonomy = spark.createDataFrame([("P", "a"), ("P", "b"), ("Q", "c")], "primary_code string, secondary_code string")
    rows = spark.createDataFrame([("5000",), ("9999",), (None,)], "gl_account string")
    got = {r.gl_account: (r.predicted_secondary_category, r.predicted_primary_category) for r in E.floor_predict(rows, train, taxonomy).collect()}
    assert got == {"5000": ("a", "P"), "9999": ("c", "Q"), None: ("c", "Q")}


def test_champion_and_margin(spark):
    metrics = spark.createDataFrame([("x", "holdout", 0.9), ("x", "maverick_holdout", 0.7), ("y", "holdout", 0.8), ("y", "maverick_holdout", 0.75),
                                     ("gl_account_baseline", "holdout", 0.99), ("gl_account_baseline", "maverick_holdout", 0.7)],
                                    "model_alias string, slice string, secondary_top1_accuracy double")
    assert E.champion(metrics, ["x", "y"]).first().model_alias == "y"
    row = E.floor_margin(metrics, "y").first()
    assert row.margin_pp == 5.0 and row.level == "warn"
