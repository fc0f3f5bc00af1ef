import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import benchmark, queries

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def aligned(item, text):
    """Best Smith-Waterman score: match 2, other -1, gap -1."""
    above, best = [0] * (len(text) + 1), 0
    for a in item:
        here = [0]
        for j, b in enumerate(text):
            here.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, here[j] - 1))
        best, above = max(best, *here), here
    return best


def by_hand(docs, items, least=0.5):
    return {(d, i): s for d, t in docs for i, x in items if len(words(x)) >= 3
            if (s := aligned(words(x), words(t)) / (2 * len(words(x)))) >= least}


def found(frame):
    return {(r["doc_id"], r["item_id"]): r["score"] for r in frame.collect()}


@pytest.fixture(scope="module")
def edited():
    """Whole, cut, edited and moved copies of items among unrelated text."""
    rnd = random.Random(9)
    def say(n):
        return [f"v{rnd.randint(0, 3000)}" for _ in range(n)]
    items = [(i, " ".join(say(rnd.choice([3, 12, 40, 70])))) for i in range(12)] + [(12, "One two"), (13, None), (14, "")]
    docs = []
    for d in range(120):
        body = say(rnd.randint(0, 80))
        if d % 2:
            part = words(items[rnd.randrange(12)][1])
            for _ in range(rnd.choice([0, 1, len(part) // 8])):
                at = rnd.randrange(len(part))
                part[at:at + rnd.randint(0, 1)] = say(rnd.randint(0, 2))
            part = part[:rnd.choice([len(part), len(part) * 3 // 4])]
            at = rnd.randint(0, len(body))
            body[at:at] = part
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(body).upper() if d % 3 else " ".join(body)))
    return docs, items


def test_edited_copies_are_found_and_nothing_else(spark, edited):
    docs, items = edited
    got = found(benchmark.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    wanted = by_hand(docs, items)
    assert set(got) <= set(wanted)
    assert all(got[k] == pytest.approx(wanted[k]) for k in got)
    # A quoted part of a very short item may lack a whole run of three words.
    sure = {k for k, s in wanted.items() if s >= 0.65 and len(words(items[k[1]][1])) > 3}
    assert len(sure) > 30 and sure <= set(got)


def test_a_benchmark_in_slices_gives_the_same(spark, edited, monkeypatch):
    docs, items = (spark.createDataFrame(edited[0], "doc_id long, text string"), spark.createDataFrame(edited[1], "item_id long, text string"))
    whole = found(benchmark.contaminated(docs, items))
    monkeypatch.setattr(benchmark, "SLICE", 150)
    assert found(benchmark.contaminated(docs, items)) == whole


def test_long_items_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(benchmark, "PART", 20)
    item = " ".join(f"q{i}" for i in range(90))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"q{i}" for i in range(40, 62)) + " z"), (2, "q1 q2 q9")], "doc_id long, text string")
    got = found(benchmark.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")))
    assert set(got) == {(1, 5)} and got[1, 5] == 1


@pytest.mark.parametrize("n", [399, 400, 401, 402, 403, 405, 799, 801, 1300])
def test_no_remainder_of_a_long_item_counts(spark, n):
    """The last words alone are a small share of an item of any length; half of its last 400 words are enough."""
    words = [f"q{i}" for i in range(n)]
    least = min(n, 400) // 2
    docs = [(1, "a b " + " ".join(words[-3:]) + " c"), (2, " ".join(words[-5:])), (3, "x " + " ".join(words[-least - 1:])), (4, " ".join(words)),
            (5, " ".join(words[-least + 5:]) + " y")]
    got = found(benchmark.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")))
    assert set(got) == {(3, 5), (4, 5)} and got[4, 5] == 1


def test_align_many_at_once():
    rnd = np.random.default_rng(4)
    items = [rnd.integers(0, 6, n).astype(np.uint64) for n in (3, 9, 14, 30)]
    texts = [rnd.integers(0, 6, n).astype(np.uint64) for n in (25, 3, 60, 31)]
    score, _ = benchmark.align(items, texts)
    assert score.tolist() == [aligned(a.tolist(), b.tolist()) for a, b in zip(items, texts)]


def test_documents(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    seeds = [(i, {tuple(words(t)[k:k + 3]) for k in range(len(words(t)) - 2)}) for i, t in items]
    near = []
    for d, t in docs:  # pairs without a common run of three words cannot reach the threshold by hand in reasonable time
        runs = {tuple(words(t)[k:k + 3]) for k in range(len(words(t)) - 2)}
        near += [(d, t, i) for i, s in seeds if len(runs & s) >= 3]
    wanted = {}
    for d, t, i in near:
        wanted |= by_hand([(d, t)], [(i, dict(items)[i])])
    assert found(queries.queries()["op6_benchmark"](spark, FOLDER)) == pytest.approx(wanted)


def test_odd_table(spark, odd):
    items = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "One, two; THREE"), (2, None), (3, " ".join(f"w{i}" for i in range(30)))],
                                  "item_id long, text string")
    rows = benchmark.contaminated(odd, items).collect()
    key = lambda r: (str(r["doc_id"]), str(r["item_id"]))
    assert sorted(map(key, rows)) == sorted([("1", "1")] * 2 + [("1", "None")] * 2 + [("None", "1"), ("None", "None"), ("7", "3"), ("8", "3"), ("8", "3"), ("9", "3")])
    assert {r["score"] for r in rows} == {1.0}
    left = benchmark.clean(odd, items)
    assert left.columns == odd.columns
    assert not {r["doc_id"] for r in left.collect()} & {1, 7, 8, 9, None}
    assert benchmark.contaminated(odd.limit(0), items).collect() == []
    assert benchmark.contaminated(odd, items.limit(0)).collect() == []
    assert benchmark.clean(odd, items.limit(0)).count() == odd.count()


def test_copies_down_to_half_are_found_beside_whole_ones(spark):
    """The seeds that an edited copy has kept are the frequent ones of its item."""
    rnd = random.Random(11)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(40))) for i in range(30)]
    docs = []
    for i, text in items:
        docs += [text] * (i % 3)
        every = text.split()
        docs.append(" ".join("zz" if k % 5 == 4 else w for k, w in enumerate(every)))
        for share in (0.1, 0.2, 0.3):
            docs.append(" ".join(f"n{rnd.randint(0, 99)}" if rnd.random() < share else w for w in every))
        # Words put in behind the only run of three words that is left.
        docs.append(" ".join(every[:3] + [x for k in range(3, 39, 2) for x in (*every[k:k + 2], "zz")]))
    docs += docs[:6] * 50
    docs = [(d, f"before {t} after") for d, t in enumerate(docs)]
    wanted = {k: s for k, s in by_hand(docs, items).items() if shares_a_run(docs[k[0]][1], items[k[1]][1])}
    assert min(wanted.values()) < 0.6
    got = found(benchmark.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == pytest.approx(wanted)


def shares_a_run(a, b):
    a, b = ({tuple(w[k:k + 3]) for k in range(len(w) - 2)} for w in (words(a), words(b)))
    return bool(a & b)


def test_the_bound_loses_nothing(monkeypatch):
    """Few different words, so that all runs are common; with the bound as without it, in parts of any size."""
    rnd = random.Random(12)
    def say(n):
        return " ".join(f"c{rnd.randint(0, 4)}" for _ in range(n))
    items = [(i, say(rnd.choice([5, 9, 20]))) for i in range(20)]
    docs = [(d, say(rnd.choice([0, 2, 15, 60]))) for d in range(40)]
    best, held = by_hand(docs, items), benchmark.Seeds.of(items)
    batch = pa.record_batch([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    def rows():
        return pa.Table.from_batches(benchmark._aligned(SimpleNamespace(value=held), 0.5)(iter([batch]))).to_pylist()
    for cells in (500_000, 100):
        with monkeypatch.context() as m:
            m.setattr(benchmark, "_CELLS", cells)
            got = rows()
            m.setattr(benchmark.Seeds, "bounds", lambda self, item, *_: np.full(len(item), 1 << 30))
            assert got == rows() and got
        assert all(r["score"] <= best[r["doc_id"], r["item_id"]] + 1e-9 for r in got)


def test_clean_texts_stay_beside_contaminated_ones_of_their_id(spark):
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    rows = [(None, "one two three four"), (None, "other words here"), (5, "see one two three four"), (5, "nothing of it"), (6, None)]
    left = benchmark.clean(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
