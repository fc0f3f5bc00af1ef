import zlib

import numpy as np
import pytest

from ledgerloom.llm import language, queries

FOLDER = "/root/testdata/sf0.001"


def test_held_out_accuracy_and_contract(spark, documents):
    truth = {r["doc_id"]: r for r in documents.collect()}
    rows = queries.queries()["op2_language"](spark, FOLDER).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_odd_table(odd, odd_rows):
    rows = language.identified(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    und = sorted(str(r["doc_id"]) for r in rows if r["lang_pred"] == "und")
    assert und == ["11", "2", "3", "4", "None"]
    assert all(r["score"] == 0 and not r["accepted"] for r in rows if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in rows} <= {"und", "en", "de"}
    assert language.identified(odd.limit(0)).collect() == []


def test_nothing_to_learn_from(odd):
    from pyspark.sql import functions as F
    rows = language.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_mean_over_all_subwords(monkeypatch):
    table = np.random.default_rng(1).random((1 << language.BITS, 3))
    texts = ["Ab cd", None, "12", "é" * 40 + " zz", "a"]
    mean, count = language.mean_rows(table, texts)
    for text, m, n in zip(texts, mean, count):
        stream, _ = language.streams([text])
        rows = [b for order in language.ORDERS for b in language.subwords(stream, order, 0, len(stream))[1]]
        assert n == len(rows) and m == pytest.approx(table[rows].mean(0) if rows else np.zeros(3))
    monkeypatch.setattr(language, "_CHUNK", 7)  # long texts go in chunks
    again, same = language.mean_rows(table, texts)
    assert again == pytest.approx(mean) and (same == count).all()


def test_threshold_rejects_what_lowers_the_accuracy():
    rnd = np.random.default_rng(3)
    def text(letters):
        return " ".join("".join(rnd.choice(list(letters), 5)) for _ in range(30))
    clean = [(text("abc"), "x") for _ in range(150)] + [(text("uvw"), "y") for _ in range(150)]
    assert language.train([t for t, _ in clean], [v for _, v in clean]).threshold == 0
    noise = [(text("klm"), v) for v in "xy" * 60]
    model = language.train([t for t, _ in clean + noise], [v for _, v in clean + noise], accuracy=0.97)
    assert 0.5 < model.threshold <= 1


def test_repeated_training_gives_the_same_model():
    texts, labels = ["aa bb", "cc dd", "aa cc", "dd ee"] * 5, ["x", "y", "x", "y"] * 5
    a, b = language.train(texts, labels), language.train(texts, labels)
    assert (a.table == b.table).all() and a.threshold == b.threshold


def test_what_was_not_learned_is_rejected(spark, documents):
    """Random letters, letters of learned texts in another order, languages never learned; learned texts all stay."""
    from pyspark.sql import functions as F
    rnd = np.random.default_rng(8)
    plain = [r["text"] for r in documents.where(F.length("text") > 60).orderBy("doc_id").limit(30).collect()]
    strange = ["".join(rnd.permutation(list(t))) for t in plain]
    strange += [" ".join("".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), len(w))) for w in t.split()) for t in plain]
    strange += ["Съешь же ещё этих мягких французских булок, да выпей чаю", "天地玄黃宇宙洪荒日月盈昃", "Onko sinulla huomenna illalla yhtään aikaa"]
    model = language.fit(documents)
    def accepted(texts):
        return [r["language"]["accepted"] for r in language.scored(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()]
    assert not any(accepted(strange)) and all(accepted(plain))


def test_nothing_is_accepted_if_no_cut_is_accurate_enough():
    rnd = np.random.default_rng(4)
    texts = [" ".join("".join(rnd.choice(list("klm"), 5)) for _ in range(30)) for _ in range(100)]
    assert language.train(texts, ["x", "y"] * 50, accuracy=1.01).threshold > 1


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """Half of the rows are one row, a quarter share an id: neither is drawn whole."""
    from pyspark.sql import functions as F
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 4 == 3, F.col("id")).otherwise(F.lit(7)).alias("doc_id"),
        F.when(F.col("id") % 2 == 0, "the same words").otherwise(F.concat(F.lit("words "), F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    taken = []
    monkeypatch.setattr(language, "train", lambda texts, labels: taken.append(texts))
    language.fit(rows, rows=1000)
    assert 200 < len(taken[0]) < 1500 and taken[0].count("the same words") <= 1
