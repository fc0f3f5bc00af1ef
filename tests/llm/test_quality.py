import collections
import itertools
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import quality, queries

FOLDER = "/root/testdata/sf0.001"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if runs[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_documents(spark, documents):
    found = {r["doc_id"]: r for r in queries.queries()["op7_quality"](spark, FOLDER).collect()}
    assert len(found) == documents.count()
    for r in documents.collect():
        row = found[r["doc_id"]]
        assert tuple(row[c] for c in BASE) == by_hand(r["text"])
        assert not (row["base_failed"] and row["kept"])
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    judged = [(bool(q), found[d]["kept"]) for d, q in marks.items() if not found[d]["base_failed"]]
    assert all(k for q, k in judged if q) and sum(q == k for q, k in judged) >= 0.97 * len(judged)


def test_odd_table(spark, odd, odd_rows):
    labels = spark.createDataFrame([(5, 1), (6, 1), (7, 1), (12, 0), (None, 0), (8, None)], "doc_id long, quality int")
    rows = quality.judged(odd, quality.fit(odd, labels)).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in BASE)) for r in rows) == sorted((str(d), *by_hand(t)) for d, t, _ in odd_rows)
    assert quality.judged(odd.limit(0), quality.fit(odd.limit(0), labels)).collect() == []


def test_without_labels_only_the_base_rules_decide(odd):
    from pyspark.sql import functions as F
    labels = odd.select("doc_id", F.lit(1).alias("quality")).limit(0)
    assert all(r["kept"] != r["base_failed"] for r in quality.judged(odd, quality.fit(odd, labels)).collect())


def _random_lines(rnd, sizes):
    text = np.repeat(np.arange(len(sizes)), sizes)
    features = np.stack([rnd.integers(0, quality.N_FEATURES, len(text)) for _ in range(3)], 1)
    return quality.Lines(text, np.ones(len(text), np.int64), features)


def _path_score(model, emit, path):
    return model.start[path[0]] + sum(emit[i] * s for i, s in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))


def test_decoding_finds_the_best_of_all_paths():
    rnd = np.random.default_rng(0)
    sizes = [3, 0, 1, 7, 5]
    lines = _random_lines(rnd, sizes)
    model = quality.Model(rnd.normal(size=quality.N_FEATURES), rnd.normal(size=(2, 2)) * 2, rnd.normal(size=2))
    got = quality.decode(model, lines).astype(int)
    emit = model.weights[lines.features].sum(1)
    for i in range(len(sizes)):
        own = np.flatnonzero(lines.text == i)
        if len(own):
            best = max(itertools.product((0, 1), repeat=len(own)), key=lambda p: _path_score(model, emit[own], p))
            assert tuple(got[own]) == best


def test_training_separates_kinds_of_lines():
    rnd = random.Random(1)
    def prose():
        return " ".join(rnd.choice(["the", "cat", "walked", "home", "slowly"]) for _ in range(12)) + "."
    def junk():
        return " | ".join(rnd.choice(["BUY", "NOW!!", "###"]) for _ in range(10))
    texts = [("\n".join(prose() for _ in range(6)), True) for _ in range(40)] + [("\n".join(junk() for _ in range(6)), False) for _ in range(20)]
    data = [t.encode() for t, _ in texts]
    _, lines = quality.measured(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    model = quality.train(lines, np.array([g for _, g in texts]))
    mixed = "\n".join([prose(), prose(), junk(), junk(), junk(), prose(), prose()]).encode()
    _, lines = quality.measured(np.frombuffer(mixed, np.uint8), np.array([0, len(mixed)]))
    assert quality.decode(model, lines).tolist() == [True, True, False, False, False, True, True]


def test_an_id_with_many_rows_gives_one_text(spark, monkeypatch):
    from pyspark.sql import functions as F
    docs = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("words "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(0, 1)] + [(i, i % 2) for i in range(3000, 4000)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda lines, good: seen.append(len(good)))
    quality.fit(docs, labels, rows=4000)
    assert seen == [1001]
