import hashlib
import random
import re
import zlib

import numpy as np

from ledgerloom.llm import periods, queries
from ledgerloom.llm import words as W

FOLDER = "/root/testdata/sf0.001"


def by_hand(words):
    """(start, length, period) of every run: each diagonal read in full, periods tested one by one."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            stretch = words[i - q:j]
            if j > i and len(stretch) >= max(12, 2 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i - q, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out)


def found(texts):
    raw = [" ".join(t).encode() for t in texts]
    edges = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, stops, before = W.spans(data, edges)
    text = np.repeat(np.arange(len(texts)), np.diff(before))
    runs = periods.runs_of(W.hashes(data, starts, stops), text)
    return [sorted((s - before[k], n, q) for s, n, q in runs if text[s] == k) for k in range(len(texts))]


def words_of(rnd):
    words = [rnd.choice("abcdefghijkl"[:rnd.choice([1, 2, 2, 3, 5, 12])]) for _ in range(rnd.randint(0, 120))]
    for _ in range(rnd.randint(0, 4)):
        if words:
            a = rnd.randrange(len(words))
            unit = words[a:a + rnd.randint(1, 20)]
            words[a:a + len(unit)] = unit * rnd.randint(1, 6)
    if rnd.random() < 0.3:  # a period cut and begun again, so that many periods share one place
        words = ["a", "b"] * rnd.randint(1, 30) + ["a"] * rnd.randint(0, 2) + ["a", "b"] * rnd.randint(1, 30) + words
    return words


def test_runs_by_hand():
    rnd = random.Random(3)
    for _ in range(40):
        texts = [words_of(rnd) for _ in range(25)]
        assert found(texts) == [by_hand(t) for t in texts]


def test_one_word_many_times_stays_cheap():
    assert found([["x"] * 300_000]) == [[(0, 300_000, 1)]]
    assert found([["x", "y"] * 150_000 + ["z"]]) == [[(0, 300_000, 2)]]


def expected(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc is not None and words and zlib.crc32(str(doc).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return row(doc, words)


def row(doc, words):
    runs = by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_by_hand(spark):
    """Every document of the smallest table; the longest texts are left to the other tests."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periods(spark, FOLDER).collect()}
    assert got.keys() == docs.keys()
    looked = [d for d, t in docs.items() if len(t or "") < 5_000]
    assert len(looked) > 100 and any(zlib.crc32(str(d).encode()) % 10 == 0 for d in looked)
    assert [got[d] for d in looked] == [expected(d, docs[d]) for d in looked]


def test_odd_rows(spark, odd, odd_rows):
    short = [(d, t) for d, t, _ in odd_rows if len(t or "") < 10_000]
    frame = odd.where("coalesce(length(text), 0) < 10000")
    same = lambda rows: sorted(rows, key=str)
    assert same(tuple(r) for r in periods.collapsed(frame, digests=True).collect()) == same(row(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in short)
    assert same(tuple(r) for r in periods.collapsed(periods.looped(frame), digests=True).collect()) == same(expected(d, t) for d, t in short)
    whole = periods.collapsed(odd).where("doc_id = 12").first()
    assert (whole["runs"], whole["collapsed"], whole["exponent_milli"]) == ("0,200,1\n", "ab", 200_000)
    assert periods.collapsed(odd).count() == len(odd_rows)
    assert [tuple(r) for r in periods.runs(odd.where("doc_id = 12")).collect()] == [(12, 0, 200, 1)]
    assert periods.collapsed(odd.limit(0)).collect() == [] and periods.runs(odd.limit(0)).collect() == []
    assert periods.looped(odd).columns == odd.columns


def test_text_ids(spark):
    frame = spark.createDataFrame([("a", "x " * 20), (None, "x " * 12)], "name string, body string")
    got = periods.collapsed(frame, "name", "body")
    assert sorted((r["doc_id"] or "", r["n_runs"], r["collapsed"]) for r in got.collect()) == [("", 1, "x"), ("a", 1, "x")]
