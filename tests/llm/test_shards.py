import random
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import queries, shards
from ledgerloom.llm.store import Workspace

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path(tokenizers):
    return tokenizers("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    encode = Tokenizer.from_file(path).encode
    return lambda text: encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_documents(spark, documents, library):
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.queries()["op8_shards"](spark, FOLDER).collect()}
    wanted, start = {}, 0
    for r in sorted(documents.collect(), key=lambda r: r["doc_id"]):
        ids = library(r["text"]) + [1]
        wanted[r["doc_id"]] = (start, len(ids), crc(ids))
        start += len(ids)
    assert found == wanted


def test_odd_table(spark, odd, odd_rows, path, library, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_IDS", 50)  # many shards
    monkeypatch.setattr(shards, "BUCKET_KEYS", 2)
    store = shards.write(odd, Workspace(spark, "test").folder, path)
    rows = store.read(shards.keys_of(odd)).collect()
    assert sorted((str(r["doc"]), r["ids_crc32"]) for r in rows) == sorted(
        (str(-(1 << 63) if d is None else d), crc(library(t) + [1])) for d, t, _ in odd_rows)
    rows.sort(key=lambda r: r["start"])
    assert [r["doc"] for r in rows] == sorted(r["doc"] for r in rows)
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert all(np.frombuffer(r["ids"], "<u4")[-1] == 1 for r in rows)
    unknown = spark.createDataFrame([(10_000 + i, 0) for i in range(50)] + [(1, 7)], "doc long, copy long")
    assert store.read(unknown).collect() == []
    assert {r["doc"] for r in store.read(spark.createDataFrame([(7, 0), (99, 0)], "doc long, copy long")).collect()} == {7}
    assert [r["doc_id"] for r in store.read(shards.keys_of(odd.where("doc_id is null"))).select(shards.document_id()).collect()] == [None, None]


def test_empty_table(spark, odd, path):
    store = shards.write(odd.limit(0), Workspace(spark, "test").folder, path)
    assert store.read(shards.keys_of(odd)).collect() == [] and store.starts().collect() == []


@pytest.mark.parametrize("n", [1, 2, 100, 5000])
def test_hash_is_minimal_and_perfect(n):
    doc = np.arange(n, dtype=np.int64) * 3 - 50
    copy = np.arange(n) % 2
    levels, sizes, slot = shards.perfect_hash(doc, copy)
    assert sorted(slot.tolist()) == list(range(n))
    assert (shards.slots(levels, sizes, doc, copy) == slot).all()
    other = shards.slots(levels, sizes, doc + 1_000_000, copy)
    assert ((other >= -1) & (other < n)).all()
    assert len(set(shards.fingerprint(doc, copy).tolist())) > 0.99 * n


def encoded(path, texts):
    raw = [t.encode() for t in texts]
    ids, places = shards.encoder(path).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [ids[a:b].tolist() for a, b in zip(places, places[1:])]


def test_random_texts_encode_as_the_library_does(path, library):
    """Letters whose lower case has two characters, marks, both normal forms, odd spaces, openings of special tokens."""
    rnd = random.Random(8)
    letters = ["a", "B", "z", "é", "e\u0301", "İ", "I", "ı", "ß", "ẞ", "ﬁ", "Σ", "ς", "ǆ", "Ω", "Å", "\u0307", "\u0323", "漢", "か\u3099", "1", "²", "٣", "½",
               "'s", "'", "’", "_", "-", "<|", "|>", "<|endoftext|>", "€", "\u200d", "😀", "\x1c", "\x85", "\u2003", "\xad"]
    ends = [".", ",", "!", "?", ";", ":", "#", "*", "$", "%", "&", "|"]
    texts = []
    for _ in range(6000):
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 4))) + "".join(rnd.choice(ends) for _ in range(rnd.choice([0, 1, 1, 2]))) for _ in range(rnd.randint(1, 5))]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(words))
    texts += ["SAHİBİ, ve DEĞERİ. son", unicodedata.normalize("NFD", "SAHİBİ, Ünlü. ÉÉ!")]
    assert [(t, i) for t, i in zip(texts, encoded(path, texts)) if i != library(t)] == []


def test_one_key_reads_one_bucket_and_one_shard(spark, odd, odd_rows, path, library, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_IDS", 50)
    monkeypatch.setattr(shards, "BUCKET_KEYS", 2)
    store = shards.write(odd, Workspace(spark, "test").folder, path)
    for doc, text in ((7, odd_rows[9][1]), (12, "ab " * 200), (2, None)):
        assert store.lookup(doc).tolist() == library(text) + [1]
    assert store.lookup(123_456) is None and store.lookup(7, 3) is None
    plan = store.index.where("bucket = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(bucket,1)" in plan


def test_words_encode_as_the_whole_text(path, library):
    odd = ["Don't I'LL 12,3!", "<|endoftext|> a<|startoftext|>b", "x y z", "É é İ ẞ ﬁ", "a\x1cb \x85c", "漢字 かな", "_a__b", "", "It's, 'S. don't! x”, ”. É. é!? ½. A#1#. a| <|x|>. ... .a. 漢。. ̈. İ. KK.", "​ ﻿"]
    assert encoded(path, odd) == [library(t) for t in odd]
