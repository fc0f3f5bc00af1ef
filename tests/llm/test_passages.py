import hashlib
import random
import re

import numpy as np
import pytest

from checks import compare
from ledgerloom.llm import passages, queries

FOLDER = "/root/testdata/sf0.001"


def by_hand(docs):
    """{id: (n_words, n_removed, sha)}; ids differ."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first, gone = {}, {d: set() for d in words}
    for d in sorted(words):
        for s in range(len(words[d]) - 19):
            w = tuple(words[d][s:s + 20])
            if first.setdefault(w, (d, s)) != (d, s):
                gone[d] |= set(range(s, s + 20))
    kept = {d: " ".join(w for i, w in enumerate(words[d]) if i not in gone[d]) for d in words}
    return {d: (len(words[d]), len(gone[d]), hashlib.sha256(kept[d].encode()).hexdigest()) for d in words}


def found(frame):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_small_tables(spark, monkeypatch, seed):
    """Passages that overlap, repeat within a text, and shards and sections of a few words."""
    monkeypatch.setattr(passages, "SECTION", 7)
    rnd = random.Random(seed)
    blocks = [[f"w{rnd.randint(0, 30)}" for _ in range(rnd.choice([5, 19, 20, 21, 60]))] for _ in range(8)]
    docs = []
    for d in range(40):
        parts = [rnd.choice(blocks) if rnd.random() < 0.7 else [f"u{d}{rnd.randint(0, 99)}"] for _ in range(rnd.randint(0, 6))]
        docs.append((d, rnd.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    docs.append((40, "a " * 100))
    assert found(passages.repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == by_hand(docs)


def test_query_matches_sql(spark):
    duck = compare.connect(FOLDER)
    assert compare.compare(queries.queries()["op4_passages"](spark, FOLDER), duck, queries.oracle_sql()["op4_passages"]) is None


def test_odd_table(odd, odd_rows):
    rows = [tuple(r) for r in passages.repeats(odd).collect()]
    assert len(rows) == len(odd_rows)
    by_id = {}
    for doc, n, gone, _ in rows:
        by_id.setdefault(doc, []).append((n, gone))
    assert by_id[1] == [(3, 0), (3, 0)] and by_id[2] == by_id[3] == by_id[4] == [(0, 0)]
    assert sorted(by_id[None]) == [(0, 0), (3, 0)]
    assert by_id[5] == [(30_000, 0)] and by_id[6] == [(30_001, 30_000)]
    assert by_id[7] == [(30, 0)] and sorted(by_id[8]) == [(31, 30), (32, 30)] and by_id[9] == [(30, 30)]
    assert by_id[12] == [(200, 199)] or by_id[12] == [(200, 180 + 19)]


def test_one_id_with_different_texts_keeps_one_copy(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    frame = spark.createDataFrame([(3, f"x {passage}"), (3, f"{passage} y")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in passages.repeats(frame).collect()) == [0, 25]


def test_texts_without_repeats(odd):
    left = passages.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in left.where("doc_id in (2, 4, 6, 7, 9)").collect()}
    assert texts[2] is None and texts[4] == " \t\n " and texts[6] == "end" and texts[9] == "" and texts[7].startswith("w0 w1")
    assert sorted(r["text"] for r in left.where("doc_id = 8").collect()) == ["other", "start end"]


def test_empty_table(odd):
    assert passages.repeats(odd.limit(0)).collect() == []
    assert passages.without_repeats(odd.limit(0)).collect() == []


def test_texts_of_one_id_get_only_their_own_windows(spark, monkeypatch):
    cut = passages._cut
    def watched(batches):
        def checked():
            for batch in batches:
                assert all(len(first) <= 11 for first in batch.column(3).to_pylist())
                yield batch
        return cut(checked())
    monkeypatch.setattr(passages, "_cut", watched)
    texts = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(20)]
    rows = [(None, f"{t} {end}") for t in texts for end in ("x", "y")]
    found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in found) == [0] * 20 + [30] * 20


def test_automaton_has_no_wide_node():
    """A root with a child for each word would be searched through for each word of a document."""
    rnd = np.random.default_rng(1)
    sections = [rnd.integers(1, 1 << 60, 83).astype(np.uint64) for _ in range(300)]
    shard = passages._Shard(sections)
    first = {shard.spelled(s)[0] for s in sections}
    assert len(first) ** 2 <= 2 * len(shard.words)
    doc = np.concatenate((sections[7][3:], sections[9], np.arange(5, dtype=np.uint64)))
    assert (7, -3) in shard.found(doc) and (9, 80) in shard.found(doc) and {i for i, _ in shard.found(doc)} == {7, 9}


def test_a_passage_is_not_sent_to_its_only_place_in_the_first_document(spark, monkeypatch):
    """Sections go where words may go, and only rows that lose words are written as changed."""
    locate = passages._locate
    def watched(batches):
        def checked():
            for batch in batches:
                assert 1 not in batch.column(0).to_pylist()
                yield batch
        for batch in locate(checked()):
            assert all(n > 0 for n in batch.column(2).to_pylist())
            yield batch
    monkeypatch.setattr(passages, "_locate", watched)
    passage = " ".join(f"p{i}" for i in range(40))
    twice = " ".join(f"t{i}" for i in range(25))
    docs = [(1, f"a {passage} b"), (2, f"c {passage}"), (3, f"{twice} d {twice}"), (4, f"e {passage} f {passage} {twice}")]
    assert found(passages.repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == by_hand(docs)


def test_runs_of_five_common_words_bring_no_text_in(spark, monkeypatch):
    """Short runs recur by chance; texts that share no run of eight words are not read again."""
    windows = passages._windows
    def watched(batches):
        for batch in batches:
            assert not batch.num_rows
            yield from windows(iter([batch]))
    monkeypatch.setattr(passages, "_windows", watched)
    docs = [(d, " ".join(w for k in range(30) for w in ("v", "w", "x", "y", "z", f"u{d}k{k}"))) for d in range(30)]
    assert found(passages.repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == by_hand(docs)
