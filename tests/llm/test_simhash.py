import random

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import links, simhash
from ledgerloom.llm.store import Workspace


def by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        words = words.replace(gap, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs):
    """Smallest id reachable, of (id, fingerprint) pairs."""
    fps = sorted({f for _, f in pairs})
    up = {f: f for f in fps}
    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {(d, f"{f:016x}", least.get(root(f))) for d, f in pairs}


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_odd_table(odd, odd_rows):
    found = rows_of(simhash.near_duplicates(odd))
    assert len(found) == len(odd_rows)
    assert set(found) == groups([(d, by_hand(t)) for d, t, _ in odd_rows])


def test_documents(documents):
    found = rows_of(simhash.near_duplicates(documents))
    assert set(found) == groups([(r["doc_id"], by_hand(r["text"])) for r in documents.collect()])


def test_empty_table(odd):
    assert rows_of(simhash.near_duplicates(odd.limit(0))) == []
    assert simhash.deduplicated(odd.limit(0)).columns == odd.columns


def test_one_of_each_group_stays(odd, odd_rows):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) == {c for _, _, c in groups([(d, by_hand(t)) for d, t, _ in odd_rows])}


@pytest.mark.parametrize("small", [256, 3])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, small):
    """Also where crowded buckets are cut again and flooded over a table."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rnd = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        base = rnd.getrandbits(64)
        for _ in range(25):
            base ^= 1 << rnd.randrange(64)
            fps |= {base, base ^ 1 << rnd.randrange(20) ^ 1 << rnd.randrange(64)}
    work = Workspace(spark, "test")
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = links.components(work, simhash.near_links(work, spark.createDataFrame([(f,) for f in signed], "fp long")))
    roots = {r["node"] % (1 << 64): r["root"] for r in found.collect()}
    wanted = groups([(i, f) for i, f in enumerate(sorted(fps))])
    ids = {int(h, 16): c for _, h, c in wanted}
    both = {f: roots.get(f, ("alone", f)) for f in fps}
    assert len({(ids[f], both[f]) for f in fps}) == len(set(ids.values())) == len(set(both.values()))


@pytest.mark.parametrize("n", [2, 40, 256, 700])
def test_spanning_links(n):
    rnd = np.random.default_rng(n)
    values = np.unique(rnd.integers(0, 1 << 14, n).astype(np.uint64) << np.uint64(30))
    a, b = simhash.spanning(values)
    assert len(a) < max(1, len(values)) and (np.bitwise_count(a ^ b) >= 1).all()
    up = {int(v): int(v) for v in values}
    def root(v):
        while up[v] != v:
            v = up[v]
        return v
    for x, y in zip(a.tolist(), b.tolist()):
        up[root(x)] = root(y)
    wanted = groups([(i, int(v)) for i, v in enumerate(values)])
    ids = {int(h, 16): c for _, h, c in wanted}
    assert len({(ids[v], root(v)) for v in ids}) == len(set(ids.values())) == len({root(v) for v in ids})


def test_components_of_a_long_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["root"] for r in links.components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}}


def test_different_texts_under_one_id_stay(spark):
    texts = [" ".join(f"t{i}w{k}" for k in range(50)) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (3, texts[2]), (3, texts[3]), (4, texts[3]), (5, texts[4]), (5, texts[4]), (None, texts[4])]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted({rows[i] for i in (0, 1, 3, 4, 6)}, key=str)
