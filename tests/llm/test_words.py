import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import words as W

TEXTS = ["a bb  ccc\n", "d", None, "", " bb a", "ccc d bb a x bb  ccc", "\x0b\x0c\r", "é ü z"]


@pytest.mark.parametrize("limit", [1, 8, 10_000])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_all_texts(limit, kind):
    found = []
    for first, last, data, edges in W.pieces(pa.chunked_array([pa.array(TEXTS[:3], kind), pa.array(TEXTS[3:], kind)]), limit):
        starts, stops, at = W.spans(data, edges)
        assert len(edges) == last - first + 1
        for i in range(last - first):
            found.append([bytes(data[a:b]).decode() for a, b in zip(starts[at[i]:at[i + 1]], stops[at[i]:at[i + 1]])])
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]


def test_hash_depends_on_the_word_alone(monkeypatch):
    data = np.frombuffer(b"ab abc ab c abc ab" * 50, np.uint8)
    starts, stops, _ = W.spans(data, np.array([0, len(data)]))
    whole = W.hashes(data, starts, stops)
    words = [bytes(data[a:b]) for a, b in zip(starts, stops)]
    assert len(set(whole.tolist())) == len(set(words))
    monkeypatch.setattr(W, "PIECE_BYTES", 7)
    assert (W.hashes(data, starts, stops) == whole).all()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 20])
def test_window_hashes_tell_runs_apart(n):
    h = W.mix(np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64))
    found = W.windows(h, n)
    runs = [tuple(h[i:i + n].tolist()) for i in range(len(h) - n + 1)]
    assert len(found) == len(runs)
    assert len({*zip(found.tolist(), runs)}) == len(set(runs)) == len(set(found.tolist()))
    assert len(W.windows(h[:n - 1], n)) == 0


def test_gathered():
    assert W.gathered(np.arange(10), np.array([7, 0, 3]), np.array([2, 0, 3])).tolist() == [7, 8, 3, 4, 5]
