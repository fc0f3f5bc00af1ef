"""Benchmark decontamination: three-word seeds find passages, Smith-Waterman alignment scores them.

Words are runs of letters and digits, lower-cased. Every run of three words of a test item is a seed, and every seed
counts, however frequent it is: an edited copy may have kept only those that other texts have too. Where a seed occurs
in a document, the item is laid on it with room for all the words that a copy may have gained; no alignment through the
seed with a wanted score reaches further. Stretches of an item that overlap are one. A stretch is aligned with its item
word by word (match 2, other word or gap -1) unless its words rule out the wanted score in any order: a word of the
item counts 2 there, any other -1, and the best run of words is a bound of the alignment. So a common phrase costs a
look at the words around it and loses nothing. The score is the best alignment's over that of the item with itself, so
edited and partly quoted copies score by what is left.

The seeds of a slice of the benchmark go to the tasks; a slice has `SLICE` seeds at most, and a larger benchmark is
searched in several slices. An item of more than `PART` words is found by any passage of it that long: it is aligned in
parts of that length, the last of which reaches back into the one before, so that none is shorter; the best part counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.store import Workspace, unused, worked_out

SEED = 3
PART = 400
SLICE = 500_000
LEAST = 0.5
_MATCH, _OTHER = 2, -1
_CELLS = 500_000
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, number of words before each row and after the last) of pieces of a text column."""
    for first, _, data, edges in W.pieces(pc.utf8_lower(column)):
        starts, stops, at = W.spans(data, edges, _GAP)
        yield first, W.hashes(data, starts, stops), at


@dataclass
class Seeds:
    """Seeds of some items: sorted different hashes, and for each the items and places it comes from."""
    values: np.ndarray
    edges: np.ndarray  # of each value in item and place
    item: np.ndarray
    place: np.ndarray
    words: list[np.ndarray]  # of each item
    ids: list[int | None]
    filter: np.ndarray
    sizes: np.ndarray  # words of each item
    has: np.ndarray  # sorted hashes of (item, word)

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> "Seeds":
        ids, words = [], []
        for first, h, at in word_hashes(pa.array([t for _, t in rows], pa.string())):
            for i in range(len(at) - 1):
                whole = h[at[i]:at[i + 1]]
                for low in [*range(0, len(whole) - PART, PART), max(0, len(whole) - PART)]:
                    ids.append(rows[first + i][0])
                    words.append(whole[low:low + PART])
        runs = [W.windows(w, SEED) for w in words]
        every = np.concatenate([np.zeros(0, np.uint64), *runs])
        sizes = [len(r) for r in runs]
        item = np.repeat(np.arange(len(words)), sizes)
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in sizes]]).astype(np.int64)
        return cls.sorted(every, item, place, words, ids)

    @classmethod
    def sorted(cls, every, item, place, words, ids) -> "Seeds":
        order = np.argsort(every, kind="stable")
        values, first = np.unique(every[order], return_index=True)
        filter_ = np.zeros(1 << 20, bool)
        filter_[values >> np.uint64(44)] = True
        sizes = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        has = np.unique(_of_item(np.concatenate([np.zeros(0, np.uint64), *words]), owner))
        return cls(values, np.append(first, len(every)), item[order], place[order], words, ids, filter_, sizes, has)

    def found(self, h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the word hashes of texts (bounded by edges) at which a seed begins, and the number of its value."""
        runs = W.windows(h, SEED)
        if not len(runs) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[runs >> np.uint64(44)])
        value = np.minimum(np.searchsorted(self.values, runs[at]), len(self.values) - 1)
        there = self.values[value] == runs[at]
        there &= at + SEED <= edges[np.searchsorted(edges, at, "right")]  # not over two texts
        return at[there], value[there]

    def bounds(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray) -> np.ndarray:
        """What the alignment of each item with h[low:high] cannot exceed."""
        n = high - low + 1  # a gap before each stretch parts it from the one before
        where = W.gathered(np.arange(len(h) + 1), low, n) - 1
        begin = np.cumsum(n) - n
        key = _of_item(h[where], np.repeat(item, n))
        at = np.minimum(np.searchsorted(self.has, key), len(self.has) - 1)
        worth = np.where(self.has[at] == key, _MATCH, _OTHER).astype(np.int64)
        worth[begin] = -_MATCH * (len(where) + 1)
        total = np.cumsum(worth)
        return np.maximum.reduceat(total - np.minimum.accumulate(total), begin)


def _of_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A hash of each word and the item it is looked for in."""
    return W.mix(words ^ W.mix(item.astype(np.uint64) + np.uint64(1)))


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its text, and the text word after it."""
    rows, width = max(map(len, items)), max(map(len, texts))
    a = np.zeros((len(items), rows), np.uint64)
    b = np.zeros((len(items), width), np.uint64)
    real_a, real_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[i, :len(x)], real_a[i, :len(x)] = x, True
        b[i, :len(y)], real_b[i, :len(y)] = y, True
    slope = np.arange(width, dtype=np.int32)
    above = np.zeros((len(items), width + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for r in range(rows):
        same = (a[:, r, None] == b) & real_a[:, r, None] & real_b
        here = np.maximum(above[:, :-1] + np.where(same, _MATCH, _OTHER).astype(np.int32), above[:, 1:] + _OTHER)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope, axis=1) - slope  # gaps along the text cost one a word
        top = here.argmax(1)
        score = here[np.arange(len(items)), top]
        better = score > best
        best[better], end[better] = score[better], top[better] + 1
        above[:, 1:] = here
    return best, end


def _stretches(seeds: Seeds, h: np.ndarray, edges: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, from, to) of the stretches of some texts on which items are to be laid, in parts of bounded size."""
    at, value = seeds.found(h, edges)
    n = seeds.edges[value + 1] - seeds.edges[value]
    upto, first = np.cumsum(n), 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - n[first] + _CELLS, "right")))
        some = slice(first, last)
        first = last
        which = W.gathered(np.arange(len(seeds.item)), seeds.edges[value[some]], n[some])
        item, place = seeds.item[which], np.repeat(at[some], n[some])
        text = np.searchsorted(edges, place, "right") - 1
        begin = place - seeds.place[which]
        order = np.lexsort((begin, text, item))
        item, text, begin = item[order], text[order], begin[order]
        gained = (_MATCH * (1 - least) * seeds.sizes[item]).astype(np.int64) + 1  # more words would cost too much
        low = np.maximum(begin - gained, edges[text])
        high = np.minimum(begin + seeds.sizes[item] + gained, edges[text + 1])
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])
        begins = np.flatnonzero(new)
        item, text, low, high = item[begins], text[begins], low[begins], high[np.append(begins[1:], len(new)) - 1]
        width, done = np.cumsum(high - low + 1), 0
        while done < len(item):
            stop = max(done + 1, int(np.searchsorted(width, width[done] + _CELLS)))
            part = slice(done, stop)
            done = stop
            good = seeds.bounds(item[part], low[part], high[part], h) >= least * _MATCH * seeds.sizes[item[part]]
            yield text[part][good], item[part][good], low[part][good], high[part][good]


def _aligned(seeds, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        for batch in batches:
            out: dict[tuple[int, int | None], tuple[float, int]] = {}
            for first, h, at in word_hashes(batch.column(1)):
                for stretches in _stretches(s, h, at, least):
                    todo = list(zip(*[x.tolist() for x in stretches], strict=True))
                    todo.sort(key=lambda x: (x[3] - x[2], len(s.words[x[1]])))
                    while todo:
                        n = max(1, min(len(todo), _CELLS // (todo[-1][3] - todo[-1][2])))
                        part, todo = todo[-n:], todo[:-n]
                        score, end = align([s.words[x[1]] for x in part], [h[x[2]:x[3]] for x in part])
                        for (row, item, low, _), top, stop in zip(part, score.tolist(), end.tolist(), strict=True):
                            share = top / (_MATCH * len(s.words[item]))
                            key, stop = (first + row, s.ids[item]), int(at[row]) - low - stop
                            if share >= least and (share, stop) > out.get(key, (0, 0)):
                                out[key] = (share, stop)
            keys = sorted(out, key=lambda k: (k[0], k[1] is None, k[1] or 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([out[k][0] for k in keys], pa.float64()), pa.array([-out[k][1] for k in keys], pa.int64())],
                ["doc_id", "item_id", "score", "end_word"])
    return run


def contaminated(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, end_word) of each document that holds an item with a score of at least `least`.

    score is 1 for a whole copy; end_word is the number of the document's words up to the end of the alignment (the
    earliest of equally good ones). Null texts and items of fewer than three words match nothing. Repeated rows and
    null ids give their own rows; equal items of different ids each give one. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    plain = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tests = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    # A text has no more words than half its characters and one.
    bound = tests.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    slices = int(bound // SLICE) + 1

    def build(work: Workspace) -> DataFrame:
        out = None
        for part in range(slices):
            rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == part).distinct().collect()
            seeds = Seeds.of(sorted({(r["item_id"], r["text"]) for r in rows}, key=str))
            held = spark.sparkContext.broadcast(seeds)
            found = work.keep(plain.mapInArrow(_aligned(held, least), "doc_id long, item_id long, score double, end_word long"), "found")
            out = found if out is None else out.unionByName(found)
        return out
    return worked_out(spark, "benchmark", build)


def clean(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, unchanged.

    Texts decide, so a clean text stays beside a contaminated one of the same id or of no id. Rows without a text hold
    nothing and go with a contaminated row of their id.
    """
    name, none = unused(documents, "_found"), F.col(text).isNull()
    h = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    texts = documents.select(h.alias("doc_id"), F.col(text).alias("text"))
    found = contaminated(texts, items, **options).select(F.col("doc_id").alias(name)).distinct()
    left = documents.join(found, h == F.col(name), "left_anti")
    if documents.where(none).isEmpty():
        return left
    ids = documents.join(found, h == F.col(name), "left_semi").select(F.col(key).cast("long").alias(name)).distinct()
    return left.join(ids, none & F.col(key).cast("long").eqNullSafe(F.col(name)), "left_anti")
