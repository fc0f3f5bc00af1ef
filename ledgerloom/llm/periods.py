"""Periodic runs: stretches of words that repeat with a period, found and collapsed to their first period.

A run is a stretch with smallest period q (words q apart are equal) of at least `LEAST` words and two periods, which
no neighbouring word extends. Method: an online sparse diagonal programme. Going through the words in order, each
earlier occurrence of the words read here, q words ago, lengthens the match on diagonal q by one; a diagonal that gets
no match has ended and emits its run at once if it was long enough.

Sparse: a run of period q has at least max(LEAST - q, q) matches in a row, six or more, so an occurrence is one of six
words for periods up to 11, of 12 words for periods from 12 to 23, of 24 up to 47, and so on: as many words as the
match must have at least, no run is missed. Only windows found twice in a text go on to the next size. Where a window
overlaps its own last occurrence, d words ago, and that one again, all of it has period d; its occurrences 2d, 3d, ...
words ago end together with the diagonal of d, never give a run of their own, and are passed over. So a text of one
repeated word costs as little as prose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.store import unused

LEAST = 12
SEED = 6  # max(LEAST - q, q) is smallest at q = LEAST / 2
_WORD = r"[^\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _occurrences(at: np.ndarray, code: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (window start, words back to an equal window) with low <= back < high, and which windows occur twice.

    `at` ascends; occurrences within a stretch of one smaller period are left out but for the nearest.
    """
    order = np.argsort(code, kind="stable")
    place, sorted_code = at[order], code[order]
    again = np.zeros(len(place), bool)
    again[1:] = sorted_code[1:] == sorted_code[:-1]
    step = np.zeros(len(place), np.int64)
    step[1:] = place[1:] - place[:-1]
    twice = again.copy()
    twice[:-1] |= again[1:]
    # An element in a row of equal overlapping steps goes back to the row's first window at once.
    begins = np.ones(len(place), bool)
    begins[1:] = ~(again[1:] & again[:-1] & (step[1:] == step[:-1]) & (step[1:] < size))
    head = np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0)) - 1
    me = np.flatnonzero(again)
    near = step[me]
    fits = (near >= low) & (near < high)
    found = [(place[me[fits]], near[fits])]
    now = head[me]
    while len(me):
        on = again[now]
        me, now = me[on], now[on] - 1
        back = place[me] - place[now]
        on = back < high
        me, now, back = me[on], now[on], back[on]
        fits = back >= low
        found.append((place[me[fits]], back[fits]))
    keep = np.zeros(len(at), bool)
    keep[order[twice]] = True
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), keep


def _matches(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (start of a window, period) that can lie on a run's diagonal, in order of the start."""
    code = W.windows(h, SEED)
    none = np.zeros(0, np.int64)
    code = W.mix(code ^ W.mix(text[:len(code)].astype(np.uint64) * _STEP))
    at = np.flatnonzero(text[:len(code)] == text[SEED - 1:])  # windows inside one text
    code, size, low, found = code[at], SEED, 1, [(none, none)]
    while len(at):
        starts, back, keep = _occurrences(at, code, size, low, 2 * size)
        found.append((starts, back))
        at, code = at[keep], code[keep]
        ahead = np.searchsorted(at, at + size)  # two windows side by side make one of twice the size
        joins = ahead < len(at)
        joins[joins] = (at[ahead[joins]] == at[joins] + size) & (text[at[ahead[joins]]] == text[at[joins]])
        at, code = at[joins], W.mix(code[joins] + W.mix(code[ahead[joins]] + _STEP))
        size, low = 2 * size, 2 * size
    starts, back = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.argsort(starts, kind="stable")
    return starts[order], back[order]


def runs_of(h: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in words with hashes h; `text` numbers the text of each word."""
    out: list[tuple[int, int, int]] = []

    def end(diagonals: dict[int, int], last: int) -> None:
        for q, first in diagonals.items():
            size = SEED
            while q >= 2 * size:
                size *= 2
            if last - first + size >= max(LEAST - q, q):
                out.append((first - q, last + size - first + q, q))

    starts, back = _matches(h, text)
    active: dict[int, int] = {}  # period -> start of the first window on its diagonal
    before = -2
    cuts = np.flatnonzero(np.diff(starts, prepend=-1)).tolist()
    lags = back.tolist()
    for here, begin, stop in zip(starts[cuts].tolist(), cuts, [*cuts[1:], len(lags)]):
        if here != before + 1:
            end(active, before)
            active = {}
        longer = {q: active.pop(q, here) for q in lags[begin:stop]}
        end(active, before)
        active, before = longer, here
    end(active, before)
    return out


def _read(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, starts and stops of words, words before each text, runs: text, start, length, period)."""
    for first, last, data, edges in W.pieces(column):
        starts, stops, before = W.spans(data, edges)
        text = np.repeat(np.arange(last - first), np.diff(before))
        runs = np.array(runs_of(W.hashes(data, starts, stops), text), np.int64).reshape(-1, 3)
        owner = text[runs[:, 0]]
        runs = np.column_stack([owner, runs[:, 0] - before[owner], runs[:, 1], runs[:, 2]])
        yield first, last, data, starts, stops, before, runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _kept(starts: np.ndarray, before: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    change = np.zeros(len(starts) + 1, np.int64)
    begin = before[runs[:, 0]] + runs[:, 1]
    np.add.at(change, begin + runs[:, 3], 1)
    np.add.at(change, begin + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


def _joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    sizes = np.where(kept, stops - starts + 1, 0)
    places = np.concatenate(([0], np.cumsum(sizes)))
    raw = W.gathered(np.append(data, np.uint8(32)), starts[kept], sizes[kept])
    raw[places[1:][kept] - 1] = 32
    whole, edges = raw.tobytes(), places[before].tolist()
    return [whole[a:max(a, b - 1)] for a, b in zip(edges, edges[1:])]


def _plain(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def _id_type(documents: DataFrame, key: str) -> str:
    return documents.select(F.col(key)).schema[0].dataType.simpleString()


def runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, period) of every run in every row's text, words numbered from 0.

    Words are stretches without space, tab, line feed, vertical tab, form feed and carriage return. Null and empty
    texts have no runs. Repeated rows give their own runs, ids may be null and of any type, other columns are not
    read, an empty table gives no rows. Memory is bounded by a piece of texts or the longest text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, _, _, _, _, found in _read(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(found[:, 0] + first)), *[pa.array(found[:, k]) for k in (1, 2, 3)]],
                    ["doc_id", "start", "length", "period"])
    return _plain(documents, key, text).mapInArrow(run, f"doc_id {_id_type(documents, key)}, start long, length long, period long")


def collapsed(documents: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed) of every row.

    start to exponent_milli describe the longest run (ties: the first, then the smallest period) and are null without
    a run; `runs` has a line `start,length,period` for each run, by start and period; `collapsed` is the text without
    the words that a run has after its first period, words joined by one space. With `digests` the last two are
    SHA-256 in hexadecimal, named runs_sha256 and collapsed_sha256. Null and empty texts give no runs and an empty
    text; odd rows as in `runs`.
    """
    ends = ["runs_sha256", "collapsed_sha256"] if digests else ["runs", "collapsed"]

    def finished(values: list[bytes]) -> pa.Array:
        if digests:
            return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
        return pa.array(values, pa.binary()).cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts, stops, before, found in _read(batch.column(1)):
                n = last - first
                lines: list[list[bytes]] = [[] for _ in range(n)]
                best: list[tuple | None] = [None] * n
                for owner, start, length, period in found.tolist():
                    lines[owner].append(b"%d,%d,%d\n" % (start, length, period))
                    if best[owner] is None or length > best[owner][1]:
                        best[owner] = (start, length, period, 1000 * length // period)
                kept = _joined(data, starts, stops, before, _kept(starts, before, found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.bincount(found[:, 0], minlength=n).astype(np.int64)),
                     *[pa.array([b and b[k] for b in best], pa.int64()) for k in range(4)],
                     finished([b"".join(x) for x in lines]), finished(kept)],
                    ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", *ends])
    return _plain(documents, key, text).mapInArrow(
        run, f"doc_id {_id_type(documents, key)}, n_runs long, start long, length long, period long, exponent_milli long, "
             f"{ends[0]} string, {ends[1]} string")


def looped(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with a loop put into one text of ten, chosen by its id: the contract's test of this operator.

    With h = crc32(id), g = h / 10 and n words: where h % 10 = 0 and n > 0, words from a = g % n on repeat the first
    p = 1 + (n - a) / (3 + g % 8) of them. Such texts come back as words joined by one space; texts with a null id
    and all other columns are left as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words, fields = (unused(documents, name) for name in ("_words", "_loop"))
    hit = (F.pmod(h, F.lit(10)) == 0) & F.col(text).rlike(_WORD)
    g = F.floor(h / 10)
    n = F.size(words).cast("long")
    with_words = documents.withColumn(words, F.when(hit, F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0))))
    a = F.pmod(g, n)
    shaped = with_words.withColumn(fields, F.when(F.col(words).isNotNull(), F.struct(
        a.cast("int").alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int").alias("p"))))
    begin, period = F.col(fields)["a"], F.col(fields)["p"]

    def word(i: Column) -> Column:
        return F.get(F.col(words), F.when(i < begin, i).otherwise(begin + F.pmod(i - begin, period)).cast("int"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.size(words) - 1), word), " ")
    return shaped.withColumn(text, F.when(F.col(fields).isNotNull(), repeated).otherwise(F.col(text))).drop(words, fields)
