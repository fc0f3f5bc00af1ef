"""Repeated passages across documents, removed everywhere but at their first place.

1. *Entered.* Every text gives its number of words, the SHA-256 of its words and its anchors: of each window of 20
   words, the smallest hash of the runs of eight words in it. Equal windows have equal anchors. Texts with the same
   words are one from here on: the first keeps its place, of the others every word goes.
2. *Confirmed.* Anchors that occur once are left out. Windows over the others are counted; those that
   occur twice recur, and the smallest document id is their first place.
3. *Passages.* The first document of each recurring window cuts its text there: runs of such windows, in sections of
   at most `SECTION` windows.
4. *Located.* A section is sent to the other documents that have one of its windows, and to its own if that has one
   twice. Each task compiles the sections of its documents into Aho-Corasick automata over word numbers, in shards of
   bounded size, and streams the documents through them. The keys are every 13th run of eight words of a section: any
   window of 20 words holds one. A key that is found lines the section up with the document, and the words on either
   side settle how far they agree.

Documents with one id are told apart by a hash of their text. Nothing but the words of a single text is held whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.store import Workspace, unused, worked_out

WINDOW = 20
RUN = 8
KEY = 8
STEP = WINDOW - KEY + 1
SECTION = 64
SHARD_WORDS = 400_000
BATCH_BYTES = 4_000_000
_LAST = (1 << 63) - 1


def _anchors(runs: np.ndarray) -> np.ndarray:
    """The anchor of each window: the smallest run hash in it."""
    low, width, span = runs, 1, WINDOW - RUN + 1
    if len(low) < span:
        return low[:0]
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def _texts(column: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bytes, word starts, word stops, word hashes) of each text."""
    for first, last, data, edges in W.pieces(column):
        starts, stops, at = W.spans(data, edges)
        h, raw = W.hashes(data, starts, stops), data.tobytes()
        for i in range(last - first):
            a, b, low = at[i], at[i + 1], edges[i]
            yield first + i, raw[low:edges[i + 1]], starts[a:b] - low, stops[a:b] - low, h[a:b]


def _joined(data: np.ndarray, edges: np.ndarray) -> Iterator[bytes]:
    """The words of each text with one space between them."""
    inside = ~W.GAP[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # a word and the byte behind it
    at = edges[edges < len(data)]
    keep[at] = inside[at]
    places = np.flatnonzero(keep)
    raw = np.where(inside, data, np.uint8(32))[places].tobytes()
    cuts = np.searchsorted(places, edges).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield raw[a:b].removesuffix(b" ")


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text -> doc_id, h, n_words, sha, anchors."""
    for batch in batches:
        counts, shas, anchors, sizes = [np.zeros(0, np.int64)], [], [np.zeros(0, np.uint64)], [0]
        for _, _, data, edges in W.pieces(batch.column(2)):
            starts, stops, at = W.spans(data, edges)
            counts.append(np.diff(at))
            shas.extend(hashlib.sha256(words).digest() for words in _joined(data, edges))
            # Over all texts of the piece at once; what reaches into the next text is cut off below.
            runs = W.windows(W.hashes(data, starts, stops), RUN)
            low = _anchors(runs)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a < WINDOW:
                    sizes.append(0)
                    continue
                mine = low[a:b - WINDOW + 1]
                found = np.unique(mine[np.flatnonzero(np.diff(mine, prepend=~mine[:1]))])
                own = np.sort(runs[a:b - RUN + 1])
                twice = own[1:][own[1:] == own[:-1]]
                if len(twice):  # one that this text has twice is listed twice
                    found = np.concatenate((found, found[np.isin(found, twice)]))
                anchors.append(found)
                sizes.append(len(found))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(anchors).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.concatenate(counts), pa.int64()), pa.array(shas, pa.binary()), lists],
            ["doc_id", "h", "n_words", "sha", "anchors"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, h, text, anchors -> a, b, doc, h, times: the windows over the given anchors, each once a document."""
    for batch in batches:
        edge, shared = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy().view(np.uint64)
        for first, _, data, edges in W.pieces(batch.column(2)):
            starts, stops, at = W.spans(data, edges)
            words = W.hashes(data, starts, stops)
            # Over all texts of the piece at once; what reaches into the next text is cut off below.
            low, every = _anchors(W.windows(words, RUN)), W.windows(words, WINDOW)
            places, rows, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), first):
                wanted = np.sort(shared[edge[row]:edge[row + 1]])
                if y - x < WINDOW or not len(wanted):
                    continue
                mine = low[x:y - WINDOW + 1]
                place = x + np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine)
                n = np.ones(len(place), np.int64)
                a = np.sort(every[place])
                if (a[1:] == a[:-1]).any():
                    _, at_first, n = np.unique(every[place], return_index=True, return_counts=True)
                    place = place[at_first]
                places.append(place)
                rows.append(np.full(len(place), row))
                times.append(n)
            place = np.concatenate(places)
            if len(place):
                b = W.windows(words, WINDOW, 1)[place]
                of = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[place].view(np.int64)), pa.array((b >> np.uint64(33)).astype(np.int32)),
                     batch.column(0).take(of), batch.column(1).take(of), pa.array(np.minimum(np.concatenate(times), 2))],
                    ["a", "b", "doc", "h", "times"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, h, text, first (window hashes) -> sections: doc, h, start, words, and the window hashes in each."""
    for batch in batches:
        out = []
        for row, raw, starts, stops, words in _texts(batch.column(2)):
            a = W.windows(words, WINDOW)
            places = np.unique(a, return_index=True)[1]  # a window's first place in this document
            mine = np.array(batch.column(3)[row].as_py(), np.int64).view(np.uint64)
            at = np.sort(places[np.isin(a[places], mine)])
            if not len(at):
                continue
            run = np.cumsum(np.diff(at, prepend=at[0] - 1) != 1)
            begin = np.flatnonzero(np.diff(run, prepend=-1))
            begin = np.concatenate([np.arange(x, y, SECTION) for x, y in zip(begin, [*begin[1:], len(at)], strict=True)])
            for x, y in zip(begin, [*begin[1:], len(at)], strict=True):
                low, high = int(at[x]), int(at[y - 1]) + WINDOW
                out.append((batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), low,
                            raw[starts[low]:stops[high - 1]].decode(), a[low:high - WINDOW + 1].view(np.int64)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         ["doc", "h", "start", "words", "windows"])


def _letters(ids: np.ndarray, base: int) -> str:
    """Word numbers as two characters each, their digits; number 0 is a word that no key has.

    The automaton looks for a character among all children of a node, and its root has a child for each first one.
    First and second characters differ, so that a key is found at whole words only.
    """
    codes = np.empty(2 * len(ids), "<u4")
    codes[::2] = ids % base + 1
    codes[1::2] = ids // base + base + 1
    return codes.tobytes().decode("utf-32-le")


class _Shard:
    """An automaton over the keys of some sections, given as word hashes."""

    def __init__(self, sections: list[np.ndarray]):
        self.sections = sections
        self.words = np.unique(np.concatenate(sections))
        self.base = math.isqrt(len(self.words)) + 1
        self.keys = ahocorasick.Automaton()
        for i, section in enumerate(sections):
            text = self.spelled(section)
            for at in range(0, len(section) - KEY + 1, STEP):
                key = text[2 * at:2 * (at + KEY)]
                places = self.keys.get(key, None)
                if places is None:
                    self.keys.add_word(key, [(i, at)])
                else:
                    places.append((i, at))
        self.keys.make_automaton()

    def spelled(self, h: np.ndarray) -> str:
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return _letters(np.where(self.words[at] == h, at + 1, 0), self.base)

    def found(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(section, place in the document at which it would begin) wherever a key occurs."""
        return {(i, end // 2 - KEY + 1 - at) for end, places in self.keys.iter(self.spelled(h)) for i, at in places}


def _agreeing(doc: np.ndarray, sections: list[np.ndarray], begin: np.ndarray) -> np.ndarray:
    """Words of the document in runs of 20 or more that agree with a section laid on it at its `begin`."""
    lengths = np.array([len(s) for s in sections])
    low, high = np.maximum(begin, 0), np.minimum(begin + lengths, len(doc))
    size = high - low
    at = W.gathered(np.arange(len(doc)), low, size)
    if len(at) < WINDOW:
        return at[:0]
    flat, first = np.concatenate(sections), np.cumsum(lengths) - lengths
    same = doc[at] == W.gathered(flat, first + low - begin, size)
    laid = np.repeat(np.arange(len(size)), size)
    sums = np.concatenate(([0], np.cumsum(same)))
    whole = (sums[WINDOW:] - sums[:-WINDOW] == WINDOW) & (laid[WINDOW - 1:] == laid[:len(laid) - WINDOW + 1])
    cover = np.zeros(len(at) + 1, np.int64)
    cover[:len(whole)] += whole
    cover[WINDOW:WINDOW + len(whole)] -= whole
    return at[np.cumsum(cover[:-1]) > 0]


def _remove(raw: bytes, starts: np.ndarray, stops: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the given words: what stood between kept words stays, one of the gaps where words went."""
    kept = np.flatnonzero(~gone)
    out, before = [], -1
    for first, last in zip(kept[np.diff(kept, prepend=-2) != 1], kept[np.diff(kept, append=len(gone) + 1) != 1], strict=True):
        if first:
            out.append(raw[stops[first - 1]:starts[first]] if out else b"")
        else:
            out.append(raw[:starts[0]])
        out.append(raw[starts[first]:stops[last]])
        before = last
    if before == len(gone) - 1 and before >= 0:
        out.append(raw[stops[-1]:])
    return b"".join(out)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, h, text, sections (doc, h, start, words) -> doc, h, n_removed, sha, kept text of those that lose a word."""
    for batch in (b.slice(first, last - first) for b in batches for first, last, *_ in W.pieces(b.column(2), BATCH_BYTES)):
        edge, items = batch.column(3).offsets.to_numpy(), batch.column(3).values
        *source, spelled = items.slice(edge[0], edge[-1] - edge[0]).flatten()
        number: dict[tuple[int, int, int], int] = {}
        asked = [number.setdefault(key, len(number)) for key in zip(*(c.to_pylist() for c in source), strict=True)]
        keys = list(number)
        sections = [h for *_, h in _texts(spelled.take(pa.array(np.unique(np.array(asked, np.int64), return_index=True)[1])))]
        edge = (edge - edge[0]).tolist()
        texts = list(_texts(batch.column(2)))
        rows, gone = [], [np.zeros(len(starts), bool) for _, _, starts, _, _ in texts]
        ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        sent = [set(asked[a:b]) for a, b in zip(edge, edge[1:], strict=False)]
        size = np.cumsum([len(s) for s in sections]) // SHARD_WORDS
        for part in np.unique(size).tolist():
            chosen = np.flatnonzero(size == part).tolist()
            shard = _Shard([sections[i] for i in chosen])
            for row, _, _, _, words in texts:
                me, mine, laid = ids[row], sent[row], []
                for i, begin in shard.found(words):
                    # Sections sent for another document of this task are none of this one's.
                    if chosen[i] in mine:
                        *source, start = keys[chosen[i]]
                        if tuple(source) < me or tuple(source) == me and begin != start:
                            laid.append((i, begin))
                if laid:
                    gone[row][_agreeing(words, [shard.sections[i] for i, _ in laid], np.array([b for _, b in laid]))] = True
        for row, raw, starts, stops, _ in texts:
            lost = gone[row]
            if lost.any():
                left = [raw[a:b] for a, b in zip(starts[~lost].tolist(), stops[~lost].tolist(), strict=True)]
                rows.append((*ids[row], int(lost.sum()), hashlib.sha256(b" ".join(left)).digest(),
                             _remove(raw, starts, stops, lost).decode()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         ["doc", "h", "n_removed", "sha", "kept"])


def _plain(documents: DataFrame, key: str, text: str) -> DataFrame:
    """doc (null ids come last), h, text."""
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"),
                            F.xxhash64(text).alias("h"), text.alias("text"))


def _repeats(work: Workspace, documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entered rows (doc, h, n_words, sha); first documents (sha, doc, h); changed ones (doc, h, n_removed, sha, kept)."""
    plain = _plain(documents, key, text)
    entered = work.keep(plain.mapInArrow(
        _enter, "doc long, h long, n_words long, sha binary, anchors array<long>"), "entered")
    first = work.keep(entered.groupBy("sha").agg(F.min(F.struct("doc", "h")).alias("f")).select("sha", "f.doc", "f.h"), "first")
    spread = (entered.where(F.size("anchors") > 0).join(first, ["sha", "doc", "h"])
              .dropDuplicates(["doc", "h"]).select("doc", "h", F.explode("anchors").alias("anchor")))
    spread = work.keep(spread, "anchors")
    often = spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    mine = spread.join(often, "anchor").groupBy("doc", "h").agg(F.collect_list("anchor").alias("anchors"))
    shared = work.keep(plain.join(work.keep(mine, "shared"), ["doc", "h"]).dropDuplicates(["doc", "h"]), "texts")
    work.drop("anchors", "shared")
    seen = work.keep(shared.select("doc", "h", "text", "anchors").mapInArrow(
        _windows, "a long, b int, doc long, h long, times long"), "windows")
    firsts = (seen.groupBy("a", "b").agg(F.min(F.struct("doc", "h")).alias("f"), F.sum("times").alias("n")).where("n > 1"))
    own = firsts.groupBy("f.doc", "f.h").agg(F.collect_list("a").alias("first"))
    texts = shared.select("doc", "h", "text")
    cut = work.keep(texts.join(own, ["doc", "h"]).select("doc", "h", "text", "first").mapInArrow(
        _cut, "doc long, h long, start long, words string, windows array<long>"), "sections")
    source = cut.select(F.struct("doc", "h", "start").alias("section"), F.explode("windows").alias("a"))
    elsewhere = (F.col("doc") != F.col("section.doc")) | (F.col("h") != F.col("section.h")) | (F.col("times") > 1)
    asked = seen.select("a", "doc", "h", "times").join(source, "a").where(elsewhere).select("doc", "h", "section").distinct()
    sent = (asked.join(cut.select(F.struct("doc", "h", "start").alias("section"), "words"), "section")
            .groupBy("doc", "h").agg(F.collect_list(F.struct("section.doc", "section.h", "section.start", "words")).alias("sections")))
    sent = work.keep(sent, "sent")
    work.drop("windows", "sections")
    changed = work.keep(texts.join(sent, ["doc", "h"]).mapInArrow(
        _locate, "doc long, h long, n_removed long, sha binary, kept string"), "changed")
    return entered.select("doc", "h", "n_words", "sha"), first, changed


def _all_gone(n_words: str = "n_words"):
    """A later text with the same words: every word is in a window that starts earlier, if there is a window."""
    return F.col(n_words) >= WINDOW


def repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    A word goes if a window of 20 words over it also starts earlier: in a document with a smaller id, or earlier in
    its own. A null text has no words. Rows with a null id come last. Rows with one id and different texts are
    ordered by a hash of the text; rows with one id and text are one document and give the same row each. Texts of
    fewer than 20 words lose nothing. Other columns are not read; an empty table gives an empty result.
    """
    def build(work: Workspace) -> DataFrame:
        entered, first, changed = _repeats(work, documents, key, text)
        first = first.select("sha", F.col("doc").alias("first_doc"), F.col("h").alias("first_h"))
        lost = changed.select("doc", "h", F.col("n_removed").alias("lost"), F.col("sha").alias("left"))
        rows = entered.join(first, "sha").join(lost, ["doc", "h"], "left")
        is_first = (F.col("doc") == F.col("first_doc")) & (F.col("h") == F.col("first_h"))
        empty = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
        gone = ~is_first & _all_gone()
        return rows.select(
            F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "n_words",
            F.when(gone, F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
            F.lower(F.hex(F.when(gone, empty).otherwise(F.coalesce("left", "sha")))).alias("kept_sha256"))
    return worked_out(documents.sparkSession, "passages", build)


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the words that `repeats` removes; white space between kept words stays.

    All columns and rows stay; a document that loses every word gets an empty text.
    """
    def build(work: Workspace) -> DataFrame:
        entered, first, changed = _repeats(work, documents, key, text)
        copies = entered.where(_all_gone()).join(
            first.select("sha", F.col("doc").alias("first_doc"), F.col("h").alias("first_h")), "sha").where(
            "doc <> first_doc or h <> first_h").select("doc", "h", F.lit("").alias("kept")).distinct()
        return changed.where("n_removed > 0").select("doc", "h", "kept").unionByName(copies)
    doc, h, kept = (unused(documents, name) for name in ("_doc", "_h", "_kept"))
    edits = worked_out(documents.sparkSession, "passages", build).select(
        F.col("doc").alias(doc), F.col("h").alias(h), F.col("kept").alias(kept))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    same = (F.coalesce(F.col(key).cast("long"), F.lit(_LAST)) == F.col(doc)) & (F.xxhash64(whole) == F.col(h))
    return documents.join(edits, same, "left").withColumn(text, F.coalesce(kept, text)).drop(doc, h, kept)
