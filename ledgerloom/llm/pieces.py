"""SentencePiece encoding (BPE models with byte fallback) by vectorised merge rounds, and decoding.

Texts are cut into words where no piece of the model can cross, each different word of a batch is encoded once, and
all words are merged together: flat arrays hold the symbols of every word, each round finds the best pair of each
word by a segmented minimum of pair ranks, merges it at its leftmost places in all words at once and closes the gaps,
until no word has a pair left.

A piece is safe if no pair that contains it ranks before it. Then its other places in the word would be next
anyway, and are merged in the same round; otherwise only the leftmost place is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W

SPACE = "▁"
CACHE_WORDS = 400_000
_NONE = np.iinfo(np.int32).max


class Model:
    """The merge table of a model file."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) < 256 or any(sp.is_unused(i) for i in plain):
            raise ValueError("needs a BPE model with byte fallback and no unused pieces")
        if sp.decode(sp.encode(" ½  b ")) != " ½  b ":
            raise ValueError("needs a model that leaves characters and white space as they are")
        self.eos = sp.eos_id()
        piece = {sp.id_to_piece(i): i for i in plain}
        self.symbol = {s: i for s, i in piece.items() if len(s) == 1}
        for s in piece:  # single characters that are no piece themselves
            for c in s:
                self.symbol.setdefault(c, n + len(self.symbol))
        known = self.symbol | piece
        best = {i: r for r, i in enumerate(sorted(plain, key=lambda i: -sp.get_score(i)))}
        for before, after in zip(order := sorted(plain, key=lambda i: -sp.get_score(i)), order[1:]):
            if sp.get_score(before) == sp.get_score(after):
                best[after] = best[before]
        pairs = {(known[s[:k]], known[s[k:]]): i for s, i in piece.items() for k in range(1, len(s))
                 if s[:k] in known and s[k:] in known}
        self.span = 1 << int(max(known.values())).bit_length()
        keys = np.array([a * self.span + b for a, b in pairs], np.int64)
        made = np.array(list(pairs.values()), np.int32)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        self.rank = np.array([best[i] for i in self.made.tolist()], np.int32)
        self.safe = np.ones(n, bool)
        for (a, b), i in pairs.items():
            for part in (a, b):
                if part < n and part in best and best[i] <= best[part]:
                    self.safe[part] = False
        ties = np.bincount([best[i] for i in plain])
        for i in plain:
            self.safe[i] &= ties[best[i]] == 1
        self.new_symbol = max(known.values()) + 1
        crosses = any(a != SPACE and b == SPACE for s in piece for a, b in zip(s, s[1:]))
        breaks = "" if any("\n" in s and len(s) > 1 for s in piece) else "\\n"
        self.words = re.compile(".+" if crosses else f"{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+" + (f"|{breaks}" if breaks else ""), re.S)
        self.cache: dict[str, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank _NONE if there is none."""
        keys = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = (self.keys[at] == keys) & (left < self.span) & (right < self.span)
        return np.where(there, self.rank[at], _NONE), self.made[at]

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        chars, at = np.unique(flat, return_inverse=True)
        ids = np.array([self.symbol.get(chr(c), self.new_symbol + i) for i, c in enumerate(chars.tolist())], np.int64)
        symbols = ids[at]
        word = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        done_symbols, done_words = [], []
        last = np.append(word[1:] != word[:-1], True)
        rank, made = self.pair(symbols, np.append(symbols[1:], -1))
        rank[last] = _NONE
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(word)))
            low = np.minimum.reduceat(rank, starts)
            finished = np.repeat(low == _NONE, lengths)
            if finished.any():
                done_symbols.append(symbols[finished])
                done_words.append(word[finished])
                symbols, word, rank, made = (x[~finished] for x in (symbols, word, rank, made))
                if not len(symbols):
                    break
                lengths, low = lengths[low != _NONE], low[low != _NONE]
            places = np.flatnonzero(rank == np.repeat(low, lengths))
            first = np.append(True, word[places[1:]] != word[places[:-1]])
            run = np.append(True, (places[1:] != places[:-1] + 1) | first[1:])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            every_other = (np.arange(len(places)) - begin) % 2 == 0
            places = places[(first | self.safe[made[places]]) & every_other]
            symbols[places] = made[places]
            left = np.ones(len(symbols), bool)
            left[places + 1] = False
            moved = (np.cumsum(left) - 1)[places]
            symbols, word, rank, made = (x[left] for x in (symbols, word, rank, made))
            touched = np.unique(np.concatenate((moved, np.maximum(moved - 1, 0))))
            right = np.minimum(touched + 1, len(symbols) - 1)
            r, m = self.pair(symbols[touched], symbols[right])
            r[(right == touched) | (word[touched] != word[right])] = _NONE
            rank[touched], made[touched] = r, m
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        strange = np.flatnonzero(symbols >= self.library.get_piece_size())
        if len(strange):  # characters that are no piece: their bytes
            char = {int(s): chr(c) for s, c in zip(ids, chars.tolist())}
            parts = [[self.bytes[b] for b in char[s].encode("utf-8", "surrogatepass")] for s in symbols[strange].tolist()]
            wide = np.ones(len(symbols), np.int64)
            wide[strange] = [len(p) for p in parts]
            symbols, word = np.repeat(symbols, wide), np.repeat(word, wide)
            symbols[W.gathered(np.arange(len(symbols)), (np.cumsum(wide) - wide)[strange], wide[strange])] = np.concatenate(parts)
        edges = (np.searchsorted(word, np.arange(len(texts) + 1)) * 4).tolist()
        raw = symbols.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them, without begin or end id."""
        split = [self.words.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = list({w for found in split for w in found if w not in cache})
        cache.update(zip(new, self.encode_words(new) if new else []))
        return [np.frombuffer(b"".join(map(cache.__getitem__, found)), "<i4") for found in split]


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def encoded(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, ids) of every row, and with `decode` the library's decoding of the ids as `decoded`.

    ids are those of the sentencepiece library for the whole text, then the end id. A null or empty text gives the
    end id alone; null and repeated ids and rows are kept. Other columns are not read; an empty table gives an empty
    result. Memory is bounded by a piece of texts, a bounded cache of words and the longest text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        end = np.array([m.eos], "<i4")
        for batch in batches:
            for first, last, *_ in W.pieces(batch.column(1)):
                part = batch.slice(first, last - first)
                ids = [np.append(x, end) for x in m.encode([t or "" for t in part.column(1).to_pylist()])]
                edges = np.cumsum([0, *map(len, ids)])
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(ids)))]
                if decode:
                    columns.append(pa.array([m.library.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][:len(columns)])

    plain = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", decoded string" if decode else ""))


def decoded(ids: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """(doc_id, text): the library's decoding of each row's ids; null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model(path).library
        for batch in batches:
            texts = [None if x is None else library.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    plain = ids.select(F.col(key).alias("doc_id"), F.col(column).cast("array<int>").alias("ids"))
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, text string")
