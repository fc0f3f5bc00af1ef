"""Token counts that follow edits: a segment tree of pre-token runs for each document.

A leaf is a run of whole pre-tokens of about `LEAF` characters; leaves begin with white space that follows a
character that is none, where every pre-tokenizer of this family starts a pre-token whatever surrounds it. Inner nodes
hold the characters and tokens of what is below them. An edit finds its leaves by descending on characters, re-encodes
those leaves only (and a neighbour, if the edit has spoilt the boundary to it), and corrects the sums on the way up.
The leaves are the state that is stored with a document; a tree is set up from them in one pass.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W

LEAF = 400
_SPACES = " \n\t\r"
# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text in runs of whole pre-tokens of at least `size` characters, but for the last."""
    out, begin, at = [], 0, size
    while at < len(text):
        if text[at] in _SPACES and not text[at - 1].isspace():
            out.append(text[begin:at])
            begin, at = at, at + size
        else:
            found = [p for p in (text.find(c, at + 1) for c in _SPACES[:2]) if p > 0]
            at = min(found, default=len(text))
    if begin < len(text):
        out.append(text[begin:])
    return out


class Tree:
    """Sums of characters and tokens over the leaves, in one array each; node 1 is the root."""

    def __init__(self, chars: Iterable[int], tokens: Iterable[int]):
        chars, tokens = list(chars), list(tokens)
        self.size = 1 << max(0, (len(chars) - 1).bit_length())
        self.n = len(chars)
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins; past the end, the last leaf that is not empty."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if char - begin >= self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more, rise = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += rise
            node //= 2

    def state(self) -> tuple[list[int], list[int]]:
        """Leaves that are not empty."""
        kept = [(c, t) for c, t in zip(self.chars[self.size:self.size + self.n], self.tokens[self.size:], strict=False) if c]
        return [c for c, _ in kept], [t for _, t in kept]


class Document:
    """A text in leaves with their tree; edits change both."""

    def __init__(self, text: str, chars: Iterable[int], tokens: Iterable[int]):
        self.tree, self.parts, at = Tree(chars, tokens), [], 0
        for n in self.tree.chars[self.tree.size:self.tree.size + self.tree.n]:
            self.parts.append(text[at:at + n])
            at += n

    def _next(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.parts) and not self.parts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.parts) else None

    def _set(self, leaf: int, text: str) -> None:
        self.parts[leaf] = text
        self.tree.put(leaf, len(text), self.tree.tokens[leaf + self.tree.size])

    def apply(self, edits: list[tuple[int, int, str]], count) -> int:
        """Replace [start, end) by a string, for all edits, in characters of the text before any of them.

        Edits must not overlap; of several at one place, the earlier in the list comes first. `count` gives the tokens
        of a string. Returns how many characters were encoded again.
        """
        order = sorted(range(len(edits)), key=lambda i: (edits[i][0], edits[i][1], i))
        before, stale = self.tree.chars[1], set()
        if not self.parts and edits:
            self.__init__("", [0], [0])
        for i in reversed(order):  # from the end, so that places before an edit stay true
            start, end, new = edits[i]
            if not 0 <= start <= end <= before:
                raise ValueError("edits overlap or lie outside the text")
            before = start
            leaf, begin = self.tree.leaf_at(start)
            last, _ = self.tree.leaf_at(max(end - 1, start))
            whole = "".join(self.parts[leaf:last + 1])
            text = whole[:start - begin] + new + whole[end - begin:]
            for gone in range(leaf + 1, last + 1):
                self._set(gone, "")
            follow = self._next(last, 1)
            if text and follow is not None and text[-1].isspace():
                text += self.parts[follow]
                self._set(follow, "")
            previous = self._next(leaf, -1)
            if text and previous is not None and text[0] not in _SPACES:
                self._set(leaf, "")
                leaf, text = previous, self.parts[previous] + text
            self._set(leaf, text)
            stale.update(range(leaf, (last if follow is None else follow) + 1))
        for leaf in stale:
            self.tree.put(leaf, len(self.parts[leaf]), count(self.parts[leaf]))
        return sum(len(self.parts[leaf]) for leaf in stale)


def counted(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = LEAF) -> DataFrame:
    """(doc_id, text, n_tokens, leaf_chars, leaf_tokens): the state that edits start from.

    A null text is empty. Repeated rows and null ids give their own rows; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(path).encode_ordinary
        for batch in batches:
            for first, last, *_ in W.pieces(batch.column(1)):
                part = batch.slice(first, last - first)
                split = [leaves(t or "", size) for t in part.column(1).to_pylist()]
                tokens = [[len(count(leaf)) for leaf in found] for found in split]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).fill_null(""), pa.array(map(sum, tokens), pa.int64()),
                     pa.array([list(map(len, found)) for found in split], pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))],
                    ["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens"])

    plain = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")


EDITS = "array<struct<start:int,end:int,text:string>>"


def recounted(state: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """(doc_id, text, n_tokens, leaf_chars, leaf_tokens, n_edits, n_reencoded) after the edits of a state's column.

    Edits are (start, end, text) in characters of the text before any of them; null is none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            for first, last, *_ in W.pieces(batch.column(1)):
                out = []
                for doc, text, chars, tokens, changes in zip(*(c.to_pylist() for c in batch.slice(first, last - first).columns), strict=True):
                    d = Document(text, chars, tokens)
                    redone = d.apply([(e["start"], e["end"], e["text"]) for e in changes or []], lambda t: len(encode(t)))
                    kept = [(len(p), n) for p, n in zip(d.parts, d.tree.tokens[d.tree.size:], strict=False) if p]
                    out.append((doc, "".join(d.parts), d.tree.tokens[1], [c for c, _ in kept], [n for _, n in kept], len(changes or []), redone))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 ["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens", "n_edits", "n_reencoded"])

    return state.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.col(edits).cast(EDITS)).mapInArrow(
        run, "doc_id long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>, n_edits long, n_reencoded long")


_NUMBER = re.compile(r"[0-9]{4,}")


def cleaning(text: str) -> list[tuple[int, int, str]]:
    """Edits that a clean-up makes: lines that the text has already go, and numbers of four or more digits become 0."""
    out, seen, at, gone = [], set(), 0, []
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip() and line in seen:
            gone.append((at - 1, end))  # with the break before it
            out.append((at - 1, end, ""))
        seen.add(line)
        at = end + 1
    spots = iter([*gone, (len(text) + 1, len(text) + 1)])
    low, high = next(spots)
    for found in _NUMBER.finditer(text):
        while high <= found.start():
            low, high = next(spots)
        if found.end() <= low:
            out.append((found.start(), found.end(), "0"))
    return out


def cleaning_edits(text: str = "text") -> Column:
    """`cleaning` of a text column."""
    @F.arrow_udf(EDITS)
    def found(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        return pa.array([[dict(zip(("start", "end", "text"), e, strict=True)) for e in cleaning(t.as_py() or "")] for t in column], kind)
    return found(text)
