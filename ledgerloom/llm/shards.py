"""Token ids on disk: shards of raw ids in document order, and a minimal perfect hash index over the document keys.

Files. `shards` holds one row a shard: its part and number, its ids as raw little-endian numbers (two bytes each where
the vocabulary allows, else four), and the keys and lengths of its documents. Rows are in ascending order of document
id by (part, number). `index` holds one row a bucket: the bit arrays of the hash, one a level, and for each of its n
slots a fingerprint of the key, the shard, the offset in it and the number of ids. Spark writes and reads both, so a
lost task leaves no half shard, and any file system will do.

Hash. A bucket's keys go to a bit array of twice their number; bits that exactly one key hits are set, the other keys
go on to the next level. A key's slot is the number of set bits before its own, so n keys have slots 0 to n - 1. A
lookup reads one bucket and compares one fingerprint: foreign keys are told apart up to one in 2^32.

A key is a document id and a copy number (0 where ids do not repeat).
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.store import put

SHARD_IDS = 500_000
BUCKET_KEYS = 8_000
RANGE_BYTES = 64 << 20  # of the stored table, by Spark's estimate
CACHE_WORDS = 1_000_000
PIECE = 2_000_000  # bytes of texts encoded at once
_TAIL = b".,!?;:#*$%&|"
_IS_TAIL, _IS_WORD = np.zeros(256, bool), np.zeros(256, bool)
_IS_TAIL[list(_TAIL)] = True
_IS_WORD[[b for b in range(128) if chr(b).isalnum()]] = True
_LETTERS = re.compile(rb"[a-z]+").fullmatch
_NULL = -(1 << 63)
_SLOT = [("print", "<u4"), ("part", "<i4"), ("number", "<i4"), ("offset", "<i8"), ("size", "<i8")]
_MARK = "<|startoftext|>"


class Encoder:
    """Ids of whole texts from the tokenizers library, each different word of a piece looked up once.

    White space separates pre-tokens and gives no id of its own, so a text's ids are those of its words in turn. The
    vocabulary lower-cases, so words are looked up with A-Z lowered; and punctuation that ends a word whose normalised
    form ends with a letter or digit is a pre-token of its own, so it is looked up apart. Words of texts with the
    opening of a special token are encoded as they are. Words are told apart by 64-bit hashes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.mark = self.library.token_to_id(_MARK)
        probe = "a b, c\td\n\nE"
        if self.mark is None or self._ids(probe) != [i for w in probe.split() for i in self._ids(w)]:
            raise ValueError("needs a vocabulary that drops white space")
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        if self._ids("AbC 1,;") != self._ids("abc") + self._ids("1") + self._ids(",;"):
            raise ValueError("needs a vocabulary that lower-cases and splits at punctuation")
        wide = np.dtype(self.width).itemsize
        self.codes = [i.to_bytes(wide, "little") for i in range(self.library.get_vocab_size())]
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.codes.__getitem__, ids))

    def _ends_a_word(self, core: bytes) -> bool:
        """Whether punctuation after these bytes is a pre-token of its own: decided by the last normalised character."""
        shaped = self.library.normalizer.normalize_str(core.decode("utf-8", "replace")) if self.library.normalizer else core.decode("utf-8", "replace")
        return bool(shaped) and unicodedata.category(shaped[-1])[0] in "LN"

    def _learn(self, words: list[bytes]) -> None:
        """Put the ids of words into the cache. Runs of a to z are one pre-token and go to the library's model alone."""
        cache, tokenize, codes, rest = self.cache, self.library.model.tokenize, self.codes, []
        for w in words:
            if _LETTERS(w):
                found = tokenize(w.decode())
                cache[w] = codes[found[0].id] if len(found) == 1 else b"".join([codes[t.id] for t in found])
            else:
                rest.append(w)
        ends = {}
        for w in rest:  # `encode` splits off what follows ASCII only
            core = w.rstrip(_TAIL)
            if core and len(core) < len(w) and core[-1:] >= b"\x80" and b"<|" not in w and self._ends_a_word(core):
                ends[w] = core, w[len(core):]
        self._encode_parts([w for w in {*(w for w in rest if w not in ends), *(p for pair in ends.values() for p in pair)} if w not in cache])
        for w, (core, tail) in ends.items():
            cache[w] = cache[core] + cache[tail]

    def _encode_parts(self, names: list[bytes]) -> None:
        """Words between marks in one text each 200; those with an opening of a special token on their own."""
        alone = [w for w in names if b"<|" in w]
        self.cache.update((w, self._raw(self._ids(w.decode("utf-8", "replace")))) for w in alone)
        names = [w for w in names if b"<|" not in w]
        plain = [w.decode("utf-8", "replace") for w in names]
        groups = [plain[i:i + 200] for i in range(0, len(plain), 200)]
        found = self.library.encode_batch_fast([f" {_MARK} ".join(g) for g in groups], add_special_tokens=False)
        at = 0
        for group, one in zip(groups, found, strict=True):
            ids = np.array(one.ids, np.int64)
            for part in np.split(ids, np.flatnonzero(ids == self.mark)):
                self.cache[names[at]] = part[part != self.mark].astype(self.width).tobytes()
                at += 1

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a piece, one after the other, and how many lie before each text."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        opening = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        special = np.unique(np.searchsorted(edges, opening, "right") - 1)
        lowered = data | (((data >= 65) & (data <= 90)).view(np.uint8) << 5)
        for text in special.tolist():
            lowered[edges[text]:edges[text + 1]] = data[edges[text]:edges[text + 1]]
        starts, stops, before = _with_tails(lowered, *W.spans(lowered, edges))
        _, first, which = np.unique(W.hashes(lowered, starts, stops), return_index=True, return_inverse=True)
        whole, cache = lowered.tobytes(), self.cache
        words = [whole[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())]
        new = [w for w in words if w not in cache]
        if new:
            self._learn(new)
        raw = [cache[w] for w in words]
        sizes = np.array([len(r) for r in raw], np.int64) // np.dtype(self.width).itemsize
        begins = np.cumsum(sizes) - sizes
        ids = W.gathered(np.frombuffer(b"".join(raw), self.width), begins[which], sizes[which])
        return ids, np.concatenate(([0], np.cumsum(sizes[which])))[before]


def _with_tails(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with the punctuation that ends them after an ASCII letter or digit as words of its own."""
    if not len(starts):
        return starts, stops, before
    core = np.maximum.accumulate(np.where(_IS_TAIL[data], 0, np.arange(1, len(data) + 1)))[stops - 1]
    split = (core < stops) & (core > starts) & _IS_WORD[data[core - 1]]
    shift = np.cumsum(split)
    place = np.arange(len(starts)) + shift - split
    out_starts, out_stops = (np.empty(len(starts) + int(shift[-1]), np.int64) for _ in range(2))
    out_starts[place], out_stops[place] = starts, np.where(split, core, stops)
    out_starts[place[split] + 1], out_stops[place[split] + 1] = core[split], stops[split]
    return out_starts, out_stops, before + np.concatenate(([0], shift))[before]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _key_hash(doc: np.ndarray, copy: np.ndarray, level: int) -> np.ndarray:
    salt = W.mix(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
    return W.mix(W.mix(doc.astype(np.int64).view(np.uint64) ^ salt) + copy.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def fingerprint(doc: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return (_key_hash(doc, copy, 10_000) >> np.uint64(32)).astype(np.uint32)


def perfect_hash(doc: np.ndarray, copy: np.ndarray) -> tuple[list[bytes], list[int], np.ndarray]:
    """Bit arrays and their sizes by level, and the slot of each key; the keys must differ."""
    levels, sizes, slot, base = [], [], np.zeros(len(doc), np.int64), 0
    left = np.arange(len(doc))
    while len(left):
        size = 2 * len(left) + 64
        at = (_key_hash(doc[left], copy[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        mine = alone[at]
        slot[left[mine]] = base + rank[at[mine]]
        base += int(alone.sum())
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        sizes.append(size)
        left = left[~mine]
    return levels, sizes, slot


def slots(levels: list[bytes], sizes: list[int], doc: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """The slot of each key in constant time; -1 for a key that no level knows."""
    out, base = np.full(len(doc), -1, np.int64), 0
    left = np.arange(len(doc))
    for level, (raw, size) in enumerate(zip(levels, sizes, strict=True)):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:size]
        rank = np.cumsum(bits, dtype=np.int64) - 1
        at = (_key_hash(doc[left], copy[left], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at] == 1
        out[left[hit]] = base + rank[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return out


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(path), TaskContext.get().partitionId()
        tail = np.array([end], e.width).tobytes()
        docs, copies, sizes, payload, offsets = [], [], [], [], [0]
        number, before, copy = 0, None, 0

        def shard() -> pa.RecordBatch:
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (docs, copies, sizes, offsets[:-1])]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([offsets[-1]], pa.int64()),
                 pa.array([b"".join(payload)], pa.binary()), *lists],
                ["part", "number", "n_ids", "payload", "docs", "copies", "sizes", "offsets"])

        for batch in batches:
            for first, last, data, edges in W.pieces(batch.column(1), PIECE):
                ids, places = e.encode(data, edges)
                raw, wide = ids.tobytes(), ids.itemsize
                cuts = (places * wide).tolist()
                for doc, begin, stop in zip(batch.column(0).slice(first, last - first).to_pylist(), cuts[:-1], cuts[1:], strict=True):
                    copy = copy + 1 if doc == before else 0
                    before = doc
                    docs.append(doc)
                    copies.append(copy)
                    payload.append(raw[begin:stop] + tail)
                    sizes.append((stop - begin) // wide + 1)
                    offsets.append(offsets[-1] + sizes[-1])
                    if offsets[-1] >= SHARD_IDS:
                        yield shard()
                        docs, copies, sizes, payload, offsets = [], [], [], [], [0]
                        number += 1
        if docs:
            yield shard()
    return run


def _bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc", "copy"), F.lit(buckets)).cast("int"))


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    doc, copy = rows["doc"].to_numpy(), rows["copy"].to_numpy()
    levels, sizes, slot = perfect_hash(doc, copy)
    table = np.zeros(len(rows), _SLOT)
    table["print"][slot] = fingerprint(doc, copy)
    for c in ("part", "number", "offset", "size"):
        table[c][slot] = rows[c].to_numpy()
    return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "n_keys": [len(rows)], "levels": [levels], "bits": [sizes], "slots": [table.tobytes()]})


class Store:
    """A written folder of shards and their index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.shards = spark.read.parquet(f"{folder}/shards")
        self.index = spark.read.parquet(f"{folder}/index")
        self.buckets = int(spark.read.parquet(f"{folder}/about").first()["buckets"])
        self.width = spark.read.parquet(f"{folder}/about").first()["width"]

    def starts(self) -> DataFrame:
        """(part, number, start): how many ids are in all shards before each. Summed by part, then within it."""
        sizes = self.shards.select("part", "number", "n_ids")
        total = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a range partition
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = total.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.join(base, "part").select(
            "part", "number", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start"))

    def places(self, keys: DataFrame) -> DataFrame:
        """(doc, copy, part, number, offset, size) of the keys (doc, copy) that the index has."""
        def look(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
            columns = ["doc", "copy", "part", "number", "offset", "size"]
            if not len(index) or not len(asked):
                return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
            row = index.iloc[0]
            doc, copy = asked["doc"].to_numpy(), asked["copy"].to_numpy()
            table = np.frombuffer(row["slots"], _SLOT)
            at = slots(list(row["levels"]), [int(x) for x in row["bits"]], doc, copy)
            known = at >= 0
            known[known] = table["print"][at[known]] == fingerprint(doc[known], copy[known])
            found = table[at[known]]
            return pd.DataFrame({"doc": doc[known], "copy": copy[known]} | {c: found[c].astype(np.int64) for c in columns[2:]})
        asked = _bucket(keys.select("doc", "copy"), self.buckets).groupBy("bucket")
        return asked.cogroup(self.index.groupBy("bucket")).applyInPandas(
            look, "doc long, copy long, part int, number int, offset long, size long")

    def lookup(self, doc: int, copy: int = 0) -> np.ndarray | None:
        """The ids of one key, or None: one bucket of the index and one shard are read, by filters that reach the files."""
        keys = _bucket(self.spark.createDataFrame([(doc, copy)], "doc long, copy long"), self.buckets)
        row = self.index.where(F.col("bucket") == keys.first()["bucket"]).first()
        doc, copy = np.array([doc]), np.array([copy])
        at = slots(list(row["levels"]), [int(x) for x in row["bits"]], doc, copy)[0] if row else -1
        if at < 0:
            return None
        found = np.frombuffer(row["slots"], _SLOT)[at]
        if found["print"] != fingerprint(doc, copy)[0]:
            return None
        shard = self.shards.where((F.col("part") == int(found["part"])) & (F.col("number") == int(found["number"]))).select("payload").first()
        return np.frombuffer(shard["payload"], self.width)[found["offset"]:found["offset"] + found["size"]].astype(np.uint32)

    def read(self, keys: DataFrame) -> DataFrame:
        """(doc, copy, start, n_tokens, ids_crc32, ids) of the keys (doc, copy); ids are 32-bit little-endian bytes."""
        width = self.width
        def cut(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
            if not len(shard) or not len(asked):
                return pd.DataFrame({c: [] for c in ("doc", "copy", "part", "number", "offset", "n_tokens", "ids_crc32", "ids")})
            ids = np.frombuffer(shard["payload"].iloc[0], width).astype("<u4")
            parts = [ids[o:o + n].tobytes() for o, n in zip(asked["offset"].tolist(), asked["size"].tolist(), strict=True)]
            return asked[["doc", "copy", "part", "number", "offset"]].assign(
                n_tokens=asked["size"], ids_crc32=[zlib.crc32(p) for p in parts], ids=parts)
        shard = ["part", "number"]
        found = self.places(keys).groupBy(*shard).cogroup(self.shards.select(*shard, "payload").groupBy(*shard)).applyInPandas(
            cut, "doc long, copy long, part int, number int, offset long, n_tokens long, ids_crc32 long, ids binary")
        return found.join(self.starts(), shard).select(
            "doc", "copy", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "ids")


def write(documents: DataFrame, folder: str, tokenizer: str, end: int = 1, key: str = "doc_id", text: str = "text") -> Store:
    """Encode whole texts, append the end id to each, and write shards and index below `folder`.

    A null text is empty and gives the end id alone. Null ids come first, under the key -2^63; rows with one id are
    copies 0, 1, ... in the order of their texts' hashes and stay in one range partition, which streams them. An
    empty table gives a store without rows. Other columns are not read.
    """
    spark = documents.sparkSession
    plain = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("doc"),
                             F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = int(str(plain._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES if size < 1 << 60 else 0)  # beyond: not known
    ranged = plain.repartitionByRange(ranges, "doc").sortWithinPartitions("doc", F.xxhash64("text"))
    lists = ", ".join(f"{c} array<long>" for c in ("docs", "copies", "sizes", "offsets"))
    shards = ranged.mapInArrow(_encode(tokenizer, end), f"part int, number int, n_ids long, payload binary, {lists}")
    written = put(shards, f"{folder}/shards", compression="zstd")
    rows = written.select("part", "number", F.explode(F.arrays_zip("docs", "copies", "sizes", "offsets")).alias("d")).select(
        F.col("d.docs").alias("doc"), F.col("d.copies").alias("copy"), "part", "number",
        F.col("d.offsets").alias("offset"), F.col("d.sizes").alias("size"))
    buckets = int(rows.count() // BUCKET_KEYS) + 1
    index = _bucket(rows, buckets).groupBy("bucket").applyInPandas(
        _index, "bucket int, n_keys long, levels array<binary>, bits array<long>, slots binary")
    # Sorted by bucket, so that a filter on the bucket skips files and row groups.
    put(index.repartitionByRange("bucket").sortWithinPartitions("bucket"), f"{folder}/index")
    put(spark.createDataFrame([(buckets, encoder(tokenizer).width)], "buckets int, width string"), f"{folder}/about")
    return Store(spark, folder)


def keys_of(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc, copy) of every row, as `write` numbers them."""
    ids = documents.groupBy(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    return ids.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))


def document_id(doc: str = "doc") -> Column:
    """The document id behind a key."""
    return F.when(F.col(doc) != _NULL, F.col(doc)).alias("doc_id")
