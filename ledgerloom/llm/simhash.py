"""Near-duplicate documents by SimHash: fingerprints that differ in few bits are found through shared blocks.

The 64 bits are cut into six blocks. Two fingerprints with at most three differing bits agree on at least three
whole blocks, so each fingerprint is entered under all 20 choices of three blocks, and only fingerprints entered
under the same choice and bits are compared. A choice leaves 32 bits open. Where more than `SMALL` different
fingerprints meet, those 32 bits are cut into six parts again, which leaves 16 open bits: at most 65,536 different
fingerprints can meet then, and their links are flooded over a table of that fixed size. So no comparison grows with
the square of a group, no group is unbounded, and none is cut short.

Copies have one fingerprint and count once until the last join.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.links import components
from ledgerloom.llm.store import Workspace, unused, worked_out

SMALL = 256
BITS = 3
SHINGLE = 3
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned SimHash of one text; 0 if it is null or has no word."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(joined, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = itertools.chain((0,), (gaps[:len(parts) - words] + 1).tolist())
        stops = itertools.chain(gaps[words - 1:].tolist(), (len(joined),))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    table = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(table, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def _hashed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp, h) of rows (doc_id, text, h)."""
    for batch in batches:
        for found in _fingerprints([batch]):
            yield pa.RecordBatch.from_arrays([*found.columns, batch.column(2)], ["doc_id", "fp", "h"])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    plain = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def choices(open_bits: list[int], parts: int = 6, open_parts: int = BITS) -> list[tuple[int, list[int]]]:
    """(mask of agreeing bits, bits left open) for each way to leave `open_parts` of `parts` blocks open."""
    blocks = [part.tolist() for part in np.array_split(np.array(open_bits), parts)]
    out = []
    for left in itertools.combinations(blocks, open_parts):
        free = [b for block in left for b in block]
        out.append(((1 << 64) - 1 - sum(1 << b for b in free), free))
    return out


FIRST = choices(list(range(64)))


def spanning(values: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of differing in at most `bits` bits connect, one for each value at most."""
    label = np.arange(len(values))
    if len(values) <= SMALL:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
        while True:
            lower = np.where(near, label[None, :], len(values)).min(1)
            if (lower == label).all():
                break
            label = lower
    else:  # at most 2^16 different values, that differ in at most 16 places
        varying = [b for b in range(64) if int(np.bitwise_or.reduce(values ^ values[0])) >> b & 1]
        slots = np.zeros(len(values), np.int64)
        for i, b in enumerate(varying):
            slots |= ((values >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
        table = np.full(1 << len(varying), len(values))
        moves = [sum(1 << b for b in c) for n in range(1, bits + 1) for c in itertools.combinations(range(len(varying)), n)]
        while True:
            table[slots] = label
            lower = label.copy()
            for m in moves:
                np.minimum(lower, table[slots ^ m], out=lower)
            lower = np.minimum(lower, lower[lower])
            if (lower == label).all():
                break
            label = lower
    away = label != np.arange(len(values))
    return values[away], values[label[away]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [spanning(np.array(group.as_py(), np.int64).view(np.uint64)) for group in batch.column(0)]
        a, b = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _met(keyed: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Rows of keyed (fp, bucket...) that meet others, with the number n of those in their bucket."""
    bucket = [c for c in keyed.columns if c != "fp"]
    sizes = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return work.keep(keyed.join(sizes, bucket), name)


def _linked(met: DataFrame) -> DataFrame:
    bucket = [c for c in met.columns if c not in ("fp", "n")]
    return met.groupBy(*bucket).agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_link, "a long, b long")


def _entered(fps: DataFrame, ways: list[tuple[int, list[int]]], way: str, bits: str, *keep: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias(way), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias(bits))
                        for i, (mask, _) in enumerate(ways)])
    return fps.select("fp", *keep, F.explode(entries).alias("e")).select("fp", *keep, f"e.{way}", f"e.{bits}")


def near_links(work: Workspace, fps: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints that connect whatever is connected by 3 or fewer differing bits."""
    met = _met(_entered(fps, FIRST, "way", "bits"), work, "met")
    links = _linked(met.where(F.col("n") <= SMALL))
    large = met.where(F.col("n") > SMALL)
    if not large.isEmpty():
        finer = None
        for i, (_, free) in enumerate(FIRST):  # each first choice has its own open bits
            rows = _entered(large.where(F.col("way") == i), choices(free), "part", "some", "way", "bits")
            finer = rows if finer is None else finer.unionByName(rows)
        links = links.unionByName(_linked(_met(finer, work, "finer")))
    return links


def _components(work: Workspace, rows: DataFrame) -> DataFrame:
    """(fp, component_id, root) of each fingerprint of rows (doc_id, fp)."""
    fps = work.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(work, near_links(work, fps.select("fp")))
    linked = roots.join(fps.withColumnRenamed("fp", "node"), "node")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    moved = roots.join(lowest, "root").select(F.col("node").alias("fp"), "lowest", "root", F.lit(True).alias("moved"))
    chosen = F.when(F.col("moved"), F.col("lowest")).otherwise(F.col("least"))
    # Written first, so that the last join has a shuffle of its own and Spark can split a fingerprint of many copies.
    return work.keep(fps.join(moved, "fp", "left").select(
        "fp", chosen.alias("component_id"), F.coalesce("root", "fp").alias("root")), "ids")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id reachable. A null text or
    one without words has fingerprint zero, linked like any other. Rows with a null doc_id take part; they never
    give the component its number unless all of it is null. Repeated rows each give a row. Other columns are
    not read. An empty table gives an empty result. Memory is bounded by an Arrow batch of texts.
    """
    def build(work: Workspace) -> DataFrame:
        rows = work.keep(fingerprints(documents, key, text), "rows")
        per_fp = _components(work, rows)
        return rows.join(per_fp, "fp").select(
            "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return worked_out(documents.sparkSession, "simhash", build)


def deduplicated(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each group of near copies: the one with the smallest id, whole and unchanged.

    A group gives one row whatever its ids are, so different texts under one id or under null stay if they are no near
    copies; of several texts of the smallest id the one with the smallest hash stays. Repeated rows give one row.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def build(work: Workspace) -> DataFrame:
        plain = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        printed = work.keep(plain.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).mapInArrow(
            _hashed_fingerprints, "doc_id long, fp long, h long"), "rows")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h"))
        per_fp = printed.groupBy("fp").agg(least.alias("first"))
        roots = _components(work, printed.select("doc_id", "fp")).select("fp", "root")
        return per_fp.join(roots, "fp").groupBy("root").agg(F.min("first").alias("f")).select("f.doc_id", "f.h")
    kept = worked_out(documents.sparkSession, "simhash", build)
    one, h = unused(documents, "_kept"), unused(documents, "_hash")
    same = F.col(key).cast("long").eqNullSafe(F.col(one)) & (F.xxhash64(whole) == F.col(h))
    kept = kept.select(F.col("doc_id").alias(one), F.col("h").alias(h)).distinct()
    marked = documents.join(kept, same, "inner").dropDuplicates([one, h])
    return marked.select(*documents.columns)
