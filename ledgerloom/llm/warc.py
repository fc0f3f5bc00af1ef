"""Web archives: pages as WARC 1.1 records in gzip members, in files of about one compressed size, and back.

Order and content of the files depend on the pages alone. Records are range-sorted by page; headers and digests are
made anew from the payload. Of equal payloads of at least `REVISIT_BYTES` bytes, that of the largest page is a response
record and the others are revisit records, which name it and carry no payload. Tasks that hold a range each compress
their records and add up the sizes; the sizes of the ranges, one row each, then give every record its place among all
compressed bytes, and a file ends with the first record that passes a multiple of `FILE_BYTES`. So neither the number
of ranges nor where they were cut shows in the files.

Commit. A task writes each file under a temporary name of its own and reports it as a row of a table that Spark
commits, so of several attempts one counts. Only then are reported files renamed, and the manifest is written last:
readers take files in the manifest and no others. Files are written through pyarrow's file systems (local, S3, GCS,
HDFS), since Spark has no writer for them; reading goes through Spark.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import Workspace, put

REVISIT_BYTES = 1000
FILE_BYTES = 32 << 20
RANGE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "!#$%&'()*+,/:;=?@[]~"  # marks that may stand in an address


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; its length and block digest are added."""
    fields = [*fields, ("WARC-Block-Digest", digest_field(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def digest_field(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_id(page: str | None, url: str | None, row: int) -> str:
    """The same page, address and row give the same id."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, repr((page, url, row))).urn}>"


def page_record(page: str | None, url: str | None, row: int, payload: bytes, sha1: bytes, n: int,
                original: tuple[str | None, str | None, int] | None, date: str) -> bytes:
    """A response record, or a revisit record if `original` (page, url and row of the response) is given."""
    target = quote(url, safe=_SAFE) if url else f"urn:page:{quote(page or '', safe='')}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if original else "response"), ("WARC-Record-ID", record_id(page, url, row)),
              ("WARC-Date", date), ("WARC-Target-URI", target)]
    if page is not None:
        fields.append(("X-Page-ID", quote(page, safe="")))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest_field(sha1))]
    if original:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*original))]
        if original[0] is not None:
            fields.append(("X-Refers-To-Page-ID", quote(original[0], safe="")))
    return member(fields, http if original else http + payload)


def info_record(number: int, date: str) -> bytes:
    """What every file begins with."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'file {number}').urn}>"),
              ("WARC-Date", date), ("WARC-Filename", _name(number)), ("Content-Type", "application/warc-fields")]
    return member(fields, b"format: WARC File Format 1.1\r\n")


def _name(number: int) -> str:
    return f"pages-{number:08d}.warc.gz"


def members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member."""
    at = 0
    while at < len(content):
        unpacker = zlib.decompressobj(31)
        data, end = [], at
        while not unpacker.eof:
            if end >= len(content):
                raise ValueError(f"the record at {at} has no end")
            data.append(unpacker.decompress(content[end:end + 65_536]))
            end += 65_536
        end = min(end, len(content)) - len(unpacker.unused_data)
        yield at, end - at, b"".join(data)
        at = end


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a record; raises if its length or block digest is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != digest_field(hashlib.sha1(block).digest()):
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, block


def _pack(date: str):
    """Records of a sorted range: (slice, before, size, page, member); before: compressed bytes of the range up to here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            made = []
            for page, url, row, html, sha1, n, revisit, first_page, first_url, first_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                original = (first_page, first_url, first_row) if revisit else None
                made.append(page_record(page, url, row, (html or "").encode(), bytes.fromhex(sha1), n, original, date))
            sizes = [len(m) for m in made]
            before = [total := total + s for s in [0, *sizes[:-1]]] if made else []
            total += sizes[-1] if sizes else 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([here] * len(made), pa.int32()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())],
                ["slice", "before", "size", "member"])
    return run


def _write(folder: str, date: str):
    """Files from records sorted by file and place; a row for each file that is whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        store, root = FileSystem.from_uri(folder)
        number = stream = None

        def done() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pylist([{"number": number, "name": _name(number), "temporary": temporary, "records": records, "bytes": size}])
        for batch in batches:
            for now, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now != number:
                    if stream:
                        yield done()
                    temporary = f"{_name(now)}.{uuid.uuid4().hex}.tmp"
                    number, stream, records, size = now, store.open_output_stream(f"{root}/{temporary}"), 0, 0
                    size += stream.write(info_record(now, date))
                size += stream.write(piece.as_buffer())
                records += 1
        if stream:
            yield done()
    return run


def _rename(folder: str):
    """Give reported files their names; a file that an earlier attempt renamed is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType
        store, root = FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                old, new = f"{root}/{row['temporary']}", f"{root}/{row['name']}"
                if store.get_file_info(old).type != FileType.NotFound:
                    store.move(old, new)
                if store.get_file_info(new).size != row["bytes"]:
                    raise OSError(f"{new} is not whole")
            yield batch.select(["number", "name", "records", "bytes"])
    return run


def _first_row(digest: str) -> Column:
    return F.max(F.struct("page", "row", "url")).alias(digest)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
          file_bytes: int = FILE_BYTES, date: str = DATE) -> Archive:
    """Write a record for every row below `folder`, which must be new.

    Pages are in the order of their id (any type that has an order), null ids first. A null html is an empty payload,
    a null address `urn:page:<id>`. Of rows with one id, the last as stored counts as the largest; a repeated row is a
    record of its own. Other columns are not read. An empty table gives a manifest without files.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    try:
        body = F.coalesce(F.col(html).cast("string"), F.lit(""))
        rows = put(pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("url"), F.monotonically_increasing_id().alias("row"),
                                body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("n")),
                   work.path("rows"), compression="zstd")
        again = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(_first_row("first"), F.count(F.lit(1)).alias("times"))
        again = work.keep(again.where("times > 1").select("digest", "first"), "again")
        revisit = F.coalesce(F.col("row") != F.col("first.row"), F.lit(False))  # row numbers differ between any two rows
        wide = rows.join(again, "digest", "left").select(
            "page", F.col("page").cast("string").alias("id"), "url", "row", F.when(~revisit, F.col("html")).alias("html"), "digest", "n", revisit.alias("revisit"),
            F.col("first.page").cast("string").alias("first_page"), F.col("first.url").alias("first_url"), F.col("first.row").alias("first_row"))
        total = rows.agg(F.sum("n")).first()[0] or 0
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = [F.asc_nulls_first("page"), "row"]
        packed = work.keep(wide.repartitionByRange(max(parts, total // RANGE_BYTES), *order).sortWithinPartitions(*order).select(
            "id", "url", "row", "html", "digest", "n", "revisit", "first_page", "first_url", "first_row").mapInArrow(
            _pack(date), "slice int, before long, size long, member binary"), "packed")
        work.drop("rows")
        sizes = packed.groupBy("slice").agg(F.sum("size").alias("size"))  # one row a range
        earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        bases = work.keep(sizes.select("slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"), "size"), "bases")
        files = (bases.agg(F.sum("size")).first()[0] or 0) // file_bytes + 1
        place = F.col("base") + F.col("before")
        placed = packed.join(bases.drop("size"), "slice").select(F.floor(place / file_bytes).cast("long").alias("number"), place.alias("place"), "member")
        ordered = placed.repartition(int(max(parts, files // 8)), "number").sortWithinPartitions("number", "place").select("number", "member")
        target = f"{folder}/files"
        _make(spark, target)
        written = work.keep(ordered.mapInArrow(_write(target, date), "number long, name string, temporary string, records long, bytes long"), "written")
        put(written.mapInArrow(_rename(target), "number long, name string, records long, bytes long"), f"{folder}/manifest")
    finally:
        work.remove()
    return Archive(spark, folder)


def _make(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


class Archive:
    """A written folder of archives and their manifest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.manifest = spark.read.parquet(f"{folder}/manifest")

    def records(self, payload: bool = True) -> DataFrame:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, file, offset, length[, payload]) of every page.

        Read from the archives: the payload is hashed again and has to agree with its record, as has each record with
        its own length and digest. A revisit's size and digest are those it states; its payload is null. Page ids come
        back as text.
        """
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{self.folder}/files")
        named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(self.manifest.select("name"), "name")
        columns = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, file string, offset long, length long"
        return named.mapInArrow(_parse(payload), columns + (", payload string" if payload else ""))


def _parse(with_payload: bool):
    from urllib.parse import unquote
    texts = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "offset", "length", "payload"]
    kept = len(names) if with_payload else len(names) - 1

    def rows(name: str, content: memoryview) -> Iterator[tuple]:
        for offset, length, data in members(content):
            fields, block = parsed(data)
            kind = fields["WARC-Type"]
            if kind not in ("response", "revisit"):
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
            n = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")))
            if kind == "response" and (hashlib.sha1(payload).digest() != stated or len(payload) != n):
                raise ValueError(f"broken payload {fields['WARC-Record-ID']}")
            page, refers = (fields.get(f) for f in ("X-Page-ID", "X-Refers-To-Page-ID"))
            yield (page and unquote(page), n, stated.hex(), kind, refers and unquote(refers), fields["WARC-Target-URI"], name, offset, length,
                   payload.decode() if kind == "response" and with_payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*some, strict=True))[:kept], texts)], names[:kept])
        for batch in batches:
            for i in range(batch.num_rows):
                some, held = [], 0
                for row in rows(batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer())):
                    some.append(row)
                    held += 200 + len(row[-1] or "")
                    if held > 4_000_000:
                        yield batch_of(some)
                        some, held = [], 0
                if some:
                    yield batch_of(some)
    return run
