import gzip
import hashlib
import os
import random

import pytest

from checks import compare
from ledgerloom.llm import queries, warc

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def by_hand(rows):
    """(page_id, bytes, digest, type, refers_to) of (page_id, url, html) in stored order."""
    best = {}
    for i, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        if len(body) >= 1000:
            best[body] = max(best.get(body, ((-1, 0), -1)), ((0, 0) if page is None else (1, page), i))
    out = []
    for i, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        revisit = len(body) >= 1000 and best[body][1] != i
        first = rows[best[body][1]][0] if revisit else None
        name = lambda v: None if v is None else str(v)
        out.append((name(page), len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", name(first)))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(4)
    bodies = ["<p>" + rnd.choice("abcé漢") * n for n in (0, 10, 990, 996, 997, 1000, 3000, 90_000)]
    rows = [(i, f"http://x{i % 7}.com/ü b?{i}\r\nEvil: 1", rnd.choice(bodies)) for i in range(60)]
    rows += [(i, "http://one.com/", "<html>" + "same " * 400) for i in range(60, 110)]  # many copies
    rows += [(None, None, None), (None, None, None), (None, "http://n.com", "z" * 2000), (None, "http://n.com", "z" * 2000), (7, None, ""),
             (200, "u", "q" * 1500), (200, "u", "q" * 1500), (200, "v", "q" * 1500)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "x", 2, b"y") for r in rows], "page_id long, url string, html string, row int, digest string, n int, first binary")
    return rows, frame


def test_query_matches_sql(spark):
    for folder in (FOLDER, FOLDER.replace("0.001", "0.01")):
        assert compare.compare(queries.queries()["op11_warc"](spark, folder), compare.connect(folder), queries.oracle_sql()["op11_warc"]) is None


def test_round_trip_by_hand(spark, pages, tmp_path):
    rows, frame = pages
    read = warc.write(frame.coalesce(1), f"{tmp_path}/a", file_bytes=4000).records().cache()
    assert got(read) == by_hand(rows)
    bodies = sorted((h or "") for (_, _, h), r in zip(rows, rows))
    kept = [r["payload"] for r in read.where("record_type = 'response'").collect()]
    assert set(bodies) == set(kept) and read.where("record_type = 'revisit' and payload is not null").count() == 0
    assert read.where("url like '% %' or url like '%\r%'").count() == 0


def files(folder):
    return {n: open(f"{folder}/files/{n}", "rb").read() for n in sorted(os.listdir(f"{folder}/files")) if n.endswith(".gz")}


def test_files_do_not_depend_on_ranges(spark, pages, tmp_path):
    """Same files from 1 and from 9 ranges; each is readable as plain gzip and ends after the byte it had to reach."""
    rows, frame = pages
    stored = frame.coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    made = []
    for n in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        archive = warc.write(stored, f"{tmp_path}/r{n}", file_bytes=4000)
        made.append(files(f"{tmp_path}/r{n}"))
        assert sorted(r["name"] for r in archive.manifest.collect()) == sorted(made[-1])
        assert sum(r["records"] for r in archive.manifest.collect()) == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1] and len(made[0]) > 2
    ids = []
    for raw in made[0].values():
        sizes = [length for _, length, _ in warc.members(memoryview(raw))]
        assert sum(sizes) == len(raw) and sum(sizes[2:]) <= 4000
        found = [warc.parsed(data)[0] for _, _, data in warc.members(memoryview(raw))]
        assert found[0]["WARC-Type"] == "warcinfo" and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
        ids += [f.get("X-Page-ID") for f in found[1:]]
    assert ids == sorted(ids, key=lambda i: (i is not None, int(i or 0)))


def test_records_name_each_other(spark, pages, tmp_path):
    _, frame = pages
    warc.write(frame, f"{tmp_path}/a")
    fields = [warc.parsed(d)[0] for raw in files(f"{tmp_path}/a").values() for _, _, d in warc.members(memoryview(raw))]
    ids = {f["WARC-Record-ID"]: f for f in fields}
    assert len(ids) == len(fields)
    for f in fields:
        if f["WARC-Type"] == "revisit":
            first = ids[f["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]


def test_only_files_of_the_manifest_are_read(spark, pages, tmp_path):
    rows, frame = pages
    archive = warc.write(frame.coalesce(1), f"{tmp_path}/a")
    (raw,) = files(f"{tmp_path}/a").values()
    for left in ("pages-00000099.warc.gz", "pages-00000000.warc.gz.0.tmp"):
        with open(f"{tmp_path}/a/files/{left}", "wb") as f:
            f.write(raw[:100])
    assert got(archive.records(payload=False)) == by_hand(rows)
    with open(f"{tmp_path}/a/files/pages-00000000.warc.gz", "wb") as f:
        f.write(raw[:-5])
    with pytest.raises(Exception, match="no end"):
        archive.records().collect()


def test_empty_and_text_ids(spark, pages, tmp_path):
    _, frame = pages
    assert warc.write(frame.limit(0), f"{tmp_path}/e").records().collect() == []
    named = spark.createDataFrame([("a b", "x" * 1200), ("é:%", "x" * 1200), ("", "y")], "name string, body string").selectExpr("*", "null as url")
    read = warc.write(named, f"{tmp_path}/n", key="name", html="body").records()
    assert sorted(tuple(r) for r in read.select("page_id", "record_type", "refers_to").collect()) == [("", "response", None), ("a b", "revisit", "é:%"), ("é:%", "response", None)]
