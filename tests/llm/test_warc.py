import gzip
import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlspar.llm import warc


@pytest.fixture
def pages(spark):
    big, other = "<p>" + "é" * 600 + "</p>", "<p>" + "z" * 1500 + "</p>"
    data = [
        (1, "http://a/1", big, 0), (9, "http://a/9", big, 0), (4, "http://a/4", big, 0), (9, "http://a/9b", big, 0), (2, None, "small", 0), (3, "u 3\r\nX: y", "small", 0),
        (5, "http://b", None, 0), (6, "http://b", "", 0), (None, "http://n", other, 0), (7, "http://n", other, 0), (8, "http://x", "".join(chr(40 + i % 8000) for i in range(300000)), 0),
    ]
    return spark.createDataFrame(data, "page_id long, url string, html string, digest int")


def expected(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    out = Counter()
    for page_id, payload in rows:
        same = [i for i, p in rows if p == payload and len(p) >= 1000]
        top = max([i for i in same if i is not None], default=None)
        again = len(same) > 1 and page_id != top
        out[page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    return out


def test_round_trip(pages):
    got = warc.archived_pages(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == expected(pages)
    assert warc.archived_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("split", [1 << 30, 5000, 997, 64])
def test_every_split_size_reads_each_record_once(spark, pages, tmp_path, split, monkeypatch):
    monkeypatch.setattr(warc, "MOST_TASKS", 16)
    files = warc.write_pages(pages.coalesce(2), f"file://{tmp_path}/w")
    got = warc.read_archives(files, split_bytes=split)
    assert Counter(r.record_id for r in got.collect()) == Counter(f"{warc.ID_PREFIX}{r.page_id}" for r in pages.collect())
    texts = {r.record_id: r.payload for r in got.filter("record_type = 'response'").collect()}
    assert texts[f"{warc.ID_PREFIX}8"].decode() == pages.filter("page_id = 8").first().html
    for path in files.collect():  # each file is plain gzip, from its first to its last byte
        data = gzip.open(path.path.removeprefix("file://")).read()
        assert data.count(b"WARC/1.1\r\n") == path.records + 1


def test_false_magic_and_damage(spark, tmp_path):
    records = [warc.page_record(i, "u", f"page {i} " * 50, "response", None) for i in range(6)]
    damaged = bytearray(records[2])
    damaged[len(damaged) // 2] ^= 0xFF
    data = b"junk" + warc.MAGIC + records[0] + warc.MAGIC + records[1] + bytes(damaged) + records[3] + gzip.compress(b"no record") + records[4] + records[5][:-9]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(f"file://{path}", os.path.getsize(path))], "path string, size long")
    for split in (1 << 20, 100):
        ids = sorted(r.record_id for r in warc.read_archives(files, split_bytes=split).collect())
        assert ids == [f"{warc.ID_PREFIX}{i}" for i in (0, 1, 3, 4)]


def test_only_named_files_count(spark, pages, tmp_path):
    files = warc.write_pages(pages, f"file://{tmp_path}/w")
    (tmp_path / "w" / "left-behind.warc.gz").write_bytes(warc.page_record(77, "u", "x", "response", None))
    assert warc.read_archives(files).filter(F.col("record_id").endswith(":77")).count() == 0


def test_ranges_go_to_as_many_tasks(spark, pages, tmp_path):
    rows = pages.filter("page_id = 8").select(F.explode(F.sequence(F.lit(1), F.lit(40))).alias("page_id"), "url", F.concat("html", F.rand(3).cast("string")).alias("html"))
    files = warc.write_pages(rows.coalesce(2), f"file://{tmp_path}/w")
    split = files.agg(F.sum("size")).first()[0] // 12
    read = warc.read_archives(files, payloads=False, split_bytes=split)
    assert read.rdd.getNumPartitions() >= 12
    assert read.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 6
    assert read.count() == 40


def test_foreign_headers(spark, tmp_path):
    """Records without lengths or digests, or with other forms of them, are read all the same."""

    def member(*lines, block=b""):
        return gzip.compress("\r\n".join(("WARC/1.0", *lines)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http, body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n", b"hello"
    sha = hashlib.sha1(body)
    records = [
        member("WARC-Type: response", "WARC-Record-ID: <a>", block=http + body),
        member("WARC-Type: response", "WARC-Record-ID: <b>", "Content-Length: many", block=http + body),
        member("WARC-Type: revisit", "WARC-Record-ID: <c>", f"Content-Length: {len(http)}", block=http),
        member("WARC-Type: revisit", "WARC-Record-ID: <d>", "WARC-Payload-Digest: sha1:" + sha.hexdigest().upper(), "Content-Length: 0"),
        member("WARC-Type: revisit", "WARC-Payload-Digest: sha256:abc", "Content-Length: 2", block=b"xx"),
    ]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(records))
    files = spark.createDataFrame([(f"file://{path}", os.path.getsize(path))], "path string, size long")
    got = {(r.record_id, r.record_type, r.payload_digest, r.payload_bytes) for r in warc.read_archives(files).collect()}
    assert got == {("a", "response", sha.hexdigest(), 5), ("b", "response", sha.hexdigest(), 5), ("c", "revisit", None, 5), ("d", "revisit", sha.hexdigest(), None), (None, "revisit", None, None)}


@pytest.mark.parametrize("split", [1 << 30, 100_000, 20_011, 4096])
def test_an_archive_inside_a_payload_is_no_archive(spark, tmp_path, split):
    """Records kept whole as the payload of another one, in stored blocks, so that their bytes stand in the file as they are."""
    inner = b"".join(warc.page_record(f"inner{i}", "u", os.urandom(500).hex(), "response", None) for i in range(300))
    block = b"HTTP/1.1 200 OK\r\n\r\n" + inner
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{warc.ID_PREFIX}outer>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    outer = gzip.compress(head + block + b"\r\n\r\n", 0)
    plain = [warc.page_record(i, "u", f"page {i} " * 50, "response", None) for i in range(4)]
    data = plain[0] + outer + plain[1] + plain[2] + outer + plain[3]
    assert data.count(b"inner7>") == 0 and sum(data.count(x) for x in [inner[:400]]) == 2
    (tmp_path / "x.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "path string, size long")
    got = Counter(r.record_id.removeprefix(warc.ID_PREFIX) for r in warc.read_archives(files, split_bytes=split).collect())
    assert got == Counter({"0": 1, "1": 1, "2": 1, "3": 1, "outer": 2})
