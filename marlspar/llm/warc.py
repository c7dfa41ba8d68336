"""WARC archives: a writer with revisits, and a splittable reader.

Every record is a gzip member of its own. A task of the reader gets a byte
range, looks for gzip's magic bytes, and takes a place for a member's start if
what decodes from there begins as a WARC record; from there on members follow
one another. It owns the records that start in its range and reads on behind
the range to finish the last. So files of any size are read by many tasks, and
a task that is lost is read again from its range.

The writer puts each task's records in a new file in the shared folder and
gives back its name and size; only files that are named in the result count, so
what a lost or repeated task has left behind is never read.

Payloads of LEAST_REVISITED bytes or more that are equal are stored once, with
the largest page_id (null is the smallest); the others become revisit records,
whose HTTP head keeps the payload's length. The largest page_id of a digest
comes from a partial aggregation; the join with it may be split where one
payload holds very many rows.

Defined cases: a null payload is empty; a null url leaves out the target; rows
of equal page_id and payload that has the largest page_id are all responses;
an empty table gives no file and an empty result; damaged members are skipped.
Of foreign records, a missing or malformed Content-Length means all that the
member holds, a revisit without a readable SHA-1 digest has a null one, and one
without the payload's length in its HTTP head has a null length. Extra columns
are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import scratch, ship, stored

LEAST_REVISITED = 1000
SPLIT_BYTES = 16 << 20
MOST_TASKS = 50_000

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
ID_PREFIX = "urn:x-page:"

_READ = 1 << 18


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", uri)))


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, f"WARC-Type: {kind}"]
    lines += [f"{k}: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in fields if v is not None]
    lines.append("Content-Type: " + ("application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response"))
    lines.append(f"Content-Length: {len(block)}")
    return zlib.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, 31)


def page_record(page_id, url: str | None, html: str | None, kind: str, refers_to) -> bytes:
    payload = (html or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<{ID_PREFIX}{page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")]
    return record(kind, fields, head if kind == "revisit" else head + payload)


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            if batch.num_rows and out is None:
                store, place = open_fs(path)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(place, compression=None)
                out.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)], b"software: marlspar\r\n"))
            for row in batch.to_pylist():
                out.write(page_record(row["page_id"], row["url"], row["html"], row["kind"], row["refers_to"]))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "size": size, "records": n}])

    return run


def write_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISITED) -> DataFrame:
    """Write pages (page_id, url, html) as archives below the folder; (path, size, records) of the files."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    twice = pages.filter(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("largest")).filter("n > 1")
    twice = stored(twice, "twice")  # a join of two plain shuffles, which may be split where a payload is common
    rows = pages.join(twice.select(F.col("digest").alias("shared"), "largest"), (F.col("digest") == F.col("shared")) & (F.col("bytes") >= least), "left")
    revisit = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    rows = rows.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("largest")).alias("refers_to"))
    return stored(rows.mapInArrow(_written(folder), "path string, size long, records long"), "manifest")


class _Source:
    """Reads of a file at any place, from one block in memory."""

    def __init__(self, path: str):
        store, place = open_fs(path)
        self.file = store.open_input_file(place)
        self.size = self.file.size()
        self.begin, self.block = 0, b""

    def at(self, place: int, n: int) -> bytes:
        inside = place - self.begin
        if inside < 0 or inside + n > len(self.block) and self.begin + len(self.block) < self.size:
            self.begin, self.block = place, self.file.read_at(max(n, _READ), place)
            inside = 0
        return self.block[inside : inside + n]


def _member(source: _Source, place: int) -> tuple[bytes, int] | None:
    """The content and the end of the gzip member at a place, if it is a whole WARC record."""
    decoder, parts, at = zlib.decompressobj(31), [], place
    try:
        while not decoder.eof:
            data = source.at(at, _READ)
            if not data:
                return None
            parts.append(decoder.decompress(data))
            if at == place and not parts[0].startswith(b"WARC/1."):
                return None
            at += len(data) - len(decoder.unused_data)
    except zlib.error:
        return None
    return b"".join(parts), at


def members(path: str, begin: int, end: int) -> Iterator[tuple[bytes, int]]:
    """The records that start in [begin, end) of a file, and where they end."""
    source, place = _Source(path), begin
    end = min(end, source.size)
    while place < end:
        data = source.at(place, min(_READ, end - place + len(MAGIC) - 1))
        found = data.find(MAGIC)
        if found < 0:
            place += max(1, len(data) - len(MAGIC) + 1)
            continue
        place += found
        if place >= end:
            return
        if member := _member(source, place):
            yield member
            place = member[1]
        else:
            place += 1


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _id(value: str | None) -> str | None:
    return value[1:-1] if value else None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


def _sha1(value: str | None) -> str | None:
    """The hex form of a labelled SHA-1 digest in base 32 or hex."""
    label, _, digest = (value or "").partition(":")
    if label.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", digest):
        return digest.lower()
    return base64.b32decode(digest.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", digest) else None


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                rows, held = [], 0
                for data, _ in members(split["path"], max(split["begin"], split["free"]), split["end"]):
                    head, _, rest = data.partition(b"\r\n\r\n")
                    fields = _fields(head)
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    length = _number(fields.get("content-length"))
                    block = rest.removesuffix(b"\r\n\r\n") if length is None else rest[:length]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                    else:
                        digest, size = _sha1(fields.get("warc-payload-digest")), _number(_fields(http).get("content-length"))
                    row = {
                        "record_id": _id(fields.get("warc-record-id")), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
                        "payload_digest": digest, "payload_bytes": size, "refers_to": _id(fields.get("warc-refers-to")),
                    }
                    if payloads:
                        row["payload"] = payload if kind == "response" else None
                        held += len(payload)
                    rows.append(row)
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_schema(payloads))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_schema(payloads))

    return run


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the last record ends that starts in each range."""
    for batch in batches:
        ends = [max((end for _, end in members(s["path"], s["begin"], s["end"])), default=0) for s in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("begin"), batch.column("end"), pa.array(ends, pa.int64())], names=["path", "begin", "end", "reached"])


def _schema(payloads: bool) -> pa.Schema:
    fields = [(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "payload_digest")] + [("payload_bytes", pa.int64()), ("refers_to", pa.string())]
    return pa.schema(fields + [("payload", pa.binary())] * payloads)


def read_archives(files: DataFrame, payloads: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The response and revisit records of archives: record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to, payload.

    files: (path, size). Each byte range is a row, and ranges are dealt out to as
    many tasks, up to MOST_TASKS. A first pass finds where the last record ends
    that starts in each range. What seems to start before the end of a record of
    an earlier range stands inside that one (an archive kept as a payload) and is
    no record of its own, so the ranges don't change the result.
    """
    ship(files.sparkSession)
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("begin")
    splits = files.select("path", begin).withColumn("end", F.col("begin") + split_bytes)
    types = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string"
    # The number is given, for a shuffle of so few bytes would otherwise end in one task.
    ranges = files.agg(F.sum(F.ceil(F.greatest(F.col("size"), F.lit(1)) / split_bytes))).first()[0] or 1
    tasks = min(int(ranges), MOST_TASKS)
    reached = splits.repartition(tasks).mapInArrow(_reached, "path string, begin long, end long, reached long")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    free = stored(reached.withColumn("free", F.coalesce(F.max("reached").over(before), F.lit(0))).filter("reached > 0"), "ranges")
    return free.repartition(tasks).mapInArrow(_read(payloads), types + ", payload binary" * payloads)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    id_type = pages.schema["page_id"].dataType
    back = read_archives(write_pages(pages), payloads=False)

    def number(c: str):
        return F.expr(f"try_cast(substring({c}, {len(ID_PREFIX) + 1}) AS {id_type.simpleString()})")

    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH sized AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
ranked AS (
  SELECT *, payload_bytes >= 1000 AND page_id < max(page_id) OVER (PARTITION BY payload_digest) AS again, max(page_id) OVER (PARTITION BY payload_digest) AS largest
  FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN largest END AS refers_to
FROM ranked
"""
