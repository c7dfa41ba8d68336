"""JSON files of any size: arrays and envelopes read by byte ranges, and written as streams.

Reading takes two passes over ranges of RANGE bytes, which tasks open by
themselves, about TASK bytes each, one range after the other: what a scan holds
is a multiple of its range, so ranges are small. The first sums up what a range
does to a reader that enters it outside or inside a string: whether it leaves it
inside one, and how much deeper it is then. The sums of a file's ranges, a row each, are chained, so the second
pass enters each range in the right state: it finds the objects that begin at
the depth of the elements and reads each to its end, also beyond the range. A
string can't hold a raw newline, so one that isn't closed ends there, and what
follows is read again.

Each object is parsed on its own, so a malformed one is one reject. Text between
elements that is none is a reject, too.

Files must be in an encoding in which ASCII bytes are ASCII characters.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from marlspar.session import ship, stored

#: Bytes of a range, bytes of a task's ranges, and bytes read at once beyond a range.
RANGE, TASK, MORE = 1 << 20, 8 << 20, 64 << 10
#: Bytes of texts that are given out at once.
GIVEN = 1 << 20

_QUOTE, _BACKSLASH, _NEWLINE, _COLON = b'"\\\n:'
_BLANK = np.isin(np.arange(256), list(b" \t\r\n,"))
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.match(r"^(?:file:)?(/.*)$", re.sub(r"^file:/+", "file:/", path))
    if local:
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(path)


def listed(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """Files, and their sizes, of those of the paths and patterns that are there; names that begin with _ or . are left out."""
    out = []
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in store.globStatus(hadoop) or []:
            files = store.listFiles(found.getPath(), True)
            while files.hasNext():
                f = files.next()
                inner = f.getPath().toString().removeprefix(found.getPath().toString())
                if not re.search(r"/[_.]", inner) and f.getLen():
                    out.append((f.getPath().toString(), f.getLen()))
    return out


@dataclass
class Scan:
    """What a reader meets in some bytes."""

    depth: np.ndarray  # after each byte
    before: np.ndarray  # and before it
    outside: np.ndarray  # of strings, before the byte
    inside_after: bool


def scanned(buf: np.ndarray, inside: bool, depth: int, slashes: int) -> Scan:
    """slashes: backslashes that stand right before the bytes."""
    n = len(buf)
    place = np.arange(n, dtype=np.int32)
    other = np.where(buf == _BACKSLASH, np.int32(-1 - slashes), place)
    last_other = np.maximum.accumulate(other) if n else other
    run = place - 1 - np.r_[np.int32(-1 - slashes), last_other[:-1]][:n]  # backslashes before each byte
    quotes = np.cumsum((buf == _QUOTE) & (run % 2 == 0), dtype=np.int32)
    newline = buf == _NEWLINE
    restart = np.maximum.accumulate(np.where(newline, place, np.int32(-1))) if n else place
    since = quotes - np.where(restart >= 0, quotes[restart], np.int32(-int(inside)))
    after = since % 2 == 1
    outside = ~np.r_[inside, after[:-1]][:n]
    deep = np.int32(depth) + np.cumsum(np.where(outside, _STEP[buf], np.int8(0)), dtype=np.int32)
    return Scan(deep, np.r_[np.int32(depth), deep[:-1]][:n], outside, bool(after[-1]) if n else inside)


def _slashes_before(file, begin: int) -> int:
    n = 0
    while n < begin:
        file.seek(max(0, begin - n - 64))
        some = file.read(min(64, begin - n))
        kept = len(some) - len(some.rstrip(b"\\"))
        n += kept
        if kept < len(some):
            break
    return n


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            store, path = opened(row["file"])
            with store.open_input_file(path) as file:
                slashes = _slashes_before(file, row["begin"])
                file.seek(row["begin"])
                data = file.read(row["end"] - row["begin"])
            buf = np.frombuffer(data, np.uint8)
            first = re.search(rb"[^\s\xEF\xBB\xBF]", data) if row["begin"] == 0 else None
            for inside in (False, True):
                s = scanned(buf, inside, 0, slashes)
                rows.append({"file": row["file"], "begin": row["begin"], "end": row["end"], "inside": inside, "then_inside": s.inside_after, "deeper": int(s.depth[-1]), "first": first[0].decode("latin-1") if first else None})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("inside", pa.bool_()), ("then_inside", pa.bool_()), ("deeper", pa.int64()), ("first", pa.string())]))


def _chained(sums: pd.DataFrame) -> pd.DataFrame:
    """How a reader enters each range of a file."""
    sums = sums.sort_values(["begin", "inside"])
    first = sums["first"].dropna()
    inside, depth, out = False, 0, []
    for (begin, end), two in sums.groupby(["begin", "end"], sort=True):
        out.append((sums["file"].iloc[0], begin, end, inside, depth, first.iloc[0] if len(first) else ""))
        one = two[two["inside"] == inside].iloc[0]
        inside, depth = bool(one["then_inside"]), depth + int(one["deeper"])
    return pd.DataFrame(out, columns=["file", "begin", "end", "inside", "depth", "first"])


def _key_before(file, colon: int) -> str | None:
    """The string that ends before a colon."""
    size = 256
    while True:
        begin = max(0, colon - size)
        file.seek(begin)
        text = file.read(colon - begin).rstrip()
        found = re.search(rb'"(?:[^"\\]|\\.)*"$', text)
        if found or begin == 0 or size > 1 << 16:
            try:
                return json.loads(found[0]) if found else None
            except ValueError:
                return None
        size *= 8


def _to_its_end(file, head: bytes, place: int, size: int, inside: bool, depth: int, at: int, an_object: bool) -> tuple[bytes, bool]:
    """An element that goes on beyond its range, which ends at ``place`` in the given state."""
    text, closed, step, slashes = [head], False, MORE, 0
    while place < size and not closed:
        file.seek(place)
        more = file.read(min(step, size - place))
        last = len(text[-1]) - len(text[-1].rstrip(b"\\"))
        slashes = last + (slashes if last == len(text[-1]) else 0)
        t = scanned(np.frombuffer(more, np.uint8), inside, depth, slashes)
        stop = np.flatnonzero(t.outside & (t.depth == at) & (t.before == at + 1))
        closed = bool(len(stop))
        text.append(more[: stop[0] + 1] if closed else more)
        place, inside, depth, step = place + len(more), t.inside_after, int(t.depth[-1]), min(2 * step, RANGE)
    return b"".join(text), closed and an_object


def _object_rows(level: int | None, encoding: str):
    """Objects that begin in each range: file, range, number in it, position, text; of level 2 the keys of the outer object, too (``name``)."""
    schema = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("nth", pa.int32()), ("position", pa.int64()), ("text", pa.string()), ("name", pa.string()), ("sound", pa.bool_())])

    def of_range(row: dict) -> Iterator[dict]:
        store, path = opened(row["file"])
        with store.open_input_file(path) as file:
            size = file.size()
            slashes = _slashes_before(file, row["begin"])
            file.seek(row["begin"])
            data = file.read(row["end"] - row["begin"])
            buf = np.frombuffer(data, np.uint8)
            s = scanned(buf, row["inside"], row["depth"], slashes)
            at = (1 if row["first"] == "[" else 0) if level is None else level
            opens = np.flatnonzero(s.outside & (_STEP[buf] == 1) & (s.before == at))
            closes = np.flatnonzero(s.outside & (s.depth == at) & (s.before == at + 1))
            ends = np.searchsorted(closes, opens)
            strays = np.empty((0, 2), np.int64)
            if level != 2:  # there, other values than arrays of objects stand between
                stray = (s.before == at) & (s.depth == at) & ~(s.outside & _BLANK[buf])
                if row["begin"] == 0 and data.startswith(b"\xEF\xBB\xBF"):
                    stray[:3] = False
                strays = np.flatnonzero(np.diff(np.r_[False, stray, False].astype(np.int8))).reshape(-1, 2)
            inside, depth = s.inside_after, int(s.depth[-1])
            marks = np.flatnonzero(s.outside & (buf == _COLON) & (s.before == 1)) if level == 2 else []
            del s

            def element(begin: int, e: int) -> tuple[bytes, bool] | None:
                an_object = buf[begin] == ord("{")
                if at == 0 and not an_object:
                    return None
                if e < len(closes):
                    return data[begin : closes[e] + 1], an_object
                return _to_its_end(file, data[begin:], row["end"], size, inside, depth, at, an_object)

            nth = 0
            # Strays and elements in their order; a text is cut when its turn comes.
            order = np.argsort(np.r_[opens, strays[:, 0]], kind="stable").tolist()
            for i in order:
                if i < len(opens):
                    begin = int(opens[i])
                    found = element(begin, int(ends[i]))
                else:
                    begin, end = strays[i - len(opens)].tolist()
                    found = data[begin:end], False
                if found is None:
                    continue
                yield {"nth": nth, "position": row["begin"] + begin, "text": found[0].decode(encoding, "replace"), "sound": bool(found[1])}
                nth += 1
            for colon in marks:
                yield {"position": row["begin"] + int(colon), "name": _key_before(file, row["begin"] + int(colon))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for x in of_range(row):
                    rows.append({"file": row["file"], "begin": row["begin"], **x})
                    held += len(x.get("text") or "")
                    if held > GIVEN or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def objects(spark: SparkSession, paths: Sequence[str], key: str | None = None, encoding: str = "utf-8", size: int = 0) -> DataFrame:
    """The elements of arrays (or of files of bare objects), or of the arrays under ``key`` of an outer object: file, seq (from 0 in each file), text, sound.

    Elements that aren't objects, or have no end, aren't sound.
    """
    ship(spark)
    size = size or RANGE
    files = spark.createDataFrame(listed(spark, paths), "file string, size long")
    step = F.lit(size)
    begins = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)).alias("begin"))
    ranges = begins.select("file", "begin", F.least("size", F.col("begin") + step).alias("end"))
    tasks = max(1, min(10_000, sum(-(-n // max(size, TASK)) for _, n in listed(spark, paths))))
    sums = ranges.repartition(tasks, "file", "begin").mapInArrow(_sum_rows, "file string, begin long, end long, inside boolean, then_inside boolean, deeper long, first string")
    entered = sums.groupBy("file").applyInPandas(_chained, "file string, begin long, end long, inside boolean, depth long, first string")
    columns = "file string, begin long, nth int, position long, text string, name string, sound boolean"
    rows = stored(entered.repartition(tasks, "file", "begin").mapInArrow(_object_rows(None if key is None else 2, encoding), columns), "objects")
    found = rows.filter("text IS NOT NULL")
    if key is not None:
        marks = rows.filter("text IS NULL").select(F.col("file").alias("of"), "name", F.col("position").alias("since"))
        marks = marks.withColumn("until", F.lead("since").over(Window.partitionBy("of").orderBy("since"))).filter(F.col("name") == key)
        found = found.join(marks, (F.col("file") == F.col("of")) & (F.col("position") > F.col("since")) & (F.col("until").isNull() | (F.col("position") < F.col("until"))))
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy("file", "begin").orderBy("position")) - 1)  # a range's objects
    counts = found.groupBy(F.col("file").alias("of_file"), F.col("begin").alias("of_begin")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("of_file").orderBy("of_begin").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = counts.select("of_file", "of_begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = found.join(starts, (F.col("file") == F.col("of_file")) & (F.col("begin") == F.col("of_begin")))
    return numbered.select("file", (F.col("start") + F.col("nth")).alias("seq"), "text", "sound")


@dataclass
class Part(WriterCommitMessage):
    staged: str
    name: str


class ArrayFiles(DataSource):
    """Writes one string column, a JSON object each, as files that each hold an array, or ``{envelope: array}``.

    Every task streams into a file of its own beside the target; the commit puts
    them in place of what is there, an abort deletes them.
    """

    @classmethod
    def name(cls) -> str:
        return "marlspar_array_files"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ArrayWriter(self.options["path"], self.options.get("envelope"), overwrite)


class _ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, envelope: str | None, overwrite: bool):
        self.path, self.envelope, self.overwrite, self.run = path.rstrip("/"), envelope, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        store, path = opened(self.path)
        name = f"part-{task.partitionId():05d}-{self.run}.json"
        store.create_dir(f"{path}/_staged-{self.run}", recursive=True)
        staged = f"{path}/_staged-{self.run}/{task.taskAttemptId()}-{name}"  # attempts of a task don't meet
        head, tail = (f"{{{json.dumps(self.envelope)}: [", "]}") if self.envelope else ("[", "]")
        with store.open_output_stream(staged) as out:
            out.write(head.encode())
            first = True
            for batch in batches:
                for value in batch.column(0).to_pylist():
                    out.write((("" if first else ",\n") + value).encode())
                    first = False
            out.write(tail.encode())
        return Part(staged, name)

    def commit(self, parts: list[Part | None]) -> None:
        store, path = opened(self.path)
        store.create_dir(path, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if not f.path.endswith(f"_staged-{self.run}")]
        for part in parts:
            if part is not None:
                store.move(part.staged, f"{path}/{part.name}")
        for f in store.get_file_info(old) if self.overwrite else []:
            store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path)
        self._clear()

    def abort(self, parts: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, path = opened(self.path)
        if store.get_file_info(f"{path}/_staged-{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_staged-{self.run}")


def write_arrays(rows: DataFrame, path: str, envelope: str | None = None) -> None:
    """rows: one column of JSON objects; a file a partition."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(ArrayFiles)
    writer = rows.write.format(ArrayFiles.name()).option("path", path).mode("overwrite")
    (writer.option("envelope", envelope) if envelope else writer).save()
