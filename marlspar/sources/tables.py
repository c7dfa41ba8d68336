"""Keyed tables on disk with a log of commits.

A version of a table is a manifest in its log: the folders of Parquet files that
make it up, by key bucket, and the batches that have been applied. Writers put
new files beside those that are there and publish them by renaming a manifest to
the next free number, which fails if another writer was first. So a reader sees
one whole version however long it reads, a crash before the rename leaves no
trace but files that no version names, and a writer that comes second looks at
what has changed: if its buckets are as it read them it only publishes anew,
else it merges again. ``vacuum`` frees what old versions held.

Renames must be atomic and refuse to replace, as those of HDFS do.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspar.session import delete, stored

LOG, DATA, BUCKET = "_log", "data", "key_bucket"
BUCKETS = 64
RETRIES = 20


class Conflict(Exception):
    """Another writer has published this version."""


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    hadoop, fs = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def modified(spark: SparkSession, path: str) -> float:
    """When a file or folder was last written to, in seconds."""
    hadoop, fs = _files(spark, path)
    return fs.getFileStatus(hadoop).getModificationTime() / 1000


def _text(spark: SparkSession, path: str) -> str:
    hadoop, fs = _files(spark, path)
    stream = fs.open(hadoop)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that can be read, in order."""
    return [int(n.removesuffix(".json")) for n in names(spark, f"{path}/{LOG}") if n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version (by default the last) consists of; None where there is no table."""
    there = versions(spark, path)
    if version is None and not there:
        return None
    if version is not None and version not in there:
        raise ValueError(f"no version {version} in {path}")
    return json.loads(_text(spark, f"{path}/{LOG}/{there[-1] if version is None else version:020d}.json"))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A snapshot of the table."""
    found = manifest(spark, path, version)
    if found is None:
        raise ValueError(f"no table in {path}")
    return _read(spark, path, found)


def _read(spark: SparkSession, path: str, found: dict, buckets: set[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(found["schema"])
    folders = [f"{path}/{f}" for b, some in sorted(found["folders"].items()) for f in some if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, path: str, found: dict) -> None:
    """Make a manifest the version whose number it has, unless there is one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staged, fs = _files(spark, f"{path}/{LOG}/.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{LOG}/{found['version']:020d}.json")
    if fs.exists(target):
        fs.delete(staged, False)
        raise Conflict(f"version {found['version']} is there")
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(staged, target, no_options)
    except Exception as e:
        fs.delete(staged, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {found['version']} is there") from e
        raise


def _fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns in the table's order and types."""
    if BUCKET in df.columns:
        raise ValueError(f"{BUCKET} is the name of the table's own column")
    if sorted(df.columns) != sorted(schema.names):
        raise ValueError(f"the table has the columns {schema.names}, not {df.columns}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def _staged(df: DataFrame, path: str, bucket) -> dict[str, list[str]]:
    """Write rows by their buckets beside the table; the folders of each bucket that has any."""
    spark, folder = df.sparkSession, f"{DATA}/{uuid.uuid4().hex}"
    df.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{path}/{folder}")
    return {n.removeprefix(f"{BUCKET}="): [f"{folder}/{n}"] for n in names(spark, f"{path}/{folder}") if n.startswith(f"{BUCKET}=")}


def upsert(
    df: DataFrame, path: str, key: str = "chat_id", buckets: int = BUCKETS, keys: DataFrame | None = None, writer: str | None = None, batch: int | None = None
) -> int:
    """Replace the rows of the keys in ``df``, or of those in ``keys``, so that a key without new rows is left with none; the version that has them.

    Keys and rows take the table's types. Only the buckets that the keys fall
    into are read and written anew. A batch of a writer that the table has
    already is not applied again. A null key is a key.
    """
    spark, once = df.sparkSession, None
    for _ in range(RETRIES):
        base = manifest(spark, path)
        if base is None:
            base = {"version": -1, "key": key, "buckets": buckets, "schema": json.loads(df.schema.json()), "folders": {}, "applied": {}}
        if base["key"] != key:
            raise ValueError(f"the table's key is {base['key']}, not {key}")
        if writer is not None and base["applied"].get(writer, -1) >= batch:
            return base["version"]
        schema = T.StructType.fromJson(base["schema"])
        bucket = F.pmod(F.xxhash64(key), F.lit(base["buckets"])).cast("int")
        if keys is None and once is None:
            df = once = stored(_fitted(df, schema), "new_rows")  # its keys and its rows are read
        rows = _fitted(df, schema)
        replaced = (rows if keys is None else keys).select(F.col(key).cast(schema[key].dataType).alias(key)).distinct()
        touched = {str(r[0]) for r in replaced.select(bucket).distinct().collect()}  # no more than there are buckets
        if base["folders"].keys() & touched:
            gone = replaced.withColumnRenamed(key, "_replaced")
            old = _read(spark, path, base, touched)
            rows = rows.unionByName(old.join(gone, F.col(key).eqNullSafe(F.col("_replaced")), "left_anti"))
        new = _staged(rows, path, bucket)
        changed = {b: new.get(b, []) for b in touched}
        changed |= {b: base["folders"].get(b, []) + some for b, some in new.items() if b not in touched}  # rows of other keys than those in ``keys``
        done = _committed(spark, path, base, changed, writer, batch)
        if done is not None:
            return done
    raise Conflict(f"{RETRIES} writers were faster")


def append(df: DataFrame, path: str, key: str = "chat_id", buckets: int = BUCKETS, writer: str | None = None, batch: int | None = None) -> int:
    """Add rows; the version that has them. A batch of a writer that the table has already is not added again."""
    spark = df.sparkSession
    base = manifest(spark, path) or {"version": -1, "key": key, "buckets": buckets, "schema": json.loads(df.schema.json()), "folders": {}, "applied": {}}
    if writer is not None and base["applied"].get(writer, -1) >= batch:
        return base["version"]
    rows = _fitted(df, T.StructType.fromJson(base["schema"]))
    new = _staged(rows, path, F.pmod(F.xxhash64(base["key"]), F.lit(base["buckets"])).cast("int"))
    done = _committed(spark, path, base, new, writer, batch, adds=True)
    if done is None:
        raise Conflict(f"{RETRIES} writers were faster")
    return done


def _committed(spark: SparkSession, path: str, base: dict, changed: dict[str, list[str]], writer: str | None, batch: int | None, adds: bool = False) -> int | None:
    """Publish the changed buckets on top of the last version; None if others have changed these since ``base``."""
    for _ in range(RETRIES):
        last = manifest(spark, path) or base
        if not adds and any(last["folders"].get(b, []) != base["folders"].get(b, []) for b in changed):
            return None
        if writer is not None and last["applied"].get(writer, -1) >= batch:
            return last["version"]
        folders = last["folders"] | {b: last["folders"].get(b, []) * adds + some for b, some in changed.items()}
        applied = last["applied"] | ({writer: batch} if writer is not None else {})
        try:
            _publish(spark, path, last | {"version": last["version"] + 1, "folders": {b: f for b, f in folders.items() if f}, "applied": applied})
            return last["version"] + 1
        except Conflict:
            continue
    return None


def vacuum(spark: SparkSession, path: str, keep: int = 1, idle_seconds: float = 86400) -> int:
    """Drop all versions but the last ``keep``, and the folders that none of these names and nobody has written to lately; how many folders went."""
    there = versions(spark, path)
    for version in there[: max(0, len(there) - keep)]:
        delete(spark, f"{path}/{LOG}/{version:020d}.json")
    named = {f for v in there[-keep:] for some in manifest(spark, path, v)["folders"].values() for f in some}
    gone = 0
    for folder in names(spark, f"{path}/{DATA}"):
        if time.time() - modified(spark, f"{path}/{DATA}/{folder}") < idle_seconds:
            continue
        for name in names(spark, f"{path}/{DATA}/{folder}"):
            if name.startswith(f"{BUCKET}=") and f"{DATA}/{folder}/{name}" not in named:
                delete(spark, f"{path}/{DATA}/{folder}/{name}")
                gone += 1
    return gone
