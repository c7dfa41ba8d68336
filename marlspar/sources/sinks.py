"""Writers: whole tables, upserts by key, rejects apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspar.sources import json_files, tables


def json(df: DataFrame, path: str) -> None:
    """Overwrite with JSON lines; characters beyond ASCII stay as they are, times keep their microseconds."""
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    df.write.mode("overwrite").options(**times).json(path)


def json_arrays(df: DataFrame, path: str, key: str, files: int = 8, envelope: str | None = None) -> None:
    """Overwrite with files that each hold an array of objects, or ``{envelope: [objects]}``; rows are dealt out by the hash of ``key``.

    Each task streams its rows into a file, in the order of the rows' text; all files appear with the commit.
    """
    rows = df.select(F.to_json(F.struct(*[df[c] for c in df.columns])).alias("value"), F.xxhash64(key).alias("dealt"))
    json_files.write_arrays(rows.repartition(files, "dealt").sortWithinPartitions("value").select("value"), path, envelope)


def json_array(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Overwrite with one array in one file, in the given order: what a consumer that knows no folders reads. One task streams it."""
    ordered = df.orderBy(*order) if order else df
    json_files.write_arrays(ordered.select(F.to_json(F.struct(*[ordered[c] for c in df.columns])).alias("value")).coalesce(1), path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def nested_csv(documents: DataFrame, path: str) -> None:
    """The metadata of nested recommendations as CSV rows."""
    rows = documents.select(F.explode("job_recommendation").alias("d")).select("d.metadata.*")
    csv(rows, path)


def comparison_csv(df: DataFrame, path: str, job: str, left: str, right: str) -> None:
    """A posting and two extractors' results side by side."""
    csv(df.select(F.col(job).alias("Job"), F.col(left).alias("left"), F.col(right).alias("right")), path)


def reload(df: DataFrame, path: str) -> None:
    """Truncate and load."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def load_with_rejects(good: DataFrame, bad: DataFrame, path: str, rejects: str) -> None:
    """Load the valid rows; the others go to a table of their own with the reason."""
    reload(good, path)
    reload(bad, rejects)


def upsert_by_key(df: DataFrame, path: str, key: str = "chat_id", buckets: int = tables.BUCKETS, keys: DataFrame | None = None) -> int:
    """Replace the rows of the keys in ``df``, or of those in ``keys``, in a table that ``tables.read`` reads; its new version."""
    return tables.upsert(df, path, key, buckets, keys)


def vectors(df: DataFrame, path: str) -> None:
    """A vector store: id, text, metadata and embedding, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def content_id(df: DataFrame, column: str = "text", name: str = "vector_id") -> DataFrame:
    """An id that depends on the content alone, so equal content is one entry."""
    return df.withColumn(name, F.sha2(F.col(column), 256))
