"""Readers of captured sources. All take explicit schemas; a path that isn't there gives an empty table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspar.schema import RAW, S
from marlspar.sources import json_files


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern has a match, in whatever store it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def _there(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    return [p for p in paths if exists(spark, p)]


def json_array(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, encoding: str | None = None, key: str | None = None) -> DataFrame:
    """Files that each hold an array of objects, or bare objects, or an array under ``key``: the schema's columns, ``_corrupt_record``, ``file`` and ``seq``.

    Files are read by byte ranges, so a large one fills many tasks. An element
    that can't be read keeps its text in ``_corrupt_record`` and costs one row;
    ``seq`` counts the elements of a file from 0. Compressed files, and those in
    UTF-16 or UTF-32, are read whole by one task each, and without ``seq`` (null).
    """
    paths = _there(spark, [paths] if isinstance(paths, str) else paths)
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", S)])
    if not paths:
        return spark.createDataFrame([], T.StructType([*full.fields, T.StructField("file", S), T.StructField("seq", T.LongType())]))
    whole = re.search("16|32", encoding or "") or any(f.endswith((".gz", ".bz2", ".zst", ".deflate")) for f, _ in json_files.listed(spark, paths))
    if not whole:
        rows = json_files.objects(spark, paths, key, encoding or "utf-8")
        parsed = F.from_json(F.when(F.col("sound"), F.col("text")), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
        broken = F.when(~F.col("sound"), F.col("text")).otherwise(F.col("row._corrupt_record")).alias("_corrupt_record")
        return rows.withColumn("row", parsed).select(*[F.col(f"row.`{f.name}`") for f in schema.fields], broken, "file", "seq")
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    if encoding:
        reader = reader.option("encoding", encoding)
    where = [F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("seq")]
    if key is None:
        return reader.schema(full).json(paths).select(*full.names, *where)
    outer = T.StructType([T.StructField(key, T.ArrayType(schema))])
    rows = reader.schema(outer).json(paths).select(F.inline(key), *where)
    return rows.select(*schema.names, F.lit(None).cast("string").alias("_corrupt_record"), "file", "seq")


def numbered_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of a file's array that can be read, with the position of each as ``seq``, for outcomes that depend on the order of input."""
    return json_array(spark, path, schema).filter("_corrupt_record IS NULL").select("seq", *schema.names)


def envelope(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, key: str = "job_listings") -> DataFrame:
    """Files that hold ``{key: [objects]}``; without the key there are no rows. Columns as those of ``json_array``."""
    return json_array(spark, paths, schema, key=key)


def fallback_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text: UTF-8 (a byte order mark is dropped) where it is valid, else Latin-1; columns file, text, encoding."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("file", F.regexp_replace(text, r"^\uFEFF", "").alias("text"), F.when(valid, "utf-8").otherwise("latin-1").alias("encoding"))


def csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with a header line; quoted fields may hold commas and newlines."""
    paths = _there(spark, [paths] if isinstance(paths, str) else paths)
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(paths)


def delimited(spark: SparkSession, path: str, names: Sequence[str], separator: str = ":") -> DataFrame:
    """Text lines with exactly as many fields as names; others are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(n, S) for n in names]))
    parts = spark.read.text(path).select(F.split(F.trim("value"), f"\\Q{separator}\\E").alias("parts"))
    return parts.filter(F.size("parts") == len(names)).select(*[F.col("parts")[i].alias(n) for i, n in enumerate(names)])


def source(spark: SparkSession, name: str, paths: str | Sequence[str]) -> DataFrame:
    """A captured source by its name in ``schema.RAW``."""
    if name == "cuvette_csv":
        return csv(spark, paths, RAW[name])
    if name == "naukri":
        return envelope(spark, paths, RAW[name])
    return json_array(spark, paths, RAW[name])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A stored collection without its store's row ids."""
    return spark.read.parquet(path).drop("_id")


def pdf_text(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """Text of PDF files, pages in order: file, text, error. ``extract`` maps bytes to a list of page texts; by default pypdf, where it is installed."""
    import pandas as pd

    def run(batches):
        page_texts = extract
        if page_texts is None:
            try:
                from io import BytesIO

                from pypdf import PdfReader

                page_texts = lambda data: [p.extract_text() for p in PdfReader(BytesIO(data)).pages]
            except ImportError:
                page_texts = None
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    if page_texts is None:
                        raise RuntimeError("no PDF library is installed")
                    rows.append((file, "".join(page_texts(bytes(content))), None))
                except Exception as e:  # one bad file is one error row
                    rows.append((file, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "text", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, text string, error string")
