"""Counts that describe a table."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from marlspar.session import stored


def column_counts(df: DataFrame) -> DataFrame:
    """One row with the number of values that are neither null nor NaN, by column."""
    floats = {n for n, t in df.dtypes if t in ("float", "double")}
    return df.agg(*[F.count(F.when(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")), 1) if c in floats else F.col(f"`{c}`")).alias(c) for c in df.columns])


def counts_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows"))


def largest_number(df: DataFrame, column: str) -> DataFrame:
    """The largest of the values that are digits only, as ``max_page``."""
    return df.agg(F.max(F.when(F.col(column).rlike("^[0-9]+$"), F.col(column).try_cast("long"))).alias("max_page"))


def removed(before: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """How many rows a delete by key takes away, as ``n_deleted``."""
    return before.join(keys, on, "left_semi").agg(F.count("*").alias("n_deleted"))


class Run:
    """Stages of a run: each is written once and read back, and is counted and timed while it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.done = spark, []

    def stage(self, name: str, df: DataFrame, *counts: Column) -> DataFrame:
        """The stage's rows, for the next one to read. counts: more aggregates to note, by their aliases."""
        seen, begin = Observation(), time.perf_counter()
        out = stored(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts), "stage")
        noted = dict(seen.get)
        self.done.append((name, noted.pop("n_rows"), time.perf_counter() - begin, {k: str(v) for k, v in noted.items()}))
        return out

    def report(self) -> DataFrame:
        """stage, n_rows, seconds, noted (the other aggregates, as text), in order."""
        return self.spark.createDataFrame(self.done, "stage string, n_rows long, seconds double, noted map<string,string>")


class StreamCounts(StreamingQueryListener):
    """Rows and milliseconds of each batch of the queries that run while this is added to ``spark.streams``, by query name."""

    def __init__(self) -> None:
        self.batches: list[tuple[str | None, int, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows, p.batchDuration))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
