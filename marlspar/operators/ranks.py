"""Numbers within keys, without a task that holds all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspar.session import stored


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """The rows with their number (from 1) in their key, in the given order, which must be total within a key.

    Rows are range-partitioned by key and order, so a key with many rows fills
    several ranges. Rows are numbered within their range of a key, and those of a
    key in several ranges start behind the counts of the ranges before: a row a
    key and range. Null is a key of its own.
    """
    taken = {c.lower() for c in df.columns}
    part, before, copies = (next(n for i in range(len(taken) + 1) if (n := f"_{base}{i or ''}") not in taken) for base in ("part", "before", "of"))
    by = [F.col(f"`{k}`") for k in keys]
    ordering = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in order]
    # A range partitioning must be asked for by columns or sort orders, and reads its input twice.
    dealt = df.repartitionByRange(*[F.asc_nulls_first(f"`{k}`") for k in keys], *ordering).withColumn(part, F.spark_partition_id())
    rows = stored(dealt, "ranges")
    counts = rows.groupBy(*by, part).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = counts.withColumn(before, F.sum("_n").over(earlier)).filter(F.col(before) > 0)
    starts = starts.select(*[F.col(f"`{k}`").alias(f"{copies}_{i}") for i, k in enumerate(keys)], F.col(part).alias(f"{copies}_part"), before)
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"{copies}_{i}")) for i, k in enumerate(keys)] + [F.col(part) == F.col(f"{copies}_part")]
    within = F.row_number().over(Window.partitionBy(part, *by).orderBy(*ordering))
    joined = rows.withColumn(name, within.cast("long")).join(starts, reduce(and_, same), "left")
    return joined.withColumn(name, F.col(name) + F.coalesce(F.col(before), F.lit(0))).select(*[f"`{c}`" for c in df.columns if c != name], name)
