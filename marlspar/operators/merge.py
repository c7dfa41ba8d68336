"""Union of sources into the master job table: defaults, then dense numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspar.functions.experience import with_default
from marlspar.functions.text import posted_date
from marlspar.schema import JOB, JOB_STRINGS

#: Rows of a source that are numbered by one sort.
CHUNK = 1_000_000


def union_sources(sources: Sequence[DataFrame | None]) -> DataFrame:
    """UNION ALL in the given order by column name; None (a missing source) is skipped. ``file_rank`` is the place in the order."""
    ranked = [df.withColumn("file_rank", F.lit(i)) for i, df in enumerate(sources) if df is not None]
    if not ranked:
        raise ValueError("no source is there")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def flattened(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """One list out of many: a row for each struct of an array column, with the key columns; null and empty arrays add nothing."""
    return df.select(*[df[k] for k in keys], F.inline(column))


def with_defaults(df: DataFrame, compat: bool = False) -> DataFrame:
    """The columns of the master table, but for the number; missing columns get their defaults, explicit nulls stay.

    compat: a missing yoe stays null (and so never recommended) instead of 0 to 60.
    """
    keep = [c for c in ("file_rank", "seq") if c in df.columns]
    out = []
    for field in JOB.fields[:-1]:
        c = field.name
        if c in JOB_STRINGS or c == "Source":
            out.append(df[c].cast("string").alias(c) if c in df.columns else F.lit("N/A").alias(c))
        elif c == "Posted_date":
            date = F.lit(None).cast("date") if c not in df.columns else df[c] if dict(df.dtypes)[c] == "date" else posted_date(df[c])
            out.append(date.alias(c))
        else:
            yoe = df[c] if c in df.columns else F.lit(None).cast(field.dataType)
            out.append((yoe if compat else with_default(yoe)).alias(c))
    return df.select(*keep, *out)


def numbered(df: DataFrame, rank: str = "file_rank", seq: str = "seq", name: str = "job_indx", chunk: int = CHUNK, ties: Sequence[str] = ()) -> DataFrame:
    """Dense numbers from 0 in order of (rank, seq, ties); seq is a whole number, unique within a rank or told apart by the ties.

    No global sort: rows are numbered within chunks of seq, and each chunk
    starts behind the counts of those before it, a small table: sequences that
    leave gaps, such as hashes, are cut into no more than as many chunks as
    their rows would fill, and a thousand more.
    """
    spans = df.groupBy(rank).agg(F.min(seq).alias("_least"), F.greatest(F.lit(float(chunk)), (F.max(seq) - F.min(seq) + 1) / (F.count("*") / chunk + 1000)).alias("_width"))
    df = df.join(spans.select(F.col(rank).alias("_span"), "_least", "_width"), F.col(rank) == F.col("_span"))
    part = F.floor((F.col(seq) - F.col("_least")) / F.col("_width"))
    df = df.withColumn("_part", part)
    counts = df.groupBy(rank, "_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy(rank, "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(rank).alias("_rank"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = df.join(starts, (F.col(rank) == F.col("_rank")) & (F.col("_part") == F.col("_of")))
    within = Window.partitionBy(rank, "_part").orderBy(seq, *ties)
    return joined.withColumn(name, F.col("_start") + F.row_number().over(within) - 1).drop("_rank", "_of", "_part", "_start", "_span", "_least", "_width")


def valid_and_rejected(df: DataFrame, raw_date: str = "Posted_date") -> tuple[DataFrame, DataFrame]:
    """Rows that can be loaded, and those whose date is there but malformed, with the reason."""
    bad = (F.coalesce(F.col(raw_date), F.lit("")) != "") & posted_date(F.col(raw_date)).isNull()
    return df.filter(~bad), df.filter(bad).withColumn("error", F.concat(F.lit("bad date: "), F.col(raw_date)))
