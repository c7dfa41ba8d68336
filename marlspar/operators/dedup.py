"""Exact duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspar.operators import ranks


def full_row(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One of each set of equal rows (null equals null); ``scope`` columns, such as a file name, keep scopes apart."""
    missing = [c for c in scope if c not in df.columns]
    if missing:
        raise ValueError(f"no such scope columns: {missing}")
    return df.dropDuplicates()


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    The order must be total for the outcome to be determined. The rows of a key
    are reduced by a partial aggregation, so a hot key is no single large task.
    """
    first = F.min_by(F.struct(*[df[c] for c in df.columns]), F.struct(*order))
    return df.groupBy(*[df[k] for k in keys]).agg(first.alias("_row")).select("_row.*")


def later_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """All rows but the first of each key, with their number among the key's rows as ``copy_no`` (from 2)."""
    return ranks.ranked(df, keys, order, "copy_no").filter("copy_no > 1")


def distinct_items(df: DataFrame, column: str) -> DataFrame:
    """Distinct elements of an array column of structs, as columns."""
    return df.select(F.inline(column)).distinct()
