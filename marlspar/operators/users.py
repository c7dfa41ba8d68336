"""Users: validation, latest registration, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"


def validated(df: DataFrame, chat_id: str = "chat_id", email: str = "email", years: str = "years_of_experience") -> DataFrame:
    """Typed id and years, and ``is_valid``: id and years are numbers and the address is well formed."""
    number, value = F.col(chat_id).try_cast("long"), F.col(years).try_cast("double")
    good = number.isNotNull() & value.isNotNull() & F.coalesce(F.col(email).rlike(EMAIL), F.lit(False))
    return df.withColumns({chat_id: number, years: value, "is_valid": good})


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key in the given order, by a partial aggregation."""
    row = F.max_by(F.struct(*[df[c] for c in df.columns]), F.struct(*order))
    return df.groupBy(df[key]).agg(row.alias("_row")).select("_row.*")


def registered(requests: DataFrame, users: DataFrame, key: str) -> DataFrame:
    return requests.join(users.select(key).distinct(), key, "left_semi")


def unregistered(requests: DataFrame, users: DataFrame, key: str) -> DataFrame:
    return requests.join(users.select(key).distinct(), key, "left_anti")


def is_pdf(name: str, mime: str) -> Column:
    return (F.col(mime) == "application/pdf") | (F.col(mime).isNull() & F.lower(F.col(name)).endswith(".pdf"))


def lookup(df: DataFrame, key: str, value, order: list[Column]) -> DataFrame:
    """The first row with that key, in the given order; none if there is none."""
    return df.filter(F.col(key) == F.lit(value)).orderBy(*order).limit(1)
