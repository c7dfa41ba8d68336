"""Free-text experience as bounds in years: the first rule that matches decides."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A pattern, and for each bound the number of a group or a value."""

    pattern: str
    lo: int | float
    hi: int | float


def rules(units: str, short_units: str, top: float, spaced: bool, bare: bool) -> tuple[Rule, ...]:
    """The live rules in order. Integers are group numbers, floats are values.

    spaced: spaces may stand around the dash. bare: numbers without a unit count.
    """
    dash = r"\s*-\s*" if spaced else "-"
    found = [
        Rule(rf"(\d+){dash}(\d+) ({units})", 1, 2),
        Rule(rf"(\d+\.\d+) to (\d+\.\d+) ({units})", 1, 2),
        Rule(rf"(\d+)\+ ({units})", 1, top),
        Rule(rf"less than (\d+) ({short_units})", 0.0, 1),
        Rule(rf"greater than (\d+) ({units})", 1, top),
        Rule(rf"(\d+) to (\d+) ({units})", 1, 2),
        Rule(rf"(\d+) ({units})", 1, 1),
    ]
    if bare:
        found += [Rule(r"(\d+)-(\d+)", 1, 2), Rule(r"(\d+)", 1, top)]
    return tuple(found)


#: Unit words and open ends of each family of sources.
CAPPED = rules("Years|years|Yrs", "Years|year|years|Yrs", 60.0, spaced=True, bare=True)
OPEN = rules("Years|years|Yrs", "Years|year|years|Yrs", float("inf"), spaced=False, bare=False)
OPEN_LOWER = rules("years|Yrs", "year|years|Yrs", float("inf"), spaced=False, bare=False)

DEFAULT_LO, DEFAULT_HI = 0.0, 60.0


def bounds(c: Column, family: Sequence[Rule] = CAPPED) -> Column:
    """struct(lo, hi) of the first rule that matches anywhere in the text; null if none does.

    The rules stand inside a lambda, so that plans which use the bounds several
    times do not generate their code several times.
    """

    def bound(x: Column, rule: Rule, b: int | float) -> Column:
        return F.lit(b) if isinstance(b, float) else F.regexp_extract(x, rule.pattern, b).try_cast("double")

    def decide(x: Column) -> Column:
        out = F
        for rule in family:
            out = out.when(x.rlike(rule.pattern), F.struct(bound(x, rule, rule.lo).alias("lo"), bound(x, rule, rule.hi).alias("hi")))
        return out

    return F.get(F.transform(F.array(c), decide), F.lit(0))


def bounds_or_default(c: Column, family: Sequence[Rule] = CAPPED) -> Column:
    """``bounds``, or 0 to 60 where no rule matches."""
    return F.coalesce(bounds(c, family), F.struct(F.lit(DEFAULT_LO).alias("lo"), F.lit(DEFAULT_HI).alias("hi")))


def with_default(yoe: Column) -> Column:
    """Null, or null or NaN bounds, become 0 to 60."""
    total = yoe["lo"] + yoe["hi"]
    return F.when(total.isNotNull() & ~F.isnan(total), yoe).otherwise(F.struct(F.lit(DEFAULT_LO).alias("lo"), F.lit(DEFAULT_HI).alias("hi")))


def to_text(yoe: Column) -> Column:
    """``lo,hi``, for outputs that keep bounds as text."""
    return F.concat_ws(",", yoe["lo"].cast("string"), yoe["hi"].cast("string"))


def from_text(c: Column) -> Column:
    """Bounds from ``lo,hi``; null if either isn't a number."""
    lo, hi = (F.get(F.split(c, ","), F.lit(i)).try_cast("double") for i in (0, 1))
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def months_to_years(yoe: Column, open_end: float = 500.0) -> Column:
    """Bounds in months as years; an upper bound of ``open_end`` is open."""
    hi = F.when(yoe["hi"] >= open_end, float("inf")).otherwise(yoe["hi"] / 12)
    return F.when(yoe.isNotNull(), F.struct((yoe["lo"] / 12).alias("lo"), hi.alias("hi")))


def in_band(years: Column, yoe: Column) -> Column:
    """Whether the years lie in the bounds, both ends included; null bounds never hold."""
    return F.coalesce(years.between(yoe["lo"], yoe["hi"]), F.lit(False))
