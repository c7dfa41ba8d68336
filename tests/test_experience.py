import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlspar.functions import experience as X

#: Pinned results of the capped family.
PINNED = [
    ("2-4 Years", 2, 4), ("2 - 4 Yrs", 2, 4), ("1.5 to 2.5 years", 1.5, 2.5), ("3+ years", 3, 60), ("less than 1 year", 0, 1),
    ("greater than 5 years", 5, 60), ("2 to 4 years", 2, 4), ("4 yrs", 4, 60), ("5 years", 5, 5), ("0-2", 0, 2), ("7", 7, 60),
    ("Fresher", None, None), ("0-2+ years", 2, 60), ("1.5-2.5 years", 5, 5), ("3-5 YEARS", 3, 5), ("0-5 Yrs", 0, 5), ("less than 2 years", 0, 2),
    ("", None, None), (None, None, None),
]


def found(spark, values, family):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", X.bounds(F.col("v"), family).alias("y")).orderBy("i").collect()
    return [None if r.y is None else (r.y.lo, r.y.hi) for r in rows]


def test_capped_family(spark):
    expected = [None if lo is None else (lo, hi) for _, lo, hi in PINNED]
    assert found(spark, [v for v, _, _ in PINNED], X.CAPPED) == expected


def test_open_families(spark):
    values = ["2 - 4 Years", "2-4 Yrs", "5 years", "3+ years", "7", "2-4 Years"]
    assert found(spark, values, X.OPEN) == [(4, 4), (2, 4), (5, 5), (3, math.inf), None, (2, 4)]
    assert found(spark, values, X.OPEN_LOWER) == [None, (2, 4), (5, 5), (3, math.inf), None, None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789.-+ toYyearslsthgr", max_size=24), min_size=20, max_size=60))
def test_first_rule_wins_like_a_plain_search(spark, values):
    def plain(v):
        for rule in X.CAPPED:
            m = re.search(rule.pattern, v, re.ASCII)
            if m:
                return tuple(b if isinstance(b, float) else float(m.group(b)) for b in (rule.lo, rule.hi))
        return None

    assert found(spark, values, X.CAPPED) == [plain(v) for v in values]


def test_defaults_text_and_band(spark):
    df = spark.sql("SELECT named_struct('lo', 1D, 'hi', 3D) y UNION ALL SELECT NULL UNION ALL SELECT named_struct('lo', double('nan'), 'hi', 3D)")
    got = {tuple(r[0]) for r in df.select(X.with_default(F.col("y"))).collect()}
    assert got == {(1.0, 3.0), (0.0, 60.0)}
    df = spark.createDataFrame([("1,3",), ("0,inf",), ("[0, 60]",), (None,)], "s string")
    got = [r[0] for r in df.select(X.from_text(F.col("s"))).collect()]
    assert [None if g is None else tuple(g) for g in got] == [(1.0, 3.0), (0.0, math.inf), None, None]
    df = spark.sql("SELECT named_struct('lo', 2D, 'hi', 4D) y")
    assert [df.select(X.in_band(F.lit(v), F.col("y"))).first()[0] for v in (1.9, 2.0, 4.0, 4.1)] == [False, True, True, False]


@pytest.mark.parametrize("months, years", [((12.0, 24.0), (1.0, 2.0)), ((6.0, 500.0), (0.5, math.inf))])
def test_months(spark, months, years):
    df = spark.createDataFrame([(months,)], "y struct<lo:double,hi:double>")
    assert tuple(df.select(X.months_to_years(F.col("y"))).first()[0]) == years
