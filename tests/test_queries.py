"""Every registered engine query against its DuckDB counterpart."""

import duckdb
import pytest

import __spark_entry__
from marlspar.functions.html import elements
from marlspar.plans import catalog, roundtrips  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return {k: plain(x) for k, x in v.asDict().items()} if hasattr(v, "asDict") else [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_oracle(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    expected = sorted(repr([dict(zip(names, r))[c] for c in order]) for r in cursor.fetchall())
    assert got == expected


def test_cards_equal_the_parser(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    expected = sorted((i, n, e["text"]) for i, page in pages.items() for n, e in enumerate(elements(page, tag="p")) if e["text"])
    assert sorted((r.page_id, r.position, r.text) for r in catalog.html_cards(spark, sf_dir).collect()) == expected


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert df.columns == ["chat_id", "vec_id", "d2", "rank"]
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
