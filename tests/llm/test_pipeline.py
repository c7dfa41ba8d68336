"""The pipeline on a small corpus, each stage held against plain Python on its own input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlspar.llm import decontaminate, runtime

from .test_documents import brute_lines, brute_near, words


@pytest.fixture(scope="module")
def corpus(spark, sf_dir, tmp_path_factory):
    """(name, input, output) of every stage, over the small data and some planted documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = " ".join(f"the uncommon word number {i} of this clean text is {i * 7919 % 1013}" for i in range(40))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    planted = [
        (90001, clean, "en", "p"), (90002, clean + " tail", "en", "p"), (90003, f"{' '.join(clean.split()[5:60])} {item} and more", "en", "p"),
        (90004, "1234 5678 !!!", "en", "p"), (90005, None, "en", "p"), (90006, clean, "en", "p"),
    ]
    docs = docs.union(spark.createDataFrame([(*p, len(p[1] or "")) for p in planted], docs.schema))
    steps = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        steps.append((name, docs, out))
        docs = out
    return steps


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_names_and_columns(corpus):
    assert [name for name, _, _ in corpus] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for _, before, after in corpus[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_rejects_what_has_no_letters(corpus):
    _, before, after = corpus[0]
    gone = texts(before).keys() - texts(after).keys()
    assert {90004, 90005} <= gone
    assert len(gone) <= 2 + 0.01 * before.count()


def test_line_stage(corpus):
    _, before, after = corpus[1]
    rows = [tuple(r) for r in before.select("doc_id", F.xxhash64("text"), "text").collect()]
    expected = {d: kept for (d, _), kept in brute_lines(rows, 8).items()}
    got = texts(after)
    for doc_id, kept in expected.items():
        assert got.get(doc_id) == kept if any(words(x) for x in kept.split("\n")) else doc_id not in got
    assert 90006 not in got and 90001 in got


def test_near_stage(corpus):
    _, before, after = corpus[2]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    expected = {d for d, _, least in brute_near(rows, 5, 80) if d == least or least is None}
    assert texts(after).keys() == expected
    assert 90002 not in expected and 90001 in expected


def test_benchmark_stage(spark, sf_dir, corpus):
    _, before, after = corpus[3]
    plain = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {d for d, t in texts(before).items() if any(i in plain(t) for i in items)}
    assert 90003 in leaks and leaks <= texts(before).keys() - texts(after).keys()
    again = decontaminate.contaminated(after, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert again.count() == 0 and len(texts(before)) - len(texts(after)) <= len(leaks) + 2


def test_mixing_stage(corpus):
    _, before, after = corpus[4]
    assert set(after.columns) == {*before.columns, "size", "source_size", "target", "taken", "copies"}
    sizes = Counter()
    for r in before.select("source", "text").collect():
        sizes[r.source] += len(words(r.text))
    for r in after.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s"), F.max("size").alias("m")).collect():
        assert r.s == sizes[r.source] and abs(r.t - r.g) <= 5000 and r.t <= 3 * r.s


def test_run_equals_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.filter("taken > 3 * size").count() == 0
    runtime.release(spark)


@pytest.mark.parametrize("rows", ["none", "awkward"])
def test_stages_on_awkward_tables(spark, sf_dir, edge_docs, rows):
    """Every stage on an empty table, and on nulls, ties, repeated rows and extra columns with the operators' own names."""
    docs = edge_docs.limit(0) if rows == "none" else edge_docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = runtime.stored(stage(spark, docs, sf_dir), name)
        if name != "mixing":
            assert docs.schema == before.schema
        assert docs.count() <= before.count()
    assert (docs.count() == 0) == (rows == "none")
    runtime.release(spark)
