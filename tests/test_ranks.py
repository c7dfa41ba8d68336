"""Numbers within keys: one key with all rows, many keys, null keys; phrases; metrics of a run."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marlspar.functions import extract, phrases
from marlspar.operators import dedup, profile, ranks


@pytest.mark.parametrize("keys", [1, 3, 400])
def test_numbers_equal_a_sort(spark, keys):
    rng = random.Random(keys)
    rows = [(rng.randrange(keys) if i % 11 else None, rng.random(), i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v double, i int, rank string").repartition(6)
    expected, seen = {}, {}
    for k, v, i, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1], r[2])):
        seen[k] = expected[i] = seen.get(k, 0) + 1
    got = ranks.ranked(df, ["k"], [F.col("v").desc(), "i"], "rank")
    assert got.columns == ["k", "v", "i", "rank"]
    assert {r.i: r["rank"] for r in got.collect()} == expected


def test_one_key_fills_many_tasks(spark, monkeypatch):
    """All rows have one key, but no task reads a third of them."""
    kept = []
    keep = ranks.stored
    monkeypatch.setattr(ranks, "stored", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    df = spark.range(40_000).select(F.lit("k").alias("k"), "id")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert dedup.later_copies(df, ["k"], ["id"]).agg(F.max("copy_no"), F.count("*"), F.countDistinct("copy_no")).first() == (40_000, 39_999, 39_999)
        sizes = [r["count"] for r in kept[0].groupBy("_part").count().collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(sizes) == 8 and max(sizes) < 40_000 / 3


def test_two_keys_and_none(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), ("a", 2, 5), ("b", 1, 9), (None, None, 3)], "x string, y int, z int")
    got = {tuple(r)[:3]: r.n for r in ranks.ranked(df, ["x", "y"], ["z"], "n").collect()}
    assert got == {("a", 1, 1): 1, ("a", 1, 2): 2, ("a", 2, 5): 1, ("b", 1, 9): 1, (None, None, 3): 1}
    assert ranks.ranked(df.limit(0), ["x"], ["z"]).count() == 0


def brute(text, known):
    """The longest known phrase at each place that is bounded, from left to right."""
    text = re.sub(r"\s+", " ", text).lower().strip(" ")
    out, at = [], 0
    while at < len(text):
        fits = [p for p in known if text.startswith(p, at)]
        fits = [p for p in fits if not (p[0].isalnum() and at and text[at - 1].isalnum()) and not (p[-1].isalnum() and text[at + len(p) : at + len(p) + 1].isalnum())]
        if fits:
            out.append(max(fits, key=len))
            at += len(out[-1])
        else:
            at += 1
    return out


def test_phrases_equal_a_search_at_every_place():
    rng = random.Random(1)
    alphabet = ["a", "b", "ab", "é", "c++", "node.js", ".", ",", " ", "  ", "\n", "-", "A"]
    for _ in range(300):
        known = {phrases.folded("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5)))) for _ in range(6)} - {""}
        text = "".join(rng.choice(alphabet) for _ in range(40))
        assert list(phrases.found(phrases.automaton(known), text)) == brute(text, known)


def test_phrases_of_several_words(spark):
    df = spark.createDataFrame([("I know Machine\nLearning, node.js. And C++, not JavaScript; machine learning",), (None,), ("",)], "t string")
    known = ["machine learning", "Machine", "node.js", "c++", "java", "learning"]
    got = [r[0] for r in df.select(extract.skills(F.col("t"), known)).collect()]
    assert got == [["machine learning", "node.js", "c++"], None, []]


def test_a_large_dictionary(spark):
    known = [f"skill {i}" for i in range(100_000)]
    df = spark.range(50).select("id", F.concat(F.lit("has skill "), F.col("id") * 1999, F.lit(", skill x.")).alias("t"))
    got = {r.id: r.s for r in df.select("id", extract.skills(F.col("t"), known).alias("s")).collect()}
    assert got == {i: [f"skill {i * 1999}"] for i in range(50)}


def test_hashed_embedding(spark):
    df = spark.createDataFrame([("a b a",), ("b a a",), (None,), ("",), ("c",)], "t string")
    got = [r[0] for r in df.select(extract.hashed_embedding(16)("t")).collect()]
    assert got[0] == got[1] and got[2] == got[3] == [0.0] * 16
    assert all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in (got[0], got[4]))


def test_a_run_counts_what_it_writes(spark):
    counted = spark.sparkContext.accumulator(0)
    one = F.udf(lambda x: counted.add(1) or x, "long")
    run = profile.Run(spark)
    first = run.stage("first", spark.range(100).select(one("id").alias("id")), F.sum("id").alias("total"))
    run.stage("second", first.filter("id < 10"))
    assert counted.value == 100  # no stage runs twice
    got = [(r.stage, r.n_rows, r.noted) for r in run.report().collect()]
    assert got == [("first", 100, {"total": "4950"}), ("second", 10, {})]
    assert all(r.seconds > 0 for r in run.report().collect())


def test_stream_counts(spark, tmp_path):
    for i in range(3):
        spark.range(5).write.parquet(str(tmp_path / "in" / str(i)))
    counts = profile.StreamCounts()
    spark.streams.addListener(counts)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        query = stream.writeStream.queryName("q").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(counts)
    assert sum(n for name, _, n, _ in counts.batches if name == "q") == 15
