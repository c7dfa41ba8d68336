"""Keyed tables: types of keys, crashes, readers and writers at once, files of old versions."""

import os

import pytest

from marlspar.sources import sinks, tables


def users(spark, keys, value, kind="long"):
    return spark.createDataFrame([(k, value) for k in keys], f"chat_id {kind}, v string")


def held(spark, path, version=None):
    return sorted((r.chat_id, r.v) for r in tables.read(spark, path, version).collect())


def test_keys_of_other_types_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_by_key(users(spark, range(20), "old"), path)
    sinks.upsert_by_key(users(spark, [1, 3], "new", "int"), path, keys=users(spark, [1, 3, 5, 7, 9], "", "int"))
    assert held(spark, path) == sorted([(k, "old") for k in range(20) if k not in (1, 3, 5, 7, 9)] + [(1, "new"), (3, "new")])
    sinks.upsert_by_key(users(spark, ["2"], "text", "string"), path)
    assert (2, "text") in held(spark, path) and len(held(spark, path)) == 17
    with pytest.raises(ValueError):
        sinks.upsert_by_key(users(spark, [1], "x").withColumnRenamed("v", "w"), path)
    assert len(held(spark, path)) == 17


def test_rows_of_other_keys_than_those_replaced_are_added(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert(users(spark, range(10), "a"), path, buckets=2)
    tables.upsert(users(spark, [1, 50], "b"), path, keys=users(spark, [1], ""))
    assert held(spark, path) == sorted([(k, "a") for k in range(10) if k != 1] + [(1, "b"), (50, "b")])


def test_null_is_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert(users(spark, [None, 1], "a"), path)
    tables.upsert(users(spark, [None], "b"), path)
    assert {(r.chat_id, r.v) for r in tables.read(spark, path).collect()} == {(None, "b"), (1, "a")}


def test_crash_before_the_commit_leaves_the_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.upsert(users(spark, range(5), "old"), path)
    with monkeypatch.context() as m:
        m.setattr(tables, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            tables.upsert(users(spark, [1, 2, 3], "lost"), path)
    assert held(spark, path) == [(k, "old") for k in range(5)] and tables.versions(spark, path) == [0]
    tables.upsert(users(spark, [2], "new"), path)
    assert held(spark, path) == [(0, "old"), (1, "old"), (2, "new"), (3, "old"), (4, "old")]


def test_readers_keep_their_version_until_it_is_freed(spark, tmp_path):
    path = str(tmp_path / "t")
    for value in "abc":
        tables.upsert(users(spark, range(3), value), path, buckets=1)
    snapshot = tables.read(spark, path, 0)
    tables.upsert(users(spark, [0], "d"), path)
    assert {r.v for r in snapshot.collect()} == {"a"} and tables.versions(spark, path) == [0, 1, 2, 3]
    assert tables.vacuum(spark, path, keep=2, idle_seconds=3600) == 0  # somebody may be writing still
    assert tables.vacuum(spark, path, keep=2, idle_seconds=-10) == 2
    assert tables.versions(spark, path) == [2, 3] and {v for _, v in held(spark, path, 2)} == {"c"}
    assert held(spark, path) == [(0, "d"), (1, "c"), (2, "c")]
    assert tables.vacuum(spark, path, idle_seconds=-10) == 1
    with pytest.raises(ValueError):
        tables.read(spark, path, 2)


@pytest.mark.parametrize("buckets", [1, 64])
def test_writers_at_once(spark, tmp_path, monkeypatch, buckets):
    """Another writer commits between a writer's reading and its commit, in the same bucket or in others."""
    path = str(tmp_path / "t")
    tables.upsert(users(spark, range(6), "old"), path, buckets=buckets)
    publish, pending = tables._publish, [True]

    def late(*args):
        if pending:
            pending.clear()
            tables.upsert(users(spark, [0, 1], "other"), path)
        publish(*args)

    monkeypatch.setattr(tables, "_publish", late)
    assert tables.upsert(users(spark, [5], "mine"), path) == 2
    assert held(spark, path) == [(0, "other"), (1, "other"), (2, "old"), (3, "old"), (4, "old"), (5, "mine")]


def test_a_version_is_published_once(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(users(spark, [1], "a"), path)
    with pytest.raises(tables.Conflict):
        tables._publish(spark, path, tables.manifest(spark, path))
    assert not [n for n in os.listdir(tmp_path / "t" / "_log") if n.startswith(".") and not n.endswith(".crc")]


def test_batches_are_applied_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in (0, 1, 1, 0):
        tables.append(users(spark, [batch], "x"), path, writer="w", batch=batch)
    assert held(spark, path) == [(0, "x"), (1, "x")]
    tables.upsert(users(spark, [0], "y"), path, writer="u", batch=7)
    tables.upsert(users(spark, [0], "z"), path, writer="u", batch=7)
    assert held(spark, path) == [(0, "y"), (1, "x")]


def test_a_key_without_rows_empties_its_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert(users(spark, [1], "a"), path, buckets=1)
    tables.upsert(users(spark, [], ""), path, keys=users(spark, [1], ""))
    assert held(spark, path) == []
    tables.upsert(users(spark, [4], "b"), path)
    assert held(spark, path) == [(4, "b")]
