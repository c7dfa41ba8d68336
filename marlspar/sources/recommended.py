"""Stored recommendations: a keyed table of users, and the lists that they name.

Users who ask with the same vector have the same nearest jobs, of which each sees
those of their own band. So a run's lists are written once a vector, as the
search gives them out, and a user's row says the run, the list's number in it and
the years: what is stored grows with users and with vectors times k, not with
users times k. Columns of jobs that the search doesn't need are stored once a run.

Lists never change, and are there before the users that name them are published
(``tables``), so a reader of a version sees whole recommendations. ``vacuum``
drops the runs that no user of a kept version names.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspar.operators import recommend, vectors
from marlspar.session import delete
from marlspar.sources import tables

USERS, LISTS, JOBS = "users", "lists", "jobs"
SEARCHED = ("vec_id", "embedding", "yoe")


def store(users: DataFrame, jobs: DataFrame, path: str, k: int = recommend.K) -> int:
    """Search anew for the users and replace what is stored for them, with nothing where nothing fits; the new version.

    users: chat_id, years, query; a row a user. jobs: vec_id, embedding, yoe, and others.
    """
    run = f"r{uuid.uuid4().hex}"  # never read as a number
    asked = users.filter(F.col("chat_id").isNotNull()).select("chat_id", "years", "query")
    mine, lists = vectors.shared_lists(jobs.select(*SEARCHED), asked, k)
    lists.write.option("compression", "zstd").parquet(f"{path}/{LISTS}/run={run}")
    others = [c for c in jobs.columns if c not in SEARCHED]
    if others:
        jobs.select("vec_id", *others).write.option("compression", "zstd").parquet(f"{path}/{JOBS}/run={run}")
    named = mine.select("chat_id", "years", F.lit(run).alias("run"), "query_no")
    return tables.upsert(named, f"{path}/{USERS}", keys=users.select("chat_id"))


def read(spark: SparkSession, path: str, version: int | None = None, chats: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """What is stored, as the rows of ``recommend.recommend``; chats: of these chat_ids alone; most: of each the first ranks alone."""
    named = tables.read(spark, f"{path}/{USERS}", version)
    if chats is not None:
        named = named.join(chats.select("chat_id").distinct(), "chat_id", "left_semi")
    lists = _runs(spark, path, LISTS)
    banded = recommend.banded_lists(named.join(lists, ["run", "query_no"]), "run")
    rows = recommend.rows_of_lists(banded if most is None else banded.withColumn("items", F.slice("items", 1, most)), "run")
    if JOBS not in tables.names(spark, path):
        return rows.drop("run")
    return rows.join(_runs(spark, path, JOBS), ["run", "vec_id"]).drop("run")


def vacuum(spark: SparkSession, path: str, keep: int = 1, idle_seconds: float = 86400) -> int:
    """Free what old versions held, and the runs that no user of the last ``keep`` versions names and nobody has written to lately; how many runs went."""
    tables.vacuum(spark, f"{path}/{USERS}", keep, idle_seconds)
    named = set()
    for version in tables.versions(spark, f"{path}/{USERS}"):
        named |= {f"run={r.run}" for r in tables.read(spark, f"{path}/{USERS}", version).select("run").distinct().collect()}  # a row a run
    gone = set()
    for kind in (LISTS, JOBS):
        for name in tables.names(spark, f"{path}/{kind}"):
            if name.startswith("run=") and name not in named and time.time() - tables.modified(spark, f"{path}/{kind}/{name}") >= idle_seconds:
                delete(spark, f"{path}/{kind}/{name}")
                gone.add(name)
    return len(gone)


def _runs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All runs' rows, with ``run``, which is the name of their partition."""
    return spark.read.option("mergeSchema", kind == JOBS).parquet(f"{path}/{kind}")
