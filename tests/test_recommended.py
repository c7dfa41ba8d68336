"""Stored recommendations: users name lists, and lists are stored once a vector."""

import time

from marlspar.operators import recommend
from marlspar.plans import flows
from marlspar.sources import recommended, tables


def _jobs(spark, low="0D"):
    return spark.range(40).selectExpr("id AS vec_id", "array(float(id div 2), 0f) AS embedding", f"named_struct('lo', {low}, 'hi', double(id % 4)) AS yoe", "concat('job ', id) AS title")


def _users(spark, n=60):
    return spark.range(n).selectExpr("id AS chat_id", "double(id % 3) AS years", "array(double(id % 2 * 19), 0D) AS query")


def test_lists_are_stored_once_a_vector_and_give_the_rows_of_the_search(spark, tmp_path):
    users, jobs, path = _users(spark), _jobs(spark), str(tmp_path / "found")
    page = flows.update(users, jobs, path, k=7)
    columns = ["chat_id", "rank", "vec_id", "d2", "yoe", "years", "title"]
    expected = recommend.recommend(users, jobs, k=7).select(*columns)
    assert sorted(recommended.read(spark, path).select(*columns).collect()) == sorted(expected.collect())
    assert sorted(page.select(*columns).collect()) == sorted(expected.filter("rank <= 10").collect())
    # Two vectors of 7 neighbours, whatever the number of users; no row a user and neighbour.
    assert [len(r["items"]) for r in spark.read.parquet(f"{path}/lists").collect()] == [7, 7]
    assert tables.read(spark, f"{path}/users").count() == 60


def test_users_are_replaced_also_by_nothing_and_runs_that_nobody_names_go(spark, tmp_path):
    users, path = _users(spark), str(tmp_path / "found")
    flows.update(users, _jobs(spark), path, k=7)
    before = recommended.read(spark, path, 0).collect()
    assert flows.update(users.filter("chat_id % 2 = 0"), _jobs(spark, "900D"), path, k=7).count() == 0
    left = recommended.read(spark, path)
    assert sorted(left.collect()) == sorted(r for r in before if r.chat_id % 2)
    assert sorted(recommended.read(spark, path, 0).collect()) == sorted(before)  # a version is whole
    assert recommended.vacuum(spark, path, keep=1, idle_seconds=0) == 0
    flows.update(users, _jobs(spark), path, k=3)
    time.sleep(0.01)
    assert recommended.vacuum(spark, path, keep=1, idle_seconds=0) == 2
    assert recommended.read(spark, path).filter("rank > 3").count() == 0
    gone = spark.createDataFrame([(0, 1.0, None)], "chat_id long, years double, query array<double>")
    flows.update(gone, _jobs(spark), path, k=3)  # no vector, so nothing is stored
    assert recommended.read(spark, path).filter("chat_id = 0").count() == 0


def test_a_page_makes_rows_of_what_it_shows_and_cuts_each_band_once(spark, tmp_path):
    users, jobs, path = _users(spark), _jobs(spark), str(tmp_path / "found")
    recommended.store(users, jobs, path, k=20)
    first = recommended.read(spark, path, most=3)
    assert sorted(first.collect()) == sorted(recommended.read(spark, path).filter("rank <= 3").collect())
    for df in (recommend.recommend(users, jobs.drop("title"), k=7), recommended.read(spark, path)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("filter(items") == 1
