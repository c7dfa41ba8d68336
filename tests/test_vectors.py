"""Exact neighbours by a grid of blocks against every distance."""

import numpy as np
import pyarrow as pa
import pytest

from marlspar.operators import recommend, vectors


def clusters(rng, n, dims=8, centers=6):
    middle = rng.normal(size=(centers, dims)) * 10
    return np.round(middle[rng.integers(0, centers, n)] + rng.normal(size=(n, dims)) * 0.3, 2)


def brute(items, queries, k):
    out = []
    for asker, q in queries:
        d = [(round(float(sum((a - b) ** 2 for a, b in zip(x, q))), 6), i) for i, x in items]
        out += [(asker, i, d2, n + 1) for n, (d2, i) in enumerate(sorted(d)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("per_pivot, rings, block_bytes, block_queries, held, k", [(10, 4, 8 * 8 * 7, 5, 20, 9), (40, 1, 1 << 20, 512, 1 << 22, 1), (1, 16, 64, 1, 1, 30), (5000, 16, 1 << 20, 512, 1 << 22, 1000)])
def test_grid_equals_every_distance(spark, monkeypatch, per_pivot, rings, block_bytes, block_queries, held, k):
    for name, value in (("ITEMS_PER_PIVOT", per_pivot), ("RINGS", rings), ("BLOCK_BYTES", block_bytes), ("BLOCK_QUERIES", block_queries), ("HELD", held)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(k)
    x = clusters(rng, 200)
    x[50:60] = x[0]  # ties, told apart by the ids
    items = [(f"i{i:03}", v.tolist()) for i, v in enumerate(x)]
    q = clusters(rng, 25)
    q[:5] = x[0]
    queries = [(i, v.tolist()) for i, v in enumerate(q)] + [(100, q[7].tolist())]
    got = vectors.nearest_to_each(
        spark.createDataFrame([*items, ("null", None)], "vec_id string, embedding array<float>").repartition(4),
        spark.createDataFrame([*queries, (200, None)], "chat_id int, query array<double>").repartition(3), k,
    )
    x32 = [(i, np.float32(v).astype(float).tolist()) for i, v in items]
    assert got.columns == ["chat_id", "vec_id", "d2", "rank"]
    expected, rows = brute(x32, queries, k), sorted(map(tuple, got.collect()), key=str)
    assert [r[:2] + r[3:] for r in rows] == [r[:2] + r[3:] for r in expected]
    assert np.allclose([r[2] for r in rows], [r[2] for r in expected], atol=2e-6)


def test_empty(spark):
    items = spark.createDataFrame([], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "chat_id long, query array<double>")
    assert vectors.nearest_to_each(items, queries).collect() == []
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert vectors.nearest_to_each(one, queries.limit(0)).collect() == []


class Sent:
    def __init__(self, value):
        self.value = value


def test_skipped_rings_hold_no_neighbour():
    """Most rings are skipped, and none that holds one of the k nearest."""
    rng = np.random.default_rng(4)
    x, q = clusters(rng, 3000, centers=12), clusters(rng, 200, centers=12)
    q = np.concatenate([q, x[:100]])
    pivots = x[rng.choice(len(x), 12, replace=False)]
    d = np.sqrt(((x[:, None] - pivots) ** 2).sum(axis=2))
    pivot, near = d.argmin(axis=1), d.min(axis=1)
    ring = np.minimum(3, (near * 2).astype(int))
    rings = []
    for p, r in sorted(set(zip(pivot.tolist(), ring.tolist()))):
        mine = near[(pivot == p) & (ring == r)]
        rings.append((p, r, mine.min(), mine.max(), len(mine)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(q.tolist())], names=["query_no", "query"])
    k, wanted = 5, set()
    for rows in vectors._wanted_rows(Sent(pivots), Sent(np.array(rings, float)), k)(iter([batch])):
        for row in rows.to_pylist():
            assert np.array_equal(np.frombuffer(row["queries"]).reshape(-1, 8), q[row["query_nos"]])
            wanted |= {(n, row["pivot"], row["ring"]) for n in row["query_nos"]}
    assert len(wanted) < len(q) * len(rings) / 4
    d2 = vectors._distances(q, x)
    for n in range(len(q)):
        limit = np.sort(d2[n])[k - 1]
        assert {(n, pivot[i], ring[i]) for i in np.flatnonzero(d2[n] <= limit)} <= wanted


def test_equal_queries_are_searched_once(spark, monkeypatch):
    searched = []
    keep = vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda df, name: searched.append((name, keep(df, name))) or searched[-1][1])
    items = spark.range(50).selectExpr("id AS vec_id", "array(float(id)) AS embedding")
    queries = spark.range(90).selectExpr("id AS chat_id", "array(double(id % 3)) AS query")
    assert vectors.nearest_to_each(items, queries, 4).count() == 360
    assert dict(searched)["queries"].count() == 3


def test_lists_carry_what_users_need_and_are_a_row_a_query(spark, monkeypatch):
    """Users who share a vector share its list until the band is cut from it: no row a neighbour is shuffled, and blocks go once to a group of queries."""
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 2 * 5)
    jobs = spark.range(40).selectExpr("id AS vec_id", "array(float(id div 2), 0f) AS embedding", "named_struct('lo', 0D, 'hi', double(id % 4)) AS yoe")
    users = spark.range(60).selectExpr("id AS chat_id", "double(id % 3) AS years", "array(double(id % 2 * 19), 0D) AS query")
    found = recommend.recommend(users, jobs, k=7)
    near = {0: list(range(7)), 1: [38, 39, 36, 37, 34, 35, 32]}
    expected = [(c, [i for i in near[c % 2] if i % 4 >= c % 3]) for c in range(60)]
    rows = found.orderBy("chat_id", "rank").collect()
    assert [(r.chat_id, r.vec_id, r["rank"]) for r in rows] == [(c, i, n + 1) for c, ids in expected for n, i in enumerate(ids)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Generate") < plan.index("Join")  # the last step but for the names
    lists = recommend.recommended_lists(users, jobs, k=7)
    docs = recommend.documents_of_lists(lists, lambda x: x["vec_id"].cast("string"), ["vec_id"])
    assert sorted((r.chat_id, [int(d.page_content) for d in r.job_recommendation]) for r in docs.collect()) == [x for x in expected if x[1]]


def test_blocks_go_once_to_as_few_groups_as_there_are_tasks():
    """Ranges of queries aren't equal: one that holds a few more than the others is still one group, and one that holds too many makes equal ones."""

    class Sent:
        def __init__(self, value):
            self.value = value

    rings = np.array([(0, 1, 0.0, 9.0, 50), (0, 2, 9.0, 20.0, 50)])
    sizes = {}
    for n in (70, 81, 100, 101):
        q = np.linspace(0, 1, n)
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([[x, 0.0] for x in q])], names=["query_no", "query"])
        with pytest.MonkeyPatch.context() as m:
            m.setattr(vectors.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
            found = [row for b in vectors._wanted_groups(Sent(np.zeros((1, 2))), Sent(rings), 5, 100, 8)(iter([batch])) for row in b.to_pylist()]
        sizes[n] = [len(row["query_nos"]) for row in found if row["query_nos"]]
        assert sorted({row["group"] for row in found}) == [3 + 8 * i for i in range(len(sizes[n]))]
    assert sizes == {70: [70], 81: [81], 100: [100], 101: [51, 50]}


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-3, 3e6), (3e20, 0.0), (1e-30, 0.0)])
def test_few_pairs_are_measured_in_double_and_none_is_lost(monkeypatch, scale, offset):
    """Single precision leaves most pairs out, also far from the origin and above its range; ties that fill more than is held are told apart by place."""
    measured = []
    keep = getattr(vectors, "_pair_distances", None)
    monkeypatch.setattr(vectors, "_pair_distances", lambda q, row, x, column: measured.append(len(row)) or keep(q, row, x, column), raising=False)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 16)) * scale + offset
    x[2000:2060] = x[7]  # more than is held of the best
    q, k = np.concatenate([x[:40], rng.normal(size=(40, 16)) * scale + offset]), 20
    pivots = x[[5, 1000]]
    d = np.sqrt(((x[:, None] - pivots) ** 2).sum(axis=2))
    group = vectors._Group(np.arange(len(q)), q, pivots, k)
    for pivot in (1, 0):
        mine = np.flatnonzero(d.argmin(axis=1) == pivot)
        mine = mine[np.argsort(d[mine, pivot])]
        for some in np.array_split(mine, 12):
            group.meet(pivot, d[some[0], pivot], d[some[-1], pivot], some[::-1], pa.StructArray.from_arrays([pa.array(some[::-1])], names=["vec_id"]), x[some[::-1]])
    got = [row["items"] for batch in group.lists() for row in batch.to_pylist()]
    for n, items in enumerate(got):
        exact = np.round(((x - q[n]) ** 2).sum(axis=1), 6)
        order = np.lexsort((np.arange(len(x)), exact))[:k]
        assert [i["vec_id"] for i in items] == order.tolist()
        assert np.allclose([i["d2"] for i in items], exact[order], rtol=1e-12, atol=1e-6)
    if scale in (1.0, 3e20):
        assert 0 < sum(measured) < len(x) * len(q) / 10


def test_groups_fill_their_rounds_and_are_as_large_as_they_may_be(monkeypatch):
    """No round of tasks is left half empty, and blocks, which go to every group, go to as few as hold the queries."""
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 10)
    monkeypatch.setattr(vectors, "GROUP_QUERIES", 400)  # 300 are aimed at
    assert [vectors._group_count(n, 4) for n in (0, 5, 25, 39, 1200, 1201, 2401)] == [1, 1, 3, 4, 4, 8, 12]
