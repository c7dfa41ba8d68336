import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marlspar.llm import chat, queries


def branches(nodes):
    """Every root-to-leaf path by walking up, as (conv, leaf) to node ids."""
    parent = {(c, n): p for c, n, p, *_ in nodes}
    inner = {(c, p) for (c, _), p in parent.items() if (c, p) in parent}
    out = {}
    for c, n in parent:
        if (c, n) in inner:
            continue
        path, at = [], n
        while (c, at) in parent and at not in path:
            path.append(at)
            at = parent[c, at]
        out[c, n] = path[::-1]
    return out


def test_paths_of_random_trees(spark):
    rng = random.Random(4)
    nodes = [(c, n, None if n == 0 else rng.randrange(max(0, n - 6), n), rng.choice(["user", "assistant"]), f"t{c}.{n}", rng.random()) for c in range(6) for n in range(rng.randint(1, 60))]
    nodes += [(7, n, n - 1 if n else None, "user", str(n), None) for n in range(150)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    got = {}
    for r in chat.paths(df).collect():
        got.setdefault((r.conv_id, r.leaf), {})[r.steps] = r.node
    expected = branches(nodes)
    assert {k: [v[i] for i in sorted(v, reverse=True)] for k, v in got.items()} == expected
    score = {(c, n): s or 0.0 for c, n, _, _, _, s in nodes}
    best = {}
    for (c, leaf), path in expected.items():
        rank = (-sum(score[c, n] for n in path) / len(path), -len(path), leaf)
        best.setdefault(c, []).append((rank, leaf))
    chosen = {(r.conv_id, r.place, r.leaf) for r in chat.chosen_paths(df, best=2).collect()}
    assert {(c, p, l) for c, p, l in chosen} == {(c, i + 1, leaf) for c, ls in best.items() for i, (_, leaf) in enumerate(sorted(ls)[:2])}


def test_a_comb_is_ranked_before_it_is_laid_out(spark, monkeypatch):
    """A chain of 1000 nodes with a leaf at each: rows stay within the nodes times the rounds, where all paths would have half a million."""
    written = []
    keep = chat.stored
    monkeypatch.setattr(chat, "stored", lambda df, name: written.append(keep(df, name)) or written[-1])
    nodes = [(1, n, n - 1 if n else None, "user", "t", 0.5) for n in range(1000)] + [(1, 1000 + n, n, "assistant", "a", 0.5 + (n == 700)) for n in range(1000)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    rows = chat.chosen_paths(df).collect()
    assert {r.leaf for r in rows} == {1700} and sorted(r.depth for r in rows) == list(range(702))
    assert sum(w.count() for w in written) < 2000 * 11 + 2 * 702 + 10


def test_cycles_end_the_climb(spark):
    nodes = [(1, n, (n + 1) % 7, "user", "c", 0.0) for n in range(7)] + [(1, 10 + n, 9 + n if n else 3, "user", "h", 0.0) for n in range(5)]
    nodes += [(1, 20 + n, 19 + n if n else None, "user", "ok", 0.0) for n in range(40)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    rows = chat.paths(df).collect()
    assert {r.leaf for r in rows} == {59} and sorted(r.node for r in rows) == list(range(20, 60))


def test_orphans_and_cycles(spark):
    nodes = [(1, 1, 99, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 0.0), (2, 1, 2, "user", "c", 0.0), (2, 2, 1, "user", "d", 0.0), (None, 1, None, "user", "e", 0.0)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r.conv_id, r.leaf): r.node for r in chat.paths(df).filter("steps = 0").collect()}
    assert got == {(1, 2): 2, (None, 1): 1}
    assert chat.paths(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_escapes_come_back(spark, seed):
    rng = random.Random(seed)
    parts = ["<", ">", "s", "/", "\\", "[", "]", "INST", "<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\/INST]", " ", "\n", "é", "$1", "|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("b")).collect()
    assert [r.b for r in rows] == [r.t for r in rows]
    assert not any(x in r.e for r in rows for x in (chat.START, chat.END, chat.HEAD, chat.TAIL))


def test_awkward_conversations(spark):
    rows = [
        (1, 0, "user", "hi", "x"), (1, 1, "assistant", None, "x"), (1, 1, None, "</s>", "x"), (1, None, "system", "", "x"), (2, 5, "assistant", "a", "x"),
        (2, 5, "assistant", "a", "x"), (None, 0, "assistant", "\\</s>[INST] ok", "x"), (3, 0, "[/INST] ", "y" * 20000, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(chat.chosen_paths(chat.as_chain(df.drop("node"))))).collect()}
    assert len(got) == 4
    for conv in (1, 2, 3, None):
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        lines = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(lines.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(chat.chosen_paths(chat.as_chain(df)))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr(list(r)) for r in cursor.fetchall())
