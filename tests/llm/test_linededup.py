"""The step of line dedup that deals the lines of an entry to one of them."""

import numpy as np
import pyarrow as pa

from marlspar.llm import linededup


def _dealt(entry, node, rows):
    batches = [pa.RecordBatch.from_arrays([pa.array(entry[i : i + rows]), pa.array(node[i : i + rows])], names=["entry", "node"]) for i in range(0, len(entry), rows)]
    return {(r["pivot"], r["node"]) for b in linededup._by_first(8)(iter(batches)) for r in b.to_pylist()}


def test_entries_need_no_order_of_their_lines(monkeypatch):
    rng = np.random.default_rng(5)
    entry = np.sort((rng.integers(0, 300, 4000) << linededup.LEVEL_BITS) | rng.integers(0, 3, 4000))
    node = rng.integers(-(10**9), 10**9, 4000)
    lines = {e: set(node[entry == e].tolist()) for e in set(entry.tolist())}
    # In one batch, the first is the least.
    expected = set()
    for e, mine in lines.items():
        before = lines.get(e - 1, set()) if e >> linededup.LEVEL_BITS == (e - 1) >> linededup.LEVEL_BITS else set()
        expected |= {(min(x), n) for x in (mine, before) if x for n in mine if n != min(x)}
    assert _dealt(entry, node, 4000) == expected
    # Cut into batches, all lines of an entry, and those of the class after it, still come to one.
    monkeypatch.setattr(linededup, "gathered", lambda batches, rows: batches)
    for rows in (7, 50):
        found = _dealt(entry, node, rows)
        firsts = {n: {p for p, m in found if m == n} | {n} for n in node.tolist()}
        for e, mine in lines.items():
            before = lines.get(e - 1, set()) if e >> linededup.LEVEL_BITS == (e - 1) >> linededup.LEVEL_BITS else set()
            assert set.intersection(*[firsts[n] for n in mine]) & mine
            assert not before or set.intersection(*[firsts[n] for n in mine | before]) & before


def test_entries_are_sorted_by_one_number(spark, edge_docs, monkeypatch):
    plans, stored = [], linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    linededup.without_repeated_lines(edge_docs).count()
    sorts = [line.split("Sort ")[1] for plan in plans for line in plan.splitlines() if "Sort [entry" in line]
    assert sorts and all(s.startswith("[entry") and "node" not in s for s in sorts)
