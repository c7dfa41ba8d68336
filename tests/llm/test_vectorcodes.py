"""Vector codes against plain Python with whole numbers of any size."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from marlspar.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int"


def brute(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], [] if r[1] is None else [-math.inf if x is None else x for x in r[1]]))
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    d = len(kept[0][1]) // parts
    cut = lambda v: [v[i * d : (i + 1) * d] for i in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned():
        return [[min((far(x, e), i) for i, e in enumerate(books[p])) for p, x in enumerate(cut(v))] for _, v, _ in kept]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [cut(kept[r][1])[p] for r in range(len(kept)) if found[r][p][1] == i]
                if mine:
                    books[p][i] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assigned()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{n:02x}" for _, n in f), e, by_label[label], sha)) for (i, _, label), f, e in zip(kept, found, errors))


def got(df, **kwargs):
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in vectorcodes.coded(df, **kwargs).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("parts, entries, rounds", [(16, 64, 2), (4, 5, 3), (2, 256, 1), (8, 1, 0)])
def test_awkward_rows(spark, parts, entries, rounds):
    """Ties (few distinct values), negative numbers, nulls, non-finite components, repeated rows and other sizes."""
    rng = np.random.default_rng(parts)
    vectors = np.round(rng.normal(size=(150, 32)) * 3) / 256 + (rng.random((150, 32)) < 0.1) * 0.001
    rows = [(int(i) if i % 9 else None, [float(np.float32(x)) for x in v], int(i % 4) if i % 5 else None) for i, v in enumerate(vectors)]
    rows += rows[:7] + [(3, rows[80][1], 1)]
    bad = [(900, None, 1), (901, [0.5] * 31 + [None], 2), (902, [float("nan")] * 32, 2), (-1, [float("-inf")] + [0.1] * 31, 0), (903, [], 1), (904, [1.0] * 16, 1)]
    df = frame(spark, rows + bad).repartition(5)
    assert got(df, parts=parts, entries=entries, rounds=rounds) == brute(rows + bad, parts, entries, rounds)


def test_empty_and_unfit(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(1, None, 1), (2, [float("nan")] * 16, 1)])) == []
    assert got(frame(spark, [(1, [1.0] * 15, 1)])) == []
    one = vectorcodes.coded(frame(spark, [(1, [1.0] * 16, None)])).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00" * 16, 0, 0)]
    big = [(1, [0.0] * 16, 1), (2, [70000.0] + [0.0] * 15, 1)]
    assert [r.vec_id for r in vectorcodes.coded(frame(spark, big)).collect()] == [1]


@pytest.mark.parametrize("size, places, span", [(64, 4, 3), (256, 1, 40), (64, 4, 1 << 20), (7, 3, 2), (64, 4, 0)])
def test_tree_equals_every_distance(size, places, span):
    rng = np.random.default_rng(size)
    entries = rng.integers(-span, span + 1, (size, places))
    points = rng.integers(-2 * span, 2 * span + 1, (4000, places))
    index, best = vectorcodes.Balls(entries).nearest(points)
    d = ((points[:, None] - entries) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (index == d.argmin(axis=1)).all()
