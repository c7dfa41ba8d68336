"""The divergence audit against plain Python with whole numbers of any size."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspar.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    """rows: (text, lang, source)."""
    docs = [(TERM.findall((t or "").translate(LOWER)), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        held = Counter(t for terms, _, _ in mine for t in set(terms))
        kept = sorted((t for t in held if held[t] >= least), key=str.encode)
        counts = {s: Counter(t for terms, _, x in mine if x == s for t in terms) for s in {d[2] for d in mine}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def got(df, **kwargs):
    return sorted(map(tuple, divergence.audit(df, **kwargs).collect()))


@pytest.mark.parametrize("least, top", [(1, 3), (2, 10), (10, 10), (1000, 10)])
def test_awkward_rows(edge_docs, edge_rows, no_docs, least, top):
    assert got(edge_docs, least=least, top=top) == brute([(r[1], r[2], r[3]) for r in edge_rows], least, top)
    assert divergence.audit(no_docs).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert divergence.audit(no_docs).count() == 0


def test_chunks_and_merges_change_nothing(spark, monkeypatch):
    """Many small chunks and matrices, merges between batches, ties, and terms in the order of UTF-8, not of UTF-16."""
    rng = np.random.default_rng(1)
    words = ["a", "b", "é", "￮", "\U0001f600", "zz", "Zz", "日本", "q"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))), str(rng.choice(["x", "y"])), f"s{rng.integers(0, 6)}") for _ in range(300)]
    rows += [("12 34", "z", "only"), (None, "w", "s1"), ("", "w", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    expected = brute(rows, 2, 4)
    assert got(df, least=2, top=4) == expected
    for name, value in (("CHUNK", 2), ("CELLS", 8), ("MERGED", 20)):
        monkeypatch.setattr(divergence, name, value)
    assert got(df, least=2, top=4) == expected


def test_scaled_is_exact():
    rng = np.random.default_rng(2)
    totals = rng.integers(1, 1 << 53, 2000)
    counts = (totals * rng.random(2000)).astype(np.int64)
    assert divergence.scaled(counts, totals).tolist() == [1 + 10**9 * c // t for c, t in zip(counts.tolist(), totals.tolist())]


def test_a_language_without_terms_has_pairs_of_zero(spark):
    df = spark.range(4).select(F.lit("1 2 3").alias("text"), F.lit("l").alias("lang"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    rows = divergence.audit(df).collect()
    assert len(rows) == 12 and {r.value for r in rows} == {0}
    assert [r.item for r in sorted(rows, key=lambda r: r["rank"]) if r.source == "s0"] == ["s1", "s2", "s3"]
