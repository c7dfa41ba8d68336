"""The suffix sort against plain Python, over every awkward case and over many buckets and chunks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspar.llm import suffixes


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, digest) of each row; rows: (doc_id, text hash, text)."""
    docs = sorted({(d is None, d, h, t) for d, h, t in rows}, key=lambda x: (x[0], x[1] or 0, x[2]))
    seen, out = set(), {}
    for _, d, h, t in docs:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        spans = int((gone & ~np.r_[False, gone[:-1]][: len(gone)]).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[d, h, t] = (d, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(repr(out[r]) for r in rows)


def got(df, **kwargs):
    rows = suffixes.without_repeats(df, **kwargs).collect()
    assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in rows)
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows)


def hashed(df):
    return [tuple(r) for r in df.select("doc_id", F.xxhash64("text"), "text").collect()]


@pytest.mark.parametrize("length, seed", [(100, 24), (100, 38), (20, 8), (133, 8)])
def test_awkward_rows(edge_docs, no_docs, length, seed):
    assert got(edge_docs, length=length, seed=seed) == brute(hashed(edge_docs), length)
    assert suffixes.without_repeats(no_docs).count() == 0


@pytest.mark.parametrize("chunk", [3, 50, 4096])
def test_common_passages_over_many_buckets(spark, monkeypatch, chunk):
    """A passage in three of four documents, near copies of one text, and bytes of 0 and beyond ASCII."""
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = random.Random(3)
    letters = ["a", "b", "é", "\0", "\n", "日"]
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, base = some(60), some(200)
    rows = []
    for i in range(120):
        text = some(rng.randrange(60)) + passage + some(rng.randrange(60)) if i % 4 else some(150)
        if i % 7 == 0:
            at = rng.randrange(200)
            text += base[:at] + "x" + base[at + 1 :]
        rows.append((None if i % 40 == 7 else 200 - i // 2, text))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert got(df, length=30, seed=8) == brute(hashed(df), 30)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_periodic_text(spark):
    """Long runs of one character: every window but the first goes."""
    df = spark.createDataFrame([(1, "a" * 5000), (2, "ab" * 700), (3, "a" * 99), (4, "b" + "a" * 100)], "doc_id int, text string")
    assert got(df) == brute(hashed(df), 100)


def test_ids_of_other_types(spark):
    text = "the quick brown fox jumps over the lazy dog " * 3
    df = spark.createDataFrame([("b", text), ("a", text), (None, text), ("c", "short")], "doc_id string, text string")
    rows = {r.doc_id: r.n_removed for r in suffixes.without_repeats(df, length=130, seed=24).collect()}
    assert rows == {"a": 0, "b": len(text), None: len(text), "c": 0}


def test_multikey_order():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (5000, 6)).astype(np.uint64)
    tie = rng.permutation(5000)
    order, same = suffixes.multikey_order(words, tie)
    keys = [(*w, t) for w, t in zip(words[order].tolist(), tie[order].tolist())]
    assert keys == sorted(keys)
    assert same.tolist() == [False, *[a[:-1] == b[:-1] for a, b in zip(keys, keys[1:])]]
