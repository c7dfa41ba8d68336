"""Exact repeated passages by seeds and extension.

A passage is a window of LENGTH words whose sequence starts at two or more
places. Seeds are winnowed anchors: the smallest hash of the SEED-word grams in
a window, the last one on a tie. The choice depends on the window's words
alone, so equal windows have equal anchors at equal offsets, and only anchors
that occur at two places are looked at again.

All windows of a document with the same anchor form a run; the stretch of words
that they cover is the anchor extended both ways as far as it is the anchor.
Runs with equal stretches are one class: if a class has two places, all its
windows repeat. If an anchor has several different stretches, one stretch of
each class is laid out as windows, and equal windows are counted over the
classes, so each stretch keeps its maximal part that repeats. Neither step
pairs up places, so an anchor that a third of all documents share costs a row a
place and a few rows a class.

Anchors, stretches and windows are compared by hashes of 128 bits (the anchor's
64 with the stretch's or window's 64).

Defined cases: a null or empty text has no words; a text of fewer than LENGTH
words loses none; rows with equal ids and texts are separate documents; null
ids are allowed; an empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship, stored
from .texts import Words, pieces, sequence_hash, sequence_sums, split_words

LENGTH = 35
SEED = 8

#: Windows whose anchors are looked for at once; places are packed in _PLACE_BITS relative to the first of them.
STRETCH = 1 << 22
_PLACE_BITS = np.uint64(24)


def anchors(grams: np.ndarray, spread: int) -> np.ndarray:
    """The place of the smallest of each ``spread`` hashes (by its high bits), the last one on a tie."""
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    out = np.empty(len(grams) - spread + 1, np.int64)
    for begin in range(0, len(out), STRETCH):
        some = grams[begin : begin + STRETCH + spread - 1]
        best = (some & ~low) | (low - np.arange(len(some), dtype=np.uint64))
        width = 1
        while width * 2 <= spread:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < spread:
            best = np.minimum(best[: len(some) - spread + 1], best[spread - width :])
        out[begin : begin + STRETCH] = begin + (low - (best & low)).astype(np.int64)
    return out


def _runs(w: Words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first window, number of windows, anchor and stretch hashes."""
    sums = sequence_sums(w.hashes())
    n = len(w.starts)
    spread = length - seed + 1
    sizes = np.diff(w.first)
    if n < length or sizes.max(initial=0) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, sums
    at = np.arange(n - seed + 1)
    grams = sequence_hash(sums, at, at + seed)
    anchor = anchors(grams, spread)
    text = np.repeat(np.arange(len(sizes)), sizes)[: n - length + 1]
    window = np.arange(n - length + 1)
    inside = window + length <= w.first[text + 1]
    window, anchor, text = window[inside], anchor[inside], text[inside]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    begin = np.flatnonzero(new)
    count = np.diff(np.r_[begin, len(window)])
    first = window[begin]
    stretch = sequence_hash(sums, first, first + count - 1 + length)
    where = (anchor[begin] - first).astype(np.uint64)  # the anchor's place in the stretch
    return text[begin], first, count, grams[anchor[begin]].view(np.int64), (stretch ^ (where * np.uint64(0x9E3779B97F4A7C15))).view(np.int64), sums


def _run_rows(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = split_words(part.column("text"))
                text, first, count, anchor, stretch, _ = _runs(w, length, seed)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(rows), part.column("text_hash").take(rows), pa.array((first - w.first[text]).astype(np.int32)),
                        pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(stretch),
                    ],
                    names=["doc_id", "text_hash", "first", "windows", "anchor", "stretch"],
                )

    return run


def _window_rows(length: int):
    """Lays out the listed stretches of each text as windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = split_words(part.column("text"))
                sums = sequence_sums(w.hashes())
                out: list[list[np.ndarray]] = []
                for row, wanted in enumerate(part.column("wanted").to_pylist()):
                    base = w.first[row]
                    for x in wanted:
                        at = base + x["first"] + np.arange(x["windows"])
                        hashes = sequence_hash(sums, at, at + length).view(np.int64)
                        full = [np.full(len(at), x[c], np.int64) for c in ("anchor", "stretch", "places")]
                        out.append([*full, np.arange(len(at)), hashes])
                columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "stretch", "places", "nth", "window"])

    return run


def _kept_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = split_words(part.column("text"))
                data = w.buf.tobytes()
                totals, removed, digests, texts = [], [], [], []
                for row, found in enumerate(part.column("found").to_pylist()):
                    begin, end = int(w.first[row]), int(w.first[row + 1])
                    edges = np.zeros(end - begin + 1, np.int32)
                    for x in found or ():
                        for nth in np.flatnonzero([(x["repeats"] >> i) & 1 for i in range(x["windows"])]):
                            edges[x["first"] + nth] += 1
                            edges[x["first"] + nth + length] -= 1
                    keep = np.cumsum(edges[:-1]) == 0
                    words = [data[a:b] for a, b in zip(w.starts[begin:end][keep].tolist(), w.ends[begin:end][keep].tolist())]
                    kept = b" ".join(words)
                    totals.append(end - begin)
                    removed.append(end - begin - len(words))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words, joined by one space).

    docs: doc_id, text. length: words of a passage. seed: words of an anchor,
    which may stand at length - seed + 1 places of a window (at most 63).
    """
    if not 1 <= seed <= length or length - seed + 1 > 63:
        raise ValueError("a window must have 1 to 63 places for its anchor")
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    runs = docs.mapInArrow(_run_rows(length, seed), f"doc_id {id_type}, text_hash long, first int, windows int, anchor long, stretch long")
    twice = runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    twice = stored(twice, "twice")  # a join of two plain shuffles, which may be split where an anchor is common
    seeds = stored(runs.join(twice, "anchor"), "seeds")

    place = F.struct("doc_id", "text_hash", "first", "windows")
    classes = stored(seeds.groupBy("anchor", "stretch").agg(F.count("*").alias("places"), F.min(place).alias("at")), "classes")
    several = classes.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    wanted = (
        classes.join(several, "anchor")
        .select("anchor", "stretch", "places", "at.*")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("anchor", "stretch", "places", "first", "windows")).alias("wanted"))
        .select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), "wanted")
    )
    same_text = (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("of"))
    laid_out = docs.join(wanted, same_text).select("text", "wanted").mapInArrow(
        _window_rows(length), "anchor long, stretch long, places long, nth long, window long"
    ).distinct()
    laid_out = stored(laid_out, "windows")
    repeated = laid_out.groupBy("anchor", "window").agg(F.sum("places").alias("all")).filter("all > 1").select("anchor", "window")
    parts = (
        laid_out.join(repeated, ["anchor", "window"])
        .groupBy("anchor", "stretch")
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(nth AS INT))")).alias("some"))
    )
    verdicts = classes.join(parts, ["anchor", "stretch"], "left").select(
        "anchor", "stretch", F.when(F.col("places") > 1, F.lit(-1)).otherwise(F.coalesce("some", F.lit(0))).cast("long").alias("repeats")
    )
    verdicts = stored(verdicts.filter("repeats != 0"), "verdicts")  # so that the next join reads plain shuffles, which may be split where a stretch is common
    found = (
        seeds.join(verdicts, ["anchor", "stretch"])
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("first", "windows", "repeats")).alias("found"))
        .select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), "found")
    )
    out = docs.join(found, same_text, "left").select("doc_id", "text", "found")
    return out.mapInArrow(_kept_rows(length), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")
