"""Benchmark decontamination: BM25 search of test items with every training passage.

The inverted index holds the test items, in segments of at most SEGMENT words.
A query is a passage of 2 * SEGMENT words, one every SEGMENT words, so each run
of SEGMENT words of a whole text lies in some passage. An item's score is its
BM25 score over that of its own text, so one threshold holds for all items and
every item above it is retrieved.

Block-max WAND, for a batch of passages at once: passages whose terms' largest
impacts do not reach the threshold together are dropped; then the largest
impacts by block of segments are summed, and blocks below the threshold are
skipped; what is left is scored exactly. The bounds are never below a score, so
nothing above the threshold is lost.

A hit is confirmed by overlap in word pairs with the passage, of the question
and of the answer both. Items of one text have their last third as the answer.

Items with the same words are indexed once. The index is sent to the executors
in shards of at most SHARD_SEGMENTS segments, SHARDS of them with each pass over
the documents, with document frequencies and lengths taken over all items.

Defined cases: words are lower-cased, character by character and by the same
function on both sides, and split at white space and ASCII punctuation; null and
empty texts and items match nothing; an item of two words needs the pair; items
of one word match nothing (they have no word pair); rows with equal ids and
texts give equal hits; without items nothing is contaminated; an empty table
gives an empty result. Columns other than doc_id and text are passed on
untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship, stored
from .texts import BETWEEN, mix, pieces, split_words

SEGMENT = 64
BLOCK = 8
SHARD_SEGMENTS, SHARDS = 4096, 8
THRESHOLD = 0.5
#: Least shares of the question's and the answer's word pairs in the passage.
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.5, 0.5
K1, B = 1.2, 0.75

_PAIR = np.uint64(0xD1342543DE82EF95)
_EXPANDED = 2_000_000


def word_pairs(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * _PAIR + hashes[1:])


class Index(NamedTuple):
    terms: np.ndarray  # sorted hashes
    largest: np.ndarray  # of each term's impacts
    block_at: np.ndarray  # where each term's blocks begin
    blocks: np.ndarray
    block_impacts: np.ndarray
    segment_at: np.ndarray
    segments: np.ndarray
    impacts: np.ndarray
    items: list[int]  # of each segment
    questions: list[np.ndarray]  # word pairs of each segment
    answers: list[np.ndarray]


def build(segments: list[tuple[int, list[str], int]], frequency: dict[str, int], items: int, mean_words: float) -> Index:
    """segments: (item, words, number of words in the question); frequency: items with the word."""
    vocabulary = sorted({w for _, words, _ in segments for w in words})
    hashed = split_words(pa.array(vocabulary, pa.string()), between=BETWEEN).hashes()
    order = np.argsort(hashed)
    number = {vocabulary[i]: place for place, i in enumerate(order.tolist())}
    idf = np.array([np.log(1 + (items - frequency[vocabulary[i]] + 0.5) / (frequency[vocabulary[i]] + 0.5)) for i in order.tolist()])
    of_term, of_segment, impacts, questions, answers = [], [], [], [], []
    for n, (_, words, asked) in enumerate(segments):
        ids = np.array([number[w] for w in words])
        terms, times = np.unique(ids, return_counts=True)
        score = idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * len(words) / mean_words))
        of_term.append(terms)
        of_segment.append(np.full(len(terms), n))
        impacts.append(score / score.sum())
        hashes = hashed[order][ids]
        questions.append(np.unique(word_pairs(hashes[:asked])))
        answers.append(np.unique(word_pairs(hashes[max(0, asked - 1) :])))
    t, s, x = (np.concatenate(c) for c in (of_term, of_segment, impacts))
    by_term = np.lexsort((s, t))
    t, s, x = t[by_term], s[by_term], x[by_term]
    edges = np.arange(len(vocabulary) + 1)
    keys, begin = np.unique(t * (len(segments) // BLOCK + 1) + s // BLOCK, return_index=True)
    return Index(
        hashed[order], np.maximum.reduceat(x, np.searchsorted(t, edges[:-1])),
        np.searchsorted(t[begin], edges), (s // BLOCK)[begin], np.maximum.reduceat(x, begin),
        np.searchsorted(t, edges), s, x, [i for i, _, _ in segments], questions, answers,
    )


def _expanded(at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For terms, the indexes of all their postings, and which term each is of."""
    counts = at[terms + 1] - at[terms]
    of = np.repeat(np.arange(len(terms)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + at[terms][of], of


def retrieve(index: Index, passages: np.ndarray, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, segment, score) at or above the threshold, for distinct (passage, term), sorted by passage."""
    least = threshold - 1e-9
    bound = np.bincount(passages, weights=index.largest[terms])
    some = bound[passages] >= least
    passages, terms = passages[some], terms[some]
    out = []
    sizes = np.cumsum(index.block_at[terms + 1] - index.block_at[terms])
    begin = 0
    n_blocks = (len(index.items) - 1) // BLOCK + 1
    while begin < len(passages):
        end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + _EXPANDED, side="right"))
        end = max(end, begin + 1)
        end = int(np.searchsorted(passages, passages[min(end, len(passages)) - 1], side="right"))
        names, p = np.unique(passages[begin:end], return_inverse=True)
        t = terms[begin:end]
        at, of = _expanded(index.block_at, t)
        cell = p[of] * n_blocks + index.blocks[at]
        open_ = np.bincount(cell, weights=index.block_impacts[at], minlength=len(names) * n_blocks) >= least
        alive = open_.reshape(len(names), n_blocks).any(axis=1)[p]
        p, t = p[alive], t[alive]
        at, of = _expanded(index.segment_at, t)
        inside = open_[p[of] * n_blocks + index.segments[at] // BLOCK]
        at, of = at[inside], of[inside]
        cells, where = np.unique(p[of] * len(index.items) + index.segments[at], return_inverse=True)
        score = np.bincount(where, weights=index.impacts[at], minlength=len(cells))
        good = score >= least
        out.append((names[cells[good] // len(index.items)], cells[good] % len(index.items), score[good]))
        begin = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def matches(shards: list[Index], texts: pa.Array, threshold: float = THRESHOLD) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item) to the score and the overlaps of the best passage that is confirmed."""
    w = split_words(pc.utf8_lower(texts), between=BETWEEN)
    hashes = w.hashes()
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(hashes):
        return best
    sizes = np.diff(w.first)
    count = np.where(sizes > 0, np.maximum(1, -(-sizes // SEGMENT) - 1), 0)  # passages of each text
    base = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(sizes)), count)
    for index in shards:
        place = np.searchsorted(index.terms, hashes)
        known = np.flatnonzero(index.terms[np.minimum(place, len(index.terms) - 1)] == hashes)
        text = np.repeat(np.arange(len(sizes)), sizes)[known]
        step = (known - w.first[text]) // SEGMENT
        late = base[text] + np.minimum(step, count[text] - 1)
        early = base[text] + np.clip(step - 1, 0, count[text] - 1)
        vocabulary = len(index.terms)
        pairs = np.unique(np.r_[late, early] * vocabulary + np.r_[place[known], place[known]])
        found = retrieve(index, pairs // vocabulary, pairs % vocabulary, threshold)
        for passage, segment, score in zip(*(x.tolist() for x in found)):
            row = int(owner[passage])
            begin = int(w.first[row]) + (passage - int(base[row])) * SEGMENT
            seen = word_pairs(hashes[begin : min(begin + 2 * SEGMENT, int(w.first[row + 1]))])
            # A question of one word has no pair of its own; the answer's first pair begins with it.
            shares = [float(np.isin(part, seen).mean()) if len(part) else 1.0 for part in (index.questions[segment], index.answers[segment])]
            if shares[0] >= QUESTION_OVERLAP and shares[1] >= ANSWER_OVERLAP:
                key = (row, index.items[segment])
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, *shares))
    return best


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of items, lower-cased and split as those of documents."""
    for batch in batches:
        for part in pieces(batch):
            w = split_words(pc.utf8_lower(part.column("text")), between=BETWEEN)
            data = w.buf.tobytes()
            words = [[data[a:b].decode() for a, b in zip(w.starts[i:j].tolist(), w.ends[i:j].tolist())] for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(words, pa.list_(pa.string()))], names=["item_id", "words"])


def numbered(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of items (item_id, text): (item_id, item) with one item number for equal words, and (item, words, copies); items of one word are left out."""
    id_type = items.schema["item_id"].dataType.simpleString()
    split = stored(items.select("item_id", "text").mapInArrow(_item_words, f"item_id {id_type}, words array<string>").filter(F.size("words") > 1), "items")
    texts = split.groupBy("words").agg(F.count("*").alias("copies")).withColumn("item", F.monotonically_increasing_id())
    texts = stored(texts, "item_texts")
    return split.join(texts, "words").select("item_id", "item").distinct(), texts


def indexes(texts: DataFrame) -> Iterator[list[Index]]:
    """The shards of the index of (item, words, copies), as many at a time as go with one pass."""
    totals = texts.agg(
        F.sum("copies").alias("n"), F.sum(F.size("words") * F.col("copies")).alias("words"), F.sum(F.ceil(F.size("words") / SEGMENT)).alias("segments")
    ).first()
    if not totals["n"]:
        return
    mean = totals["words"] / totals["n"]
    shards = -(-int(totals["segments"]) // SHARD_SEGMENTS)
    frequency = texts.select("copies", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.sum("copies").alias("count"))
    some: list[Index] = []
    for shard in range(shards):
        part = texts.filter(F.pmod(F.xxhash64("words"), F.lit(shards)) == shard)
        own = part.select(F.explode("words").alias("word")).distinct().join(frequency, "word")
        counts = {r["word"]: r["count"] for r in own.collect()}
        segments = []
        for r in part.select("item", "words").orderBy("words").collect():
            n = -(-len(r["words"]) // SEGMENT)
            edges = [len(r["words"]) * i // n for i in range(n + 1)]
            for a, b in zip(edges, edges[1:]):
                segments.append((r["item"], r["words"][a:b], b - a - max(1, (b - a) // 3)))
        if segments:
            some.append(build(segments, counts, totals["n"], mean))
        if len(some) == SHARDS:
            yield some
            some = []
    if some:
        yield some


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, score, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    measures = "score double, question_overlap double, answer_overlap double"
    ids, texts = numbered(items)
    out = None
    for shards in indexes(texts):
        sent = spark.sparkContext.broadcast(shards)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    found = sorted(matches(sent.value, part.column("text"), threshold).items())
                    of = part.column("doc_id").take(pa.array([k[0] for k, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [of, pa.array([k[1] for k, _ in found], pa.int64())] + [pa.array([v[i] for _, v in found], pa.float64()) for i in range(3)],
                        names=["doc_id", "item", "score", "question_overlap", "answer_overlap"],
                    )

        rows = docs.mapInArrow(run, f"doc_id {id_type}, item long, {measures}")
        out = rows if out is None else out.union(rows)
    if out is None:
        return spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, {measures}")
    return out.join(ids, "item").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that contain no item."""
    ship(docs.sparkSession)
    for shards in indexes(numbered(items)[1]):
        sent = docs.sparkSession.sparkContext.broadcast(shards)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    clean = np.ones(part.num_rows, bool)
                    clean[[row for row, _ in matches(sent.value, part.column("text"), threshold)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
