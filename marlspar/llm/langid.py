"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary classifier for each bit reads
hashed byte n-grams of the whole text and gives a margin. Decoding picks the
codeword with the least loss, each bit's logistic loss weighted by how reliable
that bit was in training, so some wrong bits do no harm. A text whose two best
codewords are nearly as good is flagged as ambiguous.

The classifiers are fitted on a sample of at most SAMPLE labelled documents (or
one a language, if there are more languages), in even shares of all languages;
prediction reads every whole text. The model that goes to the executors grows
with the languages only: by a codeword each, and in bits by their logarithm.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
null languages are not learned from; without any labelled document all texts
are ``und``; with one language all texts with a letter get it; rows with equal
ids and texts get equal predictions; a null doc_id is not held out and not
learned from; an empty table gives an empty result. Extra columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import ship
from .texts import LOWER, pieces, text_bytes

SAMPLE = 2000
BUCKETS = 4096
GRAMS = (1, 2, 3)
ROUNDS = 150
PENALTY = 1e-5
#: The least difference of the shares of the two best codewords, else the text is ambiguous.
MARGIN = 0.2

LETTER = regex.compile(r"\p{L}")


def features(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed n-grams, a row a text."""
    buf, offsets = text_bytes(texts)
    low = LOWER[buf].astype(np.uint32)
    n = len(low)
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    code = np.zeros(n, np.uint32)
    for size in range(1, max(GRAMS) + 1):
        code[: max(0, n - size + 1)] = code[: max(0, n - size + 1)] * np.uint32(257) + low[size - 1 :] if n >= size else 0
        if size not in GRAMS:
            continue
        place = ((code + np.uint32(size * 0x1000193)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if end - begin >= size:
                out[row] += np.bincount(place[begin : end - size + 1], minlength=BUCKETS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords (+1 and -1) of n classes: all distinct splits of up to 6 classes, else the best of some random codes."""
    if n <= 6:
        splits = [[1 if c == 0 or (b >> (c - 1)) & 1 == 0 else -1 for c in range(n)] for b in range(1, 1 << max(0, n - 1))]
        return np.array(splits, np.float32).reshape(-1, n).T if splits else np.ones((n, 1), np.float32)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, length))
        apart = (length - code @ code.T) / 2 + np.eye(n) * length
        if apart.min() > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, apart.min()
    return best


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    trust: np.ndarray


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """One logistic classifier a bit, by accelerated gradient steps; the last column of x is 1."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    index = {k: i for i, k in enumerate(languages)}
    kinds = np.array([index[k] for k in labels])
    y = code[kinds]
    even = 1 / (np.bincount(kinds)[kinds] * len(languages))
    even = even[:, None].astype(np.float32)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    ahead, momentum = w.copy(), 1.0
    for _ in range(ROUNDS):
        slope = -y * even / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))
        new = ahead - 2.0 * (x.T @ slope + PENALTY * ahead)
        grown = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead, w, momentum = new + (momentum - 1) / grown * (new - w), new, grown
    right = ((y * (x @ w) > 0) * even).sum(axis=0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return Model(languages, code, w[:-1], w[-1], (trust / trust.sum()).astype(np.float32))


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best class, its share in 0..1, and whether the two best are close."""
    margins = x @ model.weights + model.offsets
    plus, minus = (np.logaddexp(0, -sign * margins) * model.trust @ (sign * model.code.T > 0) for sign in (1, -1))
    loss = plus + minus
    share = np.exp(-loss * min(model.code.shape[1], 8))
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    top = np.sort(share, axis=1)
    second = top[:, -2] if share.shape[1] > 1 else np.zeros(len(top))
    return best, top[:, -1], top[:, -1] - second < MARGIN


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            x = features(part.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("rank"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "rank", "x"])


def _predictions(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text")
                readable = [bool(t) and LETTER.search(t) is not None for t in texts.to_pylist()]
                if model is None:
                    readable = [False] * len(readable)
                names, scores, close = ["und"] * len(readable), [0.0] * len(readable), [True] * len(readable)
                if any(readable):
                    best, share, near = decode(model, features(texts))
                    for i, good in enumerate(readable):
                        if good:
                            names[i], scores[i], close[i] = model.languages[best[i]], float(share[i]), bool(near[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())],
                    names=["doc_id", "text_hash", "held_out", "lang_pred", "score", "ambiguous"],
                )

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def most_rank(share: int, count: int) -> int:
    """A rank of 64 bits below which ``share`` of ``count`` documents are found but for a chance of less than 1e-15."""
    return int(min(1.0, (2 * share + 80) / count) * (2**64 - 2**12)) - 2**63


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    labelled = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("rank"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("rank").alias("least")).collect()
    if not counts:
        return None
    share = max(1, sample // len(counts))
    bounds = [(c["lang"], max(c["least"], most_rank(share, c["n"]))) for c in counts]
    bounds = docs.sparkSession.createDataFrame(bounds, "of string, most long")
    few = labelled.join(F.broadcast(bounds), (F.col("lang") == F.col("of")) & (F.col("rank") <= F.col("most")))
    # Texts are read where they are; only features, of one size, are sorted and sent.
    found = few.select("lang", "rank", "text").mapInArrow(_feature_rows, "lang string, rank long, x binary")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "x"))).filter(F.col("nth") <= share)
    rows = found.orderBy("lang", "nth").select("lang", "x").collect()
    x = np.ones((len(rows), BUCKETS + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, :-1] = np.frombuffer(r["x"], np.float16)
    return fit(x, [r["lang"] for r in rows]) if rows else None


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, text_hash, held_out, lang_pred, score, ambiguous; docs: doc_id, text, lang."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", "lang")
    sent = spark.sparkContext.broadcast(train(docs, sample))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(
        _predictions(sent), f"doc_id {id_type}, text_hash long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, all columns, whose language can be told.

    Rejected are texts without a letter, and ambiguous ones of which the best codeword has less than half.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(train(docs.select("doc_id", "text", "lang"), sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in pieces(batch):
                stays = np.array([bool(t) and LETTER.search(t) is not None for t in part.column("text").to_pylist()], bool)
                if model is not None and stays.any():
                    _, share, near = decode(model, features(part.column("text")))
                    stays &= ~(near & (share < 0.5))
                yield part.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
