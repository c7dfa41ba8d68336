"""Vector code compression: product codes by a ball tree over each part position's entries.

Components become whole numbers, vectors are cut into PARTS consecutive parts,
and each part position has a codebook of at most ENTRIES entries. Codebooks start
as the parts of the vectors with the smallest ids and are improved in rounds:
tasks assign parts to their nearest entries and hand back a sum and a count for
each entry and place, so a round moves ENTRIES times the dimensions and reads the
vectors once. Only codebooks, whose size is fixed by the parameters and the
dimensions, go through the driver.

The entries of a part position are held in balls: a node's ball holds all its
entries, its radius is rounded up. A part visits the nearer ball first, and
another one if it may hold an entry that is as near as the best so far (not only
a nearer one, for ties go to the lower index); bounds are in floating point and
rounded down, distances to entries are exact in whole numbers.

Defined cases: vectors that are null, hold null or non-finite components, or
components of LARGEST and more (whose errors would not fit), go; so do those
whose size differs from that of the kept vector with the smallest id, and all if
that size is no multiple of the number of parts. Null ids stand last, equal ids
in the order of their vectors; repeated rows each get a row. With fewer vectors
than entries the codebooks are as small; an empty table gives an empty result.
Null labels are one label. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship, stored
from .texts import gathered

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = float(1 << 16)

#: Entries of a leaf, and vectors handled at once.
LEAF, ROWS = 6, 1 << 14


class Balls:
    """A ball tree over the entries (whole numbers) of a part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.nodes: list[tuple] = []  # center, radius, and either the leaf's entries or two nodes
        self.root = self._node(np.arange(len(entries)))

    def _node(self, which: np.ndarray) -> int:
        points = self.entries[which].astype(np.float64)
        center = points.mean(axis=0)
        radius = float(np.sqrt(((points - center) ** 2).sum(axis=1)).max()) * (1 + 1e-9) + 1e-6  # never too small
        spread = points.max(axis=0) - points.min(axis=0)
        if len(which) <= LEAF or not spread.any():
            self.nodes.append((center, radius, np.sort(which), None))
        else:
            order = which[np.argsort(points[:, spread.argmax()], kind="stable")]
            half = len(order) // 2
            children = self._node(order[:half]), self._node(order[half:])
            self.nodes.append((center, radius, None, children))
        return len(self.nodes) - 1

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry, the lower one on a tie, and its squared distance."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.zeros(len(points), np.int64)
        self._visit(self.root, np.arange(len(points)), points, best, index)
        return index, best

    def _visit(self, node: int, rows: np.ndarray, points: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        _, _, leaf, children = self.nodes[node]
        if children is None:
            d = ((points[rows, None, :] - self.entries[leaf]) ** 2).sum(axis=2)
            nearest = d.argmin(axis=1)
            d, found = d[np.arange(len(rows)), nearest], leaf[nearest]
            better = (d < best[rows]) | ((d == best[rows]) & (found < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], found[better]
            return
        to_center = [np.sqrt(((points[rows] - self.nodes[c][0]) ** 2).sum(axis=1)) for c in children]
        # Below every distance to an entry of the ball, whatever has been rounded.
        bounds = [np.maximum(0, d * (1 - 1e-9) - 1e-6 - self.nodes[c][1]) ** 2 * (1 - 1e-9) for d, c in zip(to_center, children)]
        left_first = to_center[0] <= to_center[1]
        for first, some in ((0, left_first), (1, ~left_first)):
            for side in (first, 1 - first):
                mine, bound = rows[some], bounds[side][some]
                self._visit(children[side], mine[bound <= best[mine]], points, best, index)


def _parts(table: pa.Table, vector: str, parts: int) -> np.ndarray:
    """Whole numbers: vectors x parts x places."""
    values = table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(table.num_rows, parts, -1)


def _sum_rows(books, parts: int, vector: str):
    """A task's sums and counts for each part position, entry and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.value
        trees = [Balls(e) for e in entries]
        sums, counts = np.zeros_like(entries), np.zeros(entries.shape[:2], np.int64)
        for table in gathered(batches, ROWS):
            whole = _parts(table, vector, parts)
            for i, tree in enumerate(trees):
                index, _ = tree.nearest(whole[:, i])
                np.add.at(sums[i], index, whole[:, i])
                counts[i] += np.bincount(index, minlength=entries.shape[1])
        part, entry, place = (x.ravel() for x in np.indices(sums.shape))
        some = counts[part, entry] > 0
        columns = [part[some], entry[some], place[some], sums.ravel()[some], counts[part, entry][some]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "total", "n"])

    return run


def _code_rows(books, parts: int, vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Balls(e) for e in books.value]
        for table in gathered(batches, ROWS):
            whole = _parts(table, vector, parts)
            found = [tree.nearest(whole[:, i]) for i, tree in enumerate(trees)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            texts = pa.array([c.tobytes().hex() for c in codes], pa.string())
            head = [table.column(c).combine_chunks() for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*head, texts, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def codable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The vectors without null, non-finite or too large components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return vectors.filter(F.col(vector).isNotNull() & sound)


def fitted(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding") -> np.ndarray | None:
    """Codebooks of the vectors (all of one size): parts x entries x places; None if there are no vectors."""
    spark = kept.sparkSession
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), vector).limit(entries).select(vector).toArrow()  # as many as there are entries
    if not first.num_rows:
        return None
    books = _parts(first, vector, parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        rows = kept.select(vector).mapInArrow(_sum_rows(sent, parts, vector), "part long, entry long, place long, total long, n long")
        means = rows.groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).collect()  # a row for each number of the codebooks at most
        for part, entry, place, total, n in means:
            books[part, entry, place] = total // n
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, code (two hex digits a part), error, label_error (of all vectors of its label), codebooks_sha256.

    vectors: vec_id, label, and the vector. entries: at most 256.
    """
    if not 1 <= entries <= 256 or rounds < 0:
        raise ValueError("1 to 256 entries, and no less than 0 rounds")
    spark = vectors.sparkSession
    ship(spark)
    kept = codable(vectors.select("vec_id", "label", vector), vector)
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), vector).select(F.size(vector).alias("n")).first()
    size = least["n"] if least and least["n"] % parts == 0 else 0
    kept = kept.filter(F.lit(size > 0) & (F.size(vector) == size))
    books = fitted(kept, parts, entries, rounds, vector) if size else None
    types = dict(vectors.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    if books is None:
        rows = spark.createDataFrame([], schema)
    else:
        rows = kept.mapInArrow(_code_rows(spark.sparkContext.broadcast(books), parts, vector), schema)
    rows = stored(rows, "codes")  # a join of two plain shuffles, which may be split where a label is common
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "of")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else "").alias("codebooks_sha256"))


def _assigned(books: str) -> str:
    return f"""SELECT p.id, p.part, arg_min(b.entry, (list_sum(list_transform(list_zip(p.q, b.q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), b.entry)) AS entry,
           min(list_sum(list_transform(list_zip(p.q, b.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS d
    FROM parts p JOIN {books} b USING (part) GROUP BY p.id, p.part"""


def _improved(books: str, assigned: str) -> str:
    return f"""SELECT part, entry, coalesce(m.q, b.q) AS q FROM {books} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY place) AS q FROM (
      SELECT a.part, a.entry, place, CAST((sum(p.q[place]) - (sum(p.q[place]) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean
      FROM {assigned} a JOIN parts p ON p.id = a.id AND p.part = a.part, unnest(range(1, CAST(len(p.q) + 1 AS BIGINT))) AS t(place)
      GROUP BY a.part, a.entry, place) GROUP BY part, entry) m USING (part, entry)"""


ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT id, part, q[part * len(q) // 16 + 1:(part + 1) * len(q) // 16] AS q FROM kept, unnest(range(0, 16)) AS t(part)),
books0 AS MATERIALIZED (
  SELECT part, id - 1 AS entry, q FROM parts WHERE id <= 64),
assigned0 AS MATERIALIZED (
  {_assigned('books0')}),
books1 AS MATERIALIZED (
  {_improved('books0', 'assigned0')}),
assigned1 AS MATERIALIZED (
  {_assigned('books1')}),
books2 AS MATERIALIZED (
  {_improved('books1', 'assigned1')}),
assigned2 AS MATERIALIZED (
  {_assigned('books2')}),
codes AS (
  SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d) AS error FROM assigned2 GROUP BY id)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) FROM books2) AS codebooks_sha256
FROM kept JOIN codes USING (id)
"""
