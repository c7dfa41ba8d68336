"""Exact nearest neighbours by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marlspar.session import ship, stored

#: Pivots, at most, and items for each, at least; rings of distance around a pivot.
PIVOTS, ITEMS_PER_PIVOT, RINGS = 64, 4096, 16
#: Bytes of a block of items (in doubles), queries of a block, of a group that one task searches, and distances that are held at once.
BLOCK_BYTES, BLOCK_QUERIES, GROUP_QUERIES, HELD = 4 << 20, 512, 16384, 1 << 19


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences, in double."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def nearest(items: DataFrame, query: Sequence[float], k: int = 500, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k items nearest to one vector: id, d2 (6 decimals) and rank, ties by id.

    Each task keeps its own k best, so nothing but these is moved.
    """
    lit = F.array(*[F.lit(float(x)) for x in query])
    found = items.select(id_column, F.round(squared_distance(F.col(vector), lit), 6).alias("d2")).orderBy("d2", id_column).limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("d2", id_column)))


def upserted_nearest(existing: DataFrame, new: DataFrame, query: Sequence[float], k: int = 2, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Items replaced and added by id, then the k nearest of what is there now."""
    kept = existing.join(new.select(id_column).distinct(), id_column, "left_anti")
    return nearest(kept.unionByName(new), query, k, id_column, vector)


def nearest_to_each(
    items: DataFrame, queries: DataFrame, k: int = 500, id_column: str = "vec_id", vector: str = "embedding", query_id: str = "chat_id", query_vector: str = "query"
) -> DataFrame:
    """The k items nearest to each query: query id, item id, d2 (6 decimals), rank, ties by id.

    Rows of ``nearest_lists``, one for each neighbour. Items and queries without a vector go.
    """
    asked = queries.select(F.col(query_id), F.col(query_vector))
    lists = nearest_lists(items.select(id_column, vector), asked, k, id_column, vector, query_vector)
    rows = lists.select(query_id, F.posexplode("items"))
    return rows.select(query_id, F.col(f"col.`{id_column}`").alias(id_column), F.col("col.d2").alias("d2"), (F.col("pos") + 1).alias("rank"))


def nearest_lists(items: DataFrame, queries: DataFrame, k: int = 500, id_column: str = "vec_id", vector: str = "embedding", query_vector: str = "query") -> DataFrame:
    """A row for each query: its columns but the vector, and ``items``, its k nearest in order: d2 (6 decimals) and the item's columns but the vector; ties by id.

    Items lie around pivots (PIVOTS of them, or fewer) in the order of their
    distance, and blocks of at most BLOCK_BYTES are rows of a table; the rings of
    each pivot are summed up in a table of fixed size. Equal query vectors are
    searched once. Groups of at most GROUP_QUERIES of them meet in one task the
    blocks that one of them may need, one after the other, and hold their k best
    alone, so that what is moved are the blocks, once a group, and the lists. By
    the triangle inequality a ring is skipped if even its nearest place is farther
    than the farthest place of rings that hold k items, and for one query a block
    that is farther than the k it has. Only pivots and rings go through the driver.

    What a query needs of an item should be among its columns if it is short, for
    lists are a row a query vector where neighbours are k rows a query.

    Items and queries without a vector go.
    """
    mine, lists = shared_lists(items, queries, k, id_column, vector, query_vector)
    return mine.join(lists, "query_no").drop("query_no")


def shared_lists(items: DataFrame, queries: DataFrame, k: int = 500, id_column: str = "vec_id", vector: str = "embedding", query_vector: str = "query") -> tuple[DataFrame, DataFrame]:
    """What ``nearest_lists`` joins: the queries' columns but the vector, and ``query_no``; and a row for each vector, ``query_no`` and ``items``.

    The numbers of vectors hold for this search alone.
    """
    spark = items.sparkSession
    ship(spark)
    carried = [c for c in items.columns if c not in (id_column, vector)]
    single = dict(items.dtypes)[vector] == "array<float>"  # as wide in a block as in the table
    items = items.filter(F.col(vector).isNotNull()).select(F.col(id_column).alias("id"), F.struct(F.col(id_column), *carried).alias("item"), F.col(vector).cast("array<double>").alias("vector"))
    item = items.schema["item"].dataType.simpleString()
    # Vectors are told apart by 128 bits where queries look for theirs.
    marks = [F.xxhash64("query").alias("_mark"), F.xxhash64(F.lit(1), "query").alias("_other_mark")]
    asked = queries.withColumn("query", F.col(query_vector).cast("array<double>")).filter("query IS NOT NULL")
    searched = stored(asked.select("query", *marks).distinct().withColumn("query_no", F.monotonically_increasing_id()), "queries")

    # Numbers that stand in the order of the ids break ties.
    numbered = stored(items.orderBy("id").withColumn("place", F.monotonically_increasing_id()), "items")
    count = max(1, min(PIVOTS, numbered.count() // ITEMS_PER_PIVOT))
    chosen = [r[0] for r in numbered.orderBy(F.xxhash64("id"), "id").select("vector").limit(count).collect()]
    others = [F.col(f"`{c}`") for c in queries.columns if c != query_vector]
    mine = asked.select(*others, *marks).join(searched.select("_mark", "_other_mark", "query_no"), ["_mark", "_other_mark"]).select(*others, "query_no")
    if not chosen:
        entry = F.struct(F.lit(0.0).alias("d2"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in items.schema["item"].dataType])
        return mine, searched.limit(0).select("query_no", F.array(entry).alias("items"))
    pivots = spark.sparkContext.broadcast(np.array(chosen))  # count vectors
    placed = numbered.select("place", "item", "vector").mapInArrow(_placed(pivots, ["place", "item", "vector"], "vector"), f"place long, item {item}, vector array<double>, pivot int, distance double")
    ordered = placed.repartitionByRange("pivot", "distance").sortWithinPartitions("pivot", "distance")
    blocks = stored(ordered.mapInArrow(_block_rows(BLOCK_BYTES, single), f"pivot int, near double, far double, n int, places array<long>, items array<{item}>, vectors binary"), "blocks")

    edges = blocks.groupBy("pivot").agg(F.percentile_approx("near", [i / RINGS for i in range(RINGS)]).alias("edges"))  # the first is the least
    ring = F.size(F.filter("edges", lambda e: e <= F.col("near"))).alias("ring")
    blocks = blocks.join(F.broadcast(edges), "pivot").select("pivot", ring, "near", "far", "n", "places", "items", "vectors")  # a row a pivot
    rings = blocks.groupBy("pivot", "ring").agg(F.min("near"), F.max("far"), F.sum("n")).collect()  # PIVOTS * RINGS rows at most
    sent = spark.sparkContext.broadcast(np.array(rings, np.float64))

    # Every group takes the blocks once, so there are no more groups than tasks at a time; ranges of queries aren't equal, so they are aimed below the most.
    tasks = _group_count(searched.count(), spark.sparkContext.defaultParallelism)
    near = searched.select("query_no", "query").mapInArrow(_placed(pivots, ["query_no", "query"], "query"), "query_no long, query array<double>, pivot int, distance double")
    near = near.repartitionByRange(tasks, "pivot", "query_no").sortWithinPartitions("pivot", "query_no")  # queries that want the same blocks
    columns = "group long, pivot int, ring int, least double, query_nos array<long>, queries binary"
    groups = stored(near.mapInArrow(_wanted_groups(pivots, sent, k, GROUP_QUERIES, tasks), columns), "groups")
    asking = groups.filter("pivot IS NULL").selectExpr(
        "group", "-1D AS least", "query_nos", "queries", "CAST(NULL AS int) AS pivot", "CAST(NULL AS double) AS near", "CAST(NULL AS double) AS far",
        "CAST(NULL AS array<long>) AS places", f"CAST(NULL AS array<{item}>) AS items", "CAST(NULL AS binary) AS vectors",
    )
    wanted = groups.filter("pivot IS NOT NULL").select("group", "pivot", "ring", "least")
    met = wanted.join(blocks.select("pivot", "ring", "near", "far", "places", "items", "vectors"), ["pivot", "ring"])
    met = met.selectExpr("group", "least", "CAST(NULL AS array<long>) AS query_nos", "CAST(NULL AS binary) AS queries", "pivot", "near", "far", "places", "items", "vectors")
    dealt = asking.unionByName(met).repartitionById(tasks, F.col("group").cast("int")).sortWithinPartitions("group", "least")
    entry = StructType([StructField("d2", DoubleType()), *items.schema["item"].dataType]).simpleString()
    return mine, dealt.mapInArrow(_best_of_groups(pivots, k, single), f"query_no long, items array<{entry}>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, rounded to 6 decimals."""
    return np.round(np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (q @ x.T), 0), 6)


def _pair_distances(q: np.ndarray, row: np.ndarray, x: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, rounded to 6 decimals."""
    d = np.empty(len(row))
    for at in range(0, len(row), 4096):
        apart = q[row[at : at + 4096]]
        apart -= x[column[at : at + 4096]]
        np.einsum("ij,ij->i", apart, apart, out=d[at : at + 4096])
    return np.round(d, 6)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - pivots) ** 2).sum(axis=2))


def _placed(pivots, names: list[str], vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = np.concatenate([_to_pivots(_matrix(batch.column(vector).slice(i, 1024)), pivots.value) for i in range(0, batch.num_rows, 1024)])
                nearest = d.argmin(axis=1)
                columns = [*[batch.column(c) for c in names], pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "pivot", "distance"])

    return run


def _block(held: list[pa.RecordBatch], single: bool) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    held.clear()
    distance = rows.column("distance").to_numpy()
    places, items = (rows.column(c).combine_chunks() for c in ("place", "item"))
    one = pa.array([0, len(places)], pa.int32())
    vectors = _matrix(rows.column("vector").combine_chunks()).astype(np.float32 if single else np.float64).tobytes()
    columns = [rows.column("pivot")[:1].combine_chunks(), pa.array(distance[:1]), pa.array(distance[-1:]), pa.array([len(places)], pa.int32())]
    columns += [pa.ListArray.from_arrays(one, places), pa.ListArray.from_arrays(one, items), pa.array([vectors])]
    return pa.RecordBatch.from_arrays(columns, names=["pivot", "near", "far", "n", "places", "items", "vectors"])


def _block_rows(most_bytes: int, single: bool):
    """Blocks of items in the order of pivot and distance; a block has one pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot = batch.column("pivot").to_numpy()
            per_row = max(1, 8 * len(batch.column("vector").flatten()) // batch.num_rows)
            most = max(1, most_bytes // per_row)
            edges = np.r_[0, np.flatnonzero(pivot[1:] != pivot[:-1]) + 1, len(pivot)]
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if held and held[-1].column("pivot")[0].as_py() != pivot[begin]:
                    yield _block(held, single)
                    size = 0
                while begin < end:
                    some = min(end - begin, most - size)
                    held.append(batch.slice(begin, some))
                    begin, size = begin + some, size + some
                    if size >= most:
                        yield _block(held, single)
                        size = 0
        if held:
            yield _block(held, single)

    return run


def _needs(q: np.ndarray, pivots: np.ndarray, rings: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which queries may have one of their k nearest in which rings, and the least distance of each to each."""
    near, far, n = rings[:, 2], rings[:, 3], rings[:, 4]
    d = _to_pivots(q, pivots)[:, rings[:, 0].astype(np.int32)]
    least = np.maximum(0, np.maximum(near - d, d - far))
    most = d + far
    order = np.argsort(most, axis=1)
    enough = np.cumsum(n[order], axis=1) >= k
    limit = np.where(enough.any(axis=1), np.take_along_axis(most, order, 1)[np.arange(len(q)), enough.argmax(axis=1)], np.inf)
    # Distances count by 6 decimals of their squares, so what is as far as the last must be seen.
    return least**2 <= (limit**2 * (1 + 1e-9) + 1e-5)[:, None], least


def _wanted_rows(pivots, rings, k: int):
    """For blocks of queries and each ring, those that may have one of their k nearest there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, ring = rings.value[:, 0].astype(np.int32), rings.value[:, 1].astype(np.int32)
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_QUERIES):
                some = batch.slice(begin, BLOCK_QUERIES)
                q = _matrix(some.column("query"))
                needs, _ = _needs(q, pivots.value, rings.value, k)
                numbers = some.column("query_no").to_numpy()
                which = np.flatnonzero(needs.any(axis=0))
                nos, vectors = [numbers[needs[:, r]] for r in which], [q[needs[:, r]].tobytes() for r in which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivot[which]), pa.array(ring[which]), pa.array(nos, pa.list_(pa.int64())), pa.array(vectors, pa.binary())], names=["pivot", "ring", "query_nos", "queries"]
                )

    return run


def _group_count(n: int, parallel: int) -> int:
    """As many groups of n queries as tasks at a time, or a multiple where they would be too large, or fewer where they would be short."""
    rounds = max(1, -(-n // (GROUP_QUERIES * 3 // 4 * parallel)))
    return max(1, min(rounds * parallel, -(-n // BLOCK_QUERIES)))


def _wanted_groups(pivots, rings, k: int, most: int, tasks: int):
    """For groups of at most so many queries: a row with them all, and a row for each ring that one of them may need, with the mean of their least distances to it."""
    schema = pa.schema([("group", pa.int64()), ("pivot", pa.int32()), ("ring", pa.int32()), ("least", pa.float64()), ("query_nos", pa.list_(pa.int64())), ("queries", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, ring = rings.value[:, 0].astype(int), rings.value[:, 1].astype(int)
        group = TaskContext.get().partitionId()  # further groups of a task lie a number of tasks apart
        for batch in batches:
            each = -(-batch.num_rows // max(1, -(-batch.num_rows // most)))  # equal parts, without a short rest
            for begin in range(0, batch.num_rows, max(1, each)):
                some = batch.slice(begin, each)
                q = _matrix(some.column("query"))
                needed, least = np.zeros(len(pivot), bool), np.zeros(len(pivot))
                for at in range(0, len(q), BLOCK_QUERIES):
                    needs, distance = _needs(q[at : at + BLOCK_QUERIES], pivots.value, rings.value, k)
                    needed |= needs.any(axis=0)
                    least += distance.sum(axis=0) / len(q)
                rows = [{"group": group, "query_nos": some.column("query_no").to_pylist(), "queries": q.tobytes()}]
                rows += [{"group": group, "pivot": pivot[r], "ring": ring[r], "least": least[r]} for r in np.flatnonzero(needed).tolist()]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                group += tasks

    return run


def _kept(d: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's distances the k least, ties by place. Infinite ones stand for none."""
    last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    stay, tied = d < last, d == last
    room = k - stay.sum(axis=1)
    for row in np.flatnonzero((tied.sum(axis=1) > room) & np.isfinite(last[:, 0])).tolist():
        at = np.flatnonzero(tied[row])
        tied[row, at[np.argsort(places[row, at])[room[row] :]]] = False
    endless = np.flatnonzero(np.isinf(last[:, 0]))
    tied[endless] &= np.cumsum(tied[endless], axis=1) <= room[endless, None]
    row, at = np.nonzero(stay | tied)
    return d[row, at].reshape(-1, k), places[row, at].reshape(-1, k)


class _Group:
    """Queries of a group and their best so far, k at least and half as many again before they are cut. Blocks come one after the other.

    A product in single precision, of vectors as they lie around the block's pivot,
    leaves out what is farther than a query's k known ones by more than its error
    can be; what it lets through, some of thousands, is measured in double.
    """

    def __init__(self, numbers: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int):
        self.numbers, self.q, self.pivots, self.k = numbers, q, pivots, k
        self.to_pivots = np.concatenate([_to_pivots(q[i : i + 1024], pivots) for i in range(0, len(q), 1024)])
        self.d, self.places = np.full((len(q), k + -(-k // 2)), np.inf), np.full((len(q), k + -(-k // 2)), -1)
        self.filled, self.last = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
        self.seen: list[tuple[np.ndarray, pa.Array]] = []

    def meet(self, pivot: int, near: float, far: float, places: np.ndarray, items: pa.Array, x: np.ndarray) -> None:
        to = self.to_pivots[:, pivot]
        least = np.maximum(0, np.maximum(near - to, to - far))
        rows = np.flatnonzero(least**2 <= self.last * (1 + 1e-9) + 1e-5)
        if not len(rows):
            return
        self.seen.append((places, items))
        around = x - self.pivots[pivot]
        squares = (around * around).sum(axis=1)
        reach = (np.sqrt(squares.max()) + to) ** 2  # no distance is above, nor a term of the product
        kind = np.float32 if reach[rows].max() < 1e37 else np.float64
        right = np.concatenate([-2 * around, squares[:, None]], axis=1).astype(kind).T
        margin = np.finfo(kind).eps * (x.shape[1] + 16) * reach + 1e-6 + 1e-9 * np.minimum(reach, self.last)
        most = max(1, HELD // (len(x) + self.k))
        for begin in range(0, len(rows), most):
            some = rows[begin : begin + most]
            mine = self.q[some] - self.pivots[pivot]
            product = np.concatenate([mine, np.ones((len(some), 1))], axis=1).astype(kind) @ right  # squared distances, less those to the pivot
            limit = self.last[some] - (mine * mine).sum(axis=1) + margin[some]
            new = np.flatnonzero(np.isinf(limit))
            if len(new) and len(x) > self.k:
                limit[new] = np.partition(product[new], self.k - 1, axis=1)[:, self.k - 1] + 2 * margin[some[new]]
            row, column = np.divmod(np.flatnonzero(product <= limit.astype(kind)[:, None]), len(x))
            if len(row):
                self._add(some, row, places[column], _pair_distances(self.q, some[row], x, column))

    def _add(self, some: np.ndarray, row: np.ndarray, places: np.ndarray, d: np.ndarray) -> None:
        """Distances by the number of their row in some, in order of it."""
        fits = d <= self.last[some[row]]
        row, places, d = row[fits], places[fits], d[fits]
        count = np.bincount(row, minlength=len(some))
        nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        total = self.filled[some] + count
        cut = (total > self.d.shape[1]) | (np.isinf(self.last[some]) & (total >= self.k))
        stays = ~cut[row]
        to = some[row[stays]]
        at = self.filled[to] + nth[stays]
        self.d[to, at], self.places[to, at] = d[stays], places[stays]
        self.filled[some] = np.where(cut, self.k, total)
        over = np.flatnonzero(cut)
        if not len(over):
            return
        width, number = int(count[over].max()), np.cumsum(cut) - 1
        new_d, new_places = np.full((len(over), width), np.inf), np.full((len(over), width), -1)
        at = number[row[~stays]], nth[~stays]
        new_d[at], new_places[at] = d[~stays], places[~stays]
        over = some[over]
        best, of = _kept(np.concatenate([self.d[over], new_d], axis=1), np.concatenate([self.places[over], new_places], axis=1), self.k)
        self.d[over, : self.k], self.places[over, : self.k] = best, of
        self.d[over, self.k :] = np.inf
        self.last[over] = best.max(axis=1)

    def lists(self) -> Iterator[pa.RecordBatch]:
        if not self.seen:
            return
        known = np.concatenate([p for p, _ in self.seen])
        items = pa.concat_arrays([i for _, i in self.seen])
        order = np.argsort(known)
        known = known[order]
        for begin in range(0, len(self.q), BLOCK_QUERIES):
            d, places = self.d[begin : begin + BLOCK_QUERIES], self.places[begin : begin + BLOCK_QUERIES]
            by = np.lexsort((places, d), axis=1)[:, : self.k]
            d, places = np.take_along_axis(d, by, 1), np.take_along_axis(places, by, 1)
            there = np.isfinite(d)
            offsets = pa.array(np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32))
            found = items.take(pa.array(order[np.searchsorted(known, places[there])]))
            entries = pa.StructArray.from_arrays([pa.array(d[there]), *found.flatten()], names=["d2", *[f.name for f in found.type]])
            yield pa.RecordBatch.from_arrays([pa.array(self.numbers[begin : begin + BLOCK_QUERIES]), pa.ListArray.from_arrays(offsets, entries)], names=["query_no", "items"])


def _best_of_groups(pivots, k: int, single: bool):
    """Of rows in order of their group, its queries first and then the blocks that it meets: a row a query with its k best, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            for row in range(batch.num_rows):
                queries = batch.column("queries")[row]
                if queries.is_valid:
                    if group is not None:
                        yield from group.lists()
                    numbers = batch.column("query_nos")[row].values.to_numpy().copy()
                    q = np.frombuffer(queries.as_buffer(), np.float64).reshape(len(numbers), -1).copy()
                    group = _Group(numbers, q, pivots.value, k)
                    continue
                places = batch.column("places")[row].values.to_numpy().copy()
                x = np.frombuffer(batch.column("vectors")[row].as_buffer(), np.float32 if single else np.float64).reshape(len(places), -1).astype(np.float64)
                items = pa.concat_arrays([batch.column("items")[row].values.slice(0)])
                group.meet(*[batch.column(c)[row].as_py() for c in ("pivot", "near", "far")], places, items, x)
        if group is not None:
            yield from group.lists()

    return run
