"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature has CHUNKS * WIDTH positions of 8 bits, the low bits of a minimum
over the shingles under one hash function each. Two signatures that differ in
at most CHUNKS * (ERRORS + 1) - 1 positions agree in some chunk but for at most
ERRORS positions (pigeonhole). So each chunk is indexed once for every choice
of ERRORS positions to leave out, and equal keys give the candidates: all pairs
under that distance are among them. A pair at the similarity threshold of 0.8
differs in a fifth of the positions, and the chance that no chunk of it agrees
is (1 - P[at most ERRORS of WIDTH differ]) ** CHUNKS, 8e-5; at 0.85, 1e-6.

No group is expanded into all its pairs. Texts with equal shingle sets are one
node. Within a key, each node is held against the smallest node; what is then
still apart (several components under one key) is compared in blocks of
bounded size, nearest signatures first, and pairs that are already connected
are left out, for only components are asked for. Links are confirmed on whole
sets of 64-bit shingle hashes.

Defined cases: a null or empty text has no shingles, links with nothing and is
its own component; a text with fewer words than a shingle has one shingle, its
whole sequence; rows with equal ids and texts are linked as copies; a null
doc_id counts as larger than all others; an empty table gives an empty result.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import ship, stored
from .texts import mix, pieces, runs, split_words

CHUNKS, WIDTH, ERRORS = 11, 7, 1
POSITIONS = CHUNKS * WIDTH
#: Candidates whose signatures differ in more positions are dropped: for a pair at 0.8, 5 standard deviations above the mean.
FAR = int(0.2 * POSITIONS + 5 * (0.16 * POSITIONS) ** 0.5) + 1
#: Nodes, and shingles in all, of a block of the comparison within a key.
BLOCK, BLOCK_SHINGLES = 4096, 4_000_000
#: Nodes whose keys a task makes, while that takes no more than MOST_TASKS tasks.
NODES, MOST_TASKS = 8192, 100_000

#: The choices of positions left out of a chunk, and by the mask of positions that differ the first choice that covers them (-1: none).
CHOICES = list(combinations(range(WIDTH), ERRORS))
FIRST_CHOICE = np.array([next((i for i, c in enumerate(CHOICES) if not m & ~sum(1 << p for p in c)), -1) for m in range(1 << WIDTH)])

_STEP = np.uint64(0xD1342543DE82EF95)
_SALTS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64))
_FLIPS = (_SALTS >> np.uint64(32)).astype(np.uint32)
_FACTORS = (_SALTS & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    w = split_words(texts, lower=True)
    words = w.hashes()
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * _STEP + words[j : n - k + 1 + j]
    rolled = mix(rolled)
    sets = []
    for begin, end in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if end - begin >= k:
            s = np.sort(rolled[begin : end - k + 1])
            sets.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif end > begin:
            one = np.zeros(1, np.uint64)
            for h in words[begin:end]:
                one = one * _STEP + h
            sets.append(mix(one + np.uint64(end - begin)))
        else:
            sets.append(np.zeros(0, np.uint64))
    where = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=where[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), where


def fingerprints(shingles: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set that isn't empty: the sum and the xor of its remixed members."""
    at = where[:-1][np.diff(where) > 0]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.bitwise_xor.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), at)
    high = mix(np.add.reduceat(mix(shingles + np.uint64(0x14057B7EF767814F)), at))
    return high.view(np.int64), low.view(np.int64)


def signatures(shingles: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The signature, POSITIONS bytes, of each set that isn't empty."""
    at = where[:-1][np.diff(where) > 0]
    out = np.zeros((len(at), POSITIONS), np.uint8)
    if len(at):
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(POSITIONS):
            low = np.minimum.reduceat((short ^ _FLIPS[i]) * _FACTORS[i], at)
            out[:, i] = (low * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                shingles, where = shingle_sets(part.column("text"), k)
                sizes = np.diff(where)
                high, low = fingerprints(shingles, where)
                full = np.flatnonzero(sizes > 0)
                row = np.full(len(sizes), -1)
                row[full] = np.arange(len(full))
                rows, none = pa.array(row, mask=row < 0), pa.array([r.tobytes() for r in signatures(shingles, where)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(sizes), pa.array(high).take(rows), pa.array(low).take(rows), none.take(rows)],
                    names=["doc_id", "text_hash", "n_shingles", "node", "low", "signature"],
                )

    return run


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk and choice of positions left out; the key is the choice and the bytes kept."""
    kept = [[c * WIDTH + p for p in range(WIDTH) if p not in out] for c in range(CHUNKS) for out in CHOICES]
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            part = batch.slice(begin, 2000)
            signs = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, POSITIONS).astype(np.int64)
            keys = np.empty((len(kept), len(signs)), np.int64)
            for i, places in enumerate(kept):
                key = np.full(len(signs), i, np.int64)
                for p in places:
                    key = (key << 8) | signs[:, p]
                keys[i] = key
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(part.column("node").to_numpy(), len(kept)))], names=["key", "node"])


def _near_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("sign_a", "sign_b"))
        near = pa.array((a != b).sum(axis=1) <= FAR)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], names=["a", "b"])


def _wanted_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                shingles, where = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([shingles[a:b].tobytes() for a, b in zip(where[:-1], where[1:])], pa.binary())], names=["node", "members"]
                )

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y|, for sorted distinct members."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())
            ]
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return run


def _candidates(rows: pa.Table, percent: int) -> np.ndarray:
    """(positions that differ, i, j) of the pairs between two blocks of a key that this key has to settle.

    Left out are pairs within a component, pairs whose signatures or sizes are
    too far apart, and pairs that share an earlier key, which settles them.
    """
    signs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, POSITIONS)
    part, roots, nodes, sizes, key, one, two = (rows.column(c).to_numpy() for c in ("part", "root", "node", "size", "key", "one", "two"))
    index = int(key[0]) >> (8 * (WIDTH - ERRORS))
    first, second = np.flatnonzero(part == one[0]), np.flatnonzero(part == two[0])
    found = [np.zeros((3, 0), np.int64)]
    for begin in range(0, len(first), 64):
        some = first[begin : begin + 64]
        wanted = roots[some][:, None] != roots[second]
        if one[0] == two[0]:
            wanted &= nodes[some][:, None] < nodes[second]
        wanted &= (100 * sizes[some][:, None] >= percent * sizes[second]) & (100 * sizes[second] >= percent * sizes[some][:, None])
        i, j = np.nonzero(wanted)
        i, j = some[i], second[j]
        apart = signs[i] != signs[j]
        total = apart.sum(axis=1)
        near = total <= FAR
        i, j, total, apart = i[near], j[near], total[near], apart[near]
        choice = FIRST_CHOICE[apart.reshape(-1, CHUNKS, WIDTH) @ (1 << np.arange(WIDTH))]
        chunk = (choice >= 0).argmax(axis=1)
        own = chunk * len(CHOICES) + choice[np.arange(len(i)), chunk] == index
        found.append(np.stack([total[own], i[own], j[own]]))
    return np.concatenate(found, axis=1)


def _with_candidates(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes of two blocks of a key that are in some pair to be settled there."""
        for rows in runs(batches, ("key", "one", "two")):
            found = _candidates(rows, percent)
            if found.shape[1]:
                yield from rows.take(pa.array(np.union1d(found[1], found[2]))).combine_chunks().to_batches()

    return run


def _between_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that join components, nearest signatures first."""
        for rows in runs(batches, ("key", "one", "two")):
            found = _candidates(rows, percent)
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]
            roots, nodes, links = rows.column("root").to_pylist(), rows.column("node").to_pylist(), []
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while parent.get(x, x) != x:
                    parent[x] = x = parent.get(parent[x], parent[x])
                return x

            for _, i, j in found.T[np.argsort(found[0], kind="stable")].tolist():
                a, b = find(roots[i]), find(roots[j])
                if a != b and _similar(sets[i], sets[j], percent):
                    parent[max(a, b)] = min(a, b)
                    links.append((nodes[i], nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept.

    docs: doc_id, text. k: words in a shingle. percent: least similarity of a link.
    """
    out = _grouped(docs, k, percent).drop("root")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, and the component's root (null without shingles)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    of_all = stored(
        docs.mapInArrow(_features(k), f"doc_id {id_type}, text_hash long, n_shingles long, node long, low long, signature binary"), "signatures"
    )
    classes = (
        of_all.filter("n_shingles > 0")
        .groupBy("node", "low")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size"))
    )
    classes = classes.select("node", "low", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "signature", "size")
    classes = stored(classes, "classes")

    # A node makes many keys, so the tasks follow the nodes and not their few bytes, by which files are dealt out.
    spread = classes.select("node", "signature").repartition(min(MOST_TASKS, classes.count() // NODES + 1), "node")
    keys = spread.mapInArrow(_key_rows, "key long, node long")
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot != last").select("key", "pivot")
    shared = stored(shared, "shared")  # a join of two plain shuffles, which may be split where a key is common
    hits = stored(keys.join(shared, "key"), "hits")

    signs = classes.select("node", "signature", "size")
    pairs = hits.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = pairs.join(signs.select(F.col("node").alias("a"), F.col("signature").alias("sign_a")), "a").join(
        signs.select(F.col("node").alias("b"), F.col("signature").alias("sign_b")), "b"
    )
    pairs = stored(pairs.select("a", "b", "sign_a", "sign_b").mapInArrow(_near_signatures, "a long, b long"), "pairs")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = nodes.join(classes.select("node", "doc_id", "text_hash"), "node").select("node", F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"))
        texts = docs.join(wanted, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "text")
        return texts.mapInArrow(_wanted_sets(k), "node long, members binary").dropDuplicates(["node"])

    sets = stored(sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "sets")
    held = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b"
    )
    links = stored(held.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")
    roots = stored(components(links), "roots")

    more = stored(_across(hits, roots, signs, sets, sets_of, percent), "across")
    if more.head(1):
        roots = stored(components(links.union(more)), "roots")

    known = classes.join(roots.select("node", "root"), "node", "left").select(
        "node", "low", F.coalesce("root", "node").alias("root"), "doc_id"
    )
    named = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = known.select("node", "low", "root").join(named, "root").select(F.col("node").alias("n"), F.col("low").alias("l"), "component_id", "root")
    out = of_all.join(of_class, (F.col("node") == F.col("n")) & (F.col("low") == F.col("l")), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), "root")


def _across(hits: DataFrame, roots: DataFrame, signs: DataFrame, sets: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links between components that share a key, beyond those with the key's smallest node.

    Signatures and sets are joined to nodes, one row each with a list of the
    node's keys, which is laid out afterwards.
    """
    rest = hits.filter("node != pivot").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rest.groupBy("key").agg(F.min("root").alias("lowest"), F.max("root").alias("highest")).filter("lowest != highest").select(F.col("key").alias("of"))
    rest = rest.join(mixed, F.col("key") == F.col("of")).groupBy("node", "root").agg(F.collect_list("key").alias("keys"))
    rest = stored(rest.join(signs, "node"), "mixed")
    sizes = rest.select(F.explode("keys").alias("of"), "size").groupBy("of").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    rest = rest.withColumn("key", F.explode("keys")).join(sizes.select("of", blocks), F.col("key") == F.col("of"))
    rest = rest.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    laid = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    laid = laid.select("key", "node", "root", "part", "size", "signature", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    laid = laid.select("key", "one", "two", "part", "node", "root", "size", "signature")
    block = ("key", "one", "two")
    open_ = laid.repartition(*block).sortWithinPartitions(*block).mapInArrow(_with_candidates(percent), laid.schema)
    places = F.collect_list(F.struct("key", "one", "two", "part")).alias("places")
    open_ = stored(open_.groupBy("node", "root", "size").agg(places, F.first("signature").alias("signature")), "open")
    sets = sets_of(open_.select("node").join(sets.select("node"), "node", "left_anti")).union(sets.join(open_.select("node"), "node", "left_semi"))
    full = open_.join(sets, "node").withColumn("place", F.explode("places")).select("place.*", "node", "root", "size", "signature", "members")
    return full.repartition(*block).sortWithinPartitions(*block).mapInArrow(_between_blocks(percent), "a long, b long")


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, of which one of each component stays: the first by doc_id (null last) and text hash.

    Documents without shingles stay. Of rows with equal ids and texts one stays, whatever else they hold: that of the least hash of all columns.
    """
    grouped = stored(_grouped(docs, k, percent), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"))).alias("first")
    kept = grouped.filter("root IS NOT NULL").groupBy("root").agg(first).select("first.of", "first.hash")
    kept = kept.union(grouped.filter("root IS NULL").select("doc_id", "text_hash").distinct())
    copies = grouped.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.count("*").alias("copies"))
    kept = stored(kept.join(copies, (F.col("hash") == F.col("h")) & F.col("of").eqNullSafe(F.col("d"))).select("of", "hash", "copies"), "kept")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash"))
    joined = whole.join(kept, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("of")))
    single = joined.filter("copies = 1").select("row.*")
    repeated = joined.filter("copies > 1").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return single.union(repeated.select("row.*"))
