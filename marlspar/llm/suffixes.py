"""Exact repeated byte strings by a distributed suffix sort.

A byte goes if it is covered by a string of LENGTH bytes that also starts
earlier: in a document before (by doc_id, then text hash), or earlier in the
same one. Every place of a text starts a suffix; the first LENGTH bytes of it
(its window) decide. Only suffixes that may have an equal are sorted:

1. A window's anchor is the place of the smallest hash of its SEED-byte grams,
   so equal windows have equal anchors at equal offsets. Windows of a text with
   the same anchor form a run, and the bytes that they cover its stretch. Runs
   are dealt to buckets by splitters sampled from a part of the documents, so a
   gram that a third of all documents share fills several buckets. Within one,
   runs with equal stretches are a class: all but the first of them repeat it
   throughout, and a gram with one class is settled. Those that have an earlier
   equal in their own piece of a batch are settled before they are dealt: they
   travel to any bucket, so copies and periodic texts don't meet in one.
2. Of grams with several classes, and of those at the edges of a bucket, the
   first run of each class goes on with its bytes. These suffixes are
   range-partitioned by the bytes from the anchor on, which follow the sampled
   splitters of Spark's range partitioning, so that suffixes with common leading
   bytes stand side by side. Windows that agree with neither neighbour in the
   bytes they need are unique; the others are sorted by multikey quicksort, and
   of equal neighbours all but the first go.
3. A window whose bytes after the anchor reach over the edge of a bucket's
   chunk may have an equal beyond it. The first of each such window in its chunk
   is compared across the boundaries by 128 bits of hash: a row a chunk, not a
   row an occurrence.

Runs and classes are compared by 128 bits (gram and stretch), windows within a
chunk by their bytes.

Defined cases: a null or empty text has no bytes; a text of fewer than LENGTH
bytes loses none; a null doc_id stands last, equal ids stand in the order of
their texts' hashes, and rows with equal ids and texts are one document whose
result each row gets; an empty table gives an empty result. Matches don't cross
documents. Bytes are cut without regard to characters, so what is kept is
binary. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import ship, stored
from .substrings import anchors
from .texts import Words, byte_hash, gathered, mix, pieces, text_bytes

LENGTH = 100
SEED = 24

#: Runs that are sampled for each bucket, for its splitter.
SAMPLED = 32
#: Suffixes whose windows are sorted at once.
CHUNK = 4096


def _bytes(texts: pa.Array) -> Words:
    """The bytes of all texts, without words."""
    none = np.zeros(0, np.int64)
    return Words(*text_bytes(texts), none, none, none)


def multikey_order(words: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian words, ties by ``tie``, and whether each row in that order equals the one before.

    Multikey quicksort, a word as a key: rows are sorted by their first word, and only groups that are still tied by the next.
    """
    order = np.lexsort((tie, words[:, 0]))
    same = np.r_[False, words[order[1:], 0] == words[order[:-1], 0]][: len(order)]
    for depth in range(1, words.shape[1]):
        tied = same | np.r_[same[1:], False]  # with the first of each group
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~same[at])
        rows = order[at]
        sub = np.lexsort((tie[rows], words[rows, depth], group))
        order[at] = rows[sub]
        key = words[order[at], depth]
        same[at] = np.r_[False, (group[1:] == group[:-1]) & (key[1:] == key[:-1])]
    return order, same


def _runs(part: pa.RecordBatch, length: int, seed: int):
    """Runs of windows with one anchor: text, first window, windows, anchor's offset in the stretch, gram and stretch hashes."""
    bytes_ = _bytes(part.column("text"))
    buf, offsets = bytes_.buf, bytes_.offsets
    n, spread = len(buf), length - seed + 1
    if n < length or np.diff(offsets).max(initial=0) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = bytes_.byte_sums()
    at = np.arange(n - seed + 1)
    grams = mix(byte_hash(sums, at, at + seed))
    window = np.arange(n - length + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(window)]
    anchor = anchors(grams, spread)
    inside = window + length <= offsets[text + 1]
    window, anchor, text = window[inside], anchor[inside], text[inside]
    begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[begin, len(window)])
    first, text, anchor = window[begin], text[begin], anchor[begin]
    offset = anchor - first
    stretch = mix(byte_hash(sums, first, first + count - 1 + length) + ((offset << 8) + count).astype(np.uint64))
    return text, first - offsets[text], count, offset, grams[anchor], stretch


def _salt(text_hash: np.ndarray, doc: pa.Array) -> np.ndarray:
    """Spreads the runs of a common class."""
    ids = doc.cast(pa.int64()).fill_null(-1).to_numpy() if pa.types.is_integer(doc.type) else np.zeros(len(doc), np.int64)
    return mix(text_hash.view(np.uint64) ^ mix(ids.view(np.uint64)))


def _routing_keys(gram: np.ndarray, stretch: np.ndarray, salt: np.ndarray) -> np.ndarray:
    rows = np.stack([gram, stretch, salt], axis=1).astype(">u8")
    return rows.view("S24").reshape(-1)


def _later(gram: np.ndarray, stretch: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a run has an equal one at an earlier place among these."""
    order = np.argsort(mix(gram ^ mix(stretch)))
    same = (gram[order[1:]] == gram[order[:-1]]) & (stretch[order[1:]] == stretch[order[:-1]])
    begin = np.flatnonzero(np.r_[True, ~same][: len(order)])
    out = np.zeros(len(gram), bool)
    if len(begin) < len(order):
        least = np.minimum.reduceat(place[order], begin)
        out[order] = place[order] > np.repeat(least, np.diff(np.r_[begin, len(order)]))
    return out


def _run_rows(length: int, seed: int, splitters=None, buckets: int = 1):
    """Run rows, dealt to buckets by the splitters; without splitters the keys for choosing these.

    Runs that repeat one of their own piece are settled: they are dealt evenly, without what they would be compared by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                text, first, count, offset, gram, stretch = _runs(part, length, seed)
                rows = pa.array(text)
                doc, text_hash = part.column("doc_id").take(rows), part.column("text_hash").take(rows)
                keys = _routing_keys(gram, stretch, _salt(text_hash.to_numpy(), doc))
                if splitters is None:
                    yield pa.RecordBatch.from_arrays([pa.array([x.ljust(24, b"\0") for x in keys.tolist()], pa.binary())], names=["key"])
                    continue
                shape = (count << 8) | offset
                ranks = _ranks(pa.Table.from_batches([part.select(["doc_id", "text_hash"])]), ("doc_id", "text_hash"))
                settled = _later(gram, stretch, (ranks[text] << 32) + first)
                anywhere = mix(stretch ^ mix(_salt(text_hash.to_numpy(), doc) + first.astype(np.uint64))) % np.uint64(buckets)
                bucket = np.where(settled, anywhere.astype(np.int64), np.searchsorted(splitters.value, keys, side="right"))
                gram, stretch = (np.where(settled, np.uint64(0), x) for x in (gram, stretch))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(stretch.view(np.int64)), doc, text_hash,
                        pa.array(first.astype(np.int32)), pa.array(shape.astype(np.int32)), pa.array(settled),
                    ],
                    names=["bucket", "gram", "stretch", "doc_id", "text_hash", "first", "shape", "settled"],
                )

    return run


def _differs(column: pa.ChunkedArray | pa.Array, last) -> np.ndarray:
    """Whether each value differs from the one before, the first from ``last``; nulls are equal."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    before = pa.concat_arrays([pa.array([last], column.type), column.slice(0, len(column) - 1)])
    same = pc.equal(column, before).fill_null(False).to_numpy(zero_copy_only=False)
    both_null = column.is_null().to_numpy(zero_copy_only=False) & before.is_null().to_numpy(zero_copy_only=False)
    return ~(same | both_null)


_PLACE = ("doc_id", "text_hash", "first", "shape")


def _settled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's runs, settled or else in order of gram, stretch and place: the later ones of a class, and the firsts of classes that others or a neighbouring bucket may contest."""
    last = None  # the row before: gram, stretch and place
    pending: pa.Table | None = None  # the last first of a class, if it isn't known yet whether it is contested
    first_gram = None
    for table in gathered(batches, 1 << 16):
        yield from _marked(table.filter(table.column("settled")), False)
        table = table.filter(pc.invert(table.column("settled"))).combine_chunks()
        if not table.num_rows:
            continue
        gram, stretch = table.column("gram").to_numpy(), table.column("stretch").to_numpy()
        if last is None:
            first_gram = gram[0]
        new_gram = np.r_[last is None or gram[0] != last["gram"], gram[1:] != gram[:-1]]
        new_class = new_gram | np.r_[last is None or stretch[0] != last["stretch"], stretch[1:] != stretch[:-1]]
        other_place = np.logical_or.reduce([_differs(table.column(c), None if last is None else last[c]) for c in _PLACE])
        last = {c: table.column(c)[len(table) - 1].as_py() for c in ("gram", "stretch", *_PLACE)}
        later = ~new_class & other_place
        firsts = table.filter(pa.array(new_class)).select(["gram", *_PLACE])
        if pending is not None:
            firsts = pa.concat_tables([pending, firsts])
        grams = firsts.column("gram").to_numpy()
        if len(grams):
            again = grams[1:] == grams[:-1]
            contested = np.r_[again, False] | np.r_[False, again] | (grams == first_gram)
            # The last one goes on if it is contested already; else the next rows tell.
            pending = None if contested[-1] else firsts.slice(len(grams) - 1)
            yield from _marked(firsts.filter(pa.array(contested)), True)
            if contested[-1]:
                pending = None
                first_gram = grams[-1]  # later classes of this gram are contested, too
        yield from _marked(table.filter(pa.array(later)), False)
    if pending is not None:
        yield from _marked(pending, True)


def _marked(rows: pa.Table, contested: bool) -> Iterator[pa.RecordBatch]:
    if rows.num_rows:
        rows = rows.select(list(_PLACE)).append_column("contested", pa.array(np.full(rows.num_rows, contested)))
        yield from rows.combine_chunks().to_batches()


def _suffix_rows(length: int):
    """The stretches of the listed runs: the bytes from the anchor on, and those before it, backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                data = _bytes(part.column("text"))
                whole, base = data.buf.tobytes(), data.offsets.tolist()
                wanted = part.column("wanted")
                owner = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
                flat = wanted.flatten()
                first, shape = (pc.struct_field(flat, i).to_numpy() for i in (0, 1))
                suffix, before = [], []
                for row, f, s in zip(owner.tolist(), first.tolist(), shape.tolist()):
                    at = base[row] + f + (s & 255)
                    suffix.append(whole[at : base[row] + f + (s >> 8) - 1 + length])
                    before.append(whole[base[row] + f : at][::-1])
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("text_hash").take(rows), pa.array(first), pa.array(shape), pa.array(suffix, pa.binary()), pa.array(before, pa.binary())],
                    names=["doc_id", "text_hash", "first", "shape", "suffix", "before"],
                )

    return run


def _matrix(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, filled up with zeros, and their lengths."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    place = np.arange(width)
    inside = place < size[:, None]
    out = np.zeros((len(values), width), np.uint8)
    out[inside] = data[(offsets[:-1, None] + place)[inside]]
    return out, size


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of the rows of two matrices."""
    apart = a != b
    return np.where(apart.any(axis=1), apart.argmax(axis=1), a.shape[1])


def _compared_rows(length: int, seed: int):
    """Of suffixes in the order of their bytes: for each run the windows that repeat an earlier one of its chunk (kind 0, as bits), and the windows that may have an equal beyond the chunk (kind 1)."""

    def chunk(rows: pa.Table, cut_before: bool, cut_after: bool) -> Iterator[pa.RecordBatch]:
        right, size = _matrix(rows.column("suffix").combine_chunks(), length)
        left, _ = _matrix(rows.column("before").combine_chunks(), length - seed)
        shape = rows.column("shape").to_numpy()
        count, offset = shape >> 8, shape & 255
        n = len(shape)
        size = np.minimum(size, length)
        steps = _common(right[1:], right[:-1])
        near = np.maximum(np.r_[0, steps], np.r_[steps, 0])  # agrees with a neighbour
        edge = np.zeros(n, np.int64)  # agrees with the chunk's first or last suffix, where others may follow beyond
        if cut_before:
            edge = np.r_[length, np.minimum.accumulate(steps)] if n > 1 else np.full(1, length)
        if cut_after:
            edge = np.maximum(edge, np.r_[np.minimum.accumulate(steps[::-1])[::-1], length] if n > 1 else np.full(1, length))
        owner = np.repeat(np.arange(n), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        ahead = offset[owner] - nth  # bytes before the anchor
        needs = length - ahead
        alike = np.flatnonzero((needs <= near[owner]) | (needs <= edge[owner]))
        owner, nth, ahead, needs = owner[alike], nth[alike], ahead[alike], needs[alike]
        if not len(owner):
            return
        rows = rows.combine_chunks()
        place = _ranks(rows, ("doc_id", "text_hash", "first"))
        # A window is the bytes before its anchor and those from it on: its words are cut from both laid side by side.
        both = np.concatenate([left[:, ::-1], right], axis=1)
        begin = left.shape[1] - ahead
        wide = -(-length // 8) * 8
        windows = np.zeros((len(owner), wide), np.uint8)
        strided = np.lib.stride_tricks.sliding_window_view(both, length, axis=1)
        windows[:, :length] = strided[owner, begin]
        words = windows.view(">u8").astype(np.uint64)
        tie = place[owner] * 128 + nth
        order, same = multikey_order(words, tie)
        least = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        repeats = order[tie[order] != tie[least]]  # repeated rows of a document have equal places
        lo, hi = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        bit = np.uint64(1) << (nth % 63).astype(np.uint64)
        low = repeats[nth[repeats] < 63]
        high = repeats[nth[repeats] >= 63]
        np.bitwise_or.at(lo, owner[low], bit[low])
        np.bitwise_or.at(hi, owner[high], bit[high])
        told = np.flatnonzero(lo | hi)
        firsts = order[~same]
        beyond = firsts[needs[firsts] <= edge[owner[firsts]]]

        def out(kind: int, which: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(which):
                some = pa.array(which)
                values = [columns[c].view(np.int64) if c in columns else np.zeros(len(which), np.int64) for c in ("lo", "hi", "one", "two")]
                head = [rows.column(c).take(some).combine_chunks() for c in ("doc_id", "text_hash", "first")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), kind, np.int32)), *head, *[pa.array(v) for v in values]], names=["kind", "doc_id", "text_hash", "first", "lo", "hi", "one", "two"])

        yield from out(0, told, lo=lo[told], hi=hi[told])
        bits = bit[beyond]
        small = nth[beyond] < 63
        hashes = [_word_hash(words[beyond], k) for k in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))]
        yield from out(1, owner[beyond], lo=np.where(small, bits, np.uint64(0)), hi=np.where(small, np.uint64(0), bits), one=hashes[0], two=hashes[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        cut = True  # what stands in the partition before can't be seen
        for table in gathered(batches, CHUNK):
            for begin in range(0, table.num_rows, CHUNK):
                now = table.slice(begin, CHUNK)
                if waiting is not None:
                    head, tail = now.column("suffix")[0].as_py()[:seed], waiting.column("suffix")[waiting.num_rows - 1].as_py()[:seed]
                    yield from chunk(waiting, cut, head == tail)
                    cut = head == tail
                waiting = now
        if waiting is not None:
            yield from chunk(waiting, cut, True)

    return run


def _ranks(rows: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Places of the rows in the order of the columns, nulls last; equal rows have one."""
    order = pc.sort_indices(rows.select(list(columns)), sort_keys=[(c, "ascending") for c in columns], null_placement="at_end")
    ordered = rows.take(order)
    new = np.logical_or.reduce([_differs(ordered.column(c), None) for c in columns])
    out = np.empty(rows.num_rows, np.int64)
    out[order.to_numpy()] = np.cumsum(new)
    return out


def _word_hash(words: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + words[:, i] + base)
    return out


def _kept_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                data = _bytes(part.column("text"))
                n = len(data.buf)
                found = part.column("found")
                edges = np.zeros(n + 1, np.int64)
                flat = found.flatten()
                if len(flat):
                    sizes = pc.list_value_length(found).fill_null(0).to_numpy()
                    base = np.repeat(data.offsets[:-1], sizes)
                    first, lo, hi = (pc.struct_field(flat, i).to_numpy() for i in range(3))
                    for mask, more in ((lo, 0), (hi, 63)):
                        row, shift = np.nonzero(np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                        at = base[row] + first[row] + shift + more
                        edges += np.bincount(at, minlength=n + 1)
                        edges -= np.bincount(at + length, minlength=n + 1)
                gone = np.cumsum(edges)[:n] > 0
                starts = gone & ~np.r_[False, gone[:-1]][:n]
                begins = data.offsets[:-1]
                starts[begins[begins < n]] = gone[begins[begins < n]]
                total = np.r_[0, np.cumsum(gone)]
                spans = np.r_[0, np.cumsum(starts)]
                kept = data.buf[~gone].tobytes()
                kept_at = data.offsets - total[data.offsets]
                texts = [kept[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(np.diff(data.offsets)), pa.array(np.diff(total[data.offsets])), pa.array(np.diff(spans[data.offsets])),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
                )

    return run


def _same() -> Column:
    return (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("of"))


def _splitters(docs: DataFrame, length: int, seed: int, buckets: int) -> np.ndarray:
    """At most buckets - 1 keys that deal the runs of a sample of the documents out evenly; the sample grows with the buckets alone."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, 2 * SAMPLED * buckets * (length - seed + 2) / 2 / max(1, size))
    grid = 1 << 30
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(17)), F.lit(grid)) < max(1, int(share * grid)))
    keys = some.mapInArrow(_run_rows(length, seed), "key binary")
    # One key a slot, so that there are no more of them than slots, however long a chosen document is.
    keys = keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(8 * SAMPLED * buckets))).agg(F.min("key").alias("key")).select("key").collect()
    ordered = np.sort(np.array([bytes(r[0]) for r in keys], "S24"))
    return np.unique(ordered[np.arange(1, buckets) * len(ordered) // buckets]) if len(ordered) else ordered


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept_bytes.

    docs: doc_id, text. length: bytes of a string. seed: bytes of a gram, which
    may stand at length - seed + 1 places of a window (at most 126).
    """
    if not 8 <= seed <= length or length - seed + 1 > 126:
        raise ValueError("a window must have 1 to 126 places for its gram")
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = spark.sparkContext.broadcast(_splitters(docs, length, seed, buckets))
    place = f"doc_id {id_type}, text_hash long, first int, shape int"
    runs = docs.mapInArrow(_run_rows(length, seed, splitters, buckets), f"bucket int, gram long, stretch long, {place}, settled boolean")
    runs = runs.repartitionById(buckets, "bucket")
    runs = runs.sortWithinPartitions("gram", "stretch", F.col("doc_id").asc_nulls_last(), "text_hash", "first", "shape")
    settled = stored(runs.mapInArrow(_settled_rows, f"{place}, contested boolean"), "settled")

    wanted = settled.filter("contested").groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"))
    wanted = wanted.agg(F.collect_list(F.struct("first", "shape")).alias("wanted"))
    # Rows with equal ids and texts are one document.
    listed = docs.join(wanted, _same()).select("doc_id", "text_hash", "text", "wanted").dropDuplicates(["doc_id", "text_hash"])
    suffixes = stored(listed.mapInArrow(_suffix_rows(length), f"{place}, suffix binary, before binary"), "suffixes")
    ordered = suffixes.repartitionByRange("suffix", "before").sortWithinPartitions("suffix", "before")
    masks = f"kind int, doc_id {id_type}, text_hash long, first int, lo long, hi long, one long, two long"
    compared = stored(ordered.mapInArrow(_compared_rows(length, seed), masks), "compared")

    order = Window.partitionBy("one", "two").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash", "first", "hi", "lo")  # a row a chunk at most
    across = compared.filter("kind = 1").withColumn("nth", F.rank().over(order)).filter("nth > 1")
    count = F.shiftright("shape", 8)

    def ones(n: Column) -> Column:
        return F.when(n >= 63, F.lit((1 << 63) - 1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(n, F.lit(0))) - 1)

    whole = settled.filter("NOT contested").select("doc_id", "text_hash", "first", ones(count).alias("lo"), ones(count - 63).alias("hi"))
    columns = ["doc_id", "text_hash", "first", "lo", "hi"]
    found = whole.unionByName(compared.filter("kind = 0").select(columns)).unionByName(across.select(columns))
    found = found.groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash")).agg(F.collect_list(F.struct("first", "lo", "hi")).alias("found"))
    out = docs.join(found, _same(), "left").select("doc_id", "text", "found")
    return out.mapInArrow(_kept_rows(length), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, hex(encode(coalesce(text, ''))) AS data FROM documents),
blocks AS (
  SELECT row, begin, substr(data, 2 * begin + 1, 2198) AS block FROM docs, unnest(range(0, CAST(len(data) // 2 AS BIGINT), 1000)) AS t(begin)),
windows AS (
  SELECT row, begin + i AS i, md5(substr(block, 2 * i + 1, 200)) AS digest FROM blocks, unnest(range(0, least(1000, CAST(len(block) // 2 AS BIGINT) - 99))) AS t(i)),
later AS (
  SELECT row, i FROM windows QUALIFY row_number() OVER (PARTITION BY digest ORDER BY row, i) > 1),
begun AS (
  SELECT *, i > coalesce(lag(i) OVER (PARTITION BY row ORDER BY i) + 100, -1) AS begins FROM later),
numbered AS (
  SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY row ORDER BY i) AS span FROM begun),
spans AS (
  SELECT row, span, min(i) AS first, max(i) + 100 AS last FROM numbered GROUP BY row, span),
gaps AS (
  SELECT row, coalesce(lag(last) OVER w, 0) AS first, first AS last FROM spans WINDOW w AS (PARTITION BY row ORDER BY span)
  UNION ALL SELECT row, max(last), NULL FROM spans GROUP BY row),
kept AS (
  SELECT row, string_agg(substr(data, 2 * first + 1, 2 * (coalesce(last, CAST(len(data) // 2 AS BIGINT)) - first)), '' ORDER BY first) AS kept
  FROM gaps JOIN docs USING (row) GROUP BY row),
removed AS (
  SELECT row, sum(last - first) AS n_removed, count(*) AS n_spans FROM spans GROUP BY row)
SELECT doc_id, CAST(len(data) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, data))) AS kept_sha256
FROM docs LEFT JOIN removed USING (row) LEFT JOIN kept USING (row)
"""
