"""Line dedup: exact copies by hash, near copies by a segment-partition edit join.

Lines are compared over all documents. Of equal lines the first stays, in order
of doc_id, text hash and line number. A line also goes if some earlier line is
within the edits allowed to the two, whether that one stays or not, so the
outcome does not depend on the order of comparisons. An edit inserts, deletes or
replaces one word (a run of characters other than space and 0x09-0x0D), and
``percent`` edits a hundred words of the longer line are allowed, one at least
from EDITED words on. Shorter lines are near copies only if their words are
equal and the white space between them isn't.

Two sequences within e edits: cut one into e + 1 segments, and one of these
stands unchanged in the other, shifted by at most e. While e is at most SHIFTED,
each line is indexed by its segments, with its length and the segment's number,
and probes the indexes of its own and the e shorter lengths with the runs of
words that may match (shifts limited from both ends). A segment of a line below
SELECTIVE_LINE words is too common to be looked up alone: within one edit, the
other segment is equal less one word, so such lines are looked up by their words
without each one in turn. The number of probes grows with e ** 2 a length, so longer lines take from each stretch as long as a segment the
run of words whose hash is least: both lines choose the same one in the segment
that is unchanged, wherever it stands. No pair within its edits is missed either
way, and nothing depends on how many lines share a run of words.

Entries carry the class of their line's length, are sorted and read as a
stream. Lines of an entry in one or two neighbouring classes are dealt to the
first of them, so a line has a row for each such first line and not for each of
its pairs. The lines of a first line
are compared in the task that holds them, by counts of words and then by banded
bit-parallel edit distance, many pairs in step; only lines that go leave it. Of
many lines, blocks are compared with each other in separate tasks.

Defined cases: a null or empty text has no lines; lines without a word always
stay and are not counted; rows with equal ids and texts are one document, and
each row gets its result; a null doc_id stands last; a line is what stands
between newlines, so a carriage return belongs to it; an empty table gives an
empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ship, stored
from .texts import BYTE, byte_hash, gathered, mix, pieces, powers, sequence_hash, sequence_sums, split_words, whole_runs

#: Edits a hundred words of the longer line.
PERCENT = 8
#: Least words of a line that may have an edit, and of one whose segments are looked up alone.
EDITED, SELECTIVE_LINE = 4, 13
#: Most edits for which segments are probed at all shifts.
SHIFTED = 2
#: Words of a run that is looked up, at least, where the unchanged stretch has as many.
SELECTIVE = 5
#: Lines and words of a block, and rows and their bytes compared in one go.
BLOCK, BLOCK_WORDS, ROWS, ROW_BYTES = 2048, 4_000_000, 8192, 8 << 20
#: Lines whose entries a task remembers having sent, so that common lines are not sent again and again.
REMEMBERED = 400_000

_WORD = re.compile(r"[^\x20\x09-\x0D]")
_OTHER_BASE, _OTHER_BYTE = np.uint64(0xC2B2AE3D27D4EB4F), mix(BYTE ^ np.uint64(0xA5A5A5A5A5A5A5A5))
#: Bits of an entry that hold the class of its line's length.
LEVEL_BITS = 16


class Lines:
    """The lines with a word of some texts: text and number of each, 64 bits of its bytes, and its words."""

    def __init__(self, texts: pa.Array):
        self.words = words = split_words(texts)
        self.byte_sums = words.byte_sums()
        newline = np.flatnonzero(words.buf == 10)
        first = np.unique(np.searchsorted(words.starts, np.r_[words.offsets, newline + 1]))
        self.first = first[first < len(words.starts)]
        self.length = np.diff(np.r_[self.first, len(words.starts)])
        at = words.starts[self.first]
        self.row = np.searchsorted(words.offsets, at, side="right") - 1
        begin, limit = words.offsets[self.row], words.offsets[self.row + 1]
        before = np.searchsorted(newline, at)
        in_text = np.searchsorted(newline, begin)
        self.number = before - in_text
        breaks = np.r_[-1, newline, len(words.buf)]  # break i stands before line i of all texts together
        self.start = np.where(before > in_text, breaks[before] + 1, begin)
        self.end = np.minimum(breaks[before + 1], limit)
        self.node = self._finished(byte_hash(self.byte_sums, self.start, self.end))

    def _finished(self, hashes: np.ndarray) -> np.ndarray:
        return mix(hashes + (self.end - self.start).astype(np.uint64)).view(np.int64)

    def low(self) -> np.ndarray:
        """64 more bits of the lines' bytes."""
        buf = self.words.buf
        up, down = powers(_OTHER_BASE, len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_OTHER_BYTE[buf] * up[: len(buf)], out=sums[1:])
        return self._finished(byte_hash((sums, down), self.start, self.end))

    def run_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums for the hashes of runs of words."""
        return sequence_sums(self.words.hashes(self.byte_sums))


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            lines = Lines(part.column("text"))
            rows = pa.array(lines.row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(rows), part.column("text_hash").take(rows), pa.array(lines.number.astype(np.int32)), pa.array(lines.node), pa.array(lines.low())],
                names=["doc_id", "text_hash", "line", "node", "low"],
            )


def allowed(longer, percent: int):
    """Edits allowed to a pair by the words of its longer line."""
    return np.maximum(longer * percent // 100, np.asarray(longer) >= EDITED)


def segments(length: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Begin and length of each segment of sequences of the lengths; later segments take what is left over."""
    size, longer = length // parts, length % parts
    return [(i * size + np.maximum(0, i - (parts - longer)), size + (i >= parts - longer)) for i in range(parts)]


def shifted_entries(first: np.ndarray, length: np.ndarray, sums, edits: int, least: int, below: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which lines, their entries) for each place of a segment, for pairs whose longer line has ``least`` to ``below`` - 1 words."""
    for shorter in range(edits + 1):
        probing = np.flatnonzero((length >= least) & (length < below) & (length > shorter))
        # A line that is only the shorter one of such a pair is in the index alone.
        some = np.r_[probing, np.flatnonzero((length >= least - edits) & (length < least) & (length > 0))] if not shorter else probing
        indexed = length[some] < least
        target = length[some] - shorter
        for i, (begin, size) in enumerate(segments(target, edits + 1)):
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                at = begin + shift
                fit = (at >= 0) & (at + size <= length[some]) & (size > 0) & (~indexed | (shift == 0))
                where = first[some[fit]] + at[fit]
                tag = mix(((target[fit] * 64 + edits) * 64 + i).astype(np.uint64))
                yield some[fit], mix(sequence_hash(sums, where, where + size[fit]) ^ tag).view(np.int64)


def shortened_entries(first: np.ndarray, length: np.ndarray, sums, least: int, below: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which lines, their entries): the words of a line, and its words without each one, for pairs within one edit whose longer line has ``least`` to ``below`` - 1 words."""
    total, down = sums
    some = np.flatnonzero((length >= least - 1) & (length < below - 1))
    begin, n = first[some], length[some]
    # The hash of all words, made as that of the others below.
    yield some, _shortened((total[begin + n] - total[begin]) * down[begin], n)
    for i in range(below - 1):
        some = np.flatnonzero((length >= least) & (length < below) & (length > i))
        begin, n = first[some], length[some]
        ahead = (total[begin + i] - total[begin]) * down[begin]
        behind = (total[begin + n] - total[begin + i + 1]) * down[begin + 1]
        yield some, _shortened(ahead + behind, n - 1)


def _shortened(words: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(mix(words + length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) ^ np.uint64(0x5BD1E9955BD1E995)).view(np.int64)


def stretch(least: int, below: int, percent: int) -> int:
    """Words of which some stretch stays unchanged if the longer line has ``least`` to ``below`` - 1 words."""
    n = np.arange(least, below)
    k = allowed(n, percent)
    return int((-(-(n - k) // (k + 1))).min())


def chosen_entries(first: np.ndarray, length: np.ndarray, sums, percent: int, least: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(which lines, their entries): the run of words of least hash of every unchanged stretch there may be."""
    same = stretch(least, below if below else 64 * least, percent)
    size = max(min(SELECTIVE, same), same // 2)
    window = same - size + 1
    some = np.flatnonzero((length >= least - allowed(least, percent)) & ((length < below) if below else True) & (length >= same))
    if not len(some):
        return some, np.zeros(0, np.int64)
    counts = length[some] - size + 1
    owner = np.repeat(np.arange(len(some)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    where = first[some][owner] + place
    value = mix(sequence_hash(sums, where, where + size) ^ mix(np.uint64([least])))
    whole = max(0, len(value) - window + 1)
    inside = owner[:whole] == owner[window - 1 :]  # no window reaches over the end of its line
    least_of = value[:whole].copy()
    for i in range(1, window):
        np.minimum(least_of, value[i : i + whole], out=least_of)
    picked = np.zeros(len(value), bool)
    for i in range(window):
        picked[i : i + whole] |= (value[i : i + whole] == least_of) & inside
    at = np.flatnonzero(picked)
    order = at[np.argsort(value[at], kind="stable")]  # a line that repeats itself has each of its runs once
    again = np.r_[False, (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])][: len(order)]
    at = order[~again]
    return some[owner[at]], value[at].view(np.int64)


def classes(percent: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(edits, least, below) of the lengths whose segments are probed at all shifts, and (least, below) of longer ones; 0: no end."""
    least = [next(n for n in range(1, 10**4) if allowed(n, percent) >= e) if e else 1 for e in range(SHIFTED + 2)]
    longer = [n for n in range(least[-1], 4 * least[-1]) if stretch(n, 64 * n, percent) > stretch(max(least[-1], n - 1), 64 * n, percent)]
    return [(e, least[e], least[e + 1]) for e in range(SHIFTED + 1)], list(zip([least[-1], *longer], [*longer, 0]))


@lru_cache
def level_bounds(percent: int) -> np.ndarray:
    """The least length of each class of lengths; lengths that fit the edits are of one class or of two that follow one another."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        low = bounds[-1]
        longer = range(low + 1, 2 * low + 3)  # the least that may not be as short as the class before
        bounds.append(longer[bisect_left(longer, low, key=lambda n: n - int(allowed(n, percent)))])
    return np.array(bounds, np.int64)


def levels(size: np.ndarray, percent: int) -> np.ndarray:
    return np.searchsorted(level_bounds(percent), size, side="right") - 1


def _entry_rows(percent: int):
    short, long = classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for part in pieces(batch):
                lines = Lines(part.column("text"))
                nodes, at = np.unique(lines.node, return_index=True)
                if len(sent) > REMEMBERED:
                    sent.clear()
                new = np.array([n not in sent for n in nodes.tolist()], bool)
                sent.update(nodes[new].tolist())
                at = at[new]
                first, length, sums = lines.first[at], lines.length[at], lines.run_sums()
                found = [x for e, least, below in short if (low := max(least, SELECTIVE_LINE) if e else least) < below for x in shifted_entries(first, length, sums, e, low, below)]
                found += [x for e, least, below in short if e == 1 for x in shortened_entries(first, length, sums, least, min(below, SELECTIVE_LINE))]
                found += [chosen_entries(first, length, sums, percent, least, below) for least, below in long]
                which, entry = (np.concatenate([x[i] for x in found]) for i in (0, 1))
                entry = (entry >> LEVEL_BITS << LEVEL_BITS) | levels(length, percent)[which]
                yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(lines.node[at][which])], names=["entry", "node"])

    return run


def _by_first(percent: int):
    bounds = level_bounds(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by entry: (pivot, node, most words of its class) for each line behind the first of its length class or the class before.

        The first is the least node of an entry in the batch where the entry begins, so that lines which share several entries mostly share the first.
        """
        last = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # entries and first lines of the last two classes
        for batch in gathered(batches, 1 << 16):
            entry, node = (np.r_[x, batch.column(c).to_numpy()] for x, c in zip(last, ("entry", "node")))
            begin = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
            count = np.diff(np.r_[begin, len(entry)])
            head, key = np.minimum.reduceat(node, begin) if len(begin) else node, entry[begin]
            told_before = begin < len(last[0])  # further lines of an entry come to the first that it has
            head[told_before] = node[begin[told_before]]
            # Entries differ in their last bits alone where only the length class does.
            follows = np.r_[False, (key[1:] - key[:-1] == 1) & (key[1:] >> LEVEL_BITS == key[:-1] >> LEVEL_BITS)]
            before = np.where(follows, np.r_[0, head[:-1]], head)
            runs_ = np.flatnonzero((count > 1) | follows)  # most entries are of one line alone
            rows = np.repeat(begin[runs_] - np.cumsum(count[runs_]) + count[runs_], count[runs_]) + np.arange(count[runs_].sum())
            of = np.repeat(runs_, count[runs_])
            pivots, nodes, level = np.r_[head[of], before[of]], np.tile(node[rows], 2), np.tile(entry[rows] & ((1 << LEVEL_BITS) - 1), 2)
            told = np.flatnonzero(np.tile(rows >= len(last[0]), 2) & (pivots != nodes))
            told = told[np.lexsort((nodes[told], pivots[told]))]
            pivots, nodes = pivots[told], nodes[told]
            once = np.r_[True, (pivots[1:] != pivots[:-1]) | (nodes[1:] != nodes[:-1])][: len(pivots)]
            words = bounds[np.minimum(level[told][once] + 1, len(bounds) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(pivots[once]), pa.array(nodes[once]), pa.array(words)], names=["pivot", "node", "words"])
            last = [key[-2:], head[-2:]]

    return run


def within(left: list[np.ndarray], right: list[np.ndarray], edits: np.ndarray) -> np.ndarray:
    """Whether each pair of sequences is within its edits, by a bit-parallel edit distance in a band of 2 * most edits + 1 diagonals.

    A pair's bits are the rows j - most .. j + most of column j, and the bits of
    all pairs stand side by side in one long integer, with a free bit at least
    after each pair's for the carry. Bits of ``up`` and ``down`` mark vertical
    steps of +1 and -1, already in place for the next column. The distance is
    followed down the lowest diagonal to the last row, then along that row.
    """
    out = np.zeros(len(left), bool)
    if not len(left):
        return out
    most = int(edits.max())
    width = 2 * most + 1
    lengths = np.array([[len(x), len(y)] for x, y in zip(left, right)], np.int64)
    todo = np.flatnonzero(np.abs(lengths[:, 0] - lengths[:, 1]) <= edits)
    todo = todo[np.argsort(lengths[todo, 1], kind="stable")]
    size = width // 8 + 1  # bytes of a pair

    def bits(x: np.ndarray) -> int:
        return int.from_bytes(x.tobytes(), "little")

    def bytes_of(x: int, pairs: int) -> np.ndarray:
        return np.frombuffer(x.to_bytes(pairs * size, "little"), np.uint8).reshape(pairs, size)

    def bit(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (x[np.arange(len(x)), at >> 3] >> (at & 7)).astype(np.int64) & 1

    begin = 0
    while begin < len(todo):
        end, longest = begin, 0
        while end < len(todo) and (end == begin or (end + 1 - begin) * max(longest + width, int(lengths[todo[end]].max())) <= 1 << 20):
            longest = max(longest, int(lengths[todo[end]].max()))
            end += 1
        some = todo[begin:end]
        begin = end
        m, n = lengths[some, 0], lengths[some, 1]
        rows = np.full((len(some), longest + width), -1, np.int64)  # -1 and -2 stand for no word
        columns = np.full((len(some), longest + 1), -2, np.int64)
        for k, i in enumerate(some.tolist()):
            rows[k, most : most + m[k]] = left[i]
            columns[k, : n[k]] = right[i]
        field = np.zeros((len(some), 8 * size), np.uint8)
        field[:, :width] = 1
        full = bits(np.packbits(field, axis=1, bitorder="little"))
        field[:, :most] = 0
        up, down = bits(np.packbits(field, axis=1, bitorder="little")), 0
        field[:] = 0
        distance = np.where(m < most, m, most)
        lowest, shift = (width - 1) >> 3, (width - 1) & 7  # where the lowest diagonal's bit is
        shortest, first_end = int(m.min()), int(n.min())
        for j in range(int(n.max())):
            np.equal(rows[:, j : j + width], columns[:, j : j + 1], out=field[:, :width].view(bool))
            same = bits(np.packbits(field, axis=1, bitorder="little"))
            zero = ((((same & up) + up) ^ up) | same | down) & full
            plus = down | (full ^ (zero | up))
            minus = zero & up
            step = 1 - ((bytes_of(zero, len(some))[:, lowest] >> shift) & 1).astype(np.int64)
            if j + 1 > shortest - most:  # some pairs follow their last row by now
                last = m - (j + 1) + most  # the bit of the last row
                at = np.clip(last, 0, width - 1)
                step = np.where(last >= width - 1, step, bit(bytes_of(plus, len(some)), at) - bit(bytes_of(minus, len(some)), at))
            distance += step if j < first_end else np.where(j < n, step, 0)
            moved = (zero >> 1) & full
            up, down = minus | (full ^ (moved | plus)), moved & plus
            if j % 8 == 7:
                # Along a diagonal the distance never falls, and diagonals side by side differ by 1 at most.
                lost = (m - (j + 1) + most >= width - 1) & (distance > edits[some] + most - (m - n))
                if 4 * lost.sum() > len(lost):
                    stay = ~lost
                    full, up, down = (bits(bytes_of(x, len(some))[stay]) for x in (full, up, down))
                    some, m, n, rows, columns, field, distance = (x[stay] for x in (some, m, n, rows, columns, field, distance))
                    if not len(some):
                        break
                    shortest, first_end = int(m.min()), int(n.min())
        out[some] = distance <= edits[some]
    return out


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each pair is within the edits allowed to it."""
    most = allowed(np.array([max(len(x), len(y)) for x, y in zip(left, right)], np.int64), percent)
    out = np.zeros(len(left), bool)
    scale = np.ceil(np.log2(np.maximum(most, 0.5))).astype(np.int64)
    for k in np.unique(scale).tolist():
        some = np.flatnonzero(scale == k).tolist()
        out[some] = within([left[i] for i in some], [right[i] for i in some], most[some])
    return out


def _texts_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, lows, first, texts = [], [], [], []
        for row in batch.to_pylist():
            lines = row["text"].split("\n")
            for x in row["wanted"]:
                nodes.append(x["node"])
                lows.append(x["low"])
                first.append({"none": row["doc_id"] is None, "doc_id": row["doc_id"], "text_hash": row["text_hash"], "line": x["line"]})
                texts.append(lines[x["line"]])
        id_type = batch.schema.field("doc_id").type
        place = pa.struct([("none", pa.bool_()), ("doc_id", id_type), ("text_hash", pa.int64()), ("line", pa.int32())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(lows, pa.int64()), pa.array(first, place), pa.array(texts, pa.string())], names=["node", "low", "first", "line_text"]
        )


def _later_pairs(group: np.ndarray, place: np.ndarray, alive, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of a group in rows sorted by group, j alive when its pair is due: the first row of each group with all others, then ever more rows."""
    begin, end = 0, 1
    while True:
        left = np.flatnonzero((place >= begin) & (place < end))
        if not len(left):
            return
        at = 0
        while at < len(left):
            right = np.flatnonzero(alive())
            low = np.searchsorted(right, left[at:], side="right")
            n = np.searchsorted(group[right], group[left[at:]], side="right") - low
            some = max(1, int(np.searchsorted(np.cumsum(n), most, side="right")))
            n, low = n[:some], low[:some]
            i = np.repeat(left[at : at + some], n)
            yield i, right[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            at += some
        begin, end = end, 2 * end


def _later_lines(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the lines dealt to a first line, or two blocks of them, those that have an earlier one within the edits there."""
        for rows in whole_runs(batches, ("pivot", "one", "two"), ROWS, ROW_BYTES):
            words = split_words(rows.column("line_text"))
            size = np.diff(words.first)
            hashes = words.hashes()
            tokens = np.split((hashes >> np.uint64(1)).view(np.int64), words.first[1:-1])
            counts = np.bincount(np.repeat(np.arange(len(size)), size) * 64 + (hashes & np.uint64(63)).astype(np.int64), minlength=64 * len(size)).reshape(-1, 64).astype(np.int32)
            pivot, one, two, part, node, low = (rows.column(c).to_numpy() for c in ("pivot", "one", "two", "part", "node", "low"))
            first = pa.Table.from_arrays(rows.column("first").combine_chunks().flatten(), ["none", "doc_id", "text_hash", "line"])
            rank = np.empty(len(size), np.int64)
            rank[pc.sort_indices(first, sort_keys=[(c, "ascending") for c in first.column_names]).to_numpy()] = np.arange(len(size))
            by_line = np.lexsort((low, node))
            line = np.empty(len(node), np.int64)
            line[by_line] = np.cumsum(np.r_[True, (node[by_line][1:] != node[by_line][:-1]) | (low[by_line][1:] != low[by_line][:-1])]) - 1
            gone = np.zeros(int(line.max()) + 1, bool)
            group = np.cumsum(np.r_[True, (pivot[1:] != pivot[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]).astype(np.int64)
            order = np.lexsort((rank, group))
            group, line_of = group[order], line[order]
            place = np.arange(len(order)) - np.searchsorted(group, group)
            inside = (one == two)[order]
            for i, j in _later_pairs(group, place, lambda: ~gone[line_of]):
                apart = inside[i] | (part[order[i]] != part[order[j]])  # two blocks are compared with each other, one with itself
                i, j = order[i[apart]], order[j[apart]]
                most = allowed(np.maximum(size[i], size[j]), percent)
                some = np.flatnonzero((np.abs(size[i] - size[j]) <= most) & (line[i] != line[j]))
                some = some[np.abs(counts[i[some]] - counts[j[some]]).sum(axis=1) <= 2 * most[some]]
                some = some[np.unique(line[i[some]] * len(gone) + line[j[some]], return_index=True)[1]]
                if len(some):
                    near = near_pairs([tokens[x] for x in i[some].tolist()], [tokens[x] for x in j[some].tolist()], percent)
                    gone[line[j[some[near]]]] = True
            at = np.unique(line, return_index=True)[1][gone]
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(low[at])], names=["node", "low"])

    return run


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            total, exact, near, texts = [], [], [], []
            for text, firsts in zip(part.column("text").to_pylist(), part.column("firsts").to_pylist()):
                lines = (text or "").split("\n")
                full = [bool(_WORD.search(x)) for x in lines]
                stays = {x["line"] for x in firsts or () if not x["near"]}
                texts.append(None if text is None else "\n".join(x for i, x in enumerate(lines) if not full[i] or i in stays))
                total.append(sum(full))
                exact.append(sum(full) - len({x["line"] for x in firsts or ()}))
                near.append(sum(full) - exact[-1] - len(stays))
            digests = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), *[pa.array(x, pa.int64()) for x in (total, exact, near)], pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "text_hash", "n_lines", "n_exact", "n_near", "kept_sha256", "kept_text"],
            )


def kept_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of documents (doc_id, text, text_hash): doc_id as ``of``, text_hash as ``hash``, and the first lines, with whether they are near copies."""
    if not 0 < percent <= 10:
        raise ValueError("1 to 10 edits a hundred words")
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    lines = docs.mapInArrow(_line_rows, f"doc_id {id_type}, text_hash long, line int, node long, low long")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line")
    firsts = stored(lines.groupBy("node", "low").agg(F.min(place).alias("first")), "firsts")

    rows = docs.select("text").mapInArrow(_entry_rows(percent), "entry long, node long")
    rows = rows.repartition(F.shiftright("entry", LEVEL_BITS)).sortWithinPartitions("entry")  # by one number, which is a radix sort
    dealt = rows.mapInArrow(_by_first(percent), "pivot long, node long, words long")
    dealt = stored(dealt.distinct(), "dealt")
    firsts_of = dealt.groupBy("pivot").agg(F.max("words").alias("words")).select("pivot", F.col("pivot").alias("node"), "words")
    dealt = stored(dealt.union(firsts_of), "groups")

    wanted = dealt.select(F.col("node").alias("n")).distinct().join(firsts, F.col("n") == F.col("node"))
    wanted = wanted.groupBy(F.col("first.doc_id").alias("of"), F.col("first.text_hash").alias("hash"))
    wanted = wanted.agg(F.collect_list(F.struct("node", "low", F.col("first.line").alias("line"))).alias("wanted"))
    found = docs.join(wanted, _same()).select("doc_id", "text_hash", "text", "wanted")
    first_type = f"struct<none:boolean,doc_id:{id_type},text_hash:bigint,line:int>"
    texts = found.mapInArrow(_texts_of_lines, f"node long, low long, first {first_type}, line_text string").dropDuplicates(["node", "low"])
    texts = stored(texts, "texts")

    near = _near_lines(dealt, texts, percent).distinct().select(F.col("node").alias("n"), F.col("low").alias("l"), F.lit(True).alias("near"))
    marked = firsts.join(near, (F.col("node") == F.col("n")) & (F.col("low") == F.col("l")), "left")
    return (
        marked.groupBy(F.col("first.doc_id").alias("of"), F.col("first.text_hash").alias("hash"))
        .agg(F.collect_list(F.struct(F.col("first.line").alias("line"), F.coalesce("near", F.lit(False)).alias("near"))).alias("firsts"))
    )


def _same() -> Column:
    return (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("of"))


def _near_lines(dealt: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    most = F.greatest(F.count("*") / BLOCK, F.sum("words") / BLOCK_WORDS)
    blocks = dealt.groupBy(F.col("pivot").alias("of")).agg(F.ceil(most).cast("int").alias("blocks"))
    lines = dealt.join(blocks, F.col("pivot") == F.col("of"))
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    lines = lines.select("pivot", "node", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lines = lines.select("pivot", "node", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    block = ("pivot", "one", "two")
    rows = lines.join(texts, "node").repartition(*block).sortWithinPartitions(*block)
    return rows.mapInArrow(_later_lines(percent), "node long, low long")


def without_repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, text_hash, n_lines, n_exact and n_near (lines removed as copies and near copies), kept_sha256, kept_text.

    docs: doc_id, text. percent: edits a hundred words of the longer line of a pair, 1 to 10.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    out = docs.join(kept_lines(docs, percent), _same(), "left").select("doc_id", "text_hash", "text", "firsts")
    return out.mapInArrow(_kept_rows, f"doc_id {id_type}, text_hash long, n_lines long, n_exact long, n_near long, kept_sha256 string, kept_text string")


def rewritten(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, without the removed lines; those that lost every line with a word go.

    A whole-number column n_chars follows the text.
    """
    names = docs.columns
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kept = kept_lines(hashed, percent)
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("text_hash"))
    joined = whole.join(kept, _same(), "left").select("row", "text", "firsts")
    counted = "n_chars" in names and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = [], []
            for text, firsts in zip(batch.column("text").to_pylist(), batch.column("firsts").to_pylist()):
                lines = (text or "").split("\n")
                full = [bool(_WORD.search(x)) for x in lines]
                stays = {x["line"] for x in firsts or () if not x["near"]}
                texts.append(None if text is None else "\n".join(x for i, x in enumerate(lines) if not full[i] or i in stays))
                stay.append(bool(stays) or not any(full))
            columns = dict(zip(names, batch.column("row").flatten()))
            columns["text"] = pa.array(texts, pa.string())
            if counted:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names).filter(pa.array(stay, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
