"""Words and word hashes of whole Arrow batches, without a Python loop over words.

A word is a run of bytes other than space and 0x09-0x0D of a text's UTF-8.
Hashes are 64-bit: a polynomial over random byte values, then a finalizer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space, other control characters and ASCII punctuation.
BETWEEN = np.array([b <= 0x20 or b == 0x7F or (b < 0x7F and not chr(b).isalnum()) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    up, down = _powers.get(int(base), (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(up) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(int(base), -1, 1 << 64)
        up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(inverse), np.uint64)])
        _powers[int(base)] = up, down
    return up[:n], down[:n]


class Words(NamedTuple):
    buf: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of the texts in buf
    starts: np.ndarray  # of the words in buf
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words

    def byte_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums from which ``byte_hash`` takes the hash of any run of bytes."""
        n = len(self.buf)
        up, down = powers(_BASE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[self.buf] * up[:n], out=sums[1:])
        return sums, down

    def hashes(self, sums: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        return mix(byte_hash(sums or self.byte_sums(), self.starts, self.ends))


def byte_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes, before the finalizer."""
    total, down = sums
    return (total[end] - total[start]) * down[start]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and the texts' offsets in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False, between: np.ndarray = SPACE) -> Words:
    buf, offsets = text_bytes(texts)
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    inside = ~between[buf]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def sequence_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which ``sequence_hash`` takes the hash of any run of words."""
    n = len(hashes)
    up, down = powers(_WORD_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return sums, down


def sequence_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word runs [start, end), equal for equal runs wherever they stand."""
    total, down = sums
    length = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * down[start] + length * np.uint64(0xA0761D6478BD642F))


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = batch.column(column).cast(pa.large_string())
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1])
    total, begin = 0, 0
    for i, size in enumerate(lengths.tolist()):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            total, begin = 0, i
        total += size
    yield batch.slice(begin)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at least ``most`` rows, but for the last; none is empty."""
    rest: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        rest.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(rest).combine_chunks()
            rest, rows = [], 0
    if rows:
        yield pa.Table.from_batches(rest).combine_chunks()


def runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of equal whole-number columns in rows that are sorted by them."""
    rest: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            key = tuple(x[begin] for x in ids)
            if rest and key != last:
                yield pa.Table.from_batches(rest).combine_chunks()
                rest = []
            rest.append(batch.slice(begin, end - begin))
            last = key
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def whole_runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], most: int, most_bytes: int) -> Iterator[pa.Table]:
    """Rows that are sorted by whole-number columns, in tables of whole runs of these with about ``most`` rows or ``most_bytes``; a longer run stands alone."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        if sum(b.num_rows for b in rest) < most and sum(b.nbytes for b in rest) < most_bytes:
            continue
        table = pa.Table.from_batches(rest).combine_chunks()
        ids = [table.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
        if len(cuts):
            yield table.slice(0, int(cuts[-1])).combine_chunks()
            rest = table.slice(int(cuts[-1])).to_batches()
    if sum(b.num_rows for b in rest):
        yield pa.Table.from_batches(rest).combine_chunks()
