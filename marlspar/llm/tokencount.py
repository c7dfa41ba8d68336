"""Token counts by a deterministic transducer compiled from a BPE vocabulary.

A sequence of tokens is the BPE encoding of its text exactly when each pair of
neighbours is the encoding of its own text. So the last token of a prefix
follows from the last tokens of shorter prefixes, as far back as a token may
still grow. That is a state: the suffixes that begin some longer token, each
with the last token and the relative count before it. Reading a symbol leads to
one next state, and the transition carries the change in the number of tokens
(merging makes it negative). A symbol that ends a word has a value of its own
and leads back to the start. States are compiled when they are first reached,
and kept up to a bound.

The symbols of many texts are one stream, cut into chunks that are read in step
with each other. Reading a chunk is a map from the state before it to the state
after it. A chunk in which a word ends has a constant map. Of a chunk within one
long word the map is tabulated for the states that may stand before it: first
that which the chunk before would lead to from a word's start (nearly always the
right one, as encodings fall into step), then those that the tables lead to and
lack. The maps of all chunks compose through a parallel prefix scan, by doubling,
which gives the state before each chunk; chunks are then read from it in step.

Texts with characters above U+024F are normalised and split by the tokenizer
library itself, so its Unicode tables hold; the rest is split here. Either way
the tokens are counted by the transducer.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings
in a text count as one token each; rows are independent of each other, so
repeated rows and ids and null ids keep their own counts; an empty table gives
an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .runtime import ship
from .texts import pieces

#: Symbols: 256 bytes, the same at a word's end, and one that does nothing.
FINAL, IDLE, SYMBOLS = 256, 512, 513
CHUNK = 256
#: Entries (states by symbols seen) of the table before the transducer is compiled anew.
MOST_ENTRIES = 24_000_000
#: Symbols that are read before the table's size is looked at.
BLOCK = 1 << 18
START = -1

#: The vocabulary's own pre-tokenizer pattern, with white space by its Unicode property, and its special strings.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
BEYOND = re.compile("[^\x00-ɏ]")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Lazily compiled counts of a BPE vocabulary with word-end symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.byte_of = byte_symbols()
        suffix = model["end_of_word_suffix"]
        self.tokens: list[tuple[int, ...]] = []
        ids: dict[tuple[int, ...], int] = {}

        def add(t: tuple[int, ...]) -> int:
            if t not in ids:
                ids[t] = len(self.tokens)
                self.tokens.append(t)
            return ids[t]

        def symbols(text: str) -> tuple[int, ...]:
            ends = text.endswith(suffix)
            t = [self.byte_of[c] for c in (text[: -len(suffix)] if ends else text)]
            return (*t[:-1], t[-1] + FINAL) if ends else tuple(t)

        for s in range(2 * 256):
            add((s,))
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = map(symbols, merge if isinstance(merge, list) else merge.split(" "))
            self.ranks.setdefault((add(left), add(right)), (rank, add(left + right)))
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for i, t in enumerate(self.tokens):
            node = 0
            for s in t:
                nxt = self.children[node].get(s)
                if nxt is None:
                    nxt = self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self, keep: tuple | None = None) -> int:
        """Forget all compiled transitions; the number of the state that is kept."""
        start = ((0, START, 0),)
        self.states = [start, keep] if keep not in (None, start) else [start]
        self.number = {state: i for i, state in enumerate(self.states)}
        # A column for each symbol seen so far; column 0 is that of the idle symbol, and -1 stands for one not seen yet.
        self.column = np.full(SYMBOLS, -1, np.int64)
        self.symbol_of = [IDLE]
        self.column[IDLE] = 0
        self.table = np.full((1024, 64), -1, np.int32)
        self.table[: len(self.states), 0] = np.arange(len(self.states)) * 64 + 32
        return len(self.states) - 1

    def merged(self, parts: list[int]) -> list[int]:
        """The encoding of a symbol sequence: the pair of the lowest rank first, from the left."""
        while len(parts) > 1:
            best = min(((self.ranks.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(parts, parts[1:]))), key=lambda x: (x[0][0], x[1]))
            if best[0][0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [best[0][1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether the two tokens are the encoding of their joint text (START: the token alone)."""
        pair = (before, token)
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            single = [token] if before == START else [before, token]
            known = self.fits[pair] = self.merged([s for t in single for s in self.tokens[t]]) == single
        return known

    def compile(self, state: int, symbol: int) -> None:
        """Fill in one transition."""
        rest, now, last = [], None, None
        for node, before, count in self.states[state]:
            node = self.children[node].get(symbol)
            if node is None:
                continue
            token = self.token_at[node]
            if token >= 0 and now is None and self.follows(before, token):
                now, last = count + 1, token
            if self.children[node]:
                rest.append((node, before, count))
        if symbol >= FINAL:
            nxt = 0
        else:
            key = (*[(n, b, c - now) for n, b, c in rest], (0, last, 0))
            nxt = self.number.get(key)
            if nxt is None:
                nxt = self.number[key] = len(self.states)
                self.states.append(key)
                if nxt >= len(self.table):
                    self.table = np.concatenate([self.table, np.full((len(self.table) // 2, self.table.shape[1]), -1, np.int32)])
                self.table[nxt, 0] = nxt * 64 + 32
        self.table[state, self.column[symbol]] = nxt * 64 + now + 32

    def columns(self, stream: np.ndarray) -> np.ndarray:
        """The table's columns of the symbols; those not seen before get new ones."""
        new = np.flatnonzero(np.bincount(stream, minlength=SYMBOLS) * (self.column < 0))
        for symbol in new.tolist():
            self.column[symbol] = len(self.symbol_of)
            self.symbol_of.append(symbol)
        while len(self.symbol_of) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full((len(self.table), 64), -1, np.int32)], axis=1)
        return self.column[stream]

    def step(self, states: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Transitions of many states at once: next state * 64 + change + 32."""
        width = self.table.shape[1]
        at = states * width + columns
        out = self.table.ravel()[at]
        lacking = out < 0
        if lacking.any():
            for x in np.unique(at[lacking]).tolist():
                self.compile(x // width, self.symbol_of[x % width])
            out = self.table.ravel()[at]
        return out

    def _run(self, grid: np.ndarray, chunks: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The states after the chunks, from states before them."""
        some = np.ascontiguousarray(grid[chunks].T)
        for i in range(CHUNK):
            states = self.step(states, some[i]) >> 6
        return states

    def _scan(self, grid: np.ndarray, open_: np.ndarray, exits: np.ndarray, before: np.ndarray) -> None:
        """Set the states before open chunks (those without a word's end) and the chunks behind them.

        exits: the states after all other chunks. A table row is a chunk, a state before it and the state after it.
        """
        chunks = np.flatnonzero(open_)
        first = ~open_[chunks - 1]
        guess = np.zeros(len(open_), np.int64)
        guess[chunks] = self._run(grid, chunks, np.zeros(len(chunks), np.int64))
        new = (chunks << 32) | np.where(first, exits[chunks - 1], guess[chunks - 1])
        starts = new[first]
        keys, after = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for round_ in range(len(chunks) + 1):
            results = self._run(grid, new >> 32, new & 0xFFFFFFFF)
            order = np.argsort(np.r_[keys, new])
            keys, after = np.r_[keys, new][order], np.r_[after, results][order]
            inside = open_[np.minimum((keys >> 32) + 1, len(open_) - 1)] & ((keys >> 32) + 1 < len(open_))
            wanted = (((keys >> 32) + 1) << 32) | after
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there = inside & (keys[place] == wanted)
            # Doubling: after k steps all rows are reached that lie within 2 ** k chunks behind a word's first open chunk.
            jump, reached = np.where(there, place, -1), np.isin(keys, starts)
            for _ in range(len(chunks).bit_length()):
                ahead = jump[reached]
                reached[ahead[ahead >= 0]] = True
                jump = np.where(jump >= 0, jump[jump], -1)
            lacking = inside & ~there
            # Tables are filled for all states at first, then only along the words' own paths, so that the work stays in proportion.
            new = np.unique(wanted[lacking] if round_ < 3 else wanted[lacking & reached])
            if not (lacking & reached).any():
                break
        at = keys[reached] >> 32
        before[at] = keys[reached] & 0xFFFFFFFF
        behind = at + 1 < len(open_)
        before[at[behind] + 1] = after[reached][behind]

    def changes(self, stream: np.ndarray) -> np.ndarray:
        """The change in the number of tokens at each symbol of a stream that begins and ends with whole words.

        A block of symbols adds few entries to the table, and between blocks, also
        within a word, it is compiled anew if it is too large.
        """
        out, state = [np.zeros(0, np.int64)], 0
        for begin in range(0, len(stream), BLOCK):
            if self.table.size > MOST_ENTRIES:
                state = self.clear(self.states[state])
            some, state = self._block(stream[begin : begin + BLOCK], state)
            out.append(some)
        return np.concatenate(out)

    def _block(self, stream: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """The changes in a part of a stream that is entered in a state, and the state in which it is left."""
        n = len(stream)
        lanes = -(-n // CHUNK)
        grid, ends = np.zeros(lanes * CHUNK, np.int64), np.zeros(lanes * CHUNK, bool)
        grid[:n], ends[:n] = self.columns(stream), stream >= FINAL
        grid, ends = grid.reshape(lanes, CHUNK), ends.reshape(lanes, CHUNK)
        known = ends.any(axis=1)
        head = np.where(known, ends.argmax(axis=1) + 1, CHUNK)
        head[0], known[0] = 0, True
        body = np.ascontiguousarray(np.where(np.arange(CHUNK) < head[:, None], 0, grid).T)
        out = np.zeros((CHUNK, lanes), np.int64)
        states = np.zeros(lanes, np.int64)
        states[0] = entry
        for i in range(CHUNK):
            to = self.step(states, body[i])
            out[i] = (to & 63) - 32
            states = to >> 6
        before, left = np.r_[entry, states[:-1]], int(states[-1])
        if not known.all():
            self._scan(grid, ~known, states, before)
        late = np.flatnonzero(head > 0)
        states = before[late]
        for i in range(int(head.max())):
            to = self.step(states, np.where(i < head[late], grid[late, i], 0))
            out[i, late] += (to & 63) - 32
            states = to >> 6
        return out.T.ravel()[:n], left if known[-1] else int(states[-1])


def _counter(path: str):
    from tokenizers import Tokenizer

    machine, library = Transducer(path), Tokenizer.from_file(path)

    def words_of(text: str) -> bytes:
        """The words of a text, as bytes, each but the last followed by a newline."""
        if text.isascii() or not BEYOND.search(text):
            return "\n".join(WORD.findall(text.lower())).encode()
        split = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        return b"\n".join(bytes(machine.byte_of[c] for c in word) for word, _ in split)

    def count(texts: list[str | None]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        data, lengths, rows = [], [], []
        for row, text in enumerate(texts):
            if not text:
                continue
            segments = [text]
            if "<|" in text:
                segments = SPECIAL.split(text)
                totals[row] += len(segments) - 1
            for segment in segments:
                if words := words_of(segment):
                    data.append(words)
                    lengths.append(len(words) + 1)
                    rows.append(row)
        if rows:
            buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
            breaks = buf == 10
            letters = np.flatnonzero(~breaks)
            stream = buf[letters].astype(np.int64) + FINAL * breaks[letters + 1]
            sums = np.zeros(len(stream) + 1, np.int64)
            np.cumsum(machine.changes(stream), out=sums[1:])
            limits = np.searchsorted(letters, np.r_[0, np.cumsum(lengths)])
            np.add.at(totals, rows, np.diff(sums[limits]))
        return totals

    return count


_counters: dict = {}


def counter(path: str):
    """A function from texts to their numbers of tokens; one a process, so its states stay."""
    if path not in _counters:
        _counters[path] = _counter(path)
    return _counters[path]


def _rows(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text").to_pylist()
                tokens = count(texts)
                sizes = pc.fill_null(pc.binary_length(part.column("text")).cast(pa.int64()), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    path: a byte-level BPE vocabulary with word ends, at the same place on every machine.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_rows(path, limit), f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
