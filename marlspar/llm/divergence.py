"""Source divergence audit: how far the words of each source of a language are from its other sources'.

Texts become terms (runs of ASCII letters and of characters beyond ASCII; only
A-Z are lower-cased). A language keeps the terms that LEAST of its documents
hold. Tasks count terms and their documents by group (language and source) and
merge the counts before they are shuffled. Counts are range-partitioned by
(language, term) in UTF-8 order, so a chunk of CHUNK kept terms is a sorted
array: searchsorted gives the ids, one bincount the dense counts of all groups
of the language, and ids stand in the order of the terms, so the least id wins a
tie. Chunks add up: sums over pairs of sources, the best terms of each group.
No dictionary goes through the driver or to every task; a chunk meets the totals
of its language's groups by a join.

A group's p of a term is 1 + floor(SCALE * (count + 2) / (total + 2 * kept)), all
in whole numbers; a pair of p and q counts floor((p - q) ** 2 / (p + q)).

Defined cases: a null text, lang or source is read as ''; a group whose texts
have no kept term has counts of 0, and a language without kept terms a value of
0 for each pair; a language with one source has no pairs; rows with equal ids
are separate documents; an empty table gives an empty result. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import ship, stored
from .texts import BYTE, byte_hash, gathered, mix, pieces, powers, split_words

#: Documents of its language that hold a kept term, at least.
LEAST = 10
#: Terms of each group that are reported.
TOP = 10
SCALE = 1_000_000_000

#: Kept terms of a chunk; cells of a dense matrix; rows of counts that a task merges at once.
CHUNK, CELLS, MERGED = 1024, 1 << 20, 400_000

#: Bytes that are no part of a term: ASCII other than letters.
BETWEEN = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
_OTHER_BASE, _OTHER_BYTE = np.uint64(0xC2B2AE3D27D4EB4F), mix(BYTE ^ np.uint64(0xA5A5A5A5A5A5A5A5))
_KEYS = ["lang", "source", "term"]


def _counts_of(part: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences), d (documents) of some documents."""
    words = split_words(part.column("text"), lower=True, between=BETWEEN)
    row = np.repeat(np.arange(part.num_rows), np.diff(words.first))
    hashes = words.hashes()
    up, down = powers(_OTHER_BASE, len(words.buf) + 1)
    sums = np.zeros(len(words.buf) + 1, np.uint64)
    np.cumsum(_OTHER_BYTE[words.buf] * up[: len(words.buf)], out=sums[1:])
    other = byte_hash((sums, down), words.starts, words.ends)
    order = np.lexsort((row, other, hashes))
    same_term = np.r_[False, (hashes[order][1:] == hashes[order][:-1]) & (other[order][1:] == other[order][:-1])][: len(order)]
    term = np.cumsum(~same_term) - 1  # of the occurrences in order
    at = order[~same_term]  # an occurrence of each term
    new_doc = ~(same_term & np.r_[False, row[order][1:] == row[order][:-1]][: len(order)])
    groups = part.select(["lang", "source"]).to_struct_array() if part.num_rows else None
    names, group = np.unique([repr(g) for g in groups.to_pylist()], return_inverse=True) if groups is not None else ([], np.zeros(0, np.int64))
    first_row = {int(g): i for i, g in reversed(list(enumerate(group.tolist())))}
    key = term * max(1, len(names)) + group[row[order]]
    keys, index = np.unique(key, return_inverse=True)
    n = np.bincount(index, minlength=len(keys))
    d = np.bincount(index, weights=new_doc, minlength=len(keys)).astype(np.int64)
    offsets = np.r_[0, np.cumsum(words.ends[at] - words.starts[at])]
    data = words.buf.tobytes()
    texts = b"".join([data[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())])
    terms = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(texts)])
    rows = pa.array([first_row[g] for g in (keys % max(1, len(names))).tolist()], pa.int64())
    return pa.table([part.column("lang").take(rows), part.column("source").take(rows), terms.take(pa.array(keys // max(1, len(names)))).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d)], names=[*_KEYS, "n", "d"])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents, merged as far as they fit."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by(_KEYS).aggregate([("n", "sum"), ("d", "sum")]).rename_columns([*_KEYS, "n", "d"])

    for batch in batches:
        for part in pieces(batch, most=1 << 20):
            held.append(_counts_of(part))
            if sum(t.num_rows for t in held) > MERGED:
                held = [merged()]
                if held[0].num_rows > MERGED // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held = []
    if held:
        yield from merged().combine_chunks().to_batches()


def _kept_rows(least: int, chunk: int):
    """Of counts in order of language and term: those of kept terms, with the number of their chunk and whether they are the first of their term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled, lang = TaskContext.get().partitionId() << 32, 0, None
        waiting: pa.Table | None = None

        def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number, filled, lang
            langs, terms = rows.column("lang").combine_chunks(), rows.column("term").combine_chunks()
            new = np.r_[True, _changes(langs) | _changes(terms)]
            which = np.cumsum(new) - 1
            stays = np.bincount(which, weights=rows.column("d").to_numpy()) >= least
            begins = np.flatnonzero(new)[stays]
            if not len(begins):
                return
            chunks = np.empty(len(begins), np.int64)
            of_lang = langs.take(pa.array(begins))
            edges = np.r_[0, np.flatnonzero(_changes(of_lang)) + 1, len(begins)]
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                name = of_lang[begin].as_py()
                if name != lang:  # a chunk holds one language
                    number, filled, lang = number + 1, 0, name
                place = filled + np.arange(end - begin)
                chunks[begin:end] = number + place // chunk
                number, filled = number + (filled + end - begin) // chunk, (filled + end - begin) % chunk
            at = np.full(len(stays), -1, np.int64)
            at[stays] = chunks
            mine = stays[which]
            out = rows.select([*_KEYS, "n"]).append_column("chunk", pa.array(at[which])).append_column("leads", pa.array(new.astype(np.int64)))
            yield from out.filter(pa.array(mine)).combine_chunks().to_batches()

        for table in gathered(batches, 1 << 16):
            if waiting is not None:
                table = pa.concat_tables([waiting, table]).combine_chunks()
            cuts = np.flatnonzero(_changes(table.column("lang").combine_chunks()) | _changes(table.column("term").combine_chunks())) + 1
            last = int(cuts[-1]) if len(cuts) else 0  # the last term may go on
            if last:
                yield from kept(table.slice(0, last).combine_chunks())
            waiting = table.slice(last)
        if waiting is not None:
            yield from kept(waiting.combine_chunks())

    return run


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False).astype(bool)


def scaled(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / totals), exact for totals below 2**53: three digits after the other, so no product overflows."""
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64), counts
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + whole
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _chunk_values(top: int):
    def run(counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("source", key=lambda s: s.map(str.encode), ignore_index=True)
        lang, sources = groups["lang"][0], np.array([s.encode() for s in groups["source"]], object)
        totals = groups["total"].to_numpy(np.int64)[:, None]
        terms_kept, lang_total = int(groups["kept"][0]), int(groups["lang_total"][0])
        encoded = np.array([t.encode() for t in counts["term"]], object)
        kept = np.unique(encoded)  # sorted by UTF-8
        ids = np.searchsorted(kept, encoded) if len(kept) else np.zeros(0, np.int64)
        group = np.searchsorted(sources, np.array([s.encode() for s in counts["source"]], object)) if len(kept) else ids
        n = counts["n"].to_numpy(np.int64)
        width = max(1, CELLS // len(sources))
        sums = np.zeros((len(sources), len(sources)), np.int64)
        best: list[tuple[np.ndarray, ...]] = []
        for begin in range(0, len(kept), width):
            size = min(width, len(kept) - begin)
            some = (ids >= begin) & (ids < begin + size)
            dense = np.bincount(group[some] * size + ids[some] - begin, weights=n[some], minlength=len(sources) * size).astype(np.int64).reshape(-1, size)
            p = scaled(dense + 2, totals + 2 * terms_kept)
            q = scaled(dense.sum(axis=0) + 2, np.int64(lang_total + 2 * terms_kept)[None])
            for i in range(len(sources) - 1):
                sums[i, i + 1 :] += divergence(p[i], p[i + 1 :]).sum(axis=1)
            value = np.where((dense > 0) & (p > q), divergence(p, q), -1)
            nearest = np.argsort(-value, axis=1, kind="stable")[:, :top]  # the least id of equal values
            i = np.repeat(np.arange(len(sources)), nearest.shape[1])
            found = value[i, nearest.ravel()]
            told = found >= 0
            best.append((i[told], nearest.ravel()[told] + begin, found[told]))
        sums += sums.T
        one, two = np.nonzero(~np.eye(len(sources), dtype=bool))
        names = groups["source"].to_numpy(object)
        out = [pd.DataFrame({"lang": lang, "source": names[one], "part": "pair", "item": names[two], "value": sums[one, two]})]
        for i, term, value in best:
            out.append(pd.DataFrame({"lang": lang, "source": names[i], "part": "term", "item": [kept[t].decode() for t in term.tolist()], "value": value}))
        return pd.concat([x for x in out if len(x)] or out[:1])

    return run


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each source from every other of its language (part pair), and the ``top`` terms that it has more of than its language (part term).

    docs: text, lang, source. least: documents of a language that hold a kept term.
    """
    ship(docs.sparkSession)
    blank = F.lit("")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("text", "lang", "source")])
    counts = docs.mapInArrow(_count_rows, "lang string, source string, term string, n long, d long")
    counts = stored(counts.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "counts")
    ordered = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = stored(ordered.mapInArrow(_kept_rows(least, CHUNK), "lang string, source string, term string, n long, chunk long, leads long"), "kept")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("leads").alias("kept"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = stored(groups.select("lang", "source", "total", "lang_total", "kept"), "groups")
    chunks = kept.select("lang", "chunk").distinct()
    # A language without kept terms still has its pairs.
    met = groups.join(chunks, "lang", "left").select("lang", F.coalesce("chunk", F.lit(-1)).alias("chunk"), "source", "total", "lang_total", "kept")
    values = kept.select("lang", "chunk", "source", "term", "n").groupBy("lang", "chunk").cogroup(met.groupBy("lang", "chunk"))
    values = stored(values.applyInPandas(_chunk_values(top), "lang string, source string, part string, item string, value long"), "values")
    values = values.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term has one chunk
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")).alias("rank")
    return values.select("lang", "source", "part", "item", "value", rank).filter(F.col("part").eqNullSafe("pair") | (F.col("rank") <= top))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
terms AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (
  SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
scaled AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM dense JOIN sizes USING (lang)),
pairs AS (
  SELECT lang, a.source, b.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)), 0) AS value
  FROM scaled a JOIN scaled b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM scaled WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
