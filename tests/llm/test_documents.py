"""Operators on documents: small tables with every awkward case, against plain Python."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlspar.llm import decontaminate, langid, linededup, minhash, mixing, quality, substrings, tokencount

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_mixing(edge_docs, edge_rows, no_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    sizes = {s: sum(len(words(t)) for _, t, _, x in edge_rows if x == s) for s in {r[3] for r in edge_rows}}
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:  # reshare until no source is above three times its size
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    by_text = {(r[0], r[1]): r[3] for r in edge_rows}
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    source = {(d, md5(t)): s for (d, t), s in by_text.items()}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id, r.text_md5]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.size == 0 or r.taken // r.size >= math.floor(r.target / r.source_size + 1e-9)  # complete epochs come first
        taken[s] += r.taken
    largest = {s: max([len(words(t)) for _, t, _, x in edge_rows if x == s]) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(edge_docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert mixing.mix(no_docs).count() == 0
    mixed = mixing.mixed(edge_docs)
    assert [c for c in mixed.columns if mixed.columns.count(c) > 1] == []
    assert mixed.filter("taken <= 0 OR copies * size != taken").count() == 0
    upper = mixing.mixed(edge_docs.withColumnsRenamed({"size": "Size", "taken": "TAKEN"}))
    assert len({c.lower() for c in upper.columns}) == len(upper.columns) and upper.count() == mixed.count()


def test_mixing_prefers_heavier_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w x y z "), "id").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    weights = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    got = mixing.mix(docs, weights).filter("taken > 0 AND doc_id < 2000").groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    counts = {r.odd: r["count"] for r in got}
    assert counts[0] > 1.3 * counts[1]


def test_quality(edge_docs, edge_rows, no_docs):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.judged(edge_docs).collect()}
    for doc_id, text, _, _ in edge_rows:
        w, text = words(text), text or ""
        triples = Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[doc_id, len(w), sum(map(len, w))]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.judged(no_docs).count() == 0


def test_quality_guards(spark):
    """On either side of each guard: histograms too short are not compared, longer ones decide."""
    import random

    rng = random.Random(2)
    usual = lambda n: " ".join(rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.4 else "".join(rng.choice("etaoinsr") for _ in range(6)) for _ in range(n))
    clean = [usual(200) for _ in range(40)]
    rare = lambda n: " ".join("".join(rng.choice("etaoinsr") for _ in range(6)) for _ in range(n))  # noqa: E731  no common words
    signs = lambda n: " ".join(rng.choice("#%$|>") * 3 + str(rng.randrange(10)) for _ in range(n))
    judged = [rare(79), rare(80), signs(74), signs(76)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*clean, *judged])], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    few, many, short, full = (got[40 + i] for i in range(4))
    assert not any(r.base_failed for r in (few, many, short, full)) and all(got[i].kept for i in range(40))
    assert few.n_words < quality.COMPARED_WORDS <= many.n_words and few.word_distance > 0.32 and many.word_distance > 0.32
    assert few.kept and not many.kept
    assert short.word_chars < quality.COMPARED_CHARS <= full.word_chars and short.char_distance > 0.32 and full.char_distance > 0.32
    assert short.kept and not full.kept


def test_quality_finds_text_unlike_its_language(spark):
    import random

    rng = random.Random(1)
    clean = [" ".join(rng.choice("the of and in that renders notion beta gamma delta words here".split()) + str(i) * (j % 9 == 0) for j in range(150)) for i in range(30)]
    junk = " ".join(rng.choice(["zz###", "%%%q", "$$$$", "|||", "17", "999"]) + str(rng.randrange(10**6)) for _ in range(150))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*clean, junk])], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert got[30].char_distance > max(got[i].char_distance for i in range(30)) and not got[30].kept
    p, q = [3.0, 1.0, 0.0], [1.0, 1.0, 2.0]
    d = spark.range(1).select(quality.distance(F.array(*map(F.lit, p)), F.lit(sum(p)), F.array(*map(F.lit, q)), F.lit(sum(q)))).first()[0]
    from itertools import starmap

    x, y = [v / sum(p) for v in p], [v / sum(q) for v in q]
    h = lambda z: -sum(v * math.log2(v) for v in z if v)
    assert math.isclose(d, math.sqrt(h(list(starmap(lambda a, b: (a + b) / 2, zip(x, y)))) - (h(x) + h(y)) / 2), rel_tol=1e-9)


def brute_lines(rows, percent):
    """Kept text by (doc_id, text), comparing every pair of lines."""

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    place = {}
    for doc_id, h, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                at = (doc_id is None, doc_id or 0, h, n)
                place[line] = min(place.get(line, at), at)
    by_size, near = {}, set()
    for line in sorted(place, key=place.get):
        w = words(line)
        count = Counter(w)
        for n in range(min(len(w) - 1, math.ceil(len(w) * (100 - percent) / 100)), max(len(w) + 1, len(w) * 100 // (100 - percent)) + 1):
            most = max(max(n, len(w)) * percent // 100, int(max(n, len(w)) >= 4))
            # An edit takes away one word and adds one at most.
            if abs(n - len(w)) <= most and any(sum((count - c).values()) <= most and distance(w, x) <= most for x, c in by_size.get(n, ())):
                near.add(line)
                break
        by_size.setdefault(len(w), []).append((w, count))
    out = {}
    for doc_id, h, text in rows:
        kept = []
        for n, line in enumerate((text or "").split("\n")):
            if not WORD.search(line) or place[line] == (doc_id is None, doc_id or 0, h, n) and line not in near:
                kept.append(line)
        out[doc_id, h] = None if text is None else "\n".join(kept)
    return out


def with_edits(rng, base, edits):
    """A copy with that many words inserted, deleted or replaced, near each other or anywhere."""
    x, at = list(base), rng.randrange(len(base))
    for _ in range(edits):
        i = min(len(x) - 1, at if rng.random() < 0.5 else rng.randrange(len(x)))
        x[i : i + 1] = rng.choice([[], [f"new{rng.randrange(999)}"], [x[i], "more"]])
        x = x or ["left"]
    return x


@pytest.mark.parametrize("percent", [8, 3, 10])
def test_line_dedup(spark, edge_docs, no_docs, percent, monkeypatch):
    """Lines of all lengths around the bounds of the edits, with copies on both sides; blocks give the same result."""
    import random

    rng = random.Random(percent)
    lines = ["A  b c", "A b  c", "A b c d", "1 \t2", "1 2", "x", "x "]
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20, 24, 25, 26, 30, 37, 38, 39, 50, 75, 76, 99, 100, 130, 420):
        base = [f"w{rng.randrange(9 if n == 50 else 400)}" for _ in range(n)]
        most = max(n * percent // 100, int(n >= 4))
        lines += [" ".join(with_edits(rng, base, k)) for k in (0, 1, most, most, most + 1, 2 * most, 2 * most + 2) for _ in range(2)]
    rng.shuffle(lines)
    extra = [(100 + i, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 3)]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    expected = brute_lines(rows, percent)
    assert {(r.doc_id, r.text_hash): r.kept_text for r in linededup.without_repeated_lines(docs, percent).collect()} == expected
    assert linededup.without_repeated_lines(no_docs).count() == 0
    assert linededup.rewritten(no_docs).count() == 0
    if percent == 8:
        monkeypatch.setattr(linededup, "BLOCK", 3)
        monkeypatch.setattr(linededup, "ROWS", 10)
        assert {(r.doc_id, r.text_hash): r.kept_text for r in linededup.without_repeated_lines(docs, percent).collect()} == expected


@pytest.mark.parametrize("n", range(4, 13))
def test_one_changed_word_in_a_short_line(spark, n):
    """A word replaced, inserted or deleted at each place."""
    base = [f"w{i}" for i in range(n)]
    near = [[*base[:i], *new, *base[i + 1 :]] for i in range(n) for new in (["x"], [], ["x", base[i]])]
    docs = spark.createDataFrame([(0, " ".join(base))] + [(i + 1, " ".join(w)) for i, w in enumerate(near)] + [(999, " ".join(base[::-1]))], "doc_id long, text string")
    kept = {r.doc_id for r in linededup.without_repeated_lines(docs).collect() if r.kept_text}
    assert kept == {0, 999}


def test_classes_of_lengths():
    import numpy as np

    for percent in range(1, 11):
        n = np.arange(1, 5000)
        level = linededup.levels(n, percent)
        shortest = np.maximum(1, n - linededup.allowed(n, percent))
        assert (level - linededup.levels(shortest, percent) <= 1).all() and (np.diff(level) >= 0).all()
        assert (linededup.level_bounds(percent)[level + 1] > n).all()


@pytest.mark.parametrize("copies", [60, 300])
def test_line_dedup_rows_follow_the_lines(spark, monkeypatch, copies):
    """Of a group of near lines each has a bounded number of rows, whatever the group's size."""
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(with_edits(rng, base, 4))) for i in range(copies)], "doc_id long, text string")
    made, stored = {}, linededup.stored

    def counted(df, name):
        made[name] = (out := stored(df, name)).count()
        return out

    monkeypatch.setattr(linededup, "stored", counted)
    out = linededup.without_repeated_lines(docs).collect()
    assert {(r.doc_id, r.kept_text) for r in out} == {(d, t) for (d, _), t in brute_lines([(r.doc_id, r.text_hash, t) for r, t in zip(docs.select("doc_id", F.xxhash64("text").alias("text_hash")).collect(), [x.text for x in docs.collect()])], 8).items()}
    assert made["groups"] <= 12 * copies


def test_bands(spark):
    """The banded distance against the plain one."""
    import random

    import numpy as np

    rng = random.Random(7)

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for most in (0, 1, 2, 4, 9, 31, 40):
        left, right = [], []
        for _ in range(40):
            left.append([rng.randrange(6) for _ in range(rng.randrange(1, 80))])
            right.append([x if isinstance(x, int) else len(x) for x in with_edits(rng, left[-1], rng.randrange(most + 3))])
        edits = np.array([rng.randrange(most + 1) for _ in left])
        got = linededup.within([np.array(x, np.int32) for x in left], [np.array(x, np.int32) for x in right], edits)
        assert got.tolist() == [distance(x, y) <= k for x, y, k in zip(left, right, edits)]


def test_rewritten_keeps_columns(edge_docs):
    out = linededup.rewritten(edge_docs)
    assert out.schema == edge_docs.schema
    assert out.filter("n_chars != length(text)").count() == 0
    assert out.filter("doc_id IN (6, 7, 8)").count() == 3  # nothing to lose
    assert out.filter("doc_id = 2").count() == 0  # its only line stands in an earlier document


def brute_near(rows, k, percent):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {g: min([d for d in ids if d is not None], default=None) for g, ids in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(edge_docs, edge_rows, no_docs, k):
    got = minhash.near_duplicates(edge_docs, k, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near([r[:2] for r in edge_rows], k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(no_docs).count() == 0
    first = minhash.first_of_each(edge_docs, k, 80)
    assert first.schema == edge_docs.schema
    assert first.filter("doc_id = 2").count() == 0 and first.filter("doc_id = 1").count() == 1


def test_near_duplicates_over_chains_and_blocks(spark, monkeypatch):
    """Copies with a few words changed each, so that links lead on from one to the next."""
    import random

    rng = random.Random(2)
    text, rows = [f"w{rng.randrange(5000)}" for _ in range(120)], []
    for i in range(80):
        text = list(text)
        for _ in range(3):
            text[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i if i % 2 else 1000 - i, " ".join(text)))
    rows += [(3000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(90))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_near(rows, 2, 80)
    for block in (4096, 4):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(docs, 2, 80).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


@pytest.mark.parametrize("copies", [150, 300])
def test_near_duplicate_rows_follow_the_nodes(spark, monkeypatch, copies):
    """Of a group of near copies whose links are few, what is stored between components has a row a node at most."""
    import random

    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(copies):
        x = list(base)
        for _ in range(7):
            x[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(x)))
    made, stored = {}, minhash.stored

    def counted(df, name):
        made[name] = (out := stored(df, name)).count()
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows, 2, 80)
    assert made["mixed"] <= copies and made["open"] <= copies


def test_first_of_each_takes_one(spark):
    """Near copies with one id, rows without ids, and repeated rows that differ elsewhere."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "end"])
    rows = [(5, " ".join(base), "a"), (5, near, "b"), (None, " ".join(reversed(base)), "c"), (None, " ".join(reversed(base)) + " more", "d"), (7, "solo text of a few words", "e"), (7, "solo text of a few words", "f"), (8, "", "g"), (None, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [tuple(r) for r in minhash.first_of_each(docs, 5, 80).collect()]
    assert len(out) == 5 and len({r[0] for r in out if r[0]}) == 3
    assert sorted(map(str, out)) == sorted(str(tuple(r)) for r in minhash.first_of_each(docs.repartition(7), 5, 80).collect())


def brute_repeats(rows, length):
    texts = [(text or "").encode().split() for _, text in rows]
    counts = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = Counter()
    for (doc_id, _), w in zip(rows, texts):
        gone = {i + j for i in range(len(w) - length + 1) if counts[tuple(w[i : i + length])] > 1 for j in range(length)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc_id, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length, seed", [(35, 8), (5, 2), (3, 3), (12, 8)])
def test_repeated_passages(edge_docs, edge_rows, no_docs, length, seed):
    got = substrings.without_repeats(edge_docs, length, seed).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats([r[:2] for r in edge_rows], length)
    assert substrings.without_repeats(no_docs).count() == 0


def test_anchors_of_long_texts(monkeypatch):
    """Stretches of windows give the anchors that one pass gives, ties included."""
    import numpy as np

    rng = np.random.default_rng(2)
    for top in (2**63, 4):
        grams = rng.integers(0, top, 5000, dtype=np.uint64) << np.uint64(0 if top > 4 else 60)
        for spread in (1, 2, 28, 63):
            whole = substrings.anchors(grams, spread)
            high = grams >> np.uint64(24)
            assert all(x == max(range(i, i + spread), key=lambda j: (-int(high[j]), j)) for i, x in enumerate(whole.tolist()[:500]))
            monkeypatch.setattr(substrings, "STRETCH", 64)
            assert (substrings.anchors(grams, spread) == whole).all()
            monkeypatch.setattr(substrings, "STRETCH", 1 << 22)


def test_token_counts(edge_docs, edge_rows, no_docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [t for _, t, _, _ in edge_rows]
    texts += ["İΣσς don't we'll 's ''s", "<|endoftext|>a<|startoftext|>", "中文 한글 🙂🇩🇪 é ﬁ ǅ", "a" * 3000, "½²٣ x\x1cy\x85z", "the" * 900, "internationalization's"]
    expected = [(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts]
    docs = edge_docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(docs, path, 100).collect()}
    assert got == {i: (b, n, n > 100) for i, (b, n) in enumerate(expected)}
    assert tokencount.token_counts(edge_docs, path).count() == len(edge_rows)
    assert tokencount.token_counts(no_docs, path).count() == 0


def test_long_words():
    """Words over many chunks, whose maps compose, against the library."""
    import random

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, rng = public.path("word_bpe_49k.json"), random.Random(4)
    count, library = tokencount._counter(path), Tokenizer.from_file(path)
    made = lambda n, parts: "".join(rng.choice(parts) for _ in range(n))
    texts = [made(20_000, "abcdefghijklmnop"), made(10**6, "ab"), "a" * 100_003, "x" + "aaaab" * 9000, made(60_000, ["the", "ing", "er", "at"])]
    texts += [" ".join([made(300, "abc"), made(5000, "xyz"), "a" * 700, "the", made(513, "e"), made(2000, "ethr")]), "a" * 255, "a" * 256, "a" * 257 + " b", "7" * 2000]
    assert count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_transducer_after_clearing(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    monkeypatch.setattr(tokencount, "MOST_ENTRIES", 100)
    count, library = tokencount._counter(path), Tokenizer.from_file(path)
    for texts in (["one two three", "x" * 700], ["four, five; six! Größe"]):
        assert count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("block", [256, 700, 5000])
def test_table_is_bounded_within_a_word(monkeypatch, block):
    """The table is compiled anew between blocks, also within long words; it never holds more than a block has added."""
    import random

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, rng = public.path("word_bpe_49k.json"), random.Random(block)
    monkeypatch.setattr(tokencount, "MOST_ENTRIES", 70_000)
    monkeypatch.setattr(tokencount, "BLOCK", block)
    machine, most = tokencount.Transducer(path), []
    step = machine._block
    monkeypatch.setattr(tokencount, "Transducer", lambda _: machine)
    monkeypatch.setattr(machine, "_block", lambda *a: most.append(machine.table.size) or step(*a))
    count, library = tokencount._counter(path), Tokenizer.from_file(path)
    made = lambda n, parts: "".join(rng.choice(parts) for _ in range(n))
    texts = [made(20_000, "abcdefghijklmnop"), "one two " + made(3000, ["the", "ing", "er"]) + " three", "a" * 2999, made(1500, "ab 7")]
    assert count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert max(most) <= 70_000 * 1.5


def test_language_id(spark, sf_dir, edge_docs, edge_rows, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identified(docs).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows} <= set(lang.values()) | {"und"}
    got = langid.identified(edge_docs).collect()
    assert len(got) == len(edge_rows)
    assert all((r.lang_pred == "und") == (r.doc_id in (6, 7, 8, 10)) for r in got if r.doc_id is not None)
    assert langid.identified(no_docs).count() == 0
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identified(unlabelled).collect()} == {"und"}
    kept = langid.accepted(docs)
    assert kept.schema == docs.schema and kept.count() >= 0.99 * docs.count()


def test_language_id_learns_every_language(spark):
    """Of 80 languages of unequal sizes none is left out, nor is one of many documents."""
    rows = []
    for i in range(80):
        letters = [chr(0x4E00 + 40 * i + j) for j in range(6)]
        for n in range(12 if i < 70 else 6):
            rows.append((len(rows), " ".join("".join(letters[(n + j + k) % 6] for k in range(3)) for j in range(30)), f"l{i:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identified(docs).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.97 * len(rows)
    assert set(got.values()) == {lang for _, _, lang in rows}
    for count in (10**9, 10**13):
        assert 25 <= (langid.most_rank(25, count) + 2**63) / 2**64 * count <= 200


def test_language_id_against_plain_decoding(spark, edge_docs):
    """Every prediction against n-grams, margins and losses computed one by one."""
    import numpy as np

    model = langid.train(edge_docs.select("doc_id", "text", "lang"))
    rows = {(r.doc_id, r.text): r for r in edge_docs.collect()}
    got = {(r.doc_id, r.text_hash): r for r in langid.identified(edge_docs).collect()}
    hashes = {(r.doc_id, r.text): r.h for r in edge_docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    for key, row in rows.items():
        r = got[row.doc_id, hashes[key]]
        if not re.search(r"[^\W\d_]", row.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in row.text.encode())
        x = [0.0] * langid.BUCKETS
        for size in langid.GRAMS:
            for i in range(len(data) - size + 1):
                code = 0
                for c in data[i : i + size]:
                    code = (code * 257 + c) % 2**32
                x[(code + size * 0x1000193) % 2**32 * 0x9E3779B1 % 2**32 >> 20] += 1
        x = [math.sqrt(v / sum(x)) for v in x]
        margins = [sum(v * w for v, w in zip(x, column)) + o for column, o in zip(model.weights.T.tolist(), model.offsets.tolist())]
        losses = [sum(t * math.log1p(math.exp(-c * m)) for c, m, t in zip(word, margins, model.trust.tolist())) for word in model.code.tolist()]
        shares = [math.exp(-v * min(len(margins), 8)) for v in losses]
        shares = sorted(((s / sum(shares), k) for s, k in zip(shares, model.languages)), reverse=True)
        if shares[0][0] - shares[1][0] > 1e-4:
            assert r.lang_pred == shares[0][1]
        assert math.isclose(r.score, shares[0][0], rel_tol=1e-3)
        assert r.ambiguous == (shares[0][0] - shares[1][0] < langid.MARGIN) or abs(shares[0][0] - shares[1][0] - langid.MARGIN) < 1e-4
    # The fit is at the minimum of its convex loss: moving any way from it makes the loss no smaller.
    rng = np.random.default_rng(1)
    x = np.c_[rng.random((60, 5), np.float32), np.ones(60, np.float32)]
    labels = ["a" if (v[0] > 0.5) != (rng.random() < 0.3) else "b" for v in x]  # no plane parts them, so there is a minimum
    fitted = langid.fit(x, labels)
    y = np.where(np.array(labels)[:, None] == fitted.languages[0], fitted.code[0], fitted.code[1])
    even = np.array([1 / (2 * labels.count(k)) for k in labels])[:, None]
    loss = lambda w: float((even * np.log1p(np.exp(-y * (x @ w)))).sum() + langid.PENALTY / 2 * (w**2).sum())
    w = np.r_[fitted.weights, fitted.offsets[None]]
    assert all(loss(w + 0.5 * rng.normal(size=w.shape)) >= loss(w) for _ in range(200))


def test_codewords_differ():
    for n in (1, 2, 4, 9, 30):
        code = langid.codewords(n)
        assert code.shape[0] == n and len({tuple(c) for c in code.tolist()}) == n


def test_decontamination(spark, edge_docs, no_docs, edge_rows):
    item = "Which river runs through the old town of Kestrel Bay? The Amberline river does, since ages"
    other = "What is the boiling point of quartzine at sea level? It boils at seventy four degrees"
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "word"), (6, item + " " + " ".join(f"q{i}" for i in range(200)))], "item_id long, text string")
    filler = " ".join(f"f{i % 37}" for i in range(500))
    half = " ".join(item.split()[:8])
    planted = [
        (200, f"{filler} {item} {filler}"), (201, f"{filler} {item.upper().replace('?', ' -- ')}"), (202, other), (203, f"{filler} {half} {filler}"),
        (204, " ".join(reversed(item.split()))), (205, filler), (206, f"{item} {filler} {other}"), (206, f"{item} {filler} {other}"),
    ]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect())
    assert got == Counter({(200, 1): 1, (201, 1): 1, (202, 2): 1, (206, 1): 2, (206, 2): 2})
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    clean = decontaminate.decontaminated(edge_docs, items)
    assert clean.schema == edge_docs.schema and clean.count() == len(edge_rows)
    assert decontaminate.decontaminated(docs, items).filter("doc_id >= 200").count() == 3


def brute_matches(docs, items):
    """(doc_id, item_id) to the score and overlaps of the best confirmed passage, scoring every passage with every segment."""
    low = lambda t: "".join(c.lower()[0] for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    pairs = lambda w: set(zip(w, w[1:]))
    items = [(i, split(t)) for i, t in items]
    items = [(i, w) for i, w in items if len(w) > 1]
    frequency = Counter(x for _, w in items for x in set(w))
    mean = sum(len(w) for _, w in items) / len(items)
    segments = []
    for i, w in items:
        n = -(-len(w) // decontaminate.SEGMENT)
        edges = [len(w) * k // n for k in range(n + 1)]
        for a, b in zip(edges, edges[1:]):
            part, asked = w[a:b], b - a - max(1, (b - a) // 3)
            impact = {}
            for x, times in Counter(part).items():
                idf = math.log(1 + (len(items) - frequency[x] + 0.5) / (frequency[x] + 0.5))
                impact[x] = idf * times * (decontaminate.K1 + 1) / (times + decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(part) / mean))
            whole = sum(impact.values())
            segments.append((i, {x: v / whole for x, v in impact.items()}, pairs(part[:asked]), pairs(part[max(0, asked - 1) :])))
    best = {}
    for d, text in docs:
        w = split(text)
        for at in range(0, max(1, -(-len(w) // decontaminate.SEGMENT) - 1) * decontaminate.SEGMENT, decontaminate.SEGMENT):
            passage = w[at : at + 2 * decontaminate.SEGMENT]
            seen = pairs(passage)
            for i, impact, question, answer in segments:
                score = sum(v for x, v in impact.items() if x in set(passage))
                shares = [len(x & seen) / len(x) if x else 1.0 for x in (question, answer)]
                if score >= decontaminate.THRESHOLD - 1e-9 and shares[0] >= 0.5 and shares[1] >= 0.5:
                    best[d, i] = max(best.get((d, i), (0.0, 0.0, 0.0)), (score, *shares))
    return best


def test_decontamination_against_every_pair(spark, edge_docs, edge_rows):
    """The whole operator against scoring every passage with every item, with letters whose lower case is special."""
    import random

    rng = random.Random(9)
    odd = "ΤΟΥΣ ΟΔΟΣ İstanbul KELVİN Straße ΣΟΦΟΣ ﬁn Ǆep"
    first = " ".join((edge_rows[0][1] or "").split()[:20])
    long = " ".join(f"t{rng.randrange(60)}" for _ in range(150))
    items = [(1, odd), (2, "Amber line"), (3, first), (4, first), (5, long), (6, "x"), (7, None), (8, " ".join(edge_rows[5][1].split()[10:31]))]
    docs = [(300 + i, t) for i, t in enumerate([f"a b {odd} c", odd.lower(), "the AMBER line ends", "amber and line", f"{long} {odd}", " ".join(long.split()[40:140]), "line amber"])]
    docs += [(400 + i, " ".join(rng.sample((first + " " + odd + " " + long).split(), 90))) for i in range(30)]
    docs += [(500 + i, t) for i, (_, t, _, _) in enumerate(edge_rows)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute_matches(docs, items)
    assert {(300, 1), (302, 2), (304, 1), (304, 5)} <= expected.keys() and (306, 2) not in expected
    assert {(r.doc_id, r.item_id) for r in got} == expected.keys() and len(got) == len(expected)
    assert all(math.isclose(x, y, rel_tol=1e-9) for r in got for x, y in zip((r.score, r.question_overlap, r.answer_overlap), expected[r.doc_id, r.item_id]))


def test_decontamination_in_shards(spark, monkeypatch):
    """Shards and passes change nothing."""
    items = [(i, " ".join(f"v{(7 * i + j) % 50}" for j in range(12))) for i in range(40)]
    docs = [(i, f"before {items[i][1]} after {items[(i + 11) % 40][1]}") for i in range(40)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(map(tuple, decontaminate.contaminated(*tables).collect()))
    assert len(expected) >= 80
    monkeypatch.setattr(decontaminate, "SHARD_SEGMENTS", 7)
    monkeypatch.setattr(decontaminate, "SHARDS", 2)
    assert sorted(map(tuple, decontaminate.contaminated(*tables).collect())) == expected
    assert decontaminate.decontaminated(*tables).count() == 0


def test_block_bounds_lose_nothing(monkeypatch):
    """All items at or above the threshold, as exhaustive scoring finds them."""
    import random

    import numpy as np

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    segments = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(3, 20))], 2) for i in range(50)]
    frequency = Counter(w for _, ws, _ in segments for w in set(ws))
    index = decontaminate.build(segments, frequency, 50, sum(len(s[1]) for s in segments) / 50)
    passages = [sorted(rng.sample(range(len(index.terms)), 40)) for _ in range(60)]
    p = np.repeat(np.arange(60), 40)
    t = np.concatenate(passages)
    monkeypatch.setattr(decontaminate, "_EXPANDED", 200)
    got = {(a, b): s for a, b, s in zip(*(x.tolist() for x in decontaminate.retrieve(index, p, t, 0.4)))}
    expected = {}
    for a in range(60):
        for term in passages[a]:
            for at in range(index.segment_at[term], index.segment_at[term + 1]):
                key = (a, int(index.segments[at]))
                expected[key] = expected.get(key, 0) + index.impacts[at]
    expected = {k: v for k, v in expected.items() if v >= 0.4 - 1e-9}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k]) for k in got)
