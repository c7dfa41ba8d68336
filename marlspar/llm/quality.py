"""Quality rules: base counts, then distribution divergence from language references.

A document has two histograms, of character classes and of common words. Each
language's reference is the sum of its documents' histograms, over all those
that pass the base rules. A document is dropped if its Jensen-Shannon distance
from its language's reference is above a threshold in either histogram. The
threshold is higher the shorter the text, for the histograms of short texts
scatter more, and a histogram of fewer than COMPARED_CHARS characters or
COMPARED_WORDS words is not compared at all: such a text is judged by the other
histogram, or by the base rules alone.

Everything is a built-in expression. Texts are read once; the histograms, a few
numbers a document, are written to the shared folder, and the references are
sums of them with one row a language.

Defined cases: a null or empty text has no words, fails the base rules and is
dropped; the language whose common words the text has most of stands in for a
null one, and is compared with beside any other; a language without a reference keeps its documents; rows with equal ids and
texts are separate rows; an empty table gives an empty result. Extra columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import SEPARATORS
from .runtime import stored

#: Common words of each language.
COMMON = {
    "de": "der die und den das von zu mit im ist ein eine auf nicht dem".split(),
    "en": "the of and to in is that by for as with this was on are".split(),
    "es": "de la que el en y los se del las un por con una para".split(),
    "fr": "le la de et les des un une en que qui dans pour sur par".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})

LEAST_WORDS = 50
MOST_REPEATED = 50
#: Guards of the divergence rule: least characters in words for the one histogram, least words for the other.
COMPARED_CHARS, COMPARED_WORDS = 300, 80
#: Thresholds of the divergence rule.
MOST_CHAR_DISTANCE = 0.22
MOST_WORD_DISTANCE = 0.24
#: What a short text may be farther off, over the square root of its number of words: its histogram scatters that much more.
SHORT_ALLOWANCE = 0.6

_WORD = r"[^\x20\x09-\x0D]"


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _window_hashes(words: str) -> Column:
    """A hash of each 3-word window, in order."""
    return F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)),
    )


def _in_hash_order(hashes: str) -> Column:
    """(h, i) of all windows by hash, if any hash comes twice; else null."""
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang_key, lang_seen, the base counts, base_failed and the two histograms."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", "lang", text.alias("text")).withColumn("words", F.array_remove(F.split("text", SEPARATORS), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))
    rows = split.select(
        "doc_id", "lang", "text", "words",
        F.array_join("words", "").alias("joined"),
        F.filter("words", lambda w: w.isin(WORDS)).alias("common"),
        _window_hashes("words").alias("hashes"),
        lines.alias("lines"),
    )
    # Few characters are left without lower-case letters, so the other classes are counted there.
    rows = rows.withColumn("windows", _in_hash_order("hashes")).withColumn("rare", F.regexp_replace("joined", "[a-z]+", ""))

    def again(x: Column, i: Column) -> Column:
        """Whether a window's hash stands beside it in hash order."""
        same_before = F.get("windows", i - 1)["h"] == x["h"]
        same_after = F.get("windows", i + 1)["h"] == x["h"]
        return F.coalesce(same_before, F.lit(False)) | F.coalesce(same_after, F.lit(False))

    rows = rows.withColumn("twice", F.sort_array(F.transform(F.filter("windows", again), lambda x: x["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "twice", start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"]
    )
    hits = {w: F.size("common") - F.size(F.array_remove("common", w)) for w in WORDS}
    vowels = _without(F.col("joined"), "[aeiou]+")
    upper, digits, marks, symbols = (_without(F.col("rare"), p) for p in ("[A-Z]+", "[0-9]+", r"[.,;:!?'\"()-]+", r"[#*$%&|<>]+"))
    rows = rows.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(vowels, upper, digits, marks, symbols, F.octet_length("joined") - F.length("joined")).alias("classes"),
        F.array(*[hits[w] for w in WORDS]).alias("counts"),
    )
    rest_chars = F.col("word_chars") - F.aggregate(F.slice("classes", 1, 5), F.lit(0), lambda a, x: a + x)
    rest_words = F.col("n_words") - F.aggregate("counts", F.lit(0), lambda a, x: a + x)
    own = {k: sum((F.col("counts")[WORDS.index(w)] for w in words), F.lit(0)) for k, words in COMMON.items()}
    most = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(k).alias("k")) for k, n in own.items()]))["k"]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select(
        "doc_id", F.coalesce("lang", most).alias("lang_key"), most.alias("lang_seen"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.concat(F.transform("classes", lambda x: x.cast("long")), F.array(F.greatest(rest_chars, F.lit(0).cast("long")))).alias("classes"),
        F.concat(F.transform("counts", lambda x: x.cast("long")), F.array(rest_words)).alias("counts"),
    )


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def distance(p: Column, n: Column, q: Column, m: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts with their totals; null if either total is 0 or null."""

    def plogp(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x)).otherwise(0.0)

    # Totals are columns of their own: inside the lambda they would be summed up again for each element.
    parts = F.zip_with(p, q, lambda x, y: (plogp(x / n) + plogp(y / m)) / 2 - plogp((x / n + y / m) / 2))
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(total(parts), F.lit(0.0))))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, char_distance, word_distance; docs: doc_id, text, lang."""
    rows = stored(measured(docs.select("doc_id", "text", "lang")).withColumn("all_chars", total(F.col("classes"))), "measured")
    sound = rows.filter(~F.col("base_failed"))
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(7)] + [F.sum(F.col("counts")[i]).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    references = sound.groupBy("lang_key").agg(*sums).select(
        F.col("lang_key").alias("of"),
        F.array(*[f"c{i}" for i in range(7)]).alias("ref_classes"),
        F.array(*[f"w{i}" for i in range(len(WORDS) + 1)]).alias("ref_counts"),
    )
    references = stored(references.withColumns({"ref_chars": total(F.col("ref_classes")), "ref_words": total(F.col("ref_counts"))}), "references")
    # A language may be wrong, so that of the text's common words counts as well: the nearer reference decides.
    seen = references.select(F.col("of").alias("also"), F.col("ref_classes").alias("seen_classes"), F.col("ref_counts").alias("seen_counts"), F.col("ref_chars").alias("seen_chars"), F.col("ref_words").alias("seen_words"))
    both = rows.join(references, F.col("lang_key") == F.col("of"), "left").join(seen, F.col("lang_seen") == F.col("also"), "left")
    chars, words = F.col("all_chars"), F.col("n_words").cast("double")
    both = both.withColumns(
        {
            "char_distance": F.least(*[distance(F.col("classes"), chars, F.col(f"{r}_classes"), F.col(f"{r}_chars")) for r in ("ref", "seen")]),
            "word_distance": F.least(*[distance(F.col("counts"), words, F.col(f"{r}_counts"), F.col(f"{r}_words")) for r in ("ref", "seen")]),
        }
    )
    allowance = SHORT_ALLOWANCE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    near_chars = (F.col("word_chars") < COMPARED_CHARS) | (F.col("char_distance") <= MOST_CHAR_DISTANCE + allowance)
    near_words = (F.col("n_words") < COMPARED_WORDS) | (F.col("word_distance") <= MOST_WORD_DISTANCE + allowance)
    kept = ~F.col("base_failed") & F.coalesce(near_chars, F.lit(True)) & F.coalesce(near_words, F.lit(True))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance"
    )
