"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, ``-ln(u) / weight``, with ``u`` from a
hash of the document and a seed. Within a source, documents are taken in order
of their keys until the source's budget of words is reached. A budget above the
source's size is met by complete epochs first, then by a fractional selection.

A source is never sorted as a whole. Keys fall into buckets whose order is the
order of the keys; sums by bucket settle all buckets but the one in which the
budget ends, and only that one is sorted. So a source that holds a third of all
rows is spread over all buckets, and each sort sees one bucket of it.

Defined cases: a null source is a source of its own and stands last; a null or
empty text has size 0 and takes 0 words; rows with equal ids and texts are
separate rows with the same key; a source of size 0 has target 0; an empty
table gives an empty result. A document is taken whole: the one at which the
budget ends is taken if that brings the source nearer to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

SEPARATORS = r"[\x20\x09-\x0D]+"
MOST_EPOCHS = 3
BUCKETS = 1024


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SEPARATORS), "")), F.lit(0)).cast("long")


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the parts and the seed alone."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for good documents, 0.5 for poor ones; documents without a label count 1."""
    best = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") >= 1, 2.0).when(F.col("quality") < 1, 0.5).otherwise(1.0).alias("weight"))


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets of the sources from their sizes, one row a source.

    Weights 1..cycle repeat over the sources in code point order, null last.
    All sizes together are shared out by weight; a share above ``most`` times
    its source's size stops there, and the excess goes to the others by weight.
    With the sources ordered by cap / weight, a prefix is capped: the first
    source whose level fits ends it.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.select(
        "source", "source_size",
        (F.pmod(F.row_number().over(ordered) - 1, F.lit(cycle)) + 1).cast("long").alias("weight"),
    ).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy(F.lit(1))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    leveled = weighed.select(
        "*",
        F.row_number().over(by_ratio).alias("place"),
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("place"))
    level = F.min_by("level", fits).over(everything)
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return leveled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 0, cycle: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, text_md5, size, source_size, target, taken.

    docs: doc_id, text, source. weights: (doc_id, weight > 0), one row a doc_id.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("text_md5"), uniform(F.col("doc_id"), F.col("text"), seed=seed).alias("u"))
    if weights is not None:
        sized = sized.join(weights.select("doc_id", "weight"), "doc_id", "left")
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    key = -F.log(F.col("u")) / F.coalesce(F.col("weight"), F.lit(1.0))
    sized = sized.select("doc_id", "source", "size", "text_md5", key.alias("key"))
    sized = stored(sized.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int")), "sized")

    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), cycle)
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    settled = (
        sums.withColumn("ahead", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .withColumnRenamed("source", "of")
        .join(targets, F.col("of").eqNullSafe(F.col("source")))
        .withColumn("epochs", share)
        .withColumn("left_over", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("of", F.col("bucket").alias("at"), "ahead", "words", "source_size", "target", "epochs", "left_over")
    )
    placed = sized.join(settled, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    inside = (F.col("ahead") < F.col("left_over")) & (F.col("ahead") + F.col("words") > F.col("left_over"))
    whole = (F.col("ahead") + F.col("words") <= F.col("left_over")).cast("long")
    apart = placed.filter(~inside).withColumn("more", whole)
    in_order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = placed.filter(inside).withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    ending = sorted_.withColumn("more", (2 * F.col("before") + F.col("size") <= 2 * F.col("left_over")).cast("long")).drop("before")
    return apart.unionByName(ending).select(
        "doc_id", "text_md5", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken")
    )



def mixed(docs: DataFrame, weights: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """The documents of the mix with all their columns, and size, source_size, target, taken and copies (how often each is taken).

    Columns of these names in docs are replaced, whatever their case. Rows with equal ids and texts share the largest count among them.
    """
    found = mix(docs, weights, seed).filter("taken > 0").groupBy(F.col("doc_id").alias("of"), F.col("text_md5").alias("hash"))
    found = found.agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target", "taken")])
    names = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken", "copies")]
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"], F.md5(docs["text"]).alias("text_md5"))
    joined = whole.join(found, (F.col("text_md5") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("of")))
    return joined.select("row.*", "size", "source_size", "target", "taken", (F.col("taken") / F.col("size")).cast("long").alias("copies"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, text,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS digest
  FROM documents),
marked AS (
  SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
keyed AS (
  SELECT d.doc_id, d.source, d.size, md5(d.text) AS text_md5,
         -ln((CAST('0x' || substr(d.digest, 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)
           / CASE WHEN quality >= 1 THEN 2.0::DOUBLE WHEN quality < 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM docs d LEFT JOIN marked USING (doc_id)),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM sizes),
leveled AS (
  SELECT *, row_number() OVER o AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
level AS (
  SELECT arg_min(level, place) AS level FROM leveled WHERE cap::DOUBLE / weight >= level),
targets AS (
  SELECT w.source, w.source_size,
         CASE WHEN l.level IS NULL THEN CAST(w.cap AS DOUBLE) ELSE least(CAST(w.cap AS DOUBLE), l.level * w.weight) END AS target
  FROM weighed w, level l),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
prefix AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed)
SELECT p.doc_id, p.size, s.source_size, s.target,
       CAST(p.size * (s.epochs + CASE WHEN 2 * p.before + p.size <= 2 * (s.target - s.epochs * s.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM prefix p JOIN shares s ON p.source IS NOT DISTINCT FROM s.source
"""
