"""From raw documents to a training mix: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes all rows that its predecessor kept. All but the last give back
the columns of documents, whatever other columns there are and whatever their
names; an empty table stays empty. A null doc_id stands last wherever documents
are put in order, and rows with equal ids and texts are one document until
near_duplicates, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlspar.llm import decontaminate, langid, linededup, minhash, mixing
from marlspar.llm.runtime import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null, empty and letterless texts, and ambiguous ones."""
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, exact ones and those within 8 edits of words a hundred, and documents that have no others; n_chars follows."""
    return linededup.rewritten(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8), the first by doc_id; those without a word stay."""
    return minhash.first_of_each(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty items and texts match nothing."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' shares of the words follow their weights; what isn't taken goes. Documents without a label weigh 1, a null source is one source.

    Adds size, source_size, target, taken and copies, in place of columns of these names.
    """
    return mixing.mixed(docs, mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("mixing", mix)]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
