"""The three flows: ingest sources, recommend to users, gather what a mail needs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspar.operators import clean, dedup, merge, recommend


def ingest(sources: Mapping[str, DataFrame | None], as_of: str, across_sources: bool = False) -> DataFrame:
    """Clean each source by its recipe, drop its equal rows (within a file, where there is a ``file`` column), union, number.

    Sources come in the order of the mapping; ``seq`` columns give the order within one,
    else rows are numbered in order of their ids. across_sources: of equal ids only the first stays.
    """
    parts = []
    for name, df in sources.items():
        if df is None:
            parts.append(None)
            continue
        rows = dedup.full_row(clean.cleaned(df, clean.RECIPES[name], as_of))
        parts.append(rows.drop("file"))
    rows = merge.union_sources(parts)
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.lit(None).cast("long"))
    rows = merge.with_defaults(rows)
    if across_sources:
        rows = dedup.keep_first(rows, ["id"], ["file_rank", "seq", "text", "job_link"])
    # Rows without a place are dealt out by hash; equal hashes stand in the order of what the rows hold.
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("file_rank", "seq")]), F.lit(1 << 40))
    rows = rows.withColumn("seq", F.coalesce(F.col("seq").cast("long"), spread))
    ties = [c for c in rows.columns if c not in ("file_rank", "seq")]
    return merge.numbered(rows, ties=ties).drop("file_rank", "seq")


def recommend_and_page(users: DataFrame, jobs: DataFrame, start: int = 0, k: int = recommend.K) -> DataFrame:
    """A page of every user's recommendations."""
    return recommend.page(recommend.recommend(users, jobs, k), start)


def update(users: DataFrame, jobs: DataFrame, path: str, start: int = 0, k: int = recommend.K) -> DataFrame:
    """Recommend anew to the users, overwrite what is stored for them (with nothing, where nothing fits), and give back the page of what is stored."""
    from marlspar.sources import recommended

    version = recommended.store(users, jobs, path, k)
    return recommend.page(recommended.read(users.sparkSession, path, version, users, start + recommend.PAGE), start)


def mail(requests: DataFrame, recommended: DataFrame, users: DataFrame, kind: str = "cold_mail") -> DataFrame:
    """chat_id, job_indx and the prompt of each request whose job and user are there."""
    from marlspar.functions.extract import mail_prompt

    rows = recommend.mail_context(requests, recommended, users)
    job = F.struct(*[c for c in ("job_title", "company_name", "experience", "location", "skills", "job_description") if c in rows.columns])
    return rows.select("chat_id", "job_indx", mail_prompt(kind, F.col("resume_json"), job).alias("prompt"))


def register(requests: DataFrame, path: str) -> DataFrame:
    """Append the valid registrations to the user table; the others come back."""
    from marlspar.operators import users
    from marlspar.sources import sinks

    checked = users.validated(requests)
    sinks.append(checked.filter("is_valid").drop("is_valid"), path)
    return checked.filter("NOT is_valid").drop("is_valid")
