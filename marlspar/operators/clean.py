"""Cleaning of one source's postings: rename, filter, clean, derive, date."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspar.functions import experience, text

#: The renamed columns.
RENAMES = {
    "Job Title": "job_title",
    "Company Name": "company_name",
    "Job Link": "job_link",
    "Location": "location",
    "Experience": "experience",
    "Job Description": "job_description",
    "Skills": "skills",
}


class Recipe(NamedTuple):
    """How a source is cleaned."""

    source: str
    cleaned: Sequence[str]
    first_line: Sequence[str]
    text_from: str
    experience_from: str
    family: Sequence[experience.Rule]
    needs_description: bool


_ALL = ("job_title", "location", "company_name", "job_description")

#: What differs between the sources.
RECIPES = {
    "cuvette": Recipe("cuvette", _ALL, (), "skills", "years_of_experience", experience.CAPPED, True),
    "linkedin": Recipe("linkedin", _ALL, (), "job_description", "experience", experience.CAPPED, True),
    "instahyre": Recipe("instahyre", _ALL, (), "skills", "experience", experience.OPEN, True),
    "naukri": Recipe("naukri", ("job_title", "company_name", "job_description"), ("company_name",), "job_description", "experience", experience.OPEN_LOWER, False),
}


def cleaned(df: DataFrame, recipe: Recipe, as_of: str) -> DataFrame:
    """Postings of a source as the master table wants them; as_of: the day of ingestion, yyyy-MM-dd."""
    df = df.withColumnsRenamed(RENAMES)
    if "_corrupt_record" in df.columns:
        df = df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    if recipe.needs_description:
        df = df.filter(F.col("job_description").isNotNull())
    df = df.withColumns({c: (text.clean_first_line if c in recipe.first_line else text.clean)(F.col(c)) for c in recipe.cleaned})
    if "skills" in df.columns:
        is_list = dict(df.dtypes)["skills"].startswith("array")
        df = df.withColumn("skills", text.join_array(F.col("skills")) if is_list else text.resplit_skills(F.col("skills")))
    if recipe.experience_from not in df.columns:
        df = df.withColumn(recipe.experience_from, F.col("experience"))
    return df.withColumns(
        {
            "id": text.compose(*[F.col(c) for c in ("job_title", "company_name", "experience", "location")]),
            "text": text.compose(*[F.col(c) for c in ("job_title", "company_name", recipe.text_from, "location")]),
            "Posted_date": F.to_date(F.lit(as_of)),
            "Source": F.lit(recipe.source),
            "yoe": experience.bounds(F.col(recipe.experience_from), recipe.family),
        }
    )


def site_slice(df: DataFrame, **wanted: str | Sequence[str]) -> DataFrame:
    """The rows that a site's own filters would show: each named column has one of the values, in any case."""
    for column, values in wanted.items():
        values = [values] if isinstance(values, str) else values
        df = df.filter(F.lower(F.col(column)).isin([v.lower() for v in values]))
    return df
