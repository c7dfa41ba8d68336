"""Extractors: structured fields from text, with a fixed output schema and an error column.

A language model is plugged in as a function from a list of prompts to a list
of answers; it is made once a task by a factory. Without one, a deterministic
rule is used. A failed row is an error, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspar.functions import phrases
from marlspar.schema import RESUME
from marlspar.session import ship

#: The fields of a structured posting.
FIELDS = ("Job Title", "Job Link", "Company Name", "Experience", "Salary", "Location", "Job Description", "Skills", "Job Type")

MOST_CHARS = 1500


def repaired(answer: str) -> dict:
    """The object from the first { to the last } of an answer."""
    flat = answer.replace("\n", " ")
    return json.loads(flat[flat.index("{") : flat.rindex("}") + 1])


def answers(df: DataFrame, key: str, column: str, factory: Callable[[], Callable[[Sequence[str]], Sequence[str]]], size: int = 5, most_chars: int | None = MOST_CHARS) -> DataFrame:
    """key, answer (the object in the model's answer, as JSON), error, raw_text (what the model said, where that is no object).

    Prompts are cut to ``most_chars`` characters and three dots (None: whole) and go to the model in lots of ``size``.
    """
    ship(df.sparkSession)
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            rows = []
            for begin in range(0, len(batch), size):
                lot = batch.iloc[begin : begin + size]
                texts = [t if most_chars is None or len(t) <= most_chars else t[:most_chars] + "..." for t in lot[column].fillna("")]
                try:
                    said = list(model(texts))
                except Exception as e:  # one failed lot is as many error rows
                    said = [e] * len(lot)
                for k, answer in zip(lot[key], said):
                    if isinstance(answer, Exception):
                        rows.append([k, None, f"{type(answer).__name__}: {answer}", None])
                        continue
                    try:
                        rows.append([k, json.dumps(repaired(answer), ensure_ascii=False), None, None])
                    except Exception as e:
                        rows.append([k, None, f"{type(e).__name__}: {e}", None if answer is None else str(answer)])
            yield pd.DataFrame(rows, columns=["key", "answer", "error", "raw_text"])

    rows = df.select(key, column).mapInPandas(run, f"key {key_type}, answer string, error string, raw_text string")
    return rows.withColumnRenamed("key", key)


def structured(
    df: DataFrame, key: str, column: str, factory: Callable[[], Callable[[Sequence[str]], Sequence[str]]], fields: Sequence[str] = FIELDS, size: int = 5, most_chars: int | None = MOST_CHARS
) -> DataFrame:
    """key, the fields (text; lists are joined by commas), error and raw_text; see ``answers`` for the rest."""
    found = answers(df, key, column, factory, size, most_chars)

    def field(name: str) -> Column:
        value = F.get_json_object("answer", f"$['{name}']")
        items = F.array_join(F.from_json(value, "array<string>"), ", ")
        return F.when(value.startswith("["), items).otherwise(value).alias(name)

    return found.select(key, *[field(f) for f in fields], "error", "raw_text")


def resumes(df: DataFrame, key: str, column: str, factory: Callable[[], Callable[[Sequence[str]], Sequence[str]]], size: int = 5) -> DataFrame:
    """key, resume (as ``schema.RESUME``), error, raw_text, from whole resume texts.

    A mark that is given as ``cgpa/percentage`` is taken for a percentage above 10, else for a CGPA.
    """
    found = answers(df, key, column, factory, size, None)
    school = RESUME["Education"].dataType.elementType
    loose = T.StructType([T.StructField(f.name, T.ArrayType(T.StructType([*school.fields, T.StructField("cgpa/percentage", T.StringType())]))) if f.name == "Education" else f for f in RESUME.fields])
    parsed = found.withColumn("resume", F.from_json("answer", loose))

    def settled(e: Column) -> Column:
        either = e["cgpa/percentage"]
        percentage = F.regexp_extract(either, r"[0-9]+(\.[0-9]+)?", 0).try_cast("double") > 10
        marks = {"cgpa": F.coalesce(e["cgpa"], F.when(~percentage, either)), "percentage": F.coalesce(e["percentage"], F.when(percentage, either))}
        return F.struct(*[marks.get(f.name, e[f.name]).alias(f.name) for f in school.fields])

    whole = F.struct(*[F.transform("resume.Education", settled).alias(f.name) if f.name == "Education" else F.col(f"resume.{f.name}").alias(f.name) for f in RESUME.fields])
    return parsed.select(key, F.when(F.col("answer").isNotNull(), whole).alias("resume"), "error", "raw_text")


def skills(c: Column, known: Sequence[str]) -> Column:
    """The known skills, also of several words, that stand in the text, in any case; in order of their first places (see ``phrases``)."""
    return phrases.matcher(SparkSession.active(), known)(c)


def mail_prompt(kind: str, resume: Column, job: Column) -> Column:
    """The prompt for a mail, a referral request or a cover letter; ``kind`` is one of PROMPTS."""
    before, after = PROMPTS[kind]
    return F.concat(F.lit(before), F.to_json(job), F.lit(after), F.to_json(resume))


PROMPTS = {
    "cold_mail": ("Write a short, professional mail to a recruiter about this posting: ", "\nUse only facts of this resume, at most 4096 characters: "),
    "referral": ("Ask a contact politely for a referral to this posting: ", "\nUse only facts of this resume, at most 4096 characters: "),
    "cover_letter": ("Write a cover letter for this posting: ", "\nUse only facts of this resume, at most 4096 characters: "),
}


def hashed_embedding(dims: int = 64):
    """A pandas UDF: unit vectors of hashed words, a deterministic stand-in for a model: a word adds 1 or -1 at one place. Null and empty texts give zeros.

    All words of a batch are hashed and added up at once.
    """

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        words = [(t or "").lower().split() for t in texts]
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = np.array([w for some in words for w in some], object)
        hashes = pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)
        place = (hashes % np.uint64(dims)).astype(np.int64)
        sign = np.where(hashes >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        v = np.bincount(row * dims + place, weights=sign, minlength=dims * len(words)).reshape(-1, dims)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list((v / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return run


def batch_number(seq: Column, size: int = 10) -> Column:
    return F.floor(seq / size)
