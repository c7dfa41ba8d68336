"""Text functions, all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, "[^a-zA-Z0-9]+", " "))


def clean_first_line(c: Column) -> Column:
    """``clean`` of what stands before the first newline."""
    return clean(F.split(c, "\n")[0])


def strip_asterisks(c: Column) -> Column:
    """Each run of asterisks becomes one space."""
    return F.regexp_replace(c, r"\*+", " ")


def strip_asterisks_everywhere(df: DataFrame) -> DataFrame:
    """``strip_asterisks`` on every string column."""
    return df.withColumns({n: strip_asterisks(df[n]) for n, t in df.dtypes if t == "string"})


def resplit_skills(c: Column) -> Column:
    """Split at slashes and commas, join by spaces."""
    return F.array_join(F.split(c, "[/,]"), " ")


def join_array(c: Column) -> Column:
    return F.array_join(c, " ")


def printed(c: Column) -> Column:
    """A value as a format string prints it: null is the word None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def compose(*parts: Column) -> Column:
    """The parts, printed, with single spaces between."""
    return F.concat_ws(" ", *[printed(p) for p in parts])


def truncate(c: Column, n: int = 1500) -> Column:
    """The first n characters, and three dots if there were more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def strip_glyphs(c: Column) -> Column:
    """Without private-use icon glyphs, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\uE000-\uF8FF]", ""))


def json_span(c: Column) -> Column:
    """Newlines become spaces; then what stands from the first { to the last }, null if there is none."""
    found = F.regexp_extract(F.regexp_replace(c, r"\n", " "), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def parse_json(c: Column, schema) -> Column:
    """The repaired JSON as a struct; null where it can't be read."""
    return F.from_json(json_span(c), schema)


def default(c: Column, value="Not specified") -> Column:
    return F.coalesce(c, F.lit(value))


def first_present(*cs: Column) -> Column:
    """The first of several columns that has text, as a list of fallbacks does."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cs])


def prefixed(base: str, c: Column) -> Column:
    return F.concat(F.lit(base), c)


def url_with(base: str, params: Mapping[str, Column | str]) -> Column:
    """base and the parameters, form-encoded, in the order given."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for k, v in params.items()]
    return F.concat(F.lit(base), F.concat_ws("&", *parts))


def page_urls(base: Column, pages: int = 10) -> Column:
    """An array: the base, then the base with -2, -3 ... appended."""
    return F.transform(F.sequence(F.lit(1), F.lit(pages)), lambda n: F.when(n > 1, F.concat(base, F.lit("-"), n.cast("string"))).otherwise(base))


def offset_urls(base: Column, most: int, size: int = 25) -> Column:
    """The addresses of as many result pages as ``most`` rows fill, by the offset of the first row of each."""
    return F.transform(F.sequence(F.lit(0), F.lit(max(0, most - 1)), F.lit(size)), lambda n: F.concat(base, F.lit("&start="), n.cast("string")))


def callback(c: Column) -> Column:
    """``action:index:chat`` as a struct; parts that are missing or no numbers are null."""
    parts = F.split(c, ":")
    return F.struct(
        F.get(parts, F.lit(0)).alias("action"),
        F.get(parts, F.lit(1)).try_cast("long").alias("index"),
        F.get(parts, F.lit(2)).try_cast("long").alias("chat_id"),
    )


def job_card(job) -> Column:
    """The message of a posting; ``job`` maps a column name to a column."""
    return F.concat(
        F.lit("<b>"), printed(job("job_title")), F.lit("</b>\nCompany: "), printed(job("company_name")),
        F.lit("\nExperience: "), printed(job("experience")), F.lit("\nlink: <a href='"), printed(job("job_link")),
        F.lit("'>Apply here</a>\nLocation: "), printed(job("location")), F.lit("\nSkills: "), printed(job("skills")),
    )


def job_card_markdown(job) -> Column:
    """The message of a posting in Markdown; ``job`` maps a column name to a column."""
    return F.concat(
        F.lit("*"), printed(job("job_title")), F.lit("* at *"), printed(job("company_name")), F.lit("*\nLocation: "), printed(job("location")),
        F.lit("\nExperience: "), printed(job("experience")), F.lit("\n[Apply here]("), printed(job("job_link")), F.lit(")"),
    )


def query_text(expertise: Column, skills: Column, city: Column | str) -> Column:
    """Expertise, skills and city of a user, with spaces between."""
    return F.concat_ws(" ", F.array_join(expertise, " "), F.array_join(skills, " "), city if isinstance(city, Column) else F.lit(city))


def tuple_of_two(c: Column) -> Column:
    """A literal ``(a, b)`` of whole numbers as a struct of doubles, else null."""
    pattern = r"\(\s*(\d+)\s*,\s*(\d+)\s*\)"
    lo, hi = (F.regexp_extract(c, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(c.rlike(pattern), F.struct(lo.alias("lo"), hi.alias("hi")))


def posted_date(c: Column) -> Column:
    """A yyyy-MM-dd date; null where empty or malformed."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c.try_cast("date"))


def between_markers(lines: Column) -> Column:
    """Non-empty lines after a start marker, up to the line of responsibilities; ``Not available`` if there are none.

    lines: an array of strings. Start lines hold both ``Job Description`` and
    ``Mandate Skills``, or ``Ideal Candidate``, and are left out.
    """
    trimmed = F.transform(lines, lambda x: F.trim(x))
    state = F.struct(F.lit(0).alias("phase"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        start = (line.contains("Job Description") & line.contains("Mandate Skills")) | line.contains("Ideal Candidate")
        stop = line.contains("Responsibilities:")
        phase = F.when(acc["phase"] == 2, 2).when(start, 1).when((acc["phase"] == 1) & stop, 2).otherwise(acc["phase"])
        keep = (acc["phase"] == 1) & ~start & ~stop & (line != "")
        return F.struct(phase.alias("phase"), F.when(keep, F.array_append(acc["kept"], line)).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate(trimmed, state, step, lambda acc: acc["kept"])
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise("Not available")
