"""Captured pages by site and offset, and the recipes that make postings of them.

Pages are stored by site and by spans of their offsets, so the filters of a
site's slice (its name, where to begin, how many results) prune folders before a
file is opened: they are partition filters of the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspar.functions import html
from marlspar.operators import ranks
from marlspar.session import stored

#: Results whose pages are stored together.
SPAN = 1000

#: Up to so many first rows of a key, Spark drops the others before it deals them out.
GROUP_LIMIT = 1000

#: The classes of a result page's cards and of a detail page's text, and what stands for a missing one.
LINKEDIN_CARD = html.Part("div", ("base-card",))
LINKEDIN_PARTS = {
    "title": html.Part("h3", ("base-search-card__title",)), "company": html.Part("h4", ("base-search-card__subtitle",)),
    "location": html.Part("span", ("job-search-card__location",)), "link": html.Part("a", ("base-card__full-link",), "href"),
}
LINKEDIN_DETAIL = "show-more-less-html__markup"
NOT_FOUND, NOT_LOADED = "Job description not found", "Failed to load job description"


def store(pages: DataFrame, path: str, span: int = SPAN) -> None:
    """Add pages (site, start, and others) to a store; ``start`` is the offset of a page's first result."""
    pages.withColumn("span", F.floor(F.col("start") / span).cast("long")).write.mode("append").partitionBy("site", "span").parquet(path)


def site_pages(spark: SparkSession, path: str, site: str | list[str], since: int = 0, until: int | None = None, span: int = SPAN) -> DataFrame:
    """The pages of a site, or of several, whose offsets are from ``since`` to below ``until``; other folders aren't listed as files to read."""
    sites = [site] if isinstance(site, str) else list(site)
    pages = spark.read.option("basePath", path).parquet(path)
    wanted = pages.filter(F.col("site").isin(sites) & (F.col("span") >= since // span) & (F.col("start") >= since))
    if until is not None:
        wanted = wanted.filter((F.col("span") <= (until - 1) // span) & (F.col("start") < until))
    return wanted.drop("span")


def linkedin(results: DataFrame, details: DataFrame, most: int | None = None) -> DataFrame:
    """Postings of result pages, each with the text of its detail page: search, title, company, location, link, description.

    results: search, start, html; details: url, html. Cards that lack a part are
    skipped. most: postings of a search, the first in order of page and place. A
    detail page without the text, and one that isn't there, leave a sentence.
    """
    found = html.card_rows(results, "html", ["search", "start"], LINKEDIN_CARD, LINKEDIN_PARTS, tuple(LINKEDIN_PARTS))
    if most is not None and most <= GROUP_LIMIT:  # each task keeps as many of a search before they are dealt out
        first = Window.partitionBy("search").orderBy("start", "position")
        found = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most)
    found = stored(found, "cards")  # pages are parsed once
    if most is not None and most > GROUP_LIMIT:
        found = ranks.ranked(found, ["search"], ["start", "position"], "place").filter(F.col("place") <= most)
    # Only the detail pages of these are parsed, each once.
    wanted = details.join(found.select(F.col("link").alias("url")).distinct(), "url", "left_semi")
    text = html.text_of_class(LINKEDIN_DETAIL, NOT_FOUND)(F.coalesce("html", F.lit("")))
    pages = wanted.groupBy("url").agg(F.min("html").alias("html")).select(F.col("url").alias("link"), text.alias("text"))
    joined = found.join(pages, "link", "left")
    return joined.select("search", "title", "company", "location", "link", F.coalesce("text", F.lit(NOT_LOADED)).alias("description"))
