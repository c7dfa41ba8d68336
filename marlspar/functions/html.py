"""HTML functions: built-in expressions where a pattern will do, Arrow-batched parsing for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspar.session import ship

_HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def title(c: Column) -> Column:
    """The title's text, null without one; entities stay as they are."""
    found = F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(c.rlike(r"(?is)<title[^>]*>.*?</title>"), F.trim(found))


def strip(c: Column) -> Column:
    """The text between tags, white space collapsed; scripts, styles and comments are left out first."""
    bare = F.regexp_replace(F.regexp_replace(c, _HIDDEN, " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " "))


class _Elements(HTMLParser):
    """Text pieces of every element of a class (or tag), in document order."""

    def __init__(self, tag: str | None, name: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.name = tag, name
        self.found: list[dict] = []
        self.open: list[tuple[str, int | None]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        hit = (self.tag in (None, tag)) and (self.name is None or self.name in (attrs.get("class") or "").split())
        index = None
        if hit:
            self.found.append({"text": [], "href": attrs.get("href")})
            index = len(self.found) - 1
        elif tag == "a" and attrs.get("href"):
            for _, i in self.open:
                if i is not None and self.found[i]["href"] is None:
                    self.found[i]["href"] = attrs["href"]
        if tag in _VOID:
            return
        self.open.append((tag, index))
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] == tag:
                for closed, _ in self.open[place:]:
                    self.hidden -= closed in ("script", "style")
                del self.open[place:]
                return

    def handle_data(self, data):
        if not self.hidden and (text := data.strip()):
            for _, i in self.open:
                if i is not None:
                    self.found[i]["text"].append(text)


class _Done(Exception):
    """What was looked for is whole."""


class _First(_Elements):
    """The same, up to the end of the first."""

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if self.found and all(i != 0 for _, i in self.open):
            raise _Done


def elements(html: str | None, tag: str | None = None, name: str | None = None) -> list[dict]:
    """Elements of a tag and class: their text pieces joined by newlines, and their first link."""
    parser = _Elements(tag, name)
    parser.feed(html or "")
    parser.close()
    return [{"text": "\n".join(e["text"]), "href": e["href"]} for e in parser.found]


def first_text(page: str, name: str, missing: str) -> str:
    """The text of the first element of a class, else ``missing``; what follows the element isn't parsed."""
    parser = _First(None, name)
    try:
        parser.feed(page)
        parser.close()
    except _Done:
        pass
    return "\n".join(parser.found[0]["text"]) if parser.found else missing


def text_of_class(name: str, missing: str = "Not available"):
    """A pandas UDF: the text of the first element of a class, else a sentinel."""

    if session := SparkSession.getActiveSession():
        ship(session)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        def first(page):
            if page is None or name not in page and "&" not in page:  # an entity may stand for a part of the name
                return missing
            return first_text(page, name, missing)

        return pages.map(first)

    return run


#: Rows, and characters of their pages, whose finds are given out at once.
GIVEN_ROWS, GIVEN = 4096, 1 << 20


def _found_rows(df: DataFrame, column: str, keys: list[str], fields: str, found: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """A row for each tuple that ``found`` yields of a page, whole batches of pages at a time: the key columns and the fields."""
    ship(df.sparkSession)
    pages = df.select(*keys, F.col(column).cast("string").alias("_page"))
    given = T.StructType([*pages.schema.fields[:-1], *T.StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            types = [pa.int32() if f.dataType == T.IntegerType() else texts.type for f in given.fields[len(kept) :]]
            of, rows, held = [], [], 0

            def out() -> pa.RecordBatch:
                which = pa.array(of, pa.int64())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
                return pa.RecordBatch.from_arrays([*(c.take(which) for c in kept), *columns], given.names)

            for i, text in enumerate(texts):
                page = text.as_py() or ""
                for row in found(page):
                    of.append(i)
                    rows.append(row)
                held += len(page)
                if rows and (held > GIVEN or len(rows) >= GIVEN_ROWS):
                    yield out()
                    of, rows, held = [], [], 0
            if rows:
                yield out()

    return pages.mapInArrow(run, given)


def _might_have(page: str, names: Sequence[str]) -> bool:
    """Whether an element of one of the classes may be there (no names: any element); an entity may stand for a part of a name."""
    return not names or "&" in page or any(n in page for n in names)


def cards(df: DataFrame, column: str, keys: list[str], tag: str | None = None, name: str | None = None) -> DataFrame:
    """A row for each element of a tag or class: the key columns, its position, text and link. Elements without text are skipped."""
    return df.lateralJoin(element_table(tag, name)(F.col(column).outer())).select(*keys, "position", "text", "href")


def element_table(tag: str | None = None, name: str | None = None):
    """A table function of a page: position, text and href of its elements of a tag or class that have text; to be joined laterally."""
    if session := SparkSession.getActiveSession():
        ship(session)

    class Elements:
        def eval(self, page: str):
            for position, e in enumerate(elements(page, tag, name)):
                if e["text"]:
                    yield position, e["text"], e["href"]

    return F.udtf(Elements, returnType="position int, text string, href string")


class Part(NamedTuple):
    """A part of a card: its tag (None: any), class names of which the first that is there counts, and an attribute (None: the text)."""

    tag: str | None = None
    names: tuple[str, ...] = ()
    attribute: str | None = None


class _Cards(HTMLParser):
    """Cards with the first element of each class name of each part; a card within a card is a card of its own."""

    def __init__(self, card: Part, parts: dict[str, Part]):
        super().__init__(convert_charrefs=True)
        self.card = card
        self.wanted: dict[str | None, list[tuple[tuple[str, int], str | None]]] = {}  # by class name: the part, the name's rank, and the tag
        for part, want in parts.items():
            for rank, name in enumerate(want.names or (None,)):
                self.wanted.setdefault(name, []).append(((part, rank), want.tag))
        self.cards: list[dict] = []
        self.open: list[tuple[str, int | None, list[dict]]] = []  # with the innermost card there
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        names = (attrs.get("class") or "").split()
        inside = self.open[-1][1] if self.open else None
        collecting = []
        if inside is not None:
            for name in (None, *names):
                for key, of_tag in self.wanted.get(name, ()):
                    if of_tag in (None, tag) and key not in self.cards[inside]:
                        self.cards[inside][key] = found = {"text": [], "attributes": attrs}
                        collecting.append(found)
        if self.card.tag in (None, tag) and (not self.card.names or any(n in names for n in self.card.names)):
            self.cards.append({})
            inside = len(self.cards) - 1
        if tag in _VOID:
            return
        self.open.append((tag, inside, collecting))
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] == tag:
                for closed, _, _ in self.open[place:]:
                    self.hidden -= closed in ("script", "style")
                del self.open[place:]
                return

    def handle_data(self, data):
        if not self.hidden and (text := data.strip()):
            for _, _, collecting in self.open:
                for found in collecting:
                    found["text"].append(text)


def parted(html: str | None, card: Part, parts: dict[str, Part]) -> list[dict[str, str | None]]:
    """The cards of a page, each with its parts; a part that isn't there is None."""
    parser = _Cards(card, parts)
    parser.feed(html or "")
    parser.close()
    out = []
    for found in parser.cards:
        row = {}
        for part, want in parts.items():
            hits = [found[part, i] for i in range(max(1, len(want.names))) if (part, i) in found]
            row[part] = None if not hits else hits[0]["attributes"].get(want.attribute) if want.attribute else "\n".join(hits[0]["text"])
        out.append(row)
    return out


def card_rows(df: DataFrame, column: str, keys: list[str], card: Part, parts: dict[str, Part], required: Sequence[str] = ()) -> DataFrame:
    """A row for each card: the key columns, its position, and its parts as strings. Cards that lack a required part are skipped."""
    needed = [card.names, *(parts[p].names for p in required)]

    def found(page: str) -> Iterator[tuple]:
        if all(_might_have(page, names) for names in needed):
            for position, row in enumerate(parted(page, card, parts)):
                if all(row[p] is not None for p in required):
                    yield (position, *row.values())

    return _found_rows(df, column, keys, ", ".join(["position int"] + [f"`{p}` string" for p in parts]), found)


def section_text(lines: Column, headings: list[str]) -> Column:
    """For each heading, the line after the first line that holds it in any ASCII case; joined by blank lines, else ``Not available``."""
    upper = F.transform(lines, lambda x: F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    numbered = F.transform(upper, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    parts = []
    for heading in headings:
        wanted = heading.upper()
        hits = F.filter(numbered, lambda z: z["x"].contains(wanted))
        after = F.trim(F.get(lines, F.get(hits, F.lit(0))["i"] + 1))
        parts.append(F.when(after != "", after))
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("\n\n", *parts)).otherwise("Not available")
