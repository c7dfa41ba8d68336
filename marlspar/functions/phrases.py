"""Known phrases in texts: one automaton for the whole dictionary, a pass over each text.

Case is ignored. A phrase must stand between word bounds: before and after it
stands no letter or digit where it begins or ends with one itself, so ``java``
isn't in ``javascript``, while ``node.js`` is before a full stop and ``c++``
before a comma. White space in a phrase stands for any run of white space. Of
phrases that overlap the one that begins first is taken, the longest of those
that begin together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marlspar.session import ship

_SPACE = re.compile(r"\s+")


def folded(text: str) -> str:
    """The text in which phrases are looked up: lower case, single blanks."""
    return _SPACE.sub(" ", text).lower().strip(" ")


def automaton(phrases: Iterable[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in phrases:
        if key := folded(phrase):
            made.add_word(key, key)
    made.make_automaton()
    return made


def found(made, text: str | None) -> Iterator[str]:
    """The phrases of a text in order, as folded."""
    if not text or not len(made):
        return
    text = folded(text)
    fits = []
    for end, phrase in made.iter(text):
        begin = end + 1 - len(phrase)
        open_ = begin == 0 or not (phrase[0].isalnum() and text[begin - 1].isalnum())
        close = end + 1 == len(text) or not (phrase[-1].isalnum() and text[end + 1].isalnum())
        if open_ and close:
            fits.append((begin, -end, phrase))
    done = -1
    for begin, end, phrase in sorted(fits):
        if begin > done:
            yield phrase
            done = -end


def matcher(spark: SparkSession, phrases: Iterable[str]):
    """A function from a text column to the distinct phrases (as folded) in order of their first places.

    The dictionary is sent once to each executor, and compiled once a task.
    """
    ship(spark)
    sent = spark.sparkContext.broadcast(sorted({folded(p) for p in phrases} - {""}))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = automaton(sent.value)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else list(dict.fromkeys(found(made, t))))

    return run
