"""How the values of an index are searched.

A written postings table stores these forms beside the value, so that no query works them out again and equality and ranges reach the scan:

    term    the value as its index compares it (lower case where the index says so); null in analysed indexes
    number  years and coordinates as numbers
    words   the words of a value of an analysed index, in reading order

Rows that were never written (``ready`` false) get the same forms from expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.catalog import ANALYZED, COORDINATE, INDEXES, LOWER, YEAR
from recordloom.functions.text import tokens

FORMS = "term string, number double, words array<string>"


def is_ready(postings: DataFrame) -> bool:
    """Whether the rows carry their search forms."""
    return {"term", "number", "words"} <= set(postings.columns)


def term(kind: str | None, ready: bool = False) -> Column:
    if ready and kind != ANALYZED:
        return F.col("term")
    return F.lower("value") if kind in (LOWER, ANALYZED) else F.col("value")


def number(kind: str, ready: bool = False) -> Column:
    return F.col("number") if ready else F.col("value").try_cast("int" if kind == YEAR else "double").cast("double")


def words(ready: bool = False) -> Column:
    return F.col("words") if ready else tokens("value")


def _of_kind(kind: str) -> Column:
    """Whether the row's index has this type; a context prefix up to the first underscore is cut off."""
    place = F.instr("index", "_")
    bare = F.when(place > 1, F.substr("index", place + 1)).otherwise(F.col("index"))
    return bare.isin([name for name, index in INDEXES.items() if index.type == kind])


def with_forms(postings: DataFrame) -> DataFrame:
    """Postings with ``term``, ``number`` and ``words``, as they are written."""
    analysed = _of_kind(ANALYZED)
    return postings.withColumns({
        "term": F.when(~analysed, F.when(_of_kind(LOWER), term(LOWER)).otherwise(term(None))),
        "number": F.when(_of_kind(YEAR), number(YEAR)).when(_of_kind(COORDINATE), number(COORDINATE)),
        "words": F.when(analysed, words()),
    })
