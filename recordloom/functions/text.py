"""Tokens and Swedish stems as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.scalars import ColumnLike, _col, let

WORD = r"[\p{L}\p{N}]+"

# Endings of the published Swedish Snowball algorithm.
MAIN_ENDINGS = (
    "heterna hetens anden heten heter arnas ernas ornas andes arens andet "
    "arna erna orna ande arne aste aren ades erns ade are ern ens het ast "
    "ad en ar er or as es at a e"
).split()
S_LETTERS = "bcdfghjklmnoprtvy"
DOUBLE_ENDINGS = "dd gd nn dt gt kt tt".split()
VOWELS = "aeiouyäåö"

MAIN_PATTERN = "(" + "|".join(MAIN_ENDINGS) + ")$"
DOUBLE_PATTERN = "(" + "|".join(DOUBLE_ENDINGS) + ")$"
HEAD_PATTERN = f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]"


def tokens(value: ColumnLike) -> Column:
    """Lower-case words of a text in reading order."""
    return F.regexp_extract_all(F.lower(_col(value)), F.lit(WORD), F.lit(0))


def stem(word: ColumnLike) -> Column:
    """Swedish stem of a lower-case word."""
    def region(text: Column) -> Column:
        head_size = F.length(F.regexp_extract(text, HEAD_PATTERN, 0))
        # no region without a vowel-consonant pair; at least three letters stay before it
        split = F.when(head_size == 0, F.length(text)).otherwise(F.greatest(head_size, F.lit(3)))
        return F.struct(F.substr(text, F.lit(1), split).alias("head"), F.substr(text, split + 1).alias("tail"))

    def shorter(text: Column) -> Column:
        return F.substr(text, F.lit(1), F.length(text) - 1)

    def main_ending(part: Column) -> Column:
        tail, plain = part["tail"], F.regexp_replace(part["tail"], MAIN_PATTERN, "")
        genitive = F.concat(part["head"], tail).rlike(f"[{S_LETTERS}]s$") & tail.endswith("s")
        rest = let(plain, lambda p: F.when(p != tail, p).when(genitive, shorter(tail)).otherwise(tail))
        return F.struct(part["head"].alias("head"), rest.alias("tail"))

    def double_ending(part: Column) -> Column:
        tail = part["tail"]
        rest = F.when(tail.rlike(DOUBLE_PATTERN), shorter(tail)).otherwise(tail)
        return F.struct(part["head"].alias("head"), rest.alias("tail"))

    def last_ending(part: Column) -> Column:
        tail = part["tail"]
        rest = (
            F.when(tail.endswith("fullt") | tail.endswith("löst"), shorter(tail))
            .otherwise(F.regexp_replace(tail, "(lig|els|ig)$", ""))
        )
        return F.concat(part["head"], rest)

    return let(let(let(let(_col(word), region), main_ending), double_ending), last_ending)
