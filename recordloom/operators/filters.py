"""Predicates over postings(item_id, index, pos, value).  Results are tables of item ids.

A value of an analysed index is searched by its words inside the row, so no word table is built.  Postings that were written hold
words, terms and numbers ready (``operators.terms``); filters then read those.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.catalog import ANALYZED, COORDINATE, YEAR, index_type, normalise
from recordloom.functions import geo
from recordloom.functions.scalars import like_pattern
from recordloom.functions.text import tokens
from recordloom.operators import terms

Term = tuple[str, str, str]


def _phrase(text: str, ready: bool) -> Column:
    spaced = F.concat(F.lit(" "), F.array_join(terms.words(ready), " "), F.lit(" "))
    wanted = F.concat(F.lit(" "), F.array_join(tokens(F.lit(text)), " "), F.lit(" "))
    return F.contains(spaced, wanted)


def _equals(index: str, value: str, ready: bool) -> Column:
    kind = index_type(index)
    if "*" in value or "?" in value:
        if kind in (YEAR, COORDINATE):
            raise ValueError(f"wildcards are not supported for {index}")
        pattern = like_pattern(normalise(index, value))
        if kind == ANALYZED:
            return F.exists(terms.words(ready), lambda word: word.like(pattern))
        return terms.term(kind, ready).like(pattern)
    if kind == ANALYZED:
        return _phrase(value, ready)
    return terms.term(kind, ready) == normalise(index, value)


def _range(index: str, op: str, value: str, ready: bool) -> Column:
    kind = index_type(index)
    if kind in (YEAR, COORDINATE):
        stored, bound = terms.number(kind, ready), F.lit(float(int(value) if kind == YEAR else value))
    else:
        stored, bound = terms.term(kind, ready), F.lit(normalise(index, value))
    compare = {"<": stored < bound, "<=": stored <= bound, ">": stored > bound, ">=": stored >= bound}
    return compare[op]


def condition(index: str, op: str, value: str, ready: bool = False) -> Column:
    """Whether one postings row satisfies ``index op value``.

    ``op`` is =, scr, exact, any, <, <=, > or >=; any value of a repeated field may qualify.  ``ready``: the rows were written
    with their search forms, and the condition is on those.
    """
    if value == "":
        raise ValueError("an empty value only goes with = and has no row condition")
    here = F.col("index") == index
    if op in ("=", "scr"):
        return here & _equals(index, value, ready)
    if op == "exact":
        return here & (_phrase(value, ready) if index_type(index) == ANALYZED else F.col("value") == value)
    if op == "any":
        words = [_equals(index, word, ready) for word in value.split()]
        return here & reduce(lambda one, other: one | other, words)
    if op in ("<", "<=", ">", ">="):
        return here & _range(index, op, value, ready)
    raise ValueError(f"unsupported relation: {op}")


def select_items(
    postings: DataFrame, leaves: Mapping[str, Term], keep: Callable[[Mapping[str, Column]], Column],
    items: DataFrame | None = None, needs_hit: bool = False,
) -> DataFrame:
    """Items whose terms satisfy a boolean rule, in one pass and one shuffle.

    ``leaves`` names the terms; ``keep`` combines their flags with ``&``, ``|`` and ``~``.  Only rows that satisfy some term are
    shuffled if the rule cannot hold without one (``needs_hit``), or if the table of all items is given; else all postings are,
    for they alone tell which items there are.
    """
    ready = terms.is_ready(postings)
    rules = {name: F.coalesce(condition(*leaf, ready=ready), F.lit(False)) for name, leaf in leaves.items()}
    rows = postings if items is None and not needs_hit else postings.filter(reduce(lambda a, b: a | b, rules.values()))
    marked = rows.groupBy("item_id").agg(*[F.bool_or(rule).alias(name) for name, rule in rules.items()])
    if items is not None and not needs_hit:
        marked = items.select("item_id").distinct().join(marked, "item_id", "left").na.fill(False)
    return marked.filter(keep({name: F.col(name) for name in leaves})).select("item_id")


def match(postings: DataFrame, index: str, op: str, value: str, items: DataFrame | None = None) -> DataFrame:
    """Items that satisfy one term.

    With the table of all ``items``, terms that look for what is missing read the postings of their index alone.
    """
    ready = terms.is_ready(postings)
    if items is not None and (value == "" and op == "=" or op == "<>" and value != ""):
        found = postings.filter(F.col("index") == index) if value == "" else postings.filter(condition(index, "=", value, ready))
        return but_not(items.select("item_id").distinct(), found.select("item_id"))
    if value == "":
        if op != "=":
            raise ValueError("an empty value only goes with =")
        has_field = F.bool_or(F.col("index") == index)
        return postings.groupBy("item_id").agg(has_field.alias("has")).filter(~F.col("has")).select("item_id")
    if op == "<>":
        return select_items(postings, {"hit": (index, "=", value)}, lambda t: ~t["hit"])
    if op == "all":
        words = {f"w{place}": (index, "=", word) for place, word in enumerate(value.split())}
        rows = postings.filter(condition(index, "any", value, ready))
        return select_items(rows, words, lambda t: reduce(lambda a, b: a & b, t.values()), needs_hit=True)
    return postings.filter(condition(index, op, value, ready)).select("item_id").distinct()


def both(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.join(other, "item_id", "left_semi")


def either(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).distinct()


def but_not(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.join(other, "item_id", "left_anti")


def parse_numbers(text: str, expected: int) -> list[float]:
    numbers = [float(part) for part in text.split()]
    if len(numbers) != expected:
        raise ValueError(f"expected {expected} numbers: {text}")
    return numbers


def in_box(points: DataFrame, box: str, epsg: str | int | None = None) -> DataFrame:
    """Items inside the box ``"west south east north"`` of a reference system, edges included."""
    west, south, east, north = parse_numbers(box, 4)
    low_lon, low_lat = geo.to_wgs84(F.lit(west), F.lit(south), epsg)
    high_lon, high_lat = geo.to_wgs84(F.lit(east), F.lit(north), epsg)
    inside = F.col("lat").between(low_lat, high_lat) & F.col("lon").between(low_lon, high_lon)
    return points.filter(inside).select("item_id").distinct()


def within_km(
    points: DataFrame, lon: float, lat: float, km: float, least: float = geo.MIN_MILES / geo.MILES_PER_KM, most: float = geo.MAX_KM
) -> DataFrame:
    """Items within a radius of a WGS84 point; a radius outside ``least`` and ``most`` is refused (one mile, 30 km)."""
    if km < least or km > most:
        raise ValueError(f"radius out of range: {km}")
    # a box around the circle can use the column statistics of the files
    lat_margin = math.degrees(km / geo.EARTH_RADIUS_KM) * 1.001
    lon_margin = lat_margin / max(math.cos(math.radians(abs(lat) + lat_margin)), 1e-6)
    near = F.col("lat").between(lat - lat_margin, lat + lat_margin)
    if lon_margin < 180 and -180 <= lon - lon_margin and lon + lon_margin <= 180:
        near = near & F.col("lon").between(lon - lon_margin, lon + lon_margin)
    distance = geo.kilometres(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))
    return points.filter(near & (distance <= km)).select("item_id").distinct()


def index_alias(name: Column, context_set: str) -> Column:
    """Column form of ``catalog.resolve_index``."""
    prefix = context_set + "."
    bare = F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)
    return F.when(name == "cql.serverChoice", "text").when(bare == "replaces", "multipleReplaces").otherwise(bare)


def url_allowed(url: Column, allow: list[str]) -> Column:
    """Whether a URL contains one of the listed parts; an empty list allows all."""
    parts = [part.strip() for part in allow]
    return reduce(lambda a, b: a | b, [F.contains(url, F.lit(p)) for p in parts], F.lit(not parts))
