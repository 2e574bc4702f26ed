"""Facets, term lists and combination counts over postings."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.catalog import ANALYZED, COUNTED_INDEXES, LOWER, index_exists, index_type, normalise
from recordloom.operators import terms as search_forms
from recordloom.operators.shuffle import parts_for, top_per_group
from recordloom.session import written

# Largest product of term lists that is listed whole, and suggestions when no number is given.
MAX_COMBINATIONS = 20_000
DEFAULT_SUGGESTIONS = 3

# Rows of postings that one task of a join by item sorts.
JOIN_ROWS = 500_000


def _check(indexes: Sequence[str]) -> None:
    unknown = [name for name in indexes if not index_exists(name)]
    if unknown:
        raise ValueError(f"unknown index: {', '.join(unknown)}")


def _stored_values(postings: DataFrame, indexes: Sequence[str]) -> DataFrame:
    """(item_id, index, value) with values as the index stores them: lower case or words."""
    _check(indexes)
    analysed = [name for name in indexes if index_type(name) == ANALYZED]
    lowered = [name for name in indexes if index_type(name) == LOWER]
    whole = [name for name in indexes if name not in analysed]
    ready = search_forms.is_ready(postings)
    value = F.col("term") if ready else F.when(F.col("index").isin(lowered), F.lower("value")).otherwise(F.col("value"))
    parts = []
    if whole:
        parts.append(postings.filter(F.col("index").isin(whole)).select("item_id", "index", value.alias("value")))
    if analysed:
        words = F.explode(F.array_distinct(search_forms.words(ready))).alias("value")
        parts.append(postings.filter(F.col("index").isin(analysed)).select("item_id", "index", words))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def terms_of(postings: DataFrame, indexes: Sequence[str]) -> DataFrame:
    """Distinct (item_id, index, value) with values as the index stores them."""
    return _stored_values(postings, indexes).distinct()


def facet(
    postings: DataFrame, items: DataFrame | None, indexes: Sequence[str], min_count: int = 0
) -> DataFrame:
    """Items per index and value among ``items`` (all items when None).

    With ``min_count`` 0 the values without a match are listed too: one left join keeps the value
    domain, so it is not built a second time.
    """
    terms = terms_of(postings, indexes)
    if items is None:
        counted = terms.groupBy("index", "value").agg(F.count(F.lit(1)).alias("n"))
    elif min_count > 0:
        hits = terms.join(items.select("item_id"), "item_id", "left_semi")
        counted = hits.groupBy("index", "value").agg(F.count(F.lit(1)).alias("n"))
    else:
        marked = items.select("item_id").distinct().withColumn("_hit", F.lit(1))
        counted = terms.join(marked, "item_id", "left").groupBy("index", "value").agg(F.count("_hit").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def unique_values(
    postings: DataFrame,
    items: DataFrame | None = None,
    indexes: Sequence[str] = tuple(COUNTED_INDEXES),
    approx: bool = False,
) -> DataFrame:
    """Number of distinct values per index among matching items; indexes without values are left out.

    Both sides of the join are dealt by item in partitions of about ``JOIN_ROWS`` rows and merged, so neither what a task sorts nor a broadcast grows
    with the table.
    """
    _check(indexes)
    rows = postings.filter(F.col("index").isin(list(indexes)))
    if items is not None:
        parts = parts_for(rows, JOIN_ROWS)
        wanted = items.select("item_id").repartition(parts, "item_id").hint("merge")
        rows = rows.repartition(parts, "item_id").join(wanted, "item_id", "left_semi")
    values = _stored_values(rows, indexes).select("index", "value")
    counter = F.approx_count_distinct if approx else F.count_distinct
    return values.groupBy("index").agg(counter("value").alias("n"))


def _prefix(index: str, pattern: str | None) -> str:
    return normalise(index, pattern.replace("*", "")) if pattern and pattern.replace("*", "") else ""


def _wanted(specs: Sequence[tuple[str, str | None]]) -> Column:
    """Rows of the indexes whose value starts as the pattern says."""
    rules = [(F.col("index") == index) & F.col("value").startswith(_prefix(index, pattern)) for index, pattern in specs]
    return reduce(lambda a, b: a | b, rules)


def _term_counts(postings: DataFrame, specs: Sequence[tuple[str, str | None]], min_count: int) -> DataFrame:
    """Items per index and value, for all indexes in one pass."""
    found = terms_of(postings, [index for index, _ in specs]).filter(_wanted(specs))
    return found.groupBy("index", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def terms(
    postings: DataFrame, index: str, prefix: str | None = None, min_count: int = 0, n: int | None = None
) -> DataFrame:
    """Values of an index with a prefix, all or the ``n`` most frequent; every ``*`` in the prefix is ignored."""
    ordered = _term_counts(postings, [(index, prefix)], min_count).orderBy(F.desc("n"), F.asc("value"))
    return ordered if n is None else ordered.limit(n)


def suggest(
    postings: DataFrame, indexes: Sequence[str], prefix: str, n: int = DEFAULT_SUGGESTIONS,
    last_only: bool = False,
) -> DataFrame:
    """First ``n`` values per index; ``last_only`` keeps just the last index, as older clients expect."""
    wanted = list(indexes)[-1:] if last_only else list(indexes)
    found = terms_of(postings, wanted)
    starts = [(F.col("index") == name) & F.col("value").startswith(_prefix(name, prefix)) for name in wanted]
    rule = starts[0]
    for start in starts[1:]:
        rule = rule | start
    counted = found.filter(rule).groupBy("index", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counted, ["index"], [F.desc("n"), F.asc("value")], n)


# ---- combinations ------------------------------------------------------------------------

def _term_lists(
    postings: DataFrame, specs: Mapping[str, str | None], remove_below: int, cap: int
) -> tuple[dict[str, DataFrame], int]:
    """Term list per index, from one pass over the postings, and the size of their product, checked first."""
    counted = written(_term_counts(postings, list(specs.items()), remove_below).select("index", "value"))
    sizes = {row["index"]: row["count"] for row in counted.groupBy("index").count().collect()}
    total = math.prod(sizes.get(index, 0) for index in specs)
    if total > cap:
        raise ValueError(f"the term lists have {total} combinations, the limit is {cap}")
    return {index: counted.filter(F.col("index") == index).select("value") for index in specs}, total


def _product(lists: Mapping[str, DataFrame], total: int) -> DataFrame:
    """All combinations: numbers 0..total-1, each digit looked up in one (small, numbered) list."""
    spark = next(iter(lists.values())).sparkSession
    rows, stride = spark.range(total), 1
    for place, (index, values) in enumerate(lists.items(), start=1):
        size = values.count() if total else 0
        digit = f"_d{place}"
        ranked = values.select(
            (F.row_number().over(Window.orderBy("value")) - 1).cast("bigint").alias(digit),
            F.col("value").alias(f"v{place}"),
        )
        key = F.floor(F.col("id") / stride).cast("bigint") % max(size, 1)
        rows = rows.withColumn(digit, key).join(F.broadcast(ranked), digit).drop(digit)
        stride *= max(size, 1)
    return rows.drop("id")


def term_product(
    postings: DataFrame, specs: Mapping[str, str | None], remove_below: int = 0, cap: int = MAX_COMBINATIONS
) -> DataFrame:
    """Combinations of the values of several indexes as v1..vk."""
    lists, total = _term_lists(postings, specs, remove_below, cap)
    return _product(lists, total)


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows whose keys are at least so frequent among them."""
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys)
    return rows.join(written(often), keys, "left_semi")


def statistic(
    postings: DataFrame,
    specs: Mapping[str, str | None],
    remove_below: int = 0,
    items: DataFrame | None = None,
    cap: int = MAX_COMBINATIONS,
) -> DataFrame:
    """Items per combination of values; with ``remove_below`` 0 empty combinations are listed.

    One shuffle by item gathers the item's values per index (at most one term list each), and the
    combinations are exploded from there.  With ``remove_below`` above 1, terms and the first two, three … values of a combination that
    are too rare themselves are dropped before the next index is exploded: what is made of an item follows what is frequent, not the
    product of its values.  ``items`` restricts the counts, not the term lists.  ``cap`` bounds the listing of empty combinations,
    nothing else.
    """
    columns = [f"v{place}" for place in range(1, len(specs) + 1)]
    rows = terms_of(postings, list(specs)).filter(_wanted(list(specs.items())))
    if items is not None:
        rows = rows.join(items.select("item_id"), "item_id", "left_semi")
    if remove_below > 1:
        rows = _frequent(written(rows.select("item_id", "index", "value")), ["index", "value"], remove_below)
    gathered = rows.groupBy("item_id").agg(
        *[
            F.collect_list(F.when(F.col("index") == index, F.col("value"))).alias(column)
            for index, column in zip(specs, columns)
        ]
    )
    if remove_below > 1 and len(columns) > 2:
        gathered = written(gathered)
    for place, column in enumerate(columns, start=1):
        gathered = gathered.withColumn(column, F.explode(column))
        if remove_below > 1 and 1 < place < len(columns):
            gathered = _frequent(gathered, columns[:place], remove_below)
    counts = gathered.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    if remove_below > 0:  # a combination is never more frequent than its terms: no list is needed
        return counts.filter(F.col("n") >= remove_below)
    lists, total = _term_lists(postings, specs, remove_below, cap)
    return _product(lists, total).join(counts, columns, "left").na.fill(0, ["n"])


# ---- other aggregates --------------------------------------------------------------------

def total(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("n"))


def joined(values: DataFrame) -> DataFrame:
    """Values of a field in reading order, joined by one space; blank gives null.

    A record is one harvested row, so the values of one field of one item are few.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    text = F.array_join(F.transform(ordered, lambda entry: entry["value"]), " ")
    return values.groupBy("item_id", "index").agg(F.nullif(F.trim(text), F.lit("")).alias("value"))


def first_value(values: DataFrame) -> DataFrame:
    """First of several values of a field."""
    return values.groupBy("item_id", "index").agg(F.min(F.struct("pos", "value"))["value"].alias("value"))


def message_report(messages: DataFrame) -> DataFrame:
    """Distinct messages with their number and first place; one row says so when there are none."""
    report = messages.groupBy("message").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "col")).alias("_first")
    ).select("message", "n", F.col("_first.row").alias("row"), F.col("_first.col").alias("col"))
    empty = messages.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0).select(
        F.lit("no errors").alias("message"), "n",
        F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("bigint").alias("col"),
    )
    return report.unionByName(empty)


def geo_rollup(items: DataFrame, municipality: DataFrame, county: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Items per municipality, county and in total, with the labels of the parent tables; items without a known place count, too."""
    placed = items.join(municipality, "municipality", "left").join(county, "county", "left")
    named = placed.withColumns({name: F.coalesce(name, F.lit(unknown)) for name in ("county_name", "municipality_name")})
    return named.rollup("county_name", "municipality_name").agg(F.count(F.lit(1)).alias("n"))
