"""Sorted pages, relevance, exported fields and stem sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.catalog import ANALYZED, EXPORT_ALIASES, INDEXES, NOT_EXPORTED, index_exists, index_type
from recordloom.functions.scalars import blank_to_null
from recordloom.functions.text import stem, tokens
from recordloom.operators import shuffle, terms

# Page sizes, and the published BM25 parameters.
MAX_PAGE, SEARCH_PAGE, FEED_PAGE = 1000, 50, 100
K1, B = 1.2, 0.75

# Running steps of a source, in the order of the overview.
STEPS = ("FETCH", "STORE", "INDEX", "EMPTYINDEX", "IDLE")


def page_size(wanted: int | None, default: int = SEARCH_PAGE) -> int:
    """The page size that the web API serves for a request: what is asked within 1..1000, else the default."""
    return wanted if wanted is not None and 1 <= wanted <= MAX_PAGE else default


def page(
    items: DataFrame, postings: DataFrame, sort: str, desc: bool = False, start: int = 1, size: int = SEARCH_PAGE
) -> DataFrame:
    """One page of items by a sortable index; items without a value come last, ties go by id."""
    if size < 1:
        raise ValueError(f"bad page size: {size}, must be > 0")
    if not index_exists(sort):
        raise ValueError(f"unknown sort index: {sort}")
    if sort not in INDEXES or not INDEXES[sort].is_sortable:
        raise ValueError(f"index cannot be sorted: {sort}")
    keys = postings.filter(F.col("index") == sort).groupBy("item_id").agg(F.min("value").alias("sort_value"))
    rows = items.select("item_id").distinct().join(keys, "item_id", "left")
    return shuffle.selected_page(rows, ["sort_value", "item_id"], [desc, False], max(start, 1), size)


def bm25(postings: DataFrame, words: Sequence[str], k: int, index: str = "text") -> DataFrame:
    """Best ``k`` items for some words by BM25 over an analysed index.

    Word counts come from inside each row; corpus figures are scalar subqueries, not a join.
    """
    if index_type(index) != ANALYZED:
        raise ValueError(f"index is not analysed: {index}")
    wanted = sorted({word.lower() for word in words})
    split = postings.filter(F.col("index") == index).select(
        "item_id", terms.words(terms.is_ready(postings)).alias("_t"))

    def count_of(word: str) -> Column:
        return F.size(F.filter("_t", lambda token: token == word))

    rows = (
        split.select("item_id", F.size("_t").alias("_len"), *[
            count_of(word).alias(f"_tf{place}") for place, word in enumerate(wanted)
        ])
        .groupBy("item_id")
        .agg(F.sum("_len").alias("_len"), *[F.sum(f"_tf{place}").alias(f"_tf{place}") for place in range(len(wanted))])
    )
    corpus = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean"),
        *[F.count_if(F.col(f"_tf{place}") > 0).alias(f"df{place}") for place in range(len(wanted))],
    )
    # one subquery for all figures: Spark runs it once
    figures = corpus.select(F.struct("*")).scalar()
    score = F.lit(0.0)
    for place in range(len(wanted)):
        df, tf = figures[f"df{place}"], F.col(f"_tf{place}")
        idf = F.log(1 + (figures["n"] - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / figures["mean"]))
    found = F.greatest(*[F.col(f"_tf{place}") for place in range(len(wanted))], F.lit(0)) > 0
    return (
        rows.filter(found)
        .select("item_id", score.alias("score"))
        .orderBy(F.desc("score"), F.asc("item_id"))
        .limit(k)
    )


def check_sort(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests (column ``index``) with whether they name a sortable index."""
    names = catalog.select(F.col("name").alias("index"), "is_sortable")
    return requests.join(F.broadcast(names), "index", "left").withColumn(
        "verdict",
        F.when(F.col("is_sortable").isNull(), "unknown")
        .when(F.col("is_sortable"), "sortable")
        .otherwise("not sortable"),
    ).drop("is_sortable")


def service_board(services: DataFrame, sort: str = "name", desc: bool = False) -> DataFrame:
    """Sources in overview order: running step, then one column in Swedish order, with the position."""
    columns = {"name": "name", "id": "serviceid", "date": "lastharvestdate"}
    step = F.lit(len(STEPS))
    for place, name in enumerate(STEPS):
        step = F.when(F.col("step") == name, place).otherwise(step)
    key = F.collate(F.coalesce(F.col(columns[sort]).cast("string"), F.lit("")), "sv")
    ordered = [step.asc(), key.desc() if desc else key.asc(), F.col("serviceid").asc()]
    return shuffle.global_rank(services, ordered, "place")


def export_fields(postings: DataFrame, items: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Selected fields of the hits as (item_id, field, pos, value); blank values are dropped."""
    wanted = list(dict.fromkeys(["itemId", *[field.strip() for field in fields]]))
    for field in wanted:
        known = index_exists(field) or field in EXPORT_ALIASES
        if not known or field in NOT_EXPORTED or field.startswith("_"):
            raise ValueError(f"field is unknown or cannot be exported: {field}")
    stored = {EXPORT_ALIASES.get(field, field): field for field in wanted}
    name = F.col("index")
    for internal, public in stored.items():
        if internal != public:
            name = F.when(F.col("index") == internal, public).otherwise(name)
    return (
        postings.filter(F.col("index").isin(list(stored)))
        .join(items.select("item_id"), "item_id", "left_semi")
        .select("item_id", name.alias("field"), "pos", blank_to_null("value").alias("value"))
        .filter(F.col("value").isNotNull())
    )


def stems(docs: DataFrame, column: str = "value") -> DataFrame:
    """Distinct words of a corpus with their stems; each word is stemmed once."""
    words = docs.select(F.explode(F.array_distinct(tokens(column))).alias("word")).distinct()
    return words.select("word", stem("word").alias("stem"))


def distinct_values(rows: DataFrame) -> DataFrame:
    return rows.distinct()
