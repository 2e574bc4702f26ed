"""Relations between items: inverses, equivalence, resolving of identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.catalog import ONE_WAY, RELATED, REPLACES, REPLACES_PUBLIC, SAME_AS, inverse_names
from recordloom.operators.shuffle import top_per_group
from recordloom.session import durable, written

MODES = ("no", "yes", "sourceOnly", "targetsOnly")


def inverse_edges(relations: DataFrame, inverses: DataFrame) -> DataFrame:
    """Edges read backwards under the inverse name; names without an inverse are dropped."""
    names = F.broadcast(inverses.select("rel_type", "inverse"))
    return relations.join(names, "rel_type").select(
        F.col("target_uri").alias("item_id"),
        F.col("inverse").alias("rel_type"),
        F.col("item_id").alias("target_uri"),
        F.col("rel_type").alias("original_type"),
    )


def match_uri(requests: DataFrame, items: DataFrame, relations: DataFrame) -> DataFrame:
    """Items meant by a request: the item itself, and items that replace it.  Two equi joins."""
    wanted = requests.select("uri").distinct()
    own = wanted.join(items.select(F.col("item_id").alias("uri")).distinct(), "uri").select(
        "uri", F.col("uri").alias("item_id"), F.lit("id").alias("how")
    )
    newer = relations.filter(F.col("rel_type") == REPLACES).select(
        F.col("target_uri").alias("uri"), "item_id"
    ).distinct()
    return own.unionByName(wanted.join(newer, "uri").select("uri", "item_id", F.lit("replaces").alias("how")))


def gone(requests: DataFrame, items: DataFrame, relations: DataFrame, content: DataFrame) -> DataFrame:
    """Requests without a hit in the index whose record is, or was, in the store."""
    wanted = requests.select("uri").distinct()
    hits = match_uri(requests, items, relations).select("uri")
    return wanted.join(hits, "uri", "left_anti").join(content.select("uri"), "uri", "left_semi")


# ---- equivalence -------------------------------------------------------------------------

def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    moved = around.filter(F.col("b") > F.col("a")).join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).distinct()


def components(relations: DataFrame) -> DataFrame:
    """Closure over sameAs and replaces in both directions as (uri, component).

    Alternating large-star and small-star rounds end in one star per component in about log-squared
    rounds, also for chains; they go on until nothing moves.  Edges and minima are written tables, so both sides of a join
    are plain scans and adaptive execution splits the edges of a hub.  The component is named by its smallest uri.
    """
    edges = (
        relations.filter(F.col("rel_type").isin(SAME_AS, REPLACES))
        .select(F.col("item_id").alias("a"), F.col("target_uri").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .distinct()
    )
    edges, before = written(edges), None
    while (now := _fingerprint(edges)) != before:
        before = now
        edges = written(_small_star(written(_large_star(edges))))
    roots = edges.select(F.col("b").alias("uri")).distinct().select("uri", F.col("uri").alias("component"))
    return roots.unionByName(edges.select(F.col("a").alias("uri"), F.col("b").alias("component")))


# ---- relations of requested items --------------------------------------------------------

def _members(requests: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(request, member): the request itself and, with groups, everything equivalent to it."""
    own = requests.select(F.col("uri").alias("request"), F.col("uri").alias("member")).distinct()
    if groups is None:
        return own
    labelled = own.join(groups.select(F.col("uri").alias("member"), "component"), "member")
    mates = labelled.select("request", "component").join(
        groups.select(F.col("uri").alias("member"), "component"), "component"
    )
    return own.unionByName(mates.select("request", "member")).distinct()


def direct_relations(
    relations: DataFrame, inverses: DataFrame, requests: DataFrame, groups: DataFrame | None = None
) -> DataFrame:
    """Relations of the requests: their own, and inverted ones of items that point at them.

    Result: (request, rel_type, target_uri, source, original_type), one row per type and target.
    Identity relations that point at the request itself are read backwards.  An inferred plain
    relation is left out when a one-way relation to the same item exists.
    """
    members = _members(requests, groups)
    edges = relations.select("item_id", "rel_type", "target_uri")
    identity = F.col("rel_type").isin(SAME_AS, REPLACES)
    at_request = identity & (F.col("target_uri") == F.col("request"))

    own = (
        edges.join(members.withColumnRenamed("member", "item_id"), "item_id")
        .filter(~at_request)
        .select("request", "rel_type", "target_uri", F.lit("direct").alias("source"),
                F.lit(None).cast("string").alias("original_type"))
    )
    pointing = edges.join(members.withColumnRenamed("member", "target_uri"), "target_uri")
    outside = pointing.join(
        members.select("request", F.col("member").alias("item_id")), ["request", "item_id"], "left_anti"
    )
    reverse = outside.unionByName(pointing.filter(at_request)).distinct()
    names = F.broadcast(inverses.select("rel_type", "inverse"))
    inferred = reverse.join(names, "rel_type").select(
        "request", F.col("inverse").alias("rel_type"), F.col("item_id").alias("target_uri"),
        F.lit("reverse").alias("source"), F.col("rel_type").alias("original_type"),
    )
    one_way = own.filter(F.col("rel_type").isin(list(ONE_WAY))).select("request", "target_uri").distinct()
    plain = F.col("rel_type") == RELATED
    kept = inferred.filter(~plain).unionByName(
        inferred.filter(plain).join(one_way, ["request", "target_uri"], "left_anti")
    )
    return _one_per_target(own.unionByName(kept).filter(F.col("target_uri") != F.col("request")).withColumn(
        "rel_type", F.when(F.col("rel_type") == REPLACES, REPLACES_PUBLIC).otherwise(F.col("rel_type"))
    ))


def _one_per_target(edges: DataFrame) -> DataFrame:
    """One row per request, type and target; direct before reverse, then by original type."""
    best = F.min(F.struct("source", F.coalesce("original_type", F.lit("")).alias("t")))
    return edges.groupBy("request", "rel_type", "target_uri").agg(best.alias("_best")).select(
        "request", "rel_type", "target_uri", F.col("_best.source").alias("source"),
        F.nullif(F.col("_best.t"), F.lit("")).alias("original_type"),
    )


def widen_targets(edges: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Repeat every relation for all equivalents of its target, except the request's own items.

    Targets are first reduced to their component, so a component reached by many edges is expanded
    once per request and type, not once per edge.
    """
    labels = groups.select(F.col("uri").alias("target_uri"), "component")
    reached = edges.join(labels, "target_uri").groupBy("request", "rel_type", "component").agg(
        F.min(F.struct("source", F.coalesce("original_type", F.lit("")).alias("t"))).alias("_best")
    )
    wider = (
        reached.join(labels, "component")
        .join(members.select("request", F.col("member").alias("target_uri")), ["request", "target_uri"], "left_anti")
        .select("request", "rel_type", "target_uri", F.col("_best.source").alias("source"),
                F.nullif(F.col("_best.t"), F.lit("")).alias("original_type"))
    )
    known = edges.select("request", "rel_type", "target_uri")
    added = wider.join(known, ["request", "rel_type", "target_uri"], "left_anti")
    return edges.unionByName(added)


def limit_relations(edges: DataFrame, rel: str = "all", max_count: int | None = None) -> DataFrame:
    """Relations of one type, all of them or at most ``max_count`` per request; 0 gives none, a negative number all."""
    if rel != "all":
        if rel != REPLACES_PUBLIC and rel not in inverse_names():
            raise ValueError(f"unknown relation: {rel}")
        edges = edges.filter(F.col("rel_type") == (REPLACES_PUBLIC if rel == REPLACES else rel))
    if max_count is None or max_count < 0:
        return edges
    if max_count == 0:
        return edges.limit(0)
    order = [F.col("rel_type"), F.col("target_uri")]
    return top_per_group(edges, ["request"], order, max_count).drop("place")


def get_relations(
    relations: DataFrame,
    inverses: DataFrame,
    requests: DataFrame,
    infer: str = "no",
    rel: str = "all",
    max_count: int | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Relations of the requests; ``infer`` also follows equivalents of sources, targets or both.

    ``groups`` is the component table of the corpus; it is computed when needed and not given.
    """
    if infer not in MODES:
        raise ValueError(f"infer must be one of {MODES}")
    if infer != "no" and groups is None:
        groups = durable(components(relations))
    sources = groups if infer in ("yes", "sourceOnly") else None
    edges = direct_relations(relations, inverses, requests, sources)
    if infer in ("yes", "targetsOnly"):
        edges = widen_targets(edges, groups, _members(requests, sources))
    return limit_relations(edges, rel, max_count)


def relation_types(inverses: DataFrame, catalog: DataFrame) -> DataFrame:
    """Relation names with a title and the inverse name."""
    titles = catalog.select("name", "title")
    own = titles.select(F.col("name").alias("rel_type"), F.col("title").alias("own"))
    back = titles.select(F.col("name").alias("inverse"), F.col("title").alias("back"))
    joined = inverses.join(F.broadcast(own), "rel_type", "left").join(F.broadcast(back), "inverse", "left")
    title = F.coalesce(
        "own", F.concat(F.lit("Är/var "), F.lower("back"), F.lit(" för")), "rel_type"
    )
    return joined.select(F.col("rel_type").alias("name"), title.alias("title"), F.col("inverse").alias("reverse"))


# ---- resolver ----------------------------------------------------------------------------

def replacements(requests: DataFrame, relations: DataFrame) -> DataFrame:
    """Items that replace a request, one row each."""
    newer = relations.filter(F.col("rel_type") == REPLACES).select(
        F.col("target_uri").alias("uri"), F.col("item_id").alias("replaced_by")
    ).distinct()
    return requests.select("uri").distinct().join(newer, "uri")


def resolve(
    requests: DataFrame, docs: DataFrame, relations: DataFrame, content: DataFrame, fmt: str, own_base: str
) -> DataFrame:
    """Decision per requested uri: (uri, decision, location, n_choices).

    ``docs`` has item_id and ``target``: the payload of the format, or its URL for html and
    museumdat.  The alternatives of a multiple choice are the rows of ``replacements``.
    """
    wanted = requests.select("uri").distinct()
    newer = replacements(requests, relations).groupBy("uri").agg(
        F.count(F.lit(1)).alias("n_choices"), F.min("replaced_by").alias("replaced_by")
    )
    found = docs.select(F.col("item_id").alias("uri"), F.lit(True).alias("indexed"), "target")
    stored = content.select("uri", F.lit(True).alias("stored"))
    joined = wanted.join(found, "uri", "left").join(newer, "uri", "left").join(stored, "uri", "left")
    links = fmt in ("html", "museumdat")
    n = F.coalesce("n_choices", F.lit(0))
    hit = F.coalesce("indexed", F.lit(False)) | (n > 0)
    decision = (
        F.when(~hit & F.col("stored"), "gone")
        .when(n == 1, "redirect")
        .when(n > 1, "choices")
        .when(F.col("target").isNull(), "not found")
        .when(F.lit(links) & F.lower("target").startswith(own_base), "bad request")
        .when(F.lit(links), "redirect")
        .otherwise("found")
    )
    location = F.when(n == 1, F.col("replaced_by")).when(n > 1, None).otherwise(F.col("target"))
    return joined.select("uri", decision.alias("decision"), location.alias("location"), n.alias("n_choices"))
