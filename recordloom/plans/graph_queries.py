"""Registered queries: relations, equivalence, resolver."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.catalog import INDEXES, ONE_WAY, index_catalog, inverse_map, inverse_names
from recordloom.operators import graph
from recordloom.plans.bindings import (
    BASE, DOC_RELATIONS, ORDER_RELATIONS, doc_relations, order_relations, padded, table, with_ctes,
)
from recordloom.plans.registry import query
from recordloom.session import durable

_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in inverse_names().items())
INVERSES = f"inv AS (SELECT * FROM (VALUES {_PAIRS}) AS t(rel_type, inverse))"
_ONE_WAY = ", ".join(f"'{name}'" for name in ONE_WAY)

# relations of requests that are only themselves
_DIRECT = f""", own AS (
  SELECT r.uri AS request, rel_type, target_uri, 'direct' AS source, CAST(NULL AS VARCHAR) AS original_type
  FROM requests r JOIN relations e ON e.item_id = r.uri
), back AS (
  SELECT r.uri AS request, inverse AS rel_type, e.item_id AS target_uri, 'reverse' AS source, e.rel_type AS original_type
  FROM requests r JOIN relations e ON e.target_uri = r.uri JOIN inv ON inv.rel_type = e.rel_type
), kept AS (
  SELECT * FROM own UNION ALL SELECT * FROM back b WHERE b.rel_type <> 'isRelatedTo' OR NOT EXISTS (
    SELECT 1 FROM own o WHERE o.request = b.request AND o.target_uri = b.target_uri AND o.rel_type IN ({_ONE_WAY}))
), edges AS (
  SELECT request, rel_type, target_uri, source, nullif(original_type, '') AS original_type FROM (
    SELECT request, CASE rel_type WHEN 'multipleReplaces' THEN 'replaces' ELSE rel_type END AS rel_type, target_uri, source,
      coalesce(original_type, '') AS original_type, row_number() OVER (PARTITION BY request,
        CASE rel_type WHEN 'multipleReplaces' THEN 'replaces' ELSE rel_type END, target_uri
        ORDER BY source, coalesce(original_type, '')) AS rn
    FROM kept WHERE target_uri <> request) WHERE rn = 1
)"""
_CUSTOMERS = "requests AS (SELECT 'agent/' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS uri FROM customer)"
_ORDERS = "requests AS (SELECT 'item/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS uri FROM orders)"


def _customers(spark, folder):
    return table(spark, folder, "customer").select(padded("agent/", "c_custkey").alias("uri"))


def _orders(spark, folder):
    return table(spark, folder, "orders").select(padded("item/", "o_orderkey").alias("uri"))


@query("j03_relation_inverse", with_ctes(
    "SELECT e.target_uri AS item_id, inverse AS rel_type, e.item_id AS target_uri, e.rel_type AS original_type "
    "FROM relations e JOIN inv ON e.rel_type = inv.rel_type", ORDER_RELATIONS, INVERSES))
def relation_inverse(spark, folder):
    return graph.inverse_edges(order_relations(spark, folder), inverse_map(spark))


@query("j04_resolve_match", with_ctes(
    "SELECT uri, uri AS item_id, 'id' AS how FROM requests WHERE uri IN (SELECT item_id FROM items) UNION ALL "
    "SELECT DISTINCT r.uri, e.item_id, 'replaces' FROM requests r JOIN relations e ON e.target_uri = r.uri "
    "AND e.rel_type = 'multipleReplaces'", ORDER_RELATIONS, _ORDERS,
    "items AS (SELECT 'item/' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS item_id FROM lineitem)"))
def resolve_match(spark, folder):
    items = table(spark, folder, "lineitem").select(padded("item/", "l_orderkey").alias("item_id"))
    return graph.match_uri(_orders(spark, folder), items, order_relations(spark, folder))


@query("j05_gone_check", with_ctes(
    "SELECT uri FROM requests WHERE uri NOT IN (SELECT item_id FROM items) AND uri NOT IN (SELECT target_uri FROM relations "
    "WHERE rel_type = 'multipleReplaces') AND uri IN (SELECT 'item/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') FROM orders "
    "WHERE o_orderstatus <> 'O')", ORDER_RELATIONS, _ORDERS,
    "items AS (SELECT 'item/' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS item_id FROM lineitem)"))
def gone_check(spark, folder):
    items = table(spark, folder, "lineitem").select(padded("item/", "l_orderkey").alias("item_id"))
    stored = table(spark, folder, "orders").filter(F.col("o_orderstatus") != "O")
    content = stored.select(padded("item/", "o_orderkey").alias("uri"))
    return graph.gone(_orders(spark, folder), items, order_relations(spark, folder), content)


@query("g01_direct_relations", with_ctes("SELECT * FROM edges", ORDER_RELATIONS, INVERSES, _CUSTOMERS + _DIRECT))
def direct_relations(spark, folder):
    return graph.direct_relations(order_relations(spark, folder), inverse_map(spark), _customers(spark, folder))


@query("g02_sameas_sources", with_ctes("SELECT uri, component FROM comp", DOC_RELATIONS))
def sameas_sources(spark, folder):
    return graph.components(doc_relations(spark, folder))


# every source with what hangs on it: each part is repeated for the copies of the part
_WIDE = """, known AS (
  SELECT DISTINCT target_uri AS request, item_id AS target_uri FROM relations WHERE rel_type = 'isPartOf'
), wide AS (
  SELECT DISTINCT k.request, m.uri AS target_uri FROM known k JOIN comp c ON c.uri = k.target_uri
  JOIN comp m ON m.component = c.component
)"""


@query("g03_sameas_targets", with_ctes(
    "SELECT request, 'hasPart' AS rel_type, target_uri, 'reverse' AS source, 'isPartOf' AS original_type FROM "
    "(SELECT * FROM known UNION SELECT * FROM wide)", DOC_RELATIONS + _WIDE))
def sameas_targets(spark, folder):
    relations = doc_relations(spark, folder)
    requests = table(spark, folder, "documents").select(F.concat(F.lit("src/"), F.col("source")).alias("uri")).distinct()
    return graph.get_relations(relations, inverse_map(spark), requests, infer="targetsOnly", max_count=-1)


@query("g03_sameas_sources_only", with_ctes(
    "SELECT DISTINCT component AS request, 'isPartOf' AS rel_type, target_uri, 'direct' AS source, "
    "CAST(NULL AS VARCHAR) AS original_type FROM relations JOIN comp ON item_id = uri WHERE rel_type = 'isPartOf' "
    "UNION SELECT component, 'sameAs', uri, 'reverse', 'sameAs' FROM comp WHERE uri <> component", DOC_RELATIONS))
def sources_only(spark, folder):
    """One request per group of copies: the first copy, which answers for all of them."""
    relations = doc_relations(spark, folder)
    groups = durable(graph.components(relations))
    requests = groups.select(F.col("component").alias("uri")).distinct()
    return graph.get_relations(
        relations, inverse_map(spark), requests, infer="sourceOnly", max_count=-1, groups=groups
    )


@query("g04_relation_filter_limit", with_ctes(
    "SELECT request, rel_type, target_uri, source, original_type FROM (SELECT *, row_number() OVER (PARTITION BY request "
    "ORDER BY rel_type, target_uri) AS place FROM edges WHERE rel_type = 'is_former_or_current_owner_of') WHERE place <= 5",
    ORDER_RELATIONS, INVERSES, _CUSTOMERS + _DIRECT))
def relation_filter_limit(spark, folder):
    return graph.get_relations(
        order_relations(spark, folder), inverse_map(spark), _customers(spark, folder),
        rel="is_former_or_current_owner_of", max_count=5,
    )


_TITLES = ", ".join("('{}', '{}')".format(i.name, i.title.replace("'", "''")) for i in INDEXES.values())


@query("g05_relation_types", with_ctes(
    "SELECT i.rel_type AS name, coalesce(own.title, 'Är/var ' || lower(back.title) || ' för', i.rel_type) AS title, "
    "i.inverse AS reverse, n FROM (SELECT rel_type, count(*) AS n FROM relations GROUP BY 1) e "
    "JOIN inv i ON i.rel_type = e.rel_type LEFT JOIN titles own ON own.name = i.rel_type "
    "LEFT JOIN titles back ON back.name = i.inverse", ORDER_RELATIONS, INVERSES,
    f"titles AS (SELECT * FROM (VALUES {_TITLES}) AS t(name, title))"))
def relation_types(spark, folder):
    used = order_relations(spark, folder).groupBy(F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    types = graph.relation_types(inverse_map(spark), index_catalog(spark))
    return used.join(F.broadcast(types), "name").select("name", "title", "reverse", "n")


_RESOLVE = f""", docs AS (
  SELECT 'item/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS uri,
    CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN '{BASE}x/' || o_orderkey
    ELSE 'http://www.example.com/' || o_orderkey END AS target FROM orders WHERE o_orderstatus <> 'O'
), newer AS (
  SELECT target_uri AS uri, count(DISTINCT item_id) AS n_choices, min(item_id) AS replaced_by FROM relations
  WHERE rel_type = 'multipleReplaces' GROUP BY target_uri
)"""


@query("g06_resolve", with_ctes(
    "SELECT r.uri, CASE WHEN d.uri IS NULL AND n.uri IS NULL THEN CASE WHEN s.uri IS NOT NULL THEN 'gone' ELSE 'not found' END "
    "WHEN n_choices = 1 THEN 'redirect' WHEN n_choices > 1 THEN 'choices' WHEN target IS NULL THEN 'not found' "
    f"WHEN starts_with(lower(target), '{BASE}') THEN 'bad request' ELSE 'redirect' END AS decision, "
    "CASE WHEN n_choices = 1 THEN replaced_by WHEN n_choices > 1 THEN NULL ELSE target END AS location, "
    "coalesce(n_choices, 0) AS n_choices FROM (SELECT uri FROM requests UNION SELECT target_uri FROM relations) r "
    "LEFT JOIN docs d ON d.uri = r.uri LEFT JOIN newer n ON n.uri = r.uri LEFT JOIN requests s ON s.uri = r.uri",
    ORDER_RELATIONS, _ORDERS + _RESOLVE))
def resolve(spark, folder):
    relations, known = order_relations(spark, folder), _orders(spark, folder)
    requests = known.unionByName(relations.select(F.col("target_uri").alias("uri")))
    key = F.col("o_orderkey").cast("string")
    target = (
        F.when(F.col("o_orderpriority") == "1-URGENT", None)
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit(BASE + "x/"), key))
        .otherwise(F.concat(F.lit("http://www.example.com/"), key))
    )
    docs = table(spark, folder, "orders").filter(F.col("o_orderstatus") != "O").select(
        padded("item/", "o_orderkey").alias("item_id"), target.alias("target")
    )
    return graph.resolve(requests, docs, relations, known, "html", BASE)
