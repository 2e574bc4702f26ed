"""Registered queries: extraction from triples made of orders (items) and lines (contexts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators import extract
from recordloom.plans.bindings import BASE, NAMES, item_postings, moment, spread, table, text, with_ctes, POSTINGS
from recordloom.plans.registry import query
from recordloom.sources import harvest
from recordloom.vocabulary import PUBLIC_NAMESPACES

_VERSIONS = ["0.97", "1.0", "1.1", "1.11", "1.2.0", "1.3.0", "2.0"]
_TYPE = NAMES.resource("EntityType#")
_SUPER = NAMES.resource("EntitySuperType#")
_COUNTY, _PROVINCE = NAMES.area("county"), NAMES.area("province")


def _uri(prefix: str, key: Column | str) -> Column:
    return F.concat(F.lit(prefix), text(key))


def _version(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in _VERSIONS]), (F.col(key) % 7 + 1).cast("int"))


def _ruled(rows: DataFrame, key: str, usable: bool) -> DataFrame:
    """Orders or lines with the version of their record; where only ``usable`` ones are asked, with its rules, which then need no look at each statement."""
    stated = rows.withColumn("version", _version(key))
    return extract.versioned(stated, NAMES).filter(F.col("rules").isNotNull()) if usable else stated


def item_triples(spark, folder, gates: DataFrame | None = None, dealt: bool = False, usable: bool = False) -> DataFrame:
    """Statements about the item: one row per order and predicate.

    ``gates`` (item_id, barred) are joined to the orders, not to their many statements; orders are ``dealt`` by item for steps that gather items.
    """
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    item = _uri(BASE + "item/", key)
    full = NAMES.full
    stated = [
        # predicate, object, kind
        (PUBLIC_NAMESPACES["rdf"] + "type", F.lit(full("Entity")), "uri"),
        (full(NAMES.version_property), _version("o_orderkey"), "literal"),
        (full("itemTitle"), F.concat(F.lit("  Order "), text(key), F.lit(" ")), "literal"),
        (full("itemLabel"), priority, "literal"),
        (full("itemType"), _uri(_TYPE, status), "uri"),
        (full("itemSuperType"), F.when(priority != "3-MEDIUM", F.lit(_SUPER + "object")), "uri"),
        (full("createdDate"), day, "literal"),
        (full("itemForIndexing"), F.when((status == "F") & (priority == "5-LOW"), "n"), "literal"),
        (full("thumbnail"), F.when(status == "O", _uri("http://img.example.com/", key)), "literal"),
        (full("url"), F.when(priority == "1-URGENT", _uri(BASE + "item/", key)).otherwise(
            _uri("http://www.example.com/", key)), "literal"),
        (full("isRelatedTo"), _uri(BASE + "agent/", "o_custkey"), "uri"),
        (full("owl:sameAs"), F.when(status == "P", _uri(BASE + "item/", key - 1)), "uri"),
        (full("terms:replaces"), F.when(priority == "2-HIGH", _uri(BASE + "old/", key)), "uri"),
        (full("itemLicense"), F.lit("http://license.example.com/a"), "literal"),
        (full("itemLicense"), F.when((status == "P") & (priority == "2-HIGH"), "http://license.example.com/b"), "literal"),
        (full("itemName"), F.lit("_:n"), "blank"),
    ]
    rows = F.array(*[
        F.struct(F.lit(p).alias("predicate"), o.alias("object"), F.lit(k).alias("object_kind"), F.lit(i).alias("pos"))
        for i, (p, o, k) in enumerate(stated)
    ])
    orders = table(spark, folder, "orders").select(
        item.alias("item_id"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    if dealt or gates is not None:
        orders = spread(orders, "item_id")
    carried = ([] if gates is None else ["barred"]) + (["rules"] if usable else [])
    if gates is not None:
        orders = orders.join(gates, "item_id")
    orders = _ruled(orders, "o_orderkey", usable)
    top = orders.select("item_id", "version", *carried, F.explode(rows).alias("e")).select(
        "item_id", F.col("item_id").alias("subject"), F.lit("").alias("via"),
        "e.predicate", "e.object", "e.object_kind", "e.pos", "version", *carried,
    ).filter(F.col("object").isNotNull())
    names = orders.select(
        "item_id", F.lit("_:n").alias("subject"), F.lit(full("itemName")).alias("via"),
        F.lit(full("name")).alias("predicate"), F.concat(priority, F.lit(" name")).alias("object"),
        F.lit("literal").alias("object_kind"), F.lit(90).alias("pos"), "version", *carried,
    )
    return top.unionByName(names)


def context_triples(spark, folder, gates: DataFrame | None = None, usable: bool = False) -> DataFrame:
    """Statements about contexts and images: one node per distinct line of an order.

    Lines are dealt by item before they become many statements, so steps that gather items or nodes need not move these.
    """
    lines = table(spark, folder, "lineitem").select(
        _uri(BASE + "item/", "l_orderkey").alias("item_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    # a maximum of texts is found by sorting; numbers first, as addresses begin alike and are slow to compare
    lines = spread(lines, "item_id").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "item_id").agg(
        F.max("l_returnflag").alias("flag"), F.max(F.year("l_shipdate")).alias("year")
    )
    carried = ([] if gates is None else ["barred"]) + (["rules"] if usable else [])
    if gates is not None:
        lines = lines.join(gates, "item_id")
    lines = _ruled(lines, "l_orderkey", usable)
    number, part, supp, year = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("year")
    full = NAMES.full
    kind = F.when(F.col("flag") == "A", "produce").when(F.col("flag") == "N", "use").otherwise("bogus")
    start = F.when(number == 5, "?").when(number == 6, "null").otherwise(text(year))
    stated = [
        (full("contextType"), F.when(number != 7, _uri(NAMES.context_type, kind)), "uri"),
        (full("contextSuperType"), F.when(part > 40, F.lit(NAMES.context_supertype + "create")), "uri"),
        (full("fromTime"), start, "literal"),
        (full("toTime"), F.when(number == 2, text(year + 12)).when(number == 3, "soon"), "literal"),
        (full("geo:county"), _uri(_COUNTY + "0", supp), "uri"),
        (full("geo:province"), _uri(_PROVINCE, F.col("flag")), "uri"),
        (full("foaf:firstName"), _uri("F", supp), "literal"),
        (full("foaf:surname"), F.when(number < 6, _uri("S", part)), "literal"),
        (full("foaf:fullName"), F.when(number == 1, _uri("Full ", part)), "literal"),
        (full("nameAuth"), F.when(number == 2, "VIAF"), "literal"),
        (full("nameId"), text(part), "literal"),
        (full("periodAuth"), F.when(number == 3, "http://mis.historiska.se/rdf/period"), "literal"),
        (full("fromPeriodId"), text(supp), "literal"),
        (full("author"), _uri(BASE + "agent/", supp), "uri"),
        (full("clientOf"), F.when(F.col("flag") == "R", F.when(part < 200, _uri(BASE + "x/", part))), "uri"),
        (full("cidoc:P51F.has_former_or_current_owner"), _uri(BASE + "owner/", part), "uri"),
    ]
    media = [
        (full("mediaLicense"), F.when(part > 150, F.lit("http://license.example.com/m")), "uri"),
        (full("thumbnailSource"), _uri("http://img.example.com/s", part), "literal"),
    ]

    def rows(via, rules, subject, where):
        entries = F.array(*[
            F.struct(F.lit(p).alias("predicate"), o.alias("object"), F.lit(k).alias("object_kind"), F.lit(100 + i).alias("pos"))
            for i, (p, o, k) in enumerate(rules)
        ])
        node = F.concat_ws("-", F.lit(subject), text(number), text(part), text(supp))
        return lines.filter(where).select(
            "item_id", node.alias("subject"), "version", *carried, F.explode(entries).alias("e"),
        ).select(
            "item_id", "subject", F.lit(full(via)).alias("via"), "e.predicate", "e.object", "e.object_kind", "e.pos", "version", *carried,
        ).filter(F.col("object").isNotNull())

    return rows("context", stated, "_:c", F.lit(True)).unionByName(rows("image", media, "_:i", number == 4))


def all_triples(spark, folder, gates: DataFrame | None = None, dealt: bool = False, usable: bool = False) -> DataFrame:
    return item_triples(spark, folder, gates, dealt, usable).unionByName(context_triples(spark, folder, gates, usable))


def vocab(spark) -> DataFrame:
    rows = [
        ("1.0", _TYPE + "F", "Fulfilled"), ("1.1", _TYPE + "F", "Finished"), ("1.1", _TYPE + "O", "Open"),
        ("1.0", NAMES.context_type + "produce", "Producera"), ("1.1", NAMES.context_type + "produce", "Tillverka"),
        ("1.1", NAMES.context_type + "use", "Använda"),
    ]
    return spark.createDataFrame(rows, "version string, uri string, label string")


# the same rows in SQL: o = orders with their rule set, c = distinct lines of orders with a rule set
BASE_ROWS = f"""o AS (
  SELECT *, '{BASE}item/' || o_orderkey AS item_id,
    CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 END AS rules
  FROM orders
), c AS (
  SELECT '{BASE}item/' || l_orderkey AS item_id, l_linenumber AS num, l_partkey AS part, l_suppkey AS supp,
    max(l_returnflag) AS flag, max(year(l_shipdate)) AS y,
    '_:c-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS subject,
    any_value(CASE l_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 END) AS rules
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
  GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey
), cc AS (
  SELECT *, CASE WHEN num <> 7 THEN CASE flag WHEN 'A' THEN 'produce' WHEN 'N' THEN 'use' ELSE 'bogus' END END AS kind,
    part > 40 AS has_super FROM c
), ct AS (
  SELECT *, CASE WHEN rules = 0 OR rules IS NULL THEN kind WHEN kind IS NOT NULL THEN kind END AS context,
    CASE WHEN rules >= 1 AND has_super THEN 'create' END AS super,
    CASE WHEN kind IS NULL THEN NULL WHEN rules = 0 THEN CASE kind WHEN 'produce' THEN 'Producera' END
      ELSE CASE kind WHEN 'produce' THEN 'Tillverka' WHEN 'use' THEN 'Använda' END END AS label,
    CASE WHEN rules = 0 THEN NULL WHEN NOT has_super THEN 'no supertype for context' WHEN kind IS NULL THEN 'no context type'
      WHEN kind = 'bogus' THEN 'unknown context type' END AS reason
  FROM cc WHERE rules IS NOT NULL
)"""


def _usable(spark, folder, dealt: bool = False) -> DataFrame:
    return all_triples(spark, folder, dealt=dealt, usable=True)


@query("p01_extract_fields", with_ctes(f"""
SELECT item_id, 'itemTitle' AS index, 2 AS pos, 'Order ' || o_orderkey AS value FROM o WHERE rules IS NOT NULL
UNION ALL SELECT item_id, 'itemLabel', 3, o_orderpriority FROM o WHERE rules IS NOT NULL
UNION ALL SELECT item_id, 'itemType', 4, CASE WHEN o_orderstatus = 'F' AND rules = 0 THEN 'Fulfilled' WHEN o_orderstatus = 'F' THEN 'Finished'
  WHEN o_orderstatus = 'O' AND rules > 0 THEN 'Open' ELSE '{_TYPE}' || o_orderstatus END FROM o WHERE rules IS NOT NULL
UNION ALL SELECT item_id, 'itemSuperType', 5, '{_SUPER}object' FROM o WHERE rules >= 1 AND o_orderpriority <> '3-MEDIUM'
UNION ALL SELECT item_id, 'itemLicense', 13, 'http://license.example.com/a' FROM o WHERE rules IS NOT NULL
UNION ALL SELECT item_id, 'itemLicense', 14, 'http://license.example.com/b' FROM o WHERE rules IS NOT NULL AND o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'
UNION ALL SELECT item_id, 'itemName', 90, o_orderpriority || ' name' FROM o WHERE rules IS NOT NULL
UNION ALL SELECT item_id, 'fromTime', 102, CAST(y AS VARCHAR) FROM ct WHERE num NOT IN (5, 6)
UNION ALL SELECT item_id, 'toTime', 103, CAST(y + 12 AS VARCHAR) FROM ct WHERE num = 2
UNION ALL SELECT item_id, 'county', 104, CAST(supp AS VARCHAR) FROM ct
UNION ALL SELECT item_id, 'province', 105, flag FROM ct
UNION ALL SELECT item_id, 'firstName', 106, 'F' || supp FROM ct
UNION ALL SELECT item_id, 'surname', 107, 'S' || part FROM ct WHERE num < 6
UNION ALL SELECT item_id, 'fullName', 108, 'Full ' || part FROM ct WHERE num = 1
UNION ALL SELECT item_id, 'mediaLicense', 100, 'http://license.example.com/m' FROM ct WHERE num = 4 AND part > 150
UNION ALL SELECT item_id, 'thumbnailSource', 101, 'http://img.example.com/s' || part FROM ct WHERE num = 4""", BASE_ROWS))
def extract_fields(spark, folder):
    values = extract.field_values(_usable(spark, folder), NAMES, vocab(spark))
    return values.filter(F.col("value").isNotNull()).select("item_id", "index", "pos", "value")


_LOOKUP = with_ctes(f"""
SELECT value, found, CASE WHEN found = value THEN 'vocabulary has no entry for ' || value END AS problem, count(*) AS n FROM (
  SELECT value, CASE WHEN kind = 'F' THEN CASE WHEN rules = 0 THEN 'Fulfilled' ELSE 'Finished' END WHEN kind = 'O' AND rules > 0 THEN 'Open'
    WHEN starts_with(value, '{_COUNTY}') THEN CAST(CAST(substr(value, {len(_COUNTY) + 1}) AS BIGINT) AS VARCHAR)
    WHEN starts_with(value, '{_PROVINCE}') THEN substr(value, {len(_PROVINCE) + 1}) ELSE value END AS found FROM (
    SELECT '{_TYPE}' || o_orderstatus AS value, o_orderstatus AS kind, rules FROM o WHERE rules IS NOT NULL
    UNION ALL SELECT '{_COUNTY}0' || supp, '', rules FROM ct UNION ALL SELECT '{_PROVINCE}' || flag, '', rules FROM ct))
GROUP BY ALL""", BASE_ROWS)


def _lookups(spark, folder):
    asked = [NAMES.full(p) for p in ("itemType", "geo:county", "geo:province")]
    values = _usable(spark, folder).filter(F.col("predicate").isin(asked)).select(
        F.col("object").alias("value"), "object_kind", "rules", F.lit(True).alias("lookup"),
        F.col("object").alias("stated"),
    )
    looked = extract.lookup_uri(values, vocab(spark), NAMES)
    return looked.groupBy(F.col("stated").alias("value"), F.col("value").alias("found"), "problem").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("p02_uri_lookup", _LOOKUP)
def uri_lookup(spark, folder):
    return _lookups(spark, folder)


@query("j02_vocab_enrich", with_ctes(f"""
SELECT item_id, CASE WHEN o_orderstatus = 'F' AND rules = 0 THEN 'Fulfilled' WHEN o_orderstatus = 'F' THEN 'Finished'
  WHEN o_orderstatus = 'O' AND rules > 0 THEN 'Open' ELSE '{_TYPE}' || o_orderstatus END AS value FROM o WHERE rules IS NOT NULL""", BASE_ROWS))
def vocab_enrich(spark, folder):
    # without the version column: each item is gathered to learn its version
    values = extract.versioned(item_triples(spark, folder).drop("version"), NAMES).filter(
        (F.col("predicate") == NAMES.full("itemType")) & F.col("rules").isNotNull()
    ).select("item_id", F.col("object").alias("value"), "object_kind", "rules", F.lit(True).alias("lookup"))
    return extract.lookup_uri(values, vocab(spark), NAMES).select("item_id", "value")


@query("p03_single_value_check", with_ctes(
    "SELECT item_id, 'several values' AS reason FROM o WHERE rules IS NOT NULL AND o_orderstatus = 'P' "
    "AND o_orderpriority = '2-HIGH'", BASE_ROWS))
def single_value_check(spark, folder):
    return extract.single_value_check(_usable(spark, folder, dealt=True), NAMES)


@query("p04_context_fanout", """
WITH v AS (SELECT CAST(l_orderkey AS VARCHAR) AS item_id, l_returnflag AS value, CASE WHEN l_linenumber < 5 THEN 'create' END AS super,
  CASE WHEN l_linenumber < 3 THEN 'produce' END AS context FROM lineitem)
SELECT item_id, 'name' AS index, value FROM v UNION ALL SELECT item_id, super || '_name', value FROM v WHERE super IS NOT NULL
UNION ALL SELECT item_id, context || '_name', value FROM v WHERE context IS NOT NULL""")
def context_fanout(spark, folder):
    values = table(spark, folder, "lineitem").select(
        text("l_orderkey").alias("item_id"), F.lit("name").alias("index"), F.col("l_returnflag").alias("value"),
        F.when(F.col("l_linenumber") < 5, "create").alias("super"), F.when(F.col("l_linenumber") < 3, "produce").alias("context"),
    )
    return extract.context_fanout(values).select("item_id", "index", "value")


@query("p05_context_type_rules", with_ctes("SELECT item_id, subject, context, super, label, reason FROM ct", BASE_ROWS))
def context_type_rules(spark, folder):
    nodes = extract.context_nodes(_usable(spark, folder), NAMES)
    return extract.context_types(nodes, vocab(spark), NAMES).select(
        "item_id", "subject", "context", "super", "label", "reason"
    )


@query("p08_legacy_rewrite", f"""
WITH t AS (SELECT 'i' || l_orderkey AS item_id, 'p' || l_linenumber || '-' || l_partkey AS parent, any_value(l_linenumber) AS num,
  min(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey)
SELECT item_id, parent, 'toPeriod' AS name, 'http://mis.historiska.se/rdf/period#' || supp AS resource, CAST(NULL AS VARCHAR) AS content FROM t WHERE num = 1
UNION ALL SELECT item_id, parent, 'fromPeriod', '{NAMES.own_periods}V', NULL FROM t WHERE num = 2
UNION ALL SELECT item_id, parent, 'agent', 'http://libris.kb.se/resource/auth/' || supp, NULL FROM t WHERE num = 3
UNION ALL SELECT item_id, parent, 'label', NULL, 'L' || supp FROM t""")
def legacy_rewrite(spark, folder):
    nodes = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("supp"))
    number, supp = F.col("l_linenumber"), text("supp")
    entries = [
        ("periodAuth", F.when(number == 1, "http://mis.historiska.se/rdf/period").when(number == 2, NAMES.own_periods + "V")),
        ("toPeriodId", F.when(number == 1, supp)),
        ("fromPeriodId", F.when(number == 2, supp)),
        ("nameAuth", F.when(number == 3, "Kungliga biblioteket").when(number == 4, "nobody")),
        ("nameId", F.when(number > 2, supp)),
        ("label", F.concat(F.lit("L"), supp)),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("content"), F.lit(i).alias("pos")) for i, (n, v) in enumerate(entries)])
    tags = nodes.select(
        _uri("i", "l_orderkey").alias("item_id"),
        F.concat(F.lit("p"), text(number), F.lit("-"), text("l_partkey")).alias("parent"), F.explode(rows).alias("e"),
    ).select("item_id", "parent", "e.name", "e.content", F.lit(None).cast("string").alias("resource"), "e.pos").filter(
        F.col("content").isNotNull())
    return extract.rewrite_legacy(tags, NAMES).select("item_id", "parent", "name", "resource", "content")


_RELATIONS = f"""rels AS (
  SELECT item_id, 'isRelatedTo' AS rel_type, '{BASE}agent/' || o_custkey AS target_uri FROM o WHERE rules IS NOT NULL
  UNION ALL SELECT item_id, 'sameAs', '{BASE}item/' || (o_orderkey - 1) FROM o WHERE rules IS NOT NULL AND o_orderstatus = 'P'
  UNION ALL SELECT item_id, 'multipleReplaces', '{BASE}old/' || o_orderkey FROM o WHERE rules >= 1 AND o_orderpriority = '2-HIGH'
  UNION ALL SELECT item_id, 'author', '{BASE}agent/' || supp FROM ct WHERE rules >= 1
  UNION ALL SELECT item_id, 'has_former_or_current_owner', '{BASE}owner/' || part FROM ct WHERE rules >= 1
)"""


@query("p10_relation_extract", with_ctes(
    "SELECT item_id, rel_type AS index, target_uri AS value FROM rels UNION ALL SELECT item_id, 'relUri', target_uri FROM rels",
    BASE_ROWS, _RELATIONS))
def relation_extract(spark, folder):
    relations, _ = extract.extract_relations(_usable(spark, folder), NAMES)
    return extract.relation_postings(relations).select("item_id", "index", "value")


@query("p11_relation_type_name", with_ctes("""
SELECT rel_type, rules, count(*) AS n FROM (
  SELECT 'isRelatedTo' AS rel_type, rules FROM o WHERE rules IS NOT NULL
  UNION ALL SELECT 'sameAs', rules FROM o WHERE rules IS NOT NULL AND o_orderstatus = 'P'
  UNION ALL SELECT CASE WHEN rules >= 1 THEN 'multipleReplaces' END, rules FROM o WHERE rules IS NOT NULL AND o_orderpriority = '2-HIGH'
  UNION ALL SELECT 'author', rules FROM ct
  UNION ALL SELECT 'clientOf', rules FROM ct WHERE flag = 'R' AND part < 200
  UNION ALL SELECT CASE WHEN rules >= 1 THEN 'has_former_or_current_owner' END, rules FROM ct) GROUP BY 1, 2""", BASE_ROWS))
def relation_type_name(spark, folder):
    asked = [NAMES.full(p) for p in (
        "isRelatedTo", "owl:sameAs", "terms:replaces", "author", "clientOf", "cidoc:P51F.has_former_or_current_owner")]
    rows = _usable(spark, folder).filter(F.col("predicate").isin(asked))
    name = extract.relation_name(F.col("predicate"), F.col("rules"), NAMES)
    return rows.groupBy(name.alias("rel_type"), "rules").agg(F.count(F.lit(1)).alias("n"))


@query("p12_media_extract", with_ctes(
    "SELECT DISTINCT item_id, 'missing media license' AS reason FROM ct WHERE num = 4 AND part <= 150", BASE_ROWS))
def media_extract(spark, folder):
    return extract.media(_usable(spark, folder), NAMES)


@query("p13_exists_flags", with_ctes("""
SELECT o.item_id, 'n' AS "geoDataExists", CASE WHEN o.item_id IN (SELECT item_id FROM c WHERE num NOT IN (5, 6) OR num IN (2, 3)) THEN 'j' ELSE 'n' END AS "timeInfoExists",
  CASE WHEN o_orderstatus = 'O' THEN 'j' ELSE 'n' END AS "thumbnailExists" FROM o WHERE rules IS NOT NULL""", BASE_ROWS))
def exists_flags(spark, folder):
    return extract.exists_flags(_usable(spark, folder, dealt=True), NAMES)


@query("p15_index_gate", with_ctes(
    "SELECT item_id FROM o WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')", BASE_ROWS))
def index_gate(spark, folder):
    return extract.indexable(item_triples(spark, folder), NAMES).select("item_id").distinct()


@query("p16_system_fields", with_ctes(f"""
SELECT item_id, 'itemId' AS index, item_id AS value FROM o
UNION ALL SELECT item_id, 'stringProtocolVersion', CASE o_orderkey % 7 WHEN 0 THEN '0.97' WHEN 1 THEN '1.0' WHEN 2 THEN '1.1'
  WHEN 3 THEN '1.11' WHEN 4 THEN '1.2.0' WHEN 5 THEN '1.3.0' ELSE '2.0' END FROM o
UNION ALL SELECT item_id, '_htmlurl', CASE WHEN o_orderpriority = '1-URGENT' THEN item_id ELSE 'http://www.example.com/' || o_orderkey END FROM o
UNION ALL SELECT item_id, 'thumbnail', 'http://img.example.com/' || o_orderkey FROM o WHERE o_orderstatus = 'O'
UNION ALL SELECT item_id, 'problem', 'HTML address points back to {BASE}' FROM o WHERE o_orderpriority = '1-URGENT'""", BASE_ROWS))
def system_fields(spark, folder):
    fields, problems = extract.system_fields(item_triples(spark, folder), NAMES)
    return fields.select("item_id", "index", "value").unionByName(
        problems.select("item_id", F.lit("problem").alias("index"), F.col("message").alias("value"))
    )


@query("p16_payload_fields", """
SELECT 'doc/' || doc_id AS item_id, '_service' AS index, source AS value FROM documents
UNION ALL SELECT 'doc/' || doc_id, '_rdf', to_base64(encode(text)) FROM documents""")
def payload_fields(spark, folder):
    content = table(spark, folder, "documents").select(
        _uri("doc/", "doc_id").alias("uri"), F.col("source").alias("serviceid"), F.col("text").alias("xmldata"),
        F.lit(None).cast("timestamp_ntz").alias("deleted"),
    )
    return extract.payload_fields(content).select("item_id", "index", F.regexp_replace("value", r"[\r\n]", "").alias("value"))


_BUCKETS = "SELECT 'itemType' AS index, unnest(['item', 'text', 'strict']) AS bucket UNION ALL " \
    "SELECT 'itemMaterial', unnest(['item', 'text', 'strict']) UNION ALL SELECT 'itemTechnique', unnest(['item', 'text', 'strict']) " \
    "UNION ALL SELECT 'itemNumber', unnest(['item', 'text', 'strict']) UNION ALL SELECT 'subject', unnest(['text', 'strict']) " \
    "UNION ALL SELECT 'fromTime', unnest(['time', 'text', 'strict'])"


@query("p19_freetext_groups", with_ctes(
    "SELECT item_id, bucket AS index, value FROM postings JOIN groups USING (index)", POSTINGS, f"groups AS ({_BUCKETS})"))
def freetext(spark, folder):
    return extract.freetext(item_postings(spark, folder)).select("item_id", "index", "value")


# ---- whole records -----------------------------------------------------------------------

def record_xml(spark, folder) -> DataFrame:
    """RDF/XML of every order with its lines as contexts: markup made by Spark."""
    rdf = PUBLIC_NAMESPACES["rdf"]
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.max("l_returnflag").alias("flag"))
    context = F.concat(
        F.lit('<v:context><v:Context><v:contextType rdf:resource="' + NAMES.context_type), F.col("flag"),
        F.lit('"/><v:placeName>Place &amp; '), text("l_partkey"), F.lit("</v:placeName></v:Context></v:context>"),
    )
    # an order is one record, so its lines are few
    grouped = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_list(context), "").alias("contexts"))
    payload = F.concat(
        F.lit(f'<rdf:RDF xmlns:rdf="{rdf}" xmlns:v="{NAMES.own}" xmlns:f="{PUBLIC_NAMESPACES["foaf"]}">'),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("<v:Thing>")).otherwise(
            F.concat(F.lit(f'<v:Entity rdf:about="{BASE}item/'), text("o_orderkey"), F.lit('">'))),
        F.lit("<v:itemTitle>"), F.col("o_orderpriority"), F.lit("</v:itemTitle><v:itemType rdf:resource=\"" + _TYPE),
        F.col("o_orderstatus"), F.lit('"/><v:itemName rdf:nodeID="n1"/>'), F.coalesce("contexts", F.lit("")),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("</v:Thing>")).otherwise(F.lit("</v:Entity>")),
        F.lit('<rdf:Description rdf:nodeID="n1"><v:name>'), F.col("o_orderstatus"), F.lit("</v:name></rdf:Description></rdf:RDF>"),
    )
    # parsing costs far more than reading, so the records are spread over the session's partitions
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, folder, "orders").repartition(parts, "o_orderkey")
    return orders.join(grouped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        _uri("oai/", "o_orderkey").alias("oaiuri"), F.lit(False).alias("is_deleted"), payload.alias("payload_xml")
    )


_V = NAMES.own
_RECORDS = f"""o AS (SELECT *, '{BASE}item/' || o_orderkey AS item_id FROM orders WHERE o_orderpriority <> '5-LOW'),
l AS (SELECT DISTINCT '{BASE}item/' || l_orderkey AS item_id, l_linenumber, l_partkey, max(l_returnflag) AS flag FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM o) GROUP BY l_orderkey, l_linenumber, l_partkey)"""


@query("s02_record_triples", with_ctes(f"""
SELECT item_id, '' AS via, '{PUBLIC_NAMESPACES["rdf"]}type' AS predicate, '{_V}Entity' AS object, 'uri' AS object_kind FROM o
UNION ALL SELECT item_id, '', '{_V}itemTitle', o_orderpriority, 'literal' FROM o
UNION ALL SELECT item_id, '', '{_V}itemType', '{_TYPE}' || o_orderstatus, 'uri' FROM o
UNION ALL SELECT item_id, '', '{_V}itemName', 'blank', 'blank' FROM o
UNION ALL SELECT item_id, '{_V}itemName', '{_V}name', o_orderstatus, 'literal' FROM o
UNION ALL SELECT item_id, '', '{_V}context', 'blank', 'blank' FROM l
UNION ALL SELECT item_id, '{_V}context', '{PUBLIC_NAMESPACES["rdf"]}type', '{_V}Context', 'uri' FROM l
UNION ALL SELECT item_id, '{_V}context', '{_V}contextType', '{NAMES.context_type}' || flag, 'uri' FROM l
UNION ALL SELECT item_id, '{_V}context', '{_V}placeName', 'Place & ' || l_partkey, 'literal' FROM l""", _RECORDS))
def record_triples(spark, folder):
    triples, _ = harvest.record_triples(record_xml(spark, folder), NAMES)
    kind = F.col("object_kind")
    return triples.select(
        "item_id", "via", "predicate", F.when(kind == "blank", "blank").otherwise(F.col("object")).alias("object"), "object_kind"
    )


@query("s02_record_rejects", """
SELECT 'oai/' || o_orderkey AS oaiuri, 'no entity' AS reason FROM orders WHERE o_orderpriority = '5-LOW'""")
def record_rejects(spark, folder):
    return harvest.record_triples(record_xml(spark, folder), NAMES)[1]


_BAD = f"""bad AS (
  SELECT item_id, 'unsupported version' AS reason FROM o WHERE rules IS NULL AND NOT barred
  UNION SELECT item_id, 'no item supertype' FROM o WHERE rules >= 1 AND o_orderpriority = '3-MEDIUM' AND NOT barred
  UNION SELECT item_id, 'several values' FROM o WHERE rules IS NOT NULL AND o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'
  UNION SELECT item_id, 'missing media license' FROM ct JOIN ok USING (item_id) WHERE num = 4 AND part <= 150
  UNION SELECT item_id, reason FROM ct JOIN ok USING (item_id) WHERE reason IS NOT NULL
  UNION SELECT item_id, 'unknown relation' FROM ct JOIN ok USING (item_id) WHERE rules >= 1 AND flag = 'R' AND part < 200
)"""
_FLOW = BASE_ROWS.replace(
    "o AS (\n  SELECT *,", "o AS (\n  SELECT *, o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AS barred,", 1
) + ", ok AS (SELECT item_id FROM o WHERE NOT barred)"


def _record_flow(spark, folder):
    barred = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW")
    # lines without an order make no record
    known = table(spark, folder, "orders").select(
        _uri(BASE + "item/", "o_orderkey").alias("item_id"), barred.alias("barred"))
    return extract.extract(all_triples(spark, folder, known), NAMES, vocab(spark), moment("2005-01-01 00:00:00"))


@query("p00_record_rejects", with_ctes("SELECT item_id, reason FROM bad", _FLOW, _BAD))
def all_rejects(spark, folder):
    return _record_flow(spark, folder)["rejects"].distinct()


@query("p00_record_relations", with_ctes(
    "SELECT item_id, rel_type, target_uri FROM rels WHERE item_id IN (SELECT item_id FROM ok) "
    "AND item_id NOT IN (SELECT item_id FROM bad)", _FLOW, _BAD, _RELATIONS))
def all_relations(spark, folder):
    return _record_flow(spark, folder)["relations"]


@query("p00_record_postings", with_ctes(f"""
SELECT index, count(*) AS n, count(DISTINCT item_id) AS n_items FROM (
  SELECT item_id, 'itemTitle' AS index FROM o UNION ALL SELECT item_id, 'createdDate' FROM o WHERE o_orderdate <= TIMESTAMP '2005-01-01'
  UNION ALL SELECT item_id, 'itemId' FROM o UNION ALL SELECT item_id, 'timeInfoExists' FROM o
  UNION ALL SELECT item_id, 'contextType' FROM ct WHERE context IS NOT NULL
  UNION ALL SELECT item_id, 'contextLabel' FROM ct WHERE label IS NOT NULL
  UNION ALL SELECT item_id, 'county' FROM ct UNION ALL SELECT item_id, context || '_county' FROM ct WHERE context IS NOT NULL
  UNION ALL SELECT item_id, super || '_county' FROM ct WHERE super IS NOT NULL
  UNION ALL SELECT item_id, 'fullName' FROM ct WHERE num < 6
  UNION ALL SELECT item_id, 'agent' FROM ct WHERE num = 2 UNION ALL SELECT item_id, 'fromPeriod' FROM ct WHERE num = 3)
WHERE item_id IN (SELECT item_id FROM ok) AND item_id NOT IN (SELECT item_id FROM bad) GROUP BY index""", _FLOW, _BAD))
def all_postings(spark, folder):
    counted = [
        "itemTitle", "createdDate", "itemId", "timeInfoExists", "contextType", "contextLabel", "county", "produce_county",
        "use_county", "bogus_county", "create_county", "fullName", "agent", "fromPeriod",
    ]
    postings = _record_flow(spark, folder)["postings"].filter(F.col("index").isin(counted))
    return postings.groupBy("index").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("n_items"))
