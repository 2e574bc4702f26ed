"""How the given tables stand in for postings, content, relations, triples and logs.

Every binding has a twin in SQL (a CTE) so that the two sides of a check start from the same rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.shuffle import parts_for
from recordloom.session import checkpoint_folder
from recordloom.vocabulary import Names

NAMES = Names()
BASE = NAMES.base


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def day(value: str) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def stamp(value: str) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def moment(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the cluster's checkpoints, for stream state and written tables."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, key: str, each: int = 128_000) -> DataFrame:
    """Rows dealt by a key, in as many partitions as the table's size asks for, so that what a task holds does not grow with the table."""
    return rows.repartition(parts_for(rows, each), key)


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---- postings of orders and their lines --------------------------------------------------

def item_postings(spark: SparkSession, folder: str) -> DataFrame:
    """A union of narrow selects: a filter on the index prunes whole branches and their columns."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")

    def part(rows: DataFrame, key: str, index: str, pos: Column, value: Column) -> DataFrame:
        return rows.select(
            text(key).alias("item_id"), F.lit(index).alias("index"), pos.cast("int").alias("pos"),
            value.cast("string").alias("value"),
        )

    zero, line = F.lit(0), F.col("l_linenumber")
    return reduce(DataFrame.unionByName, [
        part(orders, "o_orderkey", "itemType", zero, F.col("o_orderstatus")),
        part(orders, "o_orderkey", "subject", zero, F.col("o_orderpriority")),
        part(orders, "o_orderkey", "createdDate", zero, day("o_orderdate")),
        part(orders, "o_orderkey", "fromTime", zero, F.year("o_orderdate")),
        part(lines, "l_orderkey", "itemMaterial", line, F.col("l_returnflag")),
        part(lines, "l_orderkey", "itemTechnique", line, F.col("l_linestatus")),
        part(lines, "l_orderkey", "itemNumber", line, F.col("l_partkey")),
    ])


POSTINGS = """postings AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS item_id, 'itemType' AS index, 0 AS pos, o_orderstatus AS value FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'subject', 0, o_orderpriority FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'createdDate', 0, strftime(o_orderdate, '%Y-%m-%d') FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'fromTime', 0, CAST(year(o_orderdate) AS VARCHAR) FROM orders
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'itemMaterial', l_linenumber, l_returnflag FROM lineitem
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'itemTechnique', l_linenumber, l_linestatus FROM lineitem
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'itemNumber', l_linenumber, CAST(l_partkey AS VARCHAR) FROM lineitem
)"""


# ---- postings of documents ---------------------------------------------------------------

def doc_postings(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")

    def part(index: str, column: str) -> DataFrame:
        return docs.select(
            text("doc_id").alias("item_id"), F.lit(index).alias("index"), F.lit(0).alias("pos"),
            F.col(column).alias("value"),
        )

    return reduce(DataFrame.unionByName, [
        part("text", "text"), part("serviceName", "source"), part("itemClassName", "lang"),
    ])


DOC_WORDS = r"""doc_words AS (
  SELECT CAST(doc_id AS VARCHAR) AS item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents
)"""


# ---- store content, runs and logs from events --------------------------------------------

SPLIT = "2024-01-16 00:00:00"
RUN_TS = "2024-02-01 00:00:00"


def event_rows(events: DataFrame) -> DataFrame:
    """Events as harvest rows: the uri repeats, the type error is a delete header."""
    k = F.regexp_extract("props", r"\d+", 0).cast("bigint")
    key = F.concat(text("user_id"), F.lit("/"), text(k))
    source = F.pmod(F.col("user_id") + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0), F.lit(5))
    return events.select(
        F.concat(F.lit("rec/"), key).alias("uri"),
        F.concat(F.lit("oai/"), key).alias("oaiuri"),
        F.concat(F.lit("svc"), text(source)).alias("serviceid"),
        F.concat(F.col("event_type"), F.lit(":"), text("event_id")).alias("xmldata"),
        F.col("ts").cast("timestamp_ntz").alias("datestamp"),
        F.concat(F.lit("http://www.example.com/"), key).alias("nativeurl"),
        F.col("event_id").alias("file_pos"),
        "event_type",
    )


def old_content(spark: SparkSession, folder: str) -> DataFrame:
    """Content before the run: the last event per uri of the first half, tombstones included."""
    rows = event_rows(table(spark, folder, "events")).filter(F.col("datestamp") < moment(SPLIT))
    last = rows.groupBy("uri").agg(
        F.max(F.struct("file_pos", "oaiuri", "serviceid", "xmldata", "datestamp", "nativeurl", "event_type")).alias("r"),
        F.min("datestamp").alias("added"),
    )
    gone = F.col("r.event_type") == "error"
    return last.select(
        "uri", "r.oaiuri", "r.serviceid",
        F.when(~gone, F.col("r.xmldata")).alias("xmldata"),
        moment(SPLIT).alias("changed"), "added",
        F.when(gone, F.col("r.datestamp")).alias("deleted"),
        F.col("r.datestamp").alias("datestamp"),
        F.lit(0).cast("bigint").alias("status"),
        "r.nativeurl",
    )


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_rows(table(spark, folder, "events"))
    return rows.filter((F.col("datestamp") >= moment(SPLIT)) & (F.col("event_type") != "error")).drop("event_type")


def run_headers(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_rows(table(spark, folder, "events"))
    return rows.filter((F.col("datestamp") >= moment(SPLIT)) & (F.col("event_type") == "error")).select(
        "oaiuri", "serviceid", "datestamp", "file_pos"
    )


def show_content(content: DataFrame) -> DataFrame:
    """Content with times as text."""
    times = {name: stamp(name) for name in ("changed", "added", "deleted", "datestamp")}
    return content.withColumns(times)


EVENT_ROWS = """event_rows AS (
  SELECT 'rec/' || user_id || '/' || regexp_extract(props, '\\d+') AS uri,
         'oai/' || user_id || '/' || regexp_extract(props, '\\d+') AS oaiuri,
         'svc' || ((user_id + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) % 5) AS serviceid,
         event_type || ':' || event_id AS xmldata, ts AS datestamp,
         'http://www.example.com/' || user_id || '/' || regexp_extract(props, '\\d+') AS nativeurl,
         event_id AS file_pos, event_type
  FROM events
)"""
CONTENT_CTES = EVENT_ROWS + f""", first_half AS (
  SELECT *, row_number() OVER (PARTITION BY uri ORDER BY file_pos DESC) AS rn,
         min(datestamp) OVER (PARTITION BY uri) AS first_at
  FROM event_rows WHERE datestamp < TIMESTAMP '{SPLIT}'
), content AS (
  SELECT uri, oaiuri, serviceid, CASE WHEN event_type <> 'error' THEN xmldata END AS xmldata,
         TIMESTAMP '{SPLIT}' AS changed, first_at AS added,
         CASE WHEN event_type = 'error' THEN datestamp END AS deleted, datestamp,
         CAST(0 AS BIGINT) AS status, nativeurl
  FROM first_half WHERE rn = 1
), records AS (
  SELECT * FROM event_rows WHERE datestamp >= TIMESTAMP '{SPLIT}' AND event_type <> 'error'
), headers AS (
  SELECT * FROM event_rows WHERE datestamp >= TIMESTAMP '{SPLIT}' AND event_type = 'error'
), fresh AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY file_pos DESC) AS rn,
                        count(*) OVER (PARTITION BY uri) AS hits FROM records) WHERE rn = 1
), merged AS (
  SELECT coalesce(c.uri, f.uri) AS uri,
         CASE WHEN f.uri IS NULL THEN c.oaiuri ELSE f.oaiuri END AS oaiuri,
         CASE WHEN f.uri IS NULL THEN c.serviceid ELSE f.serviceid END AS serviceid,
         CASE WHEN f.uri IS NULL THEN c.xmldata ELSE f.xmldata END AS xmldata,
         CASE WHEN f.uri IS NULL THEN c.changed ELSE TIMESTAMP '{RUN_TS}' END AS changed,
         CASE WHEN c.uri IS NULL THEN TIMESTAMP '{RUN_TS}' ELSE c.added END AS added,
         CASE WHEN f.uri IS NULL THEN c.deleted END AS deleted,
         CASE WHEN f.uri IS NULL THEN c.datestamp ELSE f.datestamp END AS datestamp,
         CAST(0 AS BIGINT) AS status,
         CASE WHEN f.uri IS NULL THEN c.nativeurl ELSE f.nativeurl END AS nativeurl,
         f.file_pos AS new_pos, coalesce(f.hits, 0) AS hits, c.uri IS NULL AS is_new
  FROM content c FULL OUTER JOIN fresh f ON c.uri = f.uri
), drops AS (
  SELECT serviceid, oaiuri, max(file_pos) AS delete_pos, arg_max(datestamp, file_pos) AS delete_at
  FROM headers GROUP BY serviceid, oaiuri
), applied AS (
  SELECT m.*, d.delete_at, coalesce(d.delete_pos > coalesce(m.new_pos, -1), false) AS gone
  FROM merged m LEFT JOIN drops d ON m.serviceid = d.serviceid AND m.oaiuri = d.oaiuri
), applied_rows AS (
  SELECT uri, oaiuri, serviceid, CASE WHEN NOT gone THEN xmldata END AS xmldata,
         CASE WHEN gone THEN TIMESTAMP '{RUN_TS}' ELSE changed END AS changed, added,
         CASE WHEN gone THEN delete_at ELSE deleted END AS deleted,
         CASE WHEN gone THEN delete_at ELSE datestamp END AS datestamp, status, nativeurl,
         CASE WHEN gone THEN 'd' WHEN hits > 0 AND is_new THEN 'i' WHEN hits > 0 THEN 'u' END AS action, hits
  FROM applied
)"""
_FMT = "'%Y-%m-%d %H:%M:%S'"
SHOW = (
    f"uri, oaiuri, serviceid, xmldata, strftime(changed, {_FMT}) AS changed, strftime(added, {_FMT}) AS added, "
    f"strftime(deleted, {_FMT}) AS deleted, strftime(datestamp, {_FMT}) AS datestamp, status, nativeurl"
)


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    return run_log_rows(table(spark, folder, "events"))


def run_log_rows(events: DataFrame) -> DataFrame:
    """Run log: errors and purchases stand for errors and warnings."""
    kind = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    return events.select(
        F.concat(F.lit("svc"), text(F.col("user_id") % 20)).alias("serviceid"),
        kind.cast("bigint").alias("eventtype"),
        F.element_at(F.array(*[F.lit(s) for s in ("FETCH", "STORE", "INDEX", "EMPTYINDEX", "IDLE")]),
                     (F.col("event_id") % 5 + 1).cast("int")).alias("eventstep"),
        F.col("ts").cast("timestamp_ntz").alias("eventts"),
        F.concat(F.col("event_type"), F.lit(" at "), text("user_id")).alias("message"),
        F.col("event_id").alias("eventid"),
    )


RUN_LOG = """log AS (
  SELECT 'svc' || (user_id % 20) AS serviceid,
         CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS BIGINT) AS eventtype,
         CASE event_id % 5 WHEN 0 THEN 'FETCH' WHEN 1 THEN 'STORE' WHEN 2 THEN 'INDEX'
              WHEN 3 THEN 'EMPTYINDEX' ELSE 'IDLE' END AS eventstep,
         ts AS eventts, event_type || ' at ' || user_id AS message, event_id AS eventid
  FROM events
)"""


# ---- documents as content ----------------------------------------------------------------

def doc_content(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as store rows; short ones are tombstones."""
    docs = table(spark, folder, "documents")
    gone = F.col("n_chars") < 300
    return docs.select(
        F.concat(F.lit("doc/"), text("doc_id")).alias("uri"),
        F.col("source").alias("serviceid"),
        F.when(~gone, F.col("text")).alias("xmldata"),
        F.timestamp_add("DAY", (F.col("doc_id") % 30).cast("int"), moment("2024-01-01 00:00:00")).alias("changed"),
        F.when(gone, moment("2024-01-31 00:00:00")).alias("deleted"),
    )


DOC_CONTENT = """content AS (
  SELECT 'doc/' || doc_id AS uri, source AS serviceid, CASE WHEN n_chars >= 300 THEN text END AS xmldata,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS changed,
         CASE WHEN n_chars < 300 THEN TIMESTAMP '2024-01-31 00:00:00' END AS deleted
  FROM documents
)"""


# ---- relations ---------------------------------------------------------------------------

def padded(prefix: str, key: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(text(key), 12, "0"))


def doc_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Copies are the same as the first of their kind, and every document is part of its source."""
    docs = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("h"), "source")
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    copies = docs.join(first, "h").filter(F.col("doc_id") != F.col("first_id")).select(
        padded("doc/", "doc_id").alias("item_id"), F.lit("sameAs").alias("rel_type"),
        padded("doc/", "first_id").alias("target_uri"),
    )
    parts = docs.select(
        padded("doc/", "doc_id").alias("item_id"), F.lit("isPartOf").alias("rel_type"),
        F.concat(F.lit("src/"), F.col("source")).alias("target_uri"),
    )
    return copies.unionByName(parts)


DOC_RELATIONS = """firsts AS (
  SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents
), relations AS (
  SELECT 'doc/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS item_id, 'sameAs' AS rel_type,
         'doc/' || lpad(CAST(first_id AS VARCHAR), 12, '0') AS target_uri FROM firsts WHERE doc_id <> first_id
  UNION ALL
  SELECT 'doc/' || lpad(CAST(doc_id AS VARCHAR), 12, '0'), 'isPartOf', 'src/' || source FROM firsts
), comp AS (
  SELECT 'doc/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS uri,
         'doc/' || lpad(CAST(first_id AS VARCHAR), 12, '0') AS component
  FROM firsts WHERE first_id IN (SELECT first_id FROM firsts WHERE doc_id <> first_id)
)"""


def order_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Orders have owners and parts; some use, show, replace or relate to their customer's item."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")

    def edges(rows: DataFrame, item: Column, name: str, target: Column) -> DataFrame:
        return rows.select(item.alias("item_id"), F.lit(name).alias("rel_type"), target.alias("target_uri"))

    order, customer = padded("item/", "o_orderkey"), padded("agent/", "o_custkey")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return reduce(DataFrame.unionByName, [
        edges(orders, order, "has_former_or_current_owner", customer),
        edges(orders.filter(priority == "1-URGENT"), order, "isRelatedTo", customer),
        edges(orders.filter(status == "F"), customer, "hasImage", order),
        edges(orders.filter(priority == "5-LOW"), order, "hasBeenUsedIn", customer),
        edges(orders.filter(status == "P"), order, "multipleReplaces", padded("item/", F.col("o_orderkey") - 1)),
        edges(lines, padded("item/", "l_orderkey"), "hasPart", padded("part/", "l_partkey")).distinct(),
    ])


ORDER_RELATIONS = """relations AS (
  SELECT 'item/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS item_id, 'has_former_or_current_owner' AS rel_type,
         'agent/' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS target_uri FROM orders
  UNION ALL SELECT 'item/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), 'isRelatedTo',
         'agent/' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'agent/' || lpad(CAST(o_custkey AS VARCHAR), 12, '0'), 'hasImage',
         'item/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'item/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), 'hasBeenUsedIn',
         'agent/' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') FROM orders WHERE o_orderpriority = '5-LOW'
  UNION ALL SELECT 'item/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), 'multipleReplaces',
         'item/' || lpad(CAST(o_orderkey - 1 AS VARCHAR), 12, '0') FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT DISTINCT 'item/' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), 'hasPart',
         'part/' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') FROM lineitem
)"""


# ---- points ------------------------------------------------------------------------------

def customer_points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        text("c_custkey").alias("item_id"),
        (11 + (F.col("c_custkey") % 1300) / 100.0).alias("lon"),
        (55 + (F.col("c_custkey") % 1400) / 100.0).alias("lat"),
    )


POINTS = """points AS (
  SELECT CAST(c_custkey AS VARCHAR) AS item_id, CAST(11 AS DOUBLE) + (c_custkey % 1300) / CAST(100 AS DOUBLE) AS lon,
         CAST(55 AS DOUBLE) + (c_custkey % 1400) / CAST(100 AS DOUBLE) AS lat
  FROM customer
)"""
