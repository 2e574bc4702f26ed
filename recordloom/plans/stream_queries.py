"""Registered queries: file streams run to their end over the given tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import store
from recordloom.plans.bindings import (
    CONTENT_CTES, RUN_LOG, RUN_TS, SHOW, SPLIT, event_rows, moment, old_content, run_log_rows, show_content,
    stamp, text, with_ctes, work_folder,
)
from recordloom.plans.registry import query
from recordloom.session import written
from recordloom.sinks import outputs
from recordloom.streaming import jobs


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = event_rows(batch).filter(F.col("datestamp") >= moment(SPLIT))
    gone = F.col("event_type") == "error"
    return rows.filter(~gone).drop("event_type"), rows.filter(gone)


def _run(spark: SparkSession, folder: str, work: str, *more: jobs.BatchHandler, order_by: str = "arrival") -> None:
    jobs.write_version(old_content(spark, folder), f"{work}/store", 0)
    upsert = jobs.upsert_batch(f"{work}/store", _split, lambda: moment(RUN_TS), order_by)
    jobs.table_stream(_events(spark, folder), f"{work}/state", [upsert, *more]).awaitTermination()


@query("t01_incremental_ingest", """
SELECT 'oai:' || event_id AS oaiuri, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datestamp, event_type = 'error' AS is_deleted,
  CASE WHEN event_type <> 'error' THEN '<v>' || event_type || '</v>' END AS payload_xml FROM events""")
def incremental_ingest(spark, folder):
    """Events are written as harvest files; a second start finds nothing new."""
    work = work_folder(spark, "ingest")
    deleted = F.col("event_type") == "error"
    envelope = F.concat(
        F.lit("<record><header"), F.when(deleted, ' status="deleted"').otherwise(""), F.lit("><identifier>oai:"),
        text("event_id"), F.lit("</identifier><datestamp>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("</datestamp></header>"),
        F.when(deleted, "").otherwise(F.concat(F.lit("<metadata><v>"), F.col("event_type"), F.lit("</v></metadata>"))),
        F.lit("</record>"),
    )
    spark.read.parquet(f"{folder}/events.parquet").select(envelope.alias("value")).write.text(f"{work}/spool")

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{work}/rows/batch={batch_id}")

    for _ in range(2):
        jobs.ingest_stream(spark, f"{work}/spool", f"{work}/state", [keep], lambda: moment(RUN_TS)).awaitTermination()
    rows = spark.read.parquet(f"{work}/rows")
    return rows.select("oaiuri", stamp("datestamp").alias("datestamp"), "is_deleted", "payload_xml")


@query("t02_streaming_upsert", with_ctes(f"SELECT {SHOW} FROM applied_rows", CONTENT_CTES))
def streaming_upsert(spark, folder):
    work = work_folder(spark, "upsert")
    _run(spark, folder, work)
    return show_content(jobs.read_store(spark, f"{work}/store"))


_SILENT = ("svc0", "svc1")


# Rows of the silent sources that the run does not mention: live ones become tombstones, old tombstones only count as changed.
_SYNCED = f"""synced AS (
  SELECT uri, oaiuri, serviceid, CASE WHEN NOT lost THEN xmldata END AS xmldata, CASE WHEN lost THEN TIMESTAMP '{RUN_TS}' ELSE changed END AS changed,
         added, CASE WHEN lost THEN coalesce(deleted, TIMESTAMP '{RUN_TS}') ELSE deleted END AS deleted,
         CASE WHEN lost THEN coalesce(deleted, TIMESTAMP '{RUN_TS}') ELSE datestamp END AS datestamp, status, nativeurl
  FROM (SELECT *, action IS NULL AND serviceid IN (SELECT serviceid FROM records WHERE serviceid IN {_SILENT}) AS lost FROM applied_rows))"""


def _policies(spark: SparkSession, folder: str) -> DataFrame:
    services = spark.read.parquet(f"{folder}/supplier.parquet").select(F.concat(F.lit("svc"), text("s_suppkey")).alias("serviceid"))
    policy = F.when(F.col("serviceid").isin(*_SILENT), "transient").otherwise("persistent")
    zero = spark.range(1).select(F.lit("svc0").alias("serviceid"))
    return services.unionByName(zero).distinct().withColumn("deleted_policy", policy)


# Events per file of a batch.
_FILE_EVENTS = 250_000


def _harvest_in_batches(
    spark: SparkSession, folder: str, work: str, *more: jobs.BatchHandler, batches: int = 4, old: DataFrame | None = None
) -> None:
    """All events as one run whose batches come one after the other, in the order of the events; ``old`` is the content before it.

    All batches have the same number of files, each written by a task of its own, so the stream takes a whole batch at a time.
    """
    events = spark.read.parquet(f"{folder}/events.parquet")
    least, most = events.agg(F.min("event_id"), F.max("event_id")).first()
    least, span = least or 0, max(1, (most or 0) - (least or 0) + 1)
    bounds = [least - (-k * span // batches) for k in range(batches)]
    upper = [*(F.col("event_id") < b for b in bounds[1:]), F.lit(True)]
    parts = [(F.col("event_id") >= low) & high for low, high in zip(bounds, upper)]
    counts = events.agg(*[F.count_if(part).alias(f"n{k}") for k, part in enumerate(parts)]).first()
    # rows are dealt in turn: with so many for each file none stays empty, and a batch without its number of files would take some of the next
    files = max(1, min(counts) // _FILE_EVENTS)
    for part in parts:
        rows = events.filter(part)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(f"{work}/spool")
    jobs.write_version(old_content(spark, folder) if old is None else old, f"{work}/store", 0)
    handler = jobs.upsert_batch(f"{work}/store", _split, lambda: moment(RUN_TS), services=_policies(spark, folder))
    for _ in range(2):  # the second start finds nothing and ends nothing
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{work}/spool")
        jobs.table_stream(stream, f"{work}/state", [handler, *more]).awaitTermination()


@query("t01_source_policies", with_ctes(f"SELECT {SHOW} FROM synced", CONTENT_CTES, _SYNCED))
def source_policies(spark, folder):
    """Two sources send all they have in each run of several batches, the others report deletions by headers."""
    work = work_folder(spark, "policies")
    _harvest_in_batches(spark, folder, work)
    return show_content(jobs.read_store(spark, f"{work}/store"))


@query("t01_synced_index", with_ctes(
    "SELECT uri AS item_id, serviceid, 'itemTitle' AS index, xmldata AS value FROM synced WHERE deleted IS NULL "
    "UNION ALL SELECT uri, serviceid, '_htmlurl', nativeurl FROM synced WHERE deleted IS NULL", CONTENT_CTES, _SYNCED))
def synced_index(spark, folder):
    """Postings after the same run: its end takes back those of the rows that it deletes."""
    work = work_folder(spark, "synced")
    old = written(old_content(spark, folder))
    outputs.replace_postings(_flatten(store.live_rows(old)), f"{work}/postings")
    _harvest_in_batches(spark, folder, work, jobs.index_batch(f"{work}/store", f"{work}/postings", _flatten), old=old)
    return outputs.read_postings(spark, f"{work}/postings").select("item_id", "serviceid", "index", "value")


def _flatten(rows: DataFrame) -> DataFrame:
    entries = F.array(
        F.struct(F.lit("itemTitle").alias("index"), F.col("xmldata").alias("value")),
        F.struct(F.lit("_htmlurl").alias("index"), F.col("nativeurl").alias("value")),
    )
    return rows.select(
        F.col("uri").alias("item_id"), "serviceid", F.explode(entries).alias("e")
    ).select("item_id", "e.index", F.lit(0).alias("pos"), "e.value", "serviceid")


@query("t03_incremental_index", with_ctes(
    "SELECT uri AS item_id, serviceid, 'itemTitle' AS index, xmldata AS value FROM applied_rows WHERE deleted IS NULL "
    "UNION ALL SELECT uri, serviceid, '_htmlurl', nativeurl FROM applied_rows WHERE deleted IS NULL", CONTENT_CTES))
def incremental_index(spark, folder):
    work = work_folder(spark, "index")
    outputs.replace_postings(_flatten(store.live_rows(old_content(spark, folder))), f"{work}/postings")
    _run(spark, folder, work, jobs.index_batch(f"{work}/store", f"{work}/postings", _flatten))
    return outputs.read_postings(spark, f"{work}/postings").select("item_id", "serviceid", "index", "value")


@query("t04_late_and_unparsable", with_ctes(f"""
SELECT uri, CASE WHEN f.xmldata IS NOT NULL THEN f.xmldata ELSE c.xmldata END AS xmldata,
  strftime(coalesce(f.datestamp, c.datestamp), '%Y-%m-%d %H:%M:%S') AS datestamp
FROM content c FULL OUTER JOIN late f USING (uri)""", CONTENT_CTES + f""", late AS (
  SELECT uri, arg_max(xmldata, file_pos) AS xmldata, arg_max(CASE WHEN event_type = 'view' THEN TIMESTAMP '{RUN_TS}'
    ELSE TIMESTAMP '2023-06-01 00:00:00' END, file_pos) AS datestamp FROM event_rows GROUP BY uri)"""))
def late_and_unparsable(spark, folder):
    """All events arrive with a datestamp that is old or unreadable, and still overwrite the store."""
    work = work_folder(spark, "late")
    jobs.write_version(old_content(spark, folder), f"{work}/store", 0)

    def split(batch):
        rows = event_rows(batch)
        stated = F.when(F.col("event_type") == "view", "yesterday").otherwise("2023-06-01")
        read = F.coalesce(stated.try_cast("timestamp_ntz"), moment(RUN_TS))
        rows = rows.withColumn("datestamp", read)
        return rows.drop("event_type"), rows.filter(F.lit(False))

    handler = jobs.upsert_batch(f"{work}/store", split, lambda: moment(RUN_TS))
    jobs.table_stream(_events(spark, folder), f"{work}/state", [handler]).awaitTermination()
    return jobs.read_store(spark, f"{work}/store").select("uri", "xmldata", stamp("datestamp").alias("datestamp"))


@query("t05_runlog_stream", with_ctes(
    "SELECT serviceid, eventid, eventtype, message FROM (SELECT *, row_number() OVER (PARTITION BY serviceid "
    "ORDER BY eventts DESC, eventid DESC) AS rn FROM log) WHERE rn = 1", RUN_LOG))
def runlog_stream(spark, folder):
    work = work_folder(spark, "log")
    log = run_log_rows(_events(spark, folder))
    jobs.status_stream(log, f"{work}/status", f"{work}/state").awaitTermination()
    # later micro-batches hold newer rows of a source
    return jobs.latest_status(spark.read.parquet(f"{work}/status")).select("serviceid", "eventid", "eventtype", "message")


@query("s07_postings_sink", with_ctes(
    "SELECT uri AS item_id, 'svc:' || serviceid || '#1' AS serviceid, 'itemTitle' AS index, xmldata AS value FROM content WHERE deleted IS NULL "
    "AND serviceid <> 'svc3' UNION ALL SELECT uri, 'svc:' || serviceid || '#1', '_htmlurl', nativeurl FROM content WHERE deleted IS NULL "
    "AND serviceid <> 'svc3'", CONTENT_CTES))
def postings_sink(spark, folder):
    """Written twice: a full run replaces the sources it holds; then one source is taken back.  Source names hold special characters."""
    path = work_folder(spark, "postings")
    content = old_content(spark, folder).withColumn("serviceid", F.concat(F.lit("svc:"), F.col("serviceid"), F.lit("#1")))
    rows = _flatten(store.live_rows(content))
    outputs.replace_postings(rows.withColumn("value", F.upper("value")), path, 0)
    outputs.replace_postings(rows, path, 1)
    outputs.drop_postings(rows.filter("serviceid = 'svc:svc3#1'"), path, 2)
    return outputs.read_postings(spark, path).select("item_id", "serviceid", "index", "value")


@query("s11_archive_sink", "SELECT doc_id, source, lang, md5(text) AS digest FROM documents")
def archive_sink(spark, folder):
    path = work_folder(spark, "archive")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "text")
    outputs.archive(docs, path, "first")
    kept = outputs.read_archive(spark, path, "first", "doc_id bigint, source string, lang string, text string")
    return kept.select("doc_id", "source", "lang", F.md5("text").alias("digest"))


@query("m05_rollback_pending", with_ctes(f"SELECT {SHOW} FROM content", CONTENT_CTES))
def rollback_pending(spark, folder):
    """A run that fails half way leaves the store as it was: its version is never completed."""
    work = work_folder(spark, "rollback")
    jobs.write_version(old_content(spark, folder), f"{work}/store", 0)

    def broken(batch):
        records, headers = _split(batch)
        fails = F.when(F.col("uri").isNotNull(), F.raise_error(F.lit("the harvest is broken"))).cast("string")
        return records.withColumn("xmldata", fails), headers

    handler = jobs.upsert_batch(f"{work}/store", broken, lambda: moment(RUN_TS))
    events = spark.read.parquet(f"{folder}/events.parquet")
    try:
        handler(events, 0)
    except PySparkException as error:  # the failure is the point, any other is not
        if "the harvest is broken" not in str(error):
            raise
    return show_content(jobs.read_store(spark, f"{work}/store"))
