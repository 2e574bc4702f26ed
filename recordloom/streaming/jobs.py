"""Incremental jobs: file streams around the batch functions.

The store is a folder of parquet versions, one per micro-batch, each with only the rows that the
batch changed.  A replayed batch overwrites its own version, so retries do not apply it twice.

A harvest is a run of many batches: what a start of the stream reads until nothing is left, or what several starts read if one
fails on the way.  Sources that send all they have are synchronised when their run ends, in a version of its own: a row that no batch of the run
mentioned becomes a tombstone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators import store
from recordloom.operators.shuffle import keep_latest
from recordloom.sinks import outputs
from recordloom.sources.harvest import CUT, envelopes_of, file_pieces

BatchHandler = Callable[[DataFrame, int], None]


# ---- store folder ------------------------------------------------------------------------

# Folders of a version by hash of uri: a batch opens those that it touches.
BUCKETS = 16


def version_of(batch_id: int) -> int:
    """Version of a micro-batch.  Odd, so that each run's end has a number between its last batch and the next one."""
    return 2 * batch_id + 1


def _bucket() -> Column:
    return F.pmod(F.xxhash64("uri"), F.lit(BUCKETS)).cast("int")


def write_version(changes: DataFrame, path: str, version: int) -> None:
    """One version in buckets, at most one row per uri; a large bucket is split over tasks, small ones share them."""
    rows = changes.select(*store.COLUMNS).withColumn("bucket", _bucket()).hint("rebalance", "bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/version={version}")


def _versions(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    rows = spark.read.schema(store.CONTENT + ", version bigint, bucket int").parquet(path)
    return rows if below is None else rows.filter(F.col("version") < below)


def _without_payload(versions: DataFrame) -> DataFrame:
    """The same columns, but payloads are not read: a run replaces or drops those that it touches."""
    return versions.drop("xmldata").withColumn("xmldata", F.lit(None).cast("string"))


def read_store(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """Newest row per uri over all versions, or over those below one.

    The newest version of a uri is found on two narrow columns and hashed; payloads pass by it once and are never sorted.
    """
    rows = _versions(spark, path, below)
    newest = rows.groupBy("uri").agg(F.max("version").alias("version"))
    return rows.join(newest.hint("shuffle_hash"), ["uri", "version"], "left_semi").select(*store.COLUMNS)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Copy the current state into a new store folder as its version 0."""
    write_version(read_store(spark, path), target, 0)


def changed_rows(versions: DataFrame, records: DataFrame, headers: DataFrame, run_ts: Column) -> DataFrame:
    """Rows that a batch inserts, updates or deletes.

    Delete headers are matched on three narrow columns first; the newest row is picked only for uris that the batch may
    touch, from the buckets that hold them, and without its old payload.
    """
    keys = ["serviceid", "oaiuri"]
    by_header = versions.select("uri", *keys).join(headers.select(*keys).distinct(), keys, "left_semi")
    uris = records.select("uri").unionByName(by_header.select("uri")).distinct()
    opened = [row[0] for row in uris.select(_bucket()).distinct().collect()]  # at most BUCKETS numbers
    near = _without_payload(versions.filter(F.col("bucket").isin(opened))).join(uris, "uri", "left_semi")
    touched = keep_latest(near, ["uri"], ["version"]).select(*store.COLUMNS)
    return store.apply_run(touched, records, headers, run_ts).filter(F.col("action").isNotNull())


# ---- runs --------------------------------------------------------------------------------
#
# Beside the versions lie two small tables: the sources that sent records in a batch, and the runs that have ended.

_SOURCES, _RUNS = "serviceid string, version bigint", "first bigint, last bigint, closing bigint, ended timestamp_ntz"


def _note(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs that have ended: their first and last batch version, and the version that their end wrote."""
    return spark.read.schema(_RUNS).option("recursiveFileLookup", "true").parquet(f"{path}/_runs")


def open_versions(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """First and last version that batches wrote since the last run ended."""
    after = runs(spark, path).agg(F.max("closing")).first()[0] or 0
    found = spark.read.schema(_SOURCES).parquet(f"{path}/_sources").filter(F.col("version") > after).agg(F.min("version"), F.max("version")).first()
    return None if found[0] is None else (found[0], found[1])


def unseen_rows(versions: DataFrame, first: int, sources: DataFrame) -> DataFrame:
    """Newest rows of some sources (serviceid) that no version from ``first`` on mentions, tombstones included; without payloads."""
    newest = keep_latest(_without_payload(versions), ["uri"], ["version"])
    return newest.filter(F.col("version") < first).join(sources, "serviceid", "left_semi").select(*store.COLUMNS)


def end_run(spark: SparkSession, path: str, services: DataFrame, run_ts: Column) -> int | None:
    """End the run of the batches since the last end; the version of the newest end.

    Rows of its silent sources that the run did not mention become tombstones; older tombstones keep their date and count as
    changed.  Where no batch came, nothing ends.  If a crash leaves the version without its note, the next end writes it again.
    """
    span = open_versions(spark, path)
    if span is not None:
        first, last = span
        took_part = spark.read.schema(_SOURCES).parquet(f"{path}/_sources").filter(F.col("version").between(first, last))
        silent = services.filter(F.col("deleted_policy") != "persistent").select("serviceid").distinct()
        sources = silent.join(took_part, "serviceid", "left_semi")
        missing = store.tombstones(unseen_rows(_versions(spark, path, last + 1), first, sources), run_ts)
        write_version(missing, path, last + 1)
        span = spark.range(1).select(
            F.lit(first).cast("bigint").alias("first"), F.lit(last).cast("bigint").alias("last"), F.lit(last + 1).cast("bigint").alias("closing"),
            run_ts.cast("timestamp_ntz").alias("ended"))
        _note(span, f"{path}/_runs/closing={last + 1}")
    return runs(spark, path).agg(F.max("closing")).first()[0]


def upsert_batch(
    path: str,
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    run_ts: Callable[[], Column],
    order_by: str = "arrival",
    services: DataFrame | None = None,
) -> BatchHandler:
    """Handler that applies a micro-batch to the store folder.

    ``services`` (serviceid, deleted_policy) tells how a source reports deletions: a "persistent" one by delete headers; any other
    sends all it has, so what its run leaves out is deleted when the run ends; one that says "no" must not send delete headers, or the run fails and the
    store stays as it was.

    ``split`` turns the batch into records and delete headers.  Arrival order decides by default,
    however old a datestamp is; ``order_by="datestamp"`` lets the newest datestamp of a batch win.
    """
    if order_by not in ("arrival", "datestamp"):
        raise ValueError(f"order_by must be arrival or datestamp: {order_by}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, version_of(batch_id)
        records, headers = split(batch)
        records = records.filter(F.col("uri").isNotNull())  # broken ends of files are problems, not records
        if order_by == "datestamp":
            records = keep_latest(records, ["uri"], ["datestamp", "file_pos"]).drop("hits")
        if services is not None:
            store.check_deletes(headers, services)
        write_version(changed_rows(_versions(spark, path, below=version), records, headers, run_ts()), path, version)
        if services is not None:
            _note(records.select("serviceid").distinct(), f"{path}/_sources/version={version}")

    def end(spark: SparkSession, closing: int | None) -> int | None:
        if services is None:
            return closing
        for folder, kind in (("_sources", "serviceid string"), ("_runs", _RUNS)):  # readable before the first batch
            spark.createDataFrame([], kind).write.mode("append").parquet(f"{path}/{folder}")
        return end_run(spark, path, services, run_ts())

    handle.end = end
    return handle


def index_batch(
    path: str, postings_path: str, flatten: Callable[[DataFrame], DataFrame]
) -> BatchHandler:
    """Handler that re-flattens the records a store version changed and updates their postings.

    ``flatten`` turns live content rows into postings with serviceid.
    """
    def update(spark: SparkSession, version: int) -> None:
        changed = spark.read.schema(store.CONTENT).parquet(f"{path}/version={version}").select(*store.COLUMNS)
        outputs.update_postings(flatten(store.live_rows(changed)), changed, postings_path, version)

    def handle(batch: DataFrame, batch_id: int) -> None:
        update(batch.sparkSession, version_of(batch_id))

    def end(spark: SparkSession, closing: int | None) -> int | None:
        if closing is not None:
            update(spark, closing)
        return closing

    handle.end = end
    return handle


# ---- streams -----------------------------------------------------------------------------

class Run:
    """A started harvest: a streaming query whose handlers are told when all of it is applied."""

    def __init__(self, spark: SparkSession, query: StreamingQuery, handlers: list[BatchHandler]):
        self.spark, self.query, self.handlers = spark, query, handlers

    def awaitTermination(self) -> None:  # noqa: N802 (as the query's own)
        """Wait for the last batch, then end the run; a run that fails or is stopped stays open, and the next start goes on with it."""
        self.query.awaitTermination()
        closing = None
        for handler in self.handlers:
            if hasattr(handler, "end"):
                closing = handler.end(self.spark, closing)

    def stop(self) -> None:
        self.query.stop()


def ingest_stream(
    spark: SparkSession, path: str, checkpoint: str, handlers: list[BatchHandler], run_ts: Callable[[], Column],
    max_files: int = 1000,
) -> Run:
    """Feed new harvest files to the handlers, then stop.

    The checkpoint remembers which files are done: it is the state of the last good harvest.
    """
    lines = file_pieces(spark.readStream.option("lineSep", CUT).option("maxFilesPerTrigger", max_files).format("text").load(path))

    def envelopes(batch: DataFrame) -> DataFrame:
        return envelopes_of(batch, run_ts())

    return _start(lines, checkpoint, handlers, envelopes)


def table_stream(stream: DataFrame, checkpoint: str, handlers: list[BatchHandler]) -> Run:
    """Feed a stream of rows to the handlers, then stop."""
    return _start(stream, checkpoint, handlers, lambda batch: batch)


def _start(stream: DataFrame, checkpoint: str, handlers: list[BatchHandler], prepare: Callable[[DataFrame], DataFrame]) -> Run:
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch)
        for handler in handlers:
            handler(rows, batch_id)

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return Run(stream.sparkSession, query, handlers)


def first_seen(stream: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """Extension: drop repeats of a key that arrive within the lateness of its datestamp."""
    return stream.withWatermark("datestamp", lateness).dropDuplicatesWithinWatermark(keys)


def latest_status(log: DataFrame) -> DataFrame:
    """Newest log row per source, as a batch query or as the state of a stream."""
    newest = F.max(F.struct("eventts", "eventid", "eventtype", "message")).alias("_row")
    return log.groupBy("serviceid").agg(newest).select(
        "serviceid", "_row.eventts", "_row.eventid", "_row.eventtype", "_row.message"
    )


def log_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of log rows to the log folder, a version per micro-batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        log.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def status_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest log row per source; every micro-batch writes the sources it changed."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        latest_status(log).writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
