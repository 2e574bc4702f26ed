"""Record store: upserts, tombstones, full synchronisation, run figures, source state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.shuffle import keep_latest, top_per_group

CONTENT = (
    "uri string, oaiuri string, serviceid string, xmldata string, changed timestamp_ntz, "
    "added timestamp_ntz, deleted timestamp_ntz, datestamp timestamp_ntz, status bigint, nativeurl string"
)
COLUMNS = [field.strip().split(" ")[0] for field in CONTENT.split(",")]
RECORD = ["uri", "oaiuri", "serviceid", "xmldata", "datestamp", "nativeurl", "file_pos"]

# Days a run log is kept, and its event kinds.
LOG_DAYS = 21
INFO, ERROR, WARNING = 0, 1, 2


def _moment(value: Column) -> Column:
    return value.cast("timestamp_ntz")


# ---- reading -----------------------------------------------------------------------------

def live_rows(content: DataFrame, service: str | None = None) -> DataFrame:
    """Rows that are not tombstones, of one source or of all."""
    rows = content.filter(F.col("deleted").isNull())
    return rows if service is None else rows.filter(F.col("serviceid") == service)


def changed_since(content: DataFrame, moment: Column) -> DataFrame:
    """Rows changed strictly after ``moment``, tombstones included."""
    return content.filter(F.col("changed") > _moment(moment))


def lookup(content: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with existence (tombstones count) and the payload of live records."""
    wanted = requests.select("uri").distinct()
    found = content.select(
        "uri",
        F.lit(True).alias("known"),
        F.when(F.col("deleted").isNull(), F.col("xmldata")).alias("xmldata"),
    )
    return wanted.join(found, "uri", "left").select(
        "uri", F.coalesce("known", F.lit(False)).alias("known"), "xmldata"
    )


def union_sources(*parts: DataFrame) -> DataFrame:
    """All sources in one corpus; columns are matched by name."""
    corpus = parts[0]
    for part in parts[1:]:
        corpus = corpus.unionByName(part, allowMissingColumns=True)
    return corpus


# ---- one run -----------------------------------------------------------------------------

def _merge(content: DataFrame, records: DataFrame, run_ts: Column) -> DataFrame:
    """Store joined with the last record per uri; ``hits`` and ``new_pos`` describe this run.

    Both sides have one row per uri, so no join key is hot.
    """
    fresh = keep_latest(records.select(*RECORD), ["uri"], ["file_pos"])
    old = content.select("uri", *[F.col(c).alias(f"old_{c}") for c in COLUMNS if c != "uri"])
    joined = old.join(fresh, "uri", "full_outer")
    seen = F.col("hits").isNotNull()

    def taken(name: str, new: Column) -> Column:
        return F.when(seen, new).otherwise(F.col(f"old_{name}")).alias(name)

    return joined.select(
        "uri",
        taken("oaiuri", F.col("oaiuri")),
        taken("serviceid", F.col("serviceid")),
        taken("xmldata", F.col("xmldata")),
        taken("changed", _moment(run_ts)),
        # a known record keeps its first date; a tombstone that comes back is live again
        taken("added", F.when(F.col("old_serviceid").isNull(), _moment(run_ts)).otherwise(F.col("old_added"))),
        taken("deleted", F.lit(None).cast("timestamp_ntz")),
        taken("datestamp", F.col("datestamp")),
        taken("status", F.lit(0).cast("bigint")),
        taken("nativeurl", F.col("nativeurl")),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.col("file_pos").alias("new_pos"),
        F.col("old_serviceid"),
    )


def _tombstone(rows: DataFrame, gone: Column, run_ts: Column, moment: Column) -> DataFrame:
    values = {
        "status": F.lit(0).cast("bigint"),
        "changed": _moment(run_ts),
        "datestamp": moment,
        "deleted": moment,
        "xmldata": F.lit(None).cast("string"),
    }
    return rows.withColumns({name: F.when(gone, value).otherwise(F.col(name)) for name, value in values.items()})


def _delete_positions(headers: DataFrame) -> DataFrame:
    """Last delete header per source and harvest identifier."""
    return (
        headers.groupBy("serviceid", "oaiuri")
        .agg(F.max(F.struct("file_pos", "datestamp")).alias("_last"), F.count(F.lit(1)).alias("delete_hits"))
        .select("serviceid", "oaiuri", F.col("_last.file_pos").alias("delete_pos"),
                F.col("_last.datestamp").alias("delete_at"), "delete_hits")
    )


def upsert(content: DataFrame, records: DataFrame, run_ts: Column) -> DataFrame:
    """Store after a run of records: update by uri, else insert; the last hit of a uri wins."""
    return _merge(content, records, run_ts).select(*COLUMNS)


def apply_deletes(content: DataFrame, headers: DataFrame, run_ts: Column) -> DataFrame:
    """Store after a run of delete headers, matched by source and harvest identifier."""
    joined = content.join(_delete_positions(headers), ["serviceid", "oaiuri"], "left")
    gone = F.col("delete_pos").isNotNull()
    return _tombstone(joined, gone, run_ts, F.col("delete_at")).select(*COLUMNS)


def apply_run(content: DataFrame, records: DataFrame, headers: DataFrame, run_ts: Column) -> DataFrame:
    """Store after one harvest with records and delete headers in file order, plus ``action``.

    ``action`` is i(nsert), u(pdate), d(elete) or null; ``hits`` counts the records of the row.
    """
    merged = _merge(content, records, run_ts)
    joined = merged.join(_delete_positions(headers), ["serviceid", "oaiuri"], "left")
    gone = F.col("delete_pos").isNotNull() & (F.col("new_pos").isNull() | (F.col("delete_pos") > F.col("new_pos")))
    action = (
        F.when(gone, "d")
        .when((F.col("hits") > 0) & F.col("old_serviceid").isNull(), "i")
        .when(F.col("hits") > 0, "u")
    )
    marked = joined.withColumn("action", action)
    return _tombstone(marked, gone, run_ts, F.col("delete_at")).select(*COLUMNS, "action", "hits")


def full_sync(content: DataFrame, records: DataFrame, service: str, run_ts: Column) -> DataFrame:
    """Store after a full harvest of one source: rows not seen again become tombstones.

    Old tombstones get a new change date but keep their deletion date.
    """
    merged = _merge(content, records, run_ts)
    gone = (F.col("hits") == 0) & (F.col("serviceid") == service)
    moment = F.coalesce("deleted", _moment(run_ts))
    return _tombstone(merged, gone, run_ts, moment).select(*COLUMNS)


def drop_source(content: DataFrame, service: str, run_ts: Column) -> DataFrame:
    """Store with every row of one source as a tombstone."""
    moment = F.coalesce("deleted", _moment(run_ts))
    return _tombstone(content, F.col("serviceid") == service, run_ts, moment).select(*COLUMNS)


def bad_deletes(headers: DataFrame, services: DataFrame) -> DataFrame:
    """Delete headers of sources that declare they send none, counted per source."""
    silent = services.filter(F.col("deleted_policy") == "no").select("serviceid")
    return (
        headers.join(silent, "serviceid", "left_semi")
        .groupBy("serviceid")
        .agg(F.count(F.lit(1)).alias("n_bad"))
    )


def check_deletes(headers: DataFrame, services: DataFrame) -> None:
    """Fail a run in which a source sends delete headers although it declares that it sends none."""
    found = bad_deletes(headers, services).orderBy("serviceid").limit(5).collect()
    if found:
        raise ValueError("delete headers from sources that declare none: " + ", ".join(f"{r.serviceid} ({r.n_bad})" for r in found))


def tombstones(rows: DataFrame, run_ts: Column) -> DataFrame:
    """Content rows as they are when a run no longer finds them."""
    return _tombstone(rows, F.lit(True), run_ts, F.coalesce("deleted", _moment(run_ts))).select(*COLUMNS)


def run_counters(content: DataFrame, records: DataFrame, headers: DataFrame) -> DataFrame:
    """Inserted, updated and deleted records per source of one run, and whether anything changed.

    Every event of the run counts: the first record of a new uri inserts, any other one updates, and a delete header deletes
    each row that has its source and harvest identifier at that moment.  Rows of a uri change hands during the run, so
    rows open and close in file order, and a running sum tells how many are open where a header stands.
    """
    known = content.select("uri").distinct()
    first = records.groupBy("uri").agg(F.min(F.struct("file_pos", "serviceid")).alias("_first"))
    inserted = first.join(known, "uri", "left_anti").groupBy(F.col("_first.serviceid").alias("serviceid")).agg(
        F.count(F.lit(1)).alias("inserted"))
    stored = records.groupBy("serviceid").agg(F.count(F.lit(1)).alias("_records"))

    state = ["uri", "serviceid", "oaiuri", "file_pos"]
    old = content.withColumn("file_pos", F.lit(None).cast(records.schema["file_pos"].dataType)).withColumn("_age", F.lit(0))
    states = old.select(*state, "_age").unionByName(records.select(*state).withColumn("_age", F.lit(1)))
    following = Window.partitionBy("uri").orderBy("_age", "file_pos")
    states = states.withColumn("_until", F.lead(F.struct("_age", "file_pos")).over(following))
    key = ["serviceid", "oaiuri"]
    opened = states.select(*key, F.struct("_age", "file_pos").alias("_at"), F.lit(1).alias("_step"), F.lit(0).alias("_header"))
    closed = states.filter(F.col("_until").isNotNull()).select(*key, F.col("_until").alias("_at"), F.lit(-1).alias("_step"), F.lit(0).alias("_header"))
    asked = headers.select(*key, F.struct(F.lit(1).alias("_age"), "file_pos").alias("_at"), F.lit(0).alias("_step"), F.lit(1).alias("_header"))
    running = F.sum("_step").over(Window.partitionBy(*key).orderBy("_at", "_header").rowsBetween(Window.unboundedPreceding, 0))
    deleted = opened.unionByName(closed).unionByName(asked).withColumn("_open", running).filter("_header = 1").groupBy("serviceid").agg(
        F.sum("_open").alias("deleted"))

    sources = reduce(DataFrame.unionByName, [part.select("serviceid") for part in (content, records, headers)]).distinct()
    counts = sources.join(inserted, "serviceid", "left").join(stored, "serviceid", "left").join(deleted, "serviceid", "left").na.fill(0)
    return counts.select(
        "serviceid", "inserted", (F.col("_records") - F.col("inserted")).alias("updated"), F.col("deleted").cast("bigint").alias("deleted"),
        (F.col("_records") + F.col("deleted") > 0).alias("changed"))


def advance_services(services: DataFrame, summary: DataFrame) -> DataFrame:
    """Source state after a run: harvest date moves on a clean run, first index date is set once."""
    joined = services.join(summary, "serviceid", "left")
    clean = F.col("n_errors") == 0
    return joined.select(
        *[c for c in services.columns if c not in ("lastharvestdate", "firstindexdate")],
        F.when(clean, F.col("run_ts")).otherwise(F.col("lastharvestdate")).alias("lastharvestdate"),
        F.coalesce("firstindexdate", "run_ts").alias("firstindexdate"),
    )


def source_counts(content: DataFrame, docs: DataFrame) -> DataFrame:
    """Live rows and indexed documents per source; ``drift`` is their difference."""
    live = live_rows(content).groupBy("serviceid").agg(F.count(F.lit(1)).alias("n_live"))
    indexed = docs.groupBy("serviceid").agg(F.count(F.lit(1)).alias("n_indexed"))
    joined = live.join(indexed, "serviceid", "full_outer").na.fill(0, ["n_live", "n_indexed"])
    return joined.withColumn("drift", F.col("n_live") - F.col("n_indexed"))


# ---- run log -----------------------------------------------------------------------------

def retain(log: DataFrame, now: Column, days: int = LOG_DAYS) -> DataFrame:
    """Log rows that are not older than ``days``."""
    return log.filter(F.col("eventts") >= _moment(now) - F.expr(f"INTERVAL {int(days)} DAYS"))


def latest_error(log: DataFrame) -> DataFrame:
    """Message of every source whose newest log row is an error."""
    newest = log.groupBy("serviceid").agg(
        F.max(F.struct("eventts", "eventid", "eventtype", "message")).alias("_row")
    )
    return newest.filter(F.col("_row.eventtype") == ERROR).select(
        "serviceid", F.col("_row.eventts").alias("eventts"), F.col("_row.message").alias("message")
    )


def log_history(log: DataFrame, service: str | None = None) -> DataFrame:
    """Log lines in time order with the mark for warnings and errors."""
    rows = log if service is None else log.filter(F.col("serviceid") == service)
    mark = F.when(F.col("eventtype") != INFO, "*** ").otherwise("")
    stamp = F.date_format("eventts", "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        "serviceid", "eventts", "eventid",
        F.concat(stamp, F.lit(": "), mark, F.col("message")).alias("line"),
    ).orderBy("serviceid", "eventts", "eventid")


def problem_log(log: DataFrame, n: int, sort: str = "eventts", direction: str = "desc") -> DataFrame:
    """First ``n`` warnings and errors by one column, ties by event id."""
    allowed = ["serviceid", "eventtype", "eventts", "message"]
    if sort not in allowed:
        raise ValueError(f"bad sort column: {sort}, must be one of {allowed}")
    if direction not in ("asc", "desc"):
        raise ValueError(f"bad sort direction: {direction}")
    if n <= 0:
        raise ValueError(f"bad number of rows: {n}, must be > 0")
    key = F.col(sort).asc() if direction == "asc" else F.col(sort).desc()
    return log.filter(F.col("eventtype") > INFO).orderBy(key, F.col("eventid").asc()).limit(n)


def problems(events: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct messages with counts per source and operation, in order of first appearance.

    All messages are listed; with a ``cap``, the first so many and a marker row that counts the further ones.  ``events``
    has serviceid, operation, message and a ``seq`` that gives the order.
    """
    counted = events.groupBy("serviceid", "operation", "message").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )
    group = ["serviceid", "operation"]
    order = [F.col("first_seq"), F.col("message")]
    if cap is None:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")
        return counted.select(*group, "message", "n", place.alias("place"))
    listed = top_per_group(counted, group, order, cap).select(*group, "message", "n", "place")
    distinct = counted.groupBy(*group).agg(F.count(F.lit(1)).alias("_messages"))
    more = distinct.filter(F.col("_messages") > cap).select(
        *group, F.lit("more problems").alias("message"),
        (F.col("_messages") - cap).alias("n"), F.lit(cap + 1).cast("bigint").alias("place"),
    )
    return listed.unionByName(more)


# ---- organisations -----------------------------------------------------------------------

def org_services(orgs: DataFrame, services: DataFrame) -> DataFrame:
    """One row per organisation and service; an organisation without services has one row.

    Long form instead of a list: an organisation may own any number of services.
    """
    owned = services.join(orgs, "kortnamn")
    owners = services.select("kortnamn").distinct()
    lone = orgs.join(owners, "kortnamn", "left_anti")
    return owned.unionByName(lone, allowMissingColumns=True)
