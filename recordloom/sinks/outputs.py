"""Published outputs: postings table, sitemaps, feeds, archives, run log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars
from recordloom.operators import terms
from recordloom.operators.filters import url_allowed
from recordloom.operators.shuffle import global_rank
from recordloom.operators.store import live_rows, retain

# URLs per sitemap, and how often a page is said to change.
SITEMAP_URLS = 40_000
CHANGE_FREQUENCY = "monthly"

_SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"


# ---- postings ----------------------------------------------------------------------------
#
# A postings folder is a list of versions, each written once as one table.  A row is a posting (p), an item whose older postings
# no longer hold (c), or a source whose older postings no longer hold (s).  A run writes what it changed, then notes which rows of other
# versions no longer hold: one bitmap of row numbers per 32,768 rows of a file that lost any.  Readers skip those rows by file and row number; nothing
# is joined by item.  ``compact_postings`` folds the versions into one.
#
# A version counts once its note is there (a row without a file), so a run that fails half way is not read.  A version that is written again
# gets new files; its note then also holds what versions after it took back, so versions may be repeated in any order.

_POSTING = "kind string, item_id string, index string, pos int, value string, serviceid string"
_POSTING_ROW = f"{_POSTING}, {terms.FORMS}, version bigint"
_TAKEN = "file string, block bigint, bits binary, version bigint"


def _located(spark: SparkSession, path: str) -> DataFrame:
    """All rows ever written, with the version folder's file, the block of 32,768 rows and the bit that stand for each."""
    rows = spark.read.schema(_POSTING_ROW).parquet(path)
    number = F.col("_row") + 1  # bitmap functions count from one
    return rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")).select(
        *rows.columns, "_file", F.bitmap_bucket_number(number).alias("_block"), F.bitmap_bit_position(number).alias("_bit"))


def _write_postings(rows: DataFrame, path: str, version: int) -> None:
    """One version, then its note.  Sorted ranges cluster the files by index and term, so a filter on them skips row groups."""
    keys = ["kind", "index", "term", "value", "item_id"]
    terms.with_forms(rows).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/version={version}")
    _note_taken(rows.sparkSession, path, version)


def _note_taken(spark: SparkSession, path: str, version: int) -> None:
    """Which rows of older versions this one takes back, and which of its own rows later ones do."""
    rows = _located(spark, path)
    postings = rows.filter((F.col("kind") == "p") & (F.col("version") >= 0))
    marks = rows.filter((F.col("kind") != "p") & (F.col("version") >= version))
    parts = [postings.filter(F.lit(False)).select("_file", "_block", "_bit")]
    for kind, key in (("c", "item_id"), ("s", "serviceid")):
        by = marks.filter(F.col("kind") == kind).select(F.col(key).alias("_key"), F.col("version").alias("_by")).distinct()
        if by.isEmpty():  # few versions have marks of both kinds, and rows sorted by kind tell without being read
            continue
        met = (F.col(key) == F.col("_key")) & (F.col("version") < F.col("_by")) & (
            (F.col("_by") == version) | (F.col("version") == version))
        parts.append(postings.join(by, met, "left_semi").select("_file", "_block", "_bit"))
    bits = reduce(DataFrame.unionByName, parts).groupBy(F.col("_file").alias("file"), F.col("_block").alias("block")).agg(
        F.bitmap_construct_agg("_bit").alias("bits"))
    done = spark.range(1).select(
        F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("binary").alias("bits"))
    bits.unionByName(done).write.mode("overwrite").parquet(f"{path}/_taken/version={version}")


def _rows(df: DataFrame, kind: str) -> DataFrame:
    """Postings, uris or sources as rows of a version."""
    kinds = dict(field.split(" ") for field in _POSTING.split(", ")[1:])
    return df.select(
        F.lit(kind).alias("kind"),
        *[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def replace_postings(postings: DataFrame, path: str, version: int = 0) -> None:
    """Full run: the postings (with serviceid) of a source replace all its former ones."""
    _write_postings(_rows(postings, "p").unionByName(_rows(postings.select("serviceid").distinct(), "s")), path, version)


def update_postings(postings: DataFrame, changed: DataFrame, path: str, version: int) -> None:
    """Incremental run: the changed uris (tombstones included) lose their postings and get the fresh ones, if any.

    Only the run's own rows are written, whatever the size of their sources; a record that moved to another source leaves the old one.
    Of older versions the ids are read, once, to find the rows that no longer hold.
    """
    uris = changed.select(F.col("uri").alias("item_id")).distinct()
    _write_postings(_rows(postings, "p").unionByName(_rows(uris, "c")), path, version)


def drop_postings(services: DataFrame, path: str, version: int) -> None:
    """Take back all postings of some sources, whatever characters their names have."""
    _write_postings(_rows(services.select("serviceid").distinct(), "s"), path, version)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """The postings that hold, with their search forms.

    The notes are at most one bit per row written (a thousandth of the table); where many rows were taken back, ``compact_postings``
    makes them small again.
    """
    notes = spark.read.schema(_TAKEN).parquet(f"{path}/_taken")
    finished = notes.filter(F.col("file").isNull()).select(F.col("version").alias("_done")).distinct()
    taken = notes.filter(F.col("file").isNotNull()).groupBy(F.col("file").alias("_in"), F.col("block").alias("_at")).agg(
        F.bitmap_or_agg("bits").alias("_bits"))
    rows = _located(spark, path).filter("kind = 'p'").join(finished, F.col("version") == F.col("_done"), "left_semi")
    rows = rows.join(taken, (F.col("_file") == F.col("_in")) & (F.col("_block") == F.col("_at")), "left")
    octet = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    gone = F.col("_bits").isNotNull() & (F.getbit(octet, (F.col("_bit") % 8).cast("int")) == 1)
    return rows.filter(~gone).drop("kind", "version", "_file", "_block", "_bit", "_in", "_at", "_bits")


def compact_postings(spark: SparkSession, path: str, target: str) -> None:
    """Copy what holds into a new folder as its version 0."""
    _write_postings(_rows(read_postings(spark, path), "p"), target, 0)


# ---- sitemap -----------------------------------------------------------------------------

def sitemap(
    content: DataFrame, allow: list[str], size: int = SITEMAP_URLS, base: str = ""
) -> tuple[DataFrame, DataFrame]:
    """URLs of live records in numbered batches, and one index row per batch, both ordered by uri."""
    rows = live_rows(content).filter(F.col("nativeurl").isNotNull() & url_allowed(F.col("nativeurl"), allow))
    ranked = global_rank(rows.select("uri", "nativeurl", "changed"), [F.col("uri")])
    urls = ranked.select(
        F.ceil(F.col("rank") / size).cast("bigint").alias("batch"),
        "rank",
        scalars.without_quotes("nativeurl").alias("loc"),
        F.date_format("changed", "yyyy-MM-dd").alias("lastmod"),
        F.lit(CHANGE_FREQUENCY).alias("changefreq"),
    )
    index = urls.groupBy("batch").agg(F.count(F.lit(1)).alias("n_urls"), F.max("lastmod").alias("lastmod")).select(
        "batch", "n_urls", "lastmod", F.concat(F.lit(base + "sitemap?part="), F.col("batch")).alias("loc")
    )
    return urls, index


def sitemap_documents(urls: DataFrame) -> DataFrame:
    """One document per batch; a batch holds at most the fixed number of URLs."""
    entry = F.concat(
        F.lit("<url><loc><![CDATA["), F.col("loc"), F.lit("]]></loc>"),
        F.coalesce(F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>")), F.lit("")),
        F.lit("<changefreq>"), F.col("changefreq"), F.lit("</changefreq></url>"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    body = F.array_join(F.transform(ordered, lambda e: e["entry"]), "\n")
    return urls.groupBy("batch").agg(body.alias("_body")).select("batch", F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{_SITEMAP_NS}">\n'),
        F.col("_body"), F.lit("\n</urlset>"),
    ).alias("document"))


# ---- feed --------------------------------------------------------------------------------

_PRESENTATION = (
    "itemLabel string, description array<string>, "
    "representations struct<representation:array<struct<_VALUE:string,_format:string>>>, "
    "image array<struct<src:array<struct<_VALUE:string,_type:string>>>>"
)


def feed_items(hits: DataFrame) -> DataFrame:
    """One feed item per hit.

    ``hits`` has item_id, title, keywords, build_date and ``presentation`` (markup of the hit).
    """
    parsed = F.from_xml("presentation", _PRESENTATION, {"rowTag": "item", "ignoreNamespace": "true"})
    rows = hits.withColumn("_p", parsed)
    sources = F.flatten(F.transform(F.coalesce("_p.image", F.array()), lambda image: image["src"]))

    def last_of(entries: Column, attribute: str, wanted: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e[attribute] == wanted), F.lit(-1))["_VALUE"]

    place = F.regexp_extract("presentation", r"(?s)<(?:\w+:)?where>\s*<[^>]*>\s*<[^>]*>([^<]*)<", 1)
    thumbnail = last_of(sources, "_type", "thumbnail")
    image = last_of(sources, "_type", "lowres")
    link = last_of(F.col("_p.representations.representation"), "_format", "HTML")
    return rows.select(
        "item_id",
        F.coalesce(scalars.blank_to_null("title"), F.col("_p.itemLabel")).alias("title"),
        scalars.clean_url(link).alias("link"),
        F.nullif(F.array_join("_p.description", " "), F.lit("")).alias("description"),
        thumbnail.alias("thumbnail"),
        image.alias("image"),
        F.when(image.isNotNull(), scalars.mime_of(image)).alias("image_type"),
        F.filter(F.split(F.coalesce("keywords", F.lit("")), " "), lambda word: word != "").alias("keywords"),
        F.col("build_date").try_cast("date").alias("published"),
        F.get(F.split(place, ","), F.lit(0)).try_cast("double").alias("lon"),
        F.get(F.split(place, ","), F.lit(1)).try_cast("double").alias("lat"),
    )


# ---- archive and log ---------------------------------------------------------------------

def archive(harvest: DataFrame, path: str, run: str) -> None:
    """Compressed copy of a full harvest, one folder per run."""
    harvest.write.mode("overwrite").option("compression", "gzip").json(f"{path}/run={run}")


def read_archive(spark: SparkSession, path: str, run: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/run={run}")


def append_log(events: DataFrame, path: str) -> None:
    """Append log rows, in a folder per day so that retention can skip whole days."""
    events.withColumn("day", F.to_date("eventts")).write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Log rows within the retention time; older days are not read."""
    log = spark.read.parquet(path)
    recent = F.col("day") >= F.to_date(now.cast("timestamp_ntz") - F.expr("INTERVAL 22 DAYS"))
    return retain(log.filter(recent), now).drop("day")
