"""Harvest envelopes and record payloads as tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import written
from recordloom.sources.record_cut import cut_records
from recordloom.vocabulary import PUBLIC_NAMESPACES, Names

TRIPLE = (
    "item_id string, subject string, via string, predicate string, object string, object_kind string, pos int, "
    "version string, barred boolean"
)
_RDF = PUBLIC_NAMESPACES["rdf"]


def _unescape(text: Column) -> Column:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


_P = r"(?:[\w.-]+:)?"  # any prefix
_ATTRIBUTES = r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+"""  # up to the end of a start tag; quotes may hold its sign
_DECLARED = r"""\bxmlns(?::[\w.-]+)?\s*=\s*(?:"[^"]*"|'[^']*')"""


def _declarations(tags: Column) -> Column:
    """Namespace declarations of some start tags, as they are written."""
    return F.regexp_extract_all(tags, F.lit(_DECLARED), F.lit(0))


def _declared_name(declaration: Column) -> Column:
    return F.regexp_extract(declaration, r"^(xmlns(?::[\w.-]+)?)", 1)


def _with_namespaces(payload: Column, outer: Column) -> Column:
    """The payload with the declarations that hold outside of it; of several for a prefix the innermost, and its own before all."""
    root = F.regexp_extract(payload, r"(?s)^(?:<\?.*?\?>|<!--.*?-->|\s)*<[^\s/>]+[^>]*", 0)
    own = F.transform(_declarations(root), _declared_name)
    names = F.transform(outer, _declared_name)
    last = F.filter(outer, lambda d, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), F.get(names, i)) & ~F.array_contains(own, F.get(names, i)))
    at = F.length(F.regexp_extract(payload, r"(?s)^(?:<\?.*?\?>|<!--.*?-->|\s)*<[^\s/>]+", 0))
    added = F.concat(F.substr(payload, F.lit(1), at), F.lit(" "), F.array_join(last, " "), F.substr(payload, at + 1))
    return F.when((F.size(last) > 0) & (at > 0), added).otherwise(payload)


def parse_envelopes(envelopes: DataFrame, column: str, run_ts: Column, outer: str | None = None) -> DataFrame:
    """Rows of record envelopes: identifier, datestamp (run time when unreadable), delete flag, payload.

    The payload stays as it is written; namespaces that are declared around it (in the envelope, and in the array ``outer``) are added to
    its first element.  Tags may have any prefix.
    """
    text = F.col(column)
    header = F.regexp_extract(text, rf"(?s)<{_P}header\b{_ATTRIBUTES}(?:(?<=/)>|(?<!/)>.*?</{_P}header\s*>)", 0)
    stamp = F.trim(F.regexp_extract(header, rf"(?s)<{_P}datestamp\b[^>]*>(.*?)</{_P}datestamp\s*>", 1))
    read = F.when(stamp.rlike(r"^\d{4}(-\d\d){0,2}(T.*)?$"), stamp.try_cast("timestamp"))
    message = F.concat(F.lit("unreadable datestamp, run time used: "), stamp)
    payload = F.trim(F.regexp_extract(text, rf"(?s)<{_P}metadata\b{_ATTRIBUTES}>(.*)</{_P}metadata\s*>", 1))
    around = _declarations(F.concat_ws(
        " ", F.regexp_extract(text, rf"(?s)^\s*<{_P}record\b{_ATTRIBUTES}>", 0), F.regexp_extract(text, rf"(?s)<{_P}metadata\b{_ATTRIBUTES}>", 0)))
    if outer is not None:
        around = F.concat(F.coalesce(outer, F.array().cast("array<string>")), around)
    rest = [c for c in envelopes.columns if c not in (column, outer)]
    return envelopes.select(
        *rest,
        _unescape(F.trim(F.regexp_extract(header, rf"(?s)<{_P}identifier\b[^>]*>(.*?)</{_P}identifier\s*>", 1))).alias("oaiuri"),
        F.coalesce(read, run_ts.cast("timestamp")).cast("timestamp_ntz").alias("datestamp"),
        header.rlike(rf"""^<{_P}header\b[^>]*\bstatus\s*=\s*["']deleted["']""").alias("is_deleted"),
        F.when(read.isNull(), message).alias("problem"),
        _with_namespaces(F.nullif(payload, F.lit("")), around).alias("payload_xml"),
    )


# Harvest files are read in pieces that end in these letters, a fixed text, so large files are split over tasks.  Where a record ends is
# found by ``record_cut``.
CUT = "record>"


def file_pieces(reader) -> DataFrame:
    """Pieces of harvest files from a batch or stream reader, with the place of each file and block."""
    return reader.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_block_start").alias("block"))


def envelopes_of(pieces: DataFrame, run_ts: Column) -> DataFrame:
    """Records of harvest files read in pieces.

    A payload may hold elements named record, tags may have prefixes and attributes, and comments, CDATA sections and quotes may hold
    anything.  ``file_pos`` orders records by (modification time, file, block, place in the block): later files come after earlier
    ones, however large they are.  A file that ends within a record, comment or the like gives its whole records, and a row without identifier whose
    ``problem`` tells what is left open.
    """
    records, heads = cut_records(pieces, CUT)
    outer = heads.select("file", _declarations(F.col("text")).alias("outer"))
    rows = records.select("file", F.struct("modified", "file", "block", "place").alias("file_pos"), "text", "unfinished")
    found = parse_envelopes(rows.join(outer, "file", "left"), "text", run_ts, "outer")
    broken = F.col("unfinished").isNotNull()
    return found.withColumns({
        "oaiuri": F.when(~broken, F.col("oaiuri")), "payload_xml": F.when(~broken, F.col("payload_xml")),
        "is_deleted": ~broken & F.col("is_deleted"), "problem": F.coalesce("unfinished", "problem"),
    }).drop("unfinished")


def harvest_scan(spark: SparkSession, path: str, run_ts: Column) -> DataFrame:
    """Records of harvest files with their order as ``file_pos``."""
    return envelopes_of(file_pieces(spark.read.option("lineSep", CUT).format("text").load(path)), run_ts)


# ---- record payloads ---------------------------------------------------------------------

def _name(tag: str) -> str:
    space, brace, local = tag[1:].partition("}")
    return space + local if brace else tag


class UnreadForm(ValueError):
    """A form of RDF/XML that the reader does not know."""


def _statements(root: ET.Element) -> list[tuple[str, str, str, str]]:
    """(subject, predicate, object, kind) of one RDF/XML tree, in document order."""
    found: list[tuple[str, str, str, str]] = []
    blanks = 0

    def only(element: ET.Element, *known: str) -> None:
        """Forms that are not read must not be misread."""
        for name in element.attrib:
            if name not in known and not name.startswith("{http://www.w3.org/XML/1998/namespace}"):
                raise UnreadForm(name)

    def node(element: ET.Element) -> str:
        nonlocal blanks
        only(element, f"{{{_RDF}}}about", f"{{{_RDF}}}nodeID")
        about, ident = element.get(f"{{{_RDF}}}about"), element.get(f"{{{_RDF}}}nodeID")
        if about is None and ident is None:
            blanks += 1
            ident = f"g{blanks}"
        subject = about if about is not None else f"_:{ident}"
        if element.tag != f"{{{_RDF}}}Description":
            found.append((subject, _RDF + "type", _name(element.tag), "uri"))
        for child in element:
            predicate = _name(child.tag)
            only(child, *[f"{{{_RDF}}}{name}" for name in ("resource", "nodeID", "parseType", "datatype")])
            if child.get(f"{{{_RDF}}}parseType") not in (None, "Literal"):
                raise UnreadForm("parseType")
            resource, target = child.get(f"{{{_RDF}}}resource"), child.get(f"{{{_RDF}}}nodeID")
            if resource is not None:
                found.append((subject, predicate, resource, "uri"))
            elif target is not None:
                found.append((subject, predicate, f"_:{target}", "blank"))
            elif child.get(f"{{{_RDF}}}parseType") == "Literal":
                inner = (child.text or "") + "".join(ET.tostring(part, encoding="unicode") for part in child)
                found.append((subject, predicate, inner, "literal"))
            elif len(child):
                for part in child:
                    name = node(part)
                    found.append((subject, predicate, name, "blank" if name.startswith("_:") else "uri"))
            else:
                found.append((subject, predicate, child.text or "", "literal"))
        return subject

    for element in root if root.tag == f"{{{_RDF}}}RDF" else [root]:
        node(element)
    return found


def _flatten(payload: str, entity: str, version: str, gate: str) -> tuple[list[tuple], str | None]:
    """Triple rows of one record, or the reason why it is rejected."""
    try:
        statements = _statements(ET.fromstring(payload))
    except UnreadForm:
        return [], "unread form"
    except (ET.ParseError, TypeError, ValueError):
        return [], "unreadable record"
    subjects = list(dict.fromkeys(s for s, p, o, _ in statements if p == _RDF + "type" and o == entity))
    if len(subjects) != 1:
        return [], "no entity" if not subjects else "several entities"
    item = subjects[0]
    links: dict[str, list[str]] = {item: [""]}
    for subject, predicate, target, kind in statements:
        if subject == item and kind == "blank":
            links.setdefault(target, []).append(predicate)
    stated = {p: o.strip() for s, p, o, kind in statements if s == item and kind == "literal" and p in (version, gate)}
    record = (stated.get(version) or None, stated.get(gate) == "n")
    rows = []
    for place, (subject, predicate, target, kind) in enumerate(statements):
        for via in dict.fromkeys(links.get(subject, [None])):
            rows.append((item, subject, via, predicate, target, kind, place, *record))
    return rows, None


def record_triples(harvest: DataFrame, names: Names = Names()) -> tuple[DataFrame, DataFrame]:
    """Triples of record payloads and a table of rejected records (oaiuri, reason).

    ``via`` is the predicate by which the entity points at the triple's subject ("" for the entity
    itself), so later steps need no self join to follow a blank node; ``version`` and ``barred`` repeat
    what the record states about itself, so no step has to gather a record to know it.  RDF/XML nests
    freely, which fixed-schema XML functions cannot express; the small parser runs per batch of rows.
    """
    entity = names.full("Entity")
    version, gate = names.full(names.version_property), names.full("itemForIndexing")
    columns = ["oaiuri", "reason", *[field.strip().split(" ")[0] for field in TRIPLE.split(",")]]
    kinds = [{"pos": pa.int32(), "barred": pa.bool_()}.get(name, pa.string()) for name in columns]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part, rows = batch.slice(start, 500), []
                for oaiuri, payload in zip(part.column("oaiuri").to_pylist(), part.column("payload_xml").to_pylist()):
                    triples, reason = _flatten(payload, entity, version, gate)
                    if reason:
                        rows.append((oaiuri, reason) + (None,) * (len(columns) - 2))
                    rows += [(oaiuri, None, *triple) for triple in triples]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], columns)

    payloads = harvest.filter(~F.col("is_deleted")).select("oaiuri", "payload_xml")
    # parsed once, for both results
    parsed = written(payloads.mapInArrow(parse, f"oaiuri string, reason string, {TRIPLE}"))
    triples = parsed.filter(F.col("reason").isNull()).drop("oaiuri", "reason")
    return triples, parsed.filter(F.col("reason").isNotNull()).select("oaiuri", "reason")


def extract_info(triples: DataFrame, names: Names = Names()) -> DataFrame:
    """Identifier and native URL of every record."""
    here = (F.col("via") == "") & (F.col("predicate") == names.full("url"))
    return triples.groupBy("item_id").agg(F.max(F.when(here, F.trim("object"))).alias("nativeurl"))


# ---- vocabularies ------------------------------------------------------------------------

def load_vocab(entries: DataFrame) -> DataFrame:
    """One label per version and URI from (version, priority, uri, label); a later file wins."""
    return entries.groupBy("version", "uri").agg(
        F.max_by(F.nullif(F.trim("label"), F.lit("")), "priority").alias("label")
    )


def read_vocab_files(spark: SparkSession, paths: dict[str, list[str]], row_tag: str, label_tag: str, base: str) -> DataFrame:
    """Entries of vocabulary files (``paths``: version to ordered files) for ``load_vocab``."""
    parts = []
    for version, files in paths.items():
        for priority, path in enumerate(files):
            rows = (
                spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true")
                .schema(f"_about string, _ID string, {label_tag} string").load(path)
            )
            uri = F.coalesce("_about", F.concat(F.lit(base + "#"), F.col("_ID")))
            parts.append(rows.select(
                F.lit(version).alias("version"), F.lit(priority).alias("priority"),
                uri.alias("uri"), F.col(label_tag).alias("label"),
            ))
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    return entries


# ---- validation --------------------------------------------------------------------------

def validation_messages(spark: SparkSession, path: str, row_tag: str, xsd: str, fields: str) -> DataFrame:
    """(message, row, col) of records that are malformed or do not match a schema file.

    The XML reader checks each record against ``xsd`` (a path that every executor can read);
    ``fields`` is the expected shape.  ``aggregate.message_report`` sums the messages up.
    """
    rows = (
        spark.read.format("xml").option("rowTag", row_tag).option("rowValidationXSDPath", xsd)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
        .schema(f"{fields}, _bad string").load(path)
    )
    names = [name for name in rows.columns if name != "_bad"]
    # the reader refuses a query for the record text alone, so the filter reads the fields as well
    text = F.concat_ws("", "_bad", *names)
    bad = F.col("_bad").isNotNull() & (F.length(text) >= F.length("_bad"))
    placed = rows.withColumn("row", F.monotonically_increasing_id())
    return placed.filter(bad).select(
        F.lit("record does not match the schema").alias("message"), (F.col("row") + 1).alias("row"),
        F.lit(1).cast("bigint").alias("col"),
    )
