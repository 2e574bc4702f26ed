"""From triples to postings, relations and rejects.

Values and relations are found row by row with fixed, broadcast mapping tables, without a shuffle.
Only checks of a whole node or record group rows, by keys that start with the item.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.catalog import INDEXES, REPLACES, SAME_AS, YEAR, index_type
from recordloom.functions import geo, scalars
from recordloom.functions.scalars import blank_to_null
from recordloom.session import written
from recordloom.sources.harvest import record_triples
from recordloom.vocabulary import (
    CONTEXT_FIELDS, NAMESPACE_STARTS, PUBLIC_NAMESPACES, RESOURCE_FIXES, RULE_SETS, Names, field_rules,
    freetext_groups, relation_rules,
)

POSTING = ["item_id", "index", "pos", "value"]

# The five tags that are replaced by references.
OLD_TAGS = ("periodAuth", "toPeriodId", "fromPeriodId", "nameAuth", "nameId")

# Fields that share one number as its bits, when single values are checked.
_FIELD_BITS = 62


# ---- versions ----------------------------------------------------------------------------

def _rule_place(version: Column) -> Column:
    """Place of a version's rule set; the usual spellings need no parsing."""
    parsed = F.array_position(F.array(*[F.lit(name) for name in RULE_SETS]), scalars.rule_set(version))
    place = F.when(parsed > 0, (parsed - 1).cast("int"))
    # parsing goes through arrays, which no generated code does; all below 1.0 follow its rules
    usual = F.when((version == RULE_SETS[0]) | (version.startswith("0.") & version.rlike(r"^0(\.\d+)+\.*$")), 0)
    for number, name in enumerate(RULE_SETS[1:], start=1):
        usual = usual.when(version == name, number)
    return usual.otherwise(place)


def versioned(triples: DataFrame, names: Names) -> DataFrame:
    """Triples with ``rules``, the place of the record's rule set; null when it has none.

    Parsed records carry their version in every triple.  Triples from elsewhere get it from the row
    that states it, which gathers each item once.
    """
    if "version" in triples.columns:
        return triples.withColumn("rules", _rule_place(F.col("version")))
    stated = (F.col("via") == "") & (F.col("predicate") == names.full(names.version_property))
    rules = F.max(F.when(stated, _rule_place(blank_to_null("object")))).over(Window.partitionBy("item_id"))
    return triples.withColumn("rules", rules)


def indexable(triples: DataFrame, names: Names) -> DataFrame:
    """Triples of records that do not ask to be left out."""
    if "barred" in triples.columns:
        return triples.filter(~F.col("barred"))
    barred = (F.col("via") == "") & (F.col("predicate") == names.full("itemForIndexing")) & (
        F.trim("object") == "n"
    )
    # the few ids that ask are joined, so no item is gathered or sorted
    out = triples.filter(barred).select(F.col("item_id").alias("_out")).distinct()
    return triples.join(out, F.col("item_id").eqNullSafe(F.col("_out")), "left_anti")


# ---- values ------------------------------------------------------------------------------

def _labelled(rows: DataFrame, asks: Column, key: Column, vocab: DataFrame) -> DataFrame:
    """Rows with the vocabulary label of ``key`` as ``_label`` where ``asks`` holds.

    A vocabulary is a fixed table of terms, however many records there are: it is broadcast, so the rows stay where they are.
    """
    labels = vocab.select(
        F.col("version").alias("_version"), F.col("uri").alias("_uri"), F.col("label").alias("_label")
    )
    keyed = rows.withColumns({
        "_uri": F.when(asks, key), "_version": F.when(F.col("rules") == 0, "1.0").otherwise("1.1"),
    })
    return keyed.join(F.broadcast(labels), ["_uri", "_version"], "left").drop("_uri", "_version")


def lookup_uri(values: DataFrame, vocab: DataFrame, names: Names) -> DataFrame:
    """Replace URIs by their label or area code; ``problem`` tells of a URI without either.

    ``values`` has value, object_kind, lookup and rules; ``vocab`` has version, uri and label.
    """
    asks = (F.col("object_kind") == "uri") & F.col("lookup")
    joined = _labelled(values, asks, F.col("value"), vocab)

    key = F.when(asks, F.col("value"))
    code = F.coalesce(
        scalars.suffix_after(key, names.area("county"), number=True),
        scalars.suffix_after(key, names.area("municipality"), number=True),
        scalars.suffix_after(key, names.area("province")),
        scalars.suffix_after(key, names.area("parish"), number=True),
        scalars.suffix_after(key, names.area("country")),
    )
    looked = _with_computed(joined, _found=F.coalesce("_label", code), _label_free=F.col("_label").isNull())
    numbered = [names.area(kind) for kind in ("county", "municipality", "parish")]
    odd = reduce(lambda a, b: a | b, [F.col("value").startswith(p) & ~F.substr("value", F.lit(len(p) + 1)).rlike(r"^[+-]?\d+$") for p in numbered])
    problem = F.when(asks & F.col("_found").isNull(), F.concat(F.lit("vocabulary has no entry for "), F.col("value"))).when(
        asks & F.col("_label_free") & odd, F.concat(F.lit("area code is no number in "), F.col("value")))
    return looked.withColumns({"value": F.coalesce("_found", "value"), "problem": problem}).drop("_label", "_found", "_label_free")


def _with_computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row.

    A plain column is copied into every filter and expression that mentions it; a generated one is not.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select("*", F.inline(F.array(made)))


def field_values(triples: DataFrame, names: Names, vocab: DataFrame) -> DataFrame:
    """One row per extracted value: item, node, index, pos, value, lookup problem.

    Years are normalised; a value that is no year becomes a problem without a value.
    """
    rules = F.broadcast(field_rules(triples.sparkSession, names))
    joined = triples.join(rules, ["via", "predicate"]).filter(
        (F.col("since") <= F.col("rules")) & (F.col("object_kind") != "blank")
    )
    values = joined.select(
        "item_id", "subject", "via", "predicate", "rules", "object_kind", "index", "lookup", "single", "pos",
        blank_to_null("object").alias("value"),
    ).filter(F.col("value").isNotNull())
    looked = lookup_uri(values, vocab, names)
    years = [name for name in INDEXES if index_type(name) == YEAR]

    is_year = F.col("index").isin(years)
    dated = _with_computed(looked, _year=F.when(is_year, scalars.year_of("value")))
    bad = F.concat(
        F.lit("not a date: "), F.col("index"),
        F.lit(" ("), F.col("value"), F.lit(")"),
    )
    return dated.withColumns({
        "value": F.when(is_year, F.col("_year").cast("string")).otherwise(F.col("value")),
        "problem": F.when(is_year & F.col("_year").isNull(), bad).otherwise(F.col("problem")),
    }).drop("_year")


def single_value_check(triples: DataFrame, names: Names) -> DataFrame:
    """Rejects: a field declared single has several values, or a value that is a node.

    Each field is a bit, so that a node's statements become one row in the task that makes them: a field was met twice if there are more values
    than bits.  Only where a field has nodes beside other values does that not tell which of them repeats; those nodes are counted field by field.
    """
    spark = triples.sparkSession
    rules = [(r.since, r.via, r.predicate) for r in field_rules(spark, names).filter("single").collect()]  # a fixed table of some fifty rows
    places = {field: place for place, field in enumerate(sorted({rule[1:] for rule in rules}))}
    groups = range(-(-len(places) // _FIELD_BITS))
    bits = spark.createDataFrame(
        [(*rule, places[rule[1:]] // _FIELD_BITS, 1 << places[rule[1:]] % _FIELD_BITS) for rule in rules],
        "since int, via string, predicate string, _group int, _bit bigint")
    node = F.coalesce(F.col("object_kind") == "blank", F.lit(False))
    stated = triples.join(F.broadcast(bits), ["via", "predicate"]).filter(F.col("since") <= F.col("rules")).select(
        "item_id", "subject", "_group", "_bit", node.alias("_node"))

    def over(kind: Column, name: str) -> list[Column]:
        return [F.coalesce(F.bit_or(F.when(kind & (F.col("_group") == g), F.col("_bit"))), F.lit(0).cast("bigint")).alias(f"{name}{g}") for g in groups]

    met = stated.groupBy("item_id", "subject").agg(
        F.count_if(~F.col("_node")).alias("_n"), *over(~F.col("_node"), "_plain"), *over(F.col("_node"), "_nodes"))
    several = F.col("_n") > reduce(lambda a, b: a + b, [F.bit_count(f"_plain{g}") for g in groups])
    has_node = reduce(lambda a, b: a | b, [F.col(f"_nodes{g}") != 0 for g in groups])
    mixed = several & reduce(lambda a, b: a | b, [F.col(f"_plain{g}").bitwiseAND(F.col(f"_nodes{g}")) != 0 for g in groups])
    bad = written(met.select("item_id", "subject", several.alias("_several"), has_node.alias("_has"), mixed.alias("_mixed")).filter("_several or _has"))
    several_values, is_node = F.lit("several values"), F.lit("value is a node")
    said = F.array_compact(F.array(F.when(F.col("_several") & ~F.col("_mixed"), several_values), F.when(F.col("_has"), is_node)))
    rejects = bad.select("item_id", F.explode(said).alias("reason"))
    unclear = bad.filter("_mixed").select(F.col("item_id").alias("_item"), F.col("subject").alias("_subject"))
    if not unclear.isEmpty():
        same = F.col("item_id").eqNullSafe(F.col("_item")) & F.col("subject").eqNullSafe(F.col("_subject"))
        counted = stated.join(unclear, same, "left_semi").groupBy("item_id", "subject", "_group", "_bit").agg(
            F.count(F.lit(1)).alias("_n"), F.bool_or("_node").alias("_node"))
        rejects = rejects.unionByName(counted.filter("_n > 1 and not _node").select("item_id", several_values.alias("reason")))
    return rejects.distinct()


# ---- contexts ----------------------------------------------------------------------------

def context_nodes(triples: DataFrame, names: Names) -> DataFrame:
    """One row per context node with its stated types, label, names, times and authorities."""
    own = [
        "contextType", "contextSuperType", "contextLabel", "fromTime", "toTime", "placeTermId", "placeTermAuth",
        "nameId", "nameAuth", "fromPeriodId", "toPeriodId", "periodAuth", "coordinates",
        "foaf:firstName", "foaf:surname", "foaf:fullName",
    ]

    def stated(name: str) -> Column:
        return F.max(F.when(F.col("predicate") == names.full(name), blank_to_null("object")))

    return (
        triples.filter(F.col("via") == names.full("context"))
        .groupBy("item_id", "subject", "rules")
        .agg(F.min("pos").alias("pos"), *[stated(name).alias(name.rpartition(":")[2]) for name in own])
    )


def context_types(nodes: DataFrame, vocab: DataFrame, names: Names) -> DataFrame:
    """Context nodes with ``context``, ``super``, ``label`` and, for bad ones, ``reason``.

    Oldest rules: an unknown address with # is ignored, the vocabulary label comes first.  Later
    rules: super type and known type are required, the stated label comes first.
    """
    old = F.col("rules") == 0
    typed = F.col("contextType").startswith(names.context_type)
    joined = _labelled(nodes, F.coalesce(typed, F.lit(False)), F.col("contextType"), vocab)
    kind = F.nullif(scalars.suffix_after("contextType", names.context_type), F.lit(""))
    above = F.nullif(scalars.suffix_after("contextSuperType", names.context_supertype), F.lit(""))
    kind_old = F.when(~F.contains(kind, F.lit("#")), kind)
    reason = (
        F.when(old, None)
        .when(F.col("contextSuperType").isNull(), "no supertype for context")
        .when(above.isNull(), "bad context supertype")
        .when(F.col("contextType").isNull(), "no context type")
        .when(F.col("_label").isNull() | kind.isNull(), "unknown context type")
    )
    label = F.when(F.col("contextType").isNull(), None).when(
        old, F.coalesce("_label", "contextLabel")
    ).otherwise(F.coalesce("contextLabel", "_label"))
    return joined.withColumns({
        "context": F.when(old, kind_old).otherwise(kind),
        "super": F.when(~old, above),
        "label": label,
        "reason": reason,
    }).drop("_label")


def context_fanout(values: DataFrame) -> DataFrame:
    """Values in their index, and also under the context and its super type."""
    index = F.col("index")

    def below(prefix: str) -> Column:
        return F.when(F.col(prefix).isNotNull(), F.concat_ws("_", F.col(prefix), index))

    targets = F.array_compact(F.array(index, below("super"), below("context")))
    return values.withColumn("index", F.explode(targets))


def context_values(nodes: DataFrame, names: Names) -> DataFrame:
    """Values that are made per context: labels, composed names, authorities, decades, centuries."""
    def entry(index: str, value: Column, spread: bool) -> Column:
        return F.struct(F.lit(index).alias("index"), value.cast("string").alias("value"), F.lit(spread).alias("spread"))

    full = F.when(F.col("fullName").isNull(), scalars.full_name("fullName", "firstName", "surname"))
    place = scalars.authority_uri("placeTermAuth", "placeTermId", "place", names.own_periods)
    agent = scalars.authority_uri("nameAuth", "nameId", "actor", names.own_periods)
    first = scalars.authority_uri("periodAuth", "fromPeriodId", "period", names.own_periods)
    last = scalars.authority_uri("periodAuth", "toPeriodId", "period", names.own_periods)
    fixed = F.array(
        entry("contextType", F.col("context"), False),
        entry("contextSuperType", F.col("super"), False),
        entry("contextLabel", F.col("label"), False),
        entry("fullName", full, True),
        *[
            entry(index, value, False)
            for name, value in (("placeTerm", place), ("agent", agent), ("fromPeriod", first), ("toPeriod", last))
            for index in (name, "relUri")
        ],
    )
    spans = F.transform(
        F.coalesce(
            scalars.decades_between(known_time("fromTime"), known_time("toTime")),
            F.array().cast("array<struct<index:string,value:int>>"),
        ),
        lambda e: F.struct(
            e["index"].alias("index"), e["value"].cast("string").alias("value"), F.lit(True).alias("spread")
        ),
    )
    rows = nodes.select(
        "item_id", "subject", "pos", "context", "super", F.explode(F.concat(fixed, spans)).alias("_e")
    ).select("item_id", "subject", "pos", "context", "super", "_e.index", "_e.value", "_e.spread")
    rows = rows.filter(F.col("value").isNotNull())
    spread = context_fanout(rows.filter("spread"))
    return rows.filter(~F.col("spread")).unionByName(spread).select("item_id", "subject", *POSTING[1:])


def known_time(value: str) -> Column:
    """A stated time, unless it is blank, the text null, or starts with a question mark."""
    text = F.col(value)
    return F.when((text != "null") & ~text.startswith("?"), text)


# ---- relations ---------------------------------------------------------------------------

def relation_name(predicate: Column, rules: Column, names: Names) -> Column:
    """Relation name of a predicate under a rule set; null when no vocabulary fits."""
    def after(prefix: str, skip: str = "") -> Column:
        return F.nullif(F.trim(F.regexp_extract(predicate, rf"\Q{prefix}\E{skip}(.*)$", 1)), F.lit(""))

    own = after(names.own)
    cidoc, bio = PUBLIC_NAMESPACES["cidoc"], PUBLIC_NAMESPACES["bio"]
    foreign = F.when(F.contains(predicate, F.lit(cidoc)), after(cidoc, r"[^.]*\.")).otherwise(after(bio))
    return (
        F.when(predicate == names.full("owl:sameAs"), SAME_AS)
        .when(rules == 0, own)
        .when(predicate == names.full("terms:replaces"), REPLACES)
        .otherwise(F.coalesce(own, foreign))
    )


def _is_index(name: Column) -> Column:
    """Column form of ``catalog.index_exists``."""
    known = list(INDEXES)
    parts = F.split(name, "_")
    return name.isin(known) | ((F.size(parts) == 2) & (parts[0] != "") & parts[1].isin(known))


def extract_relations(triples: DataFrame, names: Names) -> tuple[DataFrame, DataFrame]:
    """Relations (item_id, rel_type, target_uri) and rejects with an unknown relation name."""
    each = F.explode(F.sequence(F.col("since"), F.lit(len(RULE_SETS) - 1))).alias("rules")
    # names are worked out on the rules, a few hundred rows, not on the triples
    named = relation_rules(triples.sparkSession, names).select("via", "predicate", each).withColumn(
        "rel_type", relation_name(F.col("predicate"), F.col("rules"), names)
    ).withColumn("good", F.coalesce(_is_index(F.col("rel_type")), F.lit(False)))
    found = (
        triples.join(F.broadcast(named), ["via", "predicate", "rules"])
        .filter(F.col("object_kind").isin("uri", "literal"))
        .select("item_id", "pos", "rel_type", "good", blank_to_null("object").alias("target_uri"))
        .filter(F.col("target_uri").isNotNull())
    )
    rejects = found.filter(~F.col("good")).select("item_id", F.lit("unknown relation").alias("reason")).distinct()
    return found.filter("good").drop("good"), rejects


def relation_postings(relations: DataFrame) -> DataFrame:
    """Postings of relations: in the relation's own index and in the common one."""
    return relations.select(
        "item_id", F.explode(F.array(F.col("rel_type"), F.lit("relUri"))).alias("index"), "pos",
        F.col("target_uri").alias("value"),
    )


# ---- media, flags, system fields ---------------------------------------------------------

def media(triples: DataFrame, names: Names, strict: bool = True) -> DataFrame:
    """Rejects: records with an image or media node that states no license."""
    nodes = triples.filter(
        (F.col("via") == names.full("image"))
        | ((F.col("via") == names.full("media")) & (F.col("rules") >= RULE_SETS.index("1.11")))
    )
    licensed = (F.col("predicate") == names.full("mediaLicense")) & blank_to_null("object").isNotNull()
    bare = nodes.groupBy("item_id", "subject").agg(F.bool_or(licensed).alias("ok")).filter(~F.col("ok"))
    rejects = bare.select("item_id", F.lit("missing media license").alias("reason")).distinct()
    return rejects if strict else rejects.limit(0)


def exists_flags(triples: DataFrame, names: Names) -> DataFrame:
    """Per item: geoDataExists, timeInfoExists, thumbnailExists as j or n."""
    context = F.col("via") == names.full("context")
    text = blank_to_null("object")

    def stated(name: str) -> Column:
        return (F.col("predicate") == names.full(name)) & text.isNotNull()

    time = context & (stated("fromTime") | stated("toTime")) & (text != "null") & ~text.startswith("?")
    flags = {
        "geoDataExists": context & stated("coordinates"),
        "timeInfoExists": time,
        "thumbnailExists": (F.col("via") == "") & stated("thumbnail"),
    }
    per_item = triples.groupBy("item_id").agg(
        *[F.bool_or(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in flags.items()]
    )
    return per_item.select("item_id", *[F.when(F.col(n), "j").otherwise("n").alias(n) for n in flags])


def system_fields(triples: DataFrame, names: Names) -> tuple[DataFrame, DataFrame]:
    """Postings of identifier, version and URLs, and problems of URLs that point back here."""
    own = triples.filter(F.col("via") == "")
    singles = {
        names.full(names.version_property): "stringProtocolVersion",
        names.full("url"): "_htmlurl",
        names.full("museumdatUrl"): "_museumdaturl",
        names.full("thumbnail"): "thumbnail",
    }
    index = reduce(
        lambda rest, pair: F.when(F.col("predicate") == pair[0], pair[1]).otherwise(rest),
        singles.items(), F.lit(None).cast("string"),
    )
    stated = own.select("item_id", index.alias("index"), "pos", blank_to_null("object").alias("value")).filter(
        F.col("index").isNotNull() & F.col("value").isNotNull()
    )
    ids = own.select("item_id").distinct().select(
        "item_id", F.lit("itemId").alias("index"), F.lit(0).alias("pos"), F.col("item_id").alias("value")
    )
    back = F.lower("value").startswith(names.base) & F.col("index").isin("_htmlurl", "_museumdaturl")
    label = F.when(F.col("index") == "_htmlurl", "HTML").otherwise("Museumdat")
    problems = stated.filter(back).select(
        "item_id", F.concat(label, F.lit(" address points back to "), F.lit(names.base)).alias("message")
    )
    return ids.unionByName(stated), problems


def payload_fields(content: DataFrame) -> DataFrame:
    """Source and payload (base64) of live records as postings."""
    live = content.filter(F.col("deleted").isNull() & F.col("xmldata").isNotNull())
    entries = F.array(
        F.struct(F.lit("_service").alias("index"), F.col("serviceid").alias("value")),
        F.struct(F.lit("_rdf").alias("index"), F.base64(F.encode("xmldata", "UTF-8")).alias("value")),
    )
    rows = live.select(F.col("uri").alias("item_id"), F.explode(entries).alias("_e"))
    return rows.select("item_id", "_e.index", F.lit(0).alias("pos"), "_e.value")


def date_fields(triples: DataFrame, names: Names, now: Column) -> tuple[DataFrame, DataFrame]:
    """Postings of created, changed and build dates, and problems of dates that are dropped."""
    kinds = ("createdDate", "lastChangedDate", "buildDate")
    wanted = [names.full(kind) for kind in kinds]
    rows = triples.filter((F.col("via") == "") & F.col("predicate").isin(wanted)).select(
        "item_id", F.substr("predicate", F.lit(len(names.own) + 1)).alias("index"), "pos",
        blank_to_null("object").alias("raw"),
    )
    checked = rows.withColumn("value", scalars.iso_day("raw", now)).withColumn(
        "message", scalars.iso_problem("index", "item_id", "raw", now)
    )
    good = checked.filter(F.col("value").isNotNull()).select(*POSTING)
    return good, checked.filter(F.col("message").isNotNull()).select("item_id", "message")


# ---- geometry ----------------------------------------------------------------------------

def geo_points(coordinates: DataFrame) -> DataFrame:
    """Longitude and latitude of the centroid of the first geometry per item.

    ``coordinates`` has item_id, pos and markup.  Unknown systems and unreadable shapes give null.
    """
    first = coordinates.groupBy("item_id").agg(F.min(F.struct("pos", "markup"))["markup"].alias("markup"))
    parts = geo.geometry_parts("markup")
    shaped = first.select("item_id", parts["epsg"].alias("epsg"), parts["kind"].alias("kind"),
                          parts["parts"].alias("parts"))
    x, y = geo.centroid("parts", "kind")
    centred = shaped.select("item_id", "epsg", x.alias("x"), y.alias("y"))
    lon, lat = geo.to_wgs84_any("x", "y", "epsg")
    return centred.select("item_id", lon.alias("lon"), lat.alias("lat"))


# ---- free text ---------------------------------------------------------------------------

def freetext(postings: DataFrame) -> DataFrame:
    """Postings of the free text buckets: every member field's values under the bucket name."""
    groups = F.broadcast(freetext_groups(postings.sparkSession))
    return postings.join(groups, "index").select("item_id", F.col("bucket").alias("index"), "pos", "value")


# ---- namespaces and old tags -------------------------------------------------------------

def fix_namespace(uri: Column, names: Names) -> Column:
    """Correct own resource addresses, then replace any form of a vocabulary by the right one."""
    for line in RESOURCE_FIXES.strip().splitlines():
        wrong, right = line.split()
        uri = F.replace(uri, F.lit(names.base + wrong), F.lit(names.base + right))
    fixed = uri
    for start, short in reversed(NAMESPACE_STARTS):
        prefix = start.replace("{own}", names.own.rstrip("#/"))
        fixed = F.when(uri.startswith(prefix), PUBLIC_NAMESPACES.get(short, names.own)).otherwise(fixed)
    return fixed


def fix_payload(payload: Column, names: Names) -> Column:
    """A record's markup with the resource addresses and namespace declarations that ``fix_namespace`` corrects."""
    for line in RESOURCE_FIXES.strip().splitlines():
        wrong, right = line.split()
        payload = F.regexp_replace(payload, re.escape(names.base + wrong) + r"(?=[#/\"'])", names.base + right)
    for start, short in NAMESPACE_STARTS:
        prefix = re.escape(start.replace("{own}", names.own.rstrip("#/")))
        right = PUBLIC_NAMESPACES.get(short, names.own)
        payload = F.regexp_replace(payload, rf"""(\bxmlns(?::[\w.-]+)?\s*=\s*["']){prefix}[^"']*""", f"$1{right}")
    return payload


def rewrite_legacy(tags: DataFrame, names: Names) -> DataFrame:
    """Replace the old authority and identifier tags of a node by references.

    ``tags`` has item_id, parent, name, content, resource and pos; other tags pass through.
    """
    def last(name: str) -> Column:
        return F.max_by(F.when(F.col("name") == name, F.col("content")), F.when(F.col("name") == name, F.col("pos")))

    old = tags.filter(F.col("name").isin(list(OLD_TAGS)))
    pairs = old.groupBy("item_id", "parent").agg(
        F.max("pos").alias("pos"), *[last(name).alias(name) for name in OLD_TAGS]
    )

    def made(name: str, auth: str, ident: str) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            scalars.authority_uri(auth, ident, "any", names.own_periods).alias("resource"),
        )

    entries = F.array(
        made("toPeriod", "periodAuth", "toPeriodId"),
        made("fromPeriod", "periodAuth", "fromPeriodId"),
        made("agent", "nameAuth", "nameId"),
    )
    fresh = pairs.select("item_id", "parent", "pos", F.explode(entries).alias("_e")).select(
        "item_id", "parent", "_e.name", F.lit(None).cast("string").alias("content"), "_e.resource", "pos"
    ).filter(F.col("resource").isNotNull())
    kept = tags.filter(~F.col("name").isin(list(OLD_TAGS)))
    return kept.unionByName(fresh)


# ---- the whole record --------------------------------------------------------------------

def extract(
    triples: DataFrame, names: Names, vocab: DataFrame, now: Column, strict: bool = True
) -> dict[str, DataFrame]:
    """Tables of one corpus: postings, relations, rejects (item_id, reason), problems (item_id, message)."""
    # every step below reads it; records that state their version and gate in each triple need no gathering, and are not copied
    known = versioned(indexable(triples, names), names)
    if not {"version", "barred"} <= set(triples.columns):
        known = written(known)
    unknown = known.filter(F.col("rules").isNull()).select(
        "item_id", F.lit("unsupported version").alias("reason")
    ).distinct()
    usable = known.filter(F.col("rules").isNotNull())

    nodes = written(context_types(context_nodes(usable, names), vocab, names))
    values = field_values(usable, names, vocab)
    relations, bad_relations = extract_relations(usable, names)
    no_supertype = (
        usable.filter(F.col("rules") >= 1).groupBy("item_id")
        .agg(F.bool_or((F.col("via") == "") & (F.col("predicate") == names.full("itemSuperType"))).alias("ok"))
        .filter(~F.col("ok")).select("item_id", F.lit("no item supertype").alias("reason"))
    )
    # a few rows per rejected record, read by every table below
    rejects = written(reduce(DataFrame.unionByName, [
        unknown, no_supertype, bad_relations, single_value_check(usable, names), media(usable, names, strict),
        nodes.filter(F.col("reason").isNotNull()).select("item_id", "reason").distinct(),
    ]))

    direct = values.filter(F.col("value").isNotNull())
    in_context = (F.col("via") == names.full("context")) & F.col("index").isin(list(CONTEXT_FIELDS))
    plain = direct.filter(~in_context).select(*POSTING)
    # only values inside a context need to know its node
    kinds = nodes.select("item_id", "subject", "context", "super")
    spread = context_fanout(direct.filter(in_context).join(kinds, ["item_id", "subject"], "left")).select(*POSTING)
    system, back = system_fields(usable, names)
    dates, bad_dates = date_fields(usable, names, now)
    flags = exists_flags(usable, names)
    flag_rows = flags.select("item_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("index"), F.col(n).alias("value")) for n in flags.columns if n != "item_id"
    ])).alias("_e")).select("item_id", "_e.index", F.lit(0).alias("pos"), "_e.value")

    postings = reduce(DataFrame.unionByName, [
        plain, spread, context_values(nodes, names).select(*POSTING), relation_postings(relations), system, dates,
        flag_rows,
    ])
    barred = rejects.select("item_id").distinct()
    problems = values.filter(F.col("problem").isNotNull()).select(
        "item_id", F.col("problem").alias("message")
    ).unionByName(back).unionByName(bad_dates)
    return {
        "postings": postings.join(barred, "item_id", "left_anti"),
        "relations": relations.join(barred, "item_id", "left_anti").select("item_id", "rel_type", "target_uri"),
        "rejects": rejects,
        "problems": problems,
    }


def index_corpus(
    content: DataFrame, services: DataFrame, names: Names, vocab: DataFrame, now: Column, strict: bool = True
) -> dict[str, DataFrame]:
    """From store to index: the tables of ``extract`` for the live rows of ``content``, with all that the store adds.

    Namespaces are corrected before a record is read.  Accepted records also get their source and payload, the presentation markup, the
    centre of their first geometry, the date they entered the index (``services`` has serviceid and firstindexdate) and the
    free text buckets over all of it.  Unreadable records are among the rejects under their uri.
    """
    live = content.filter(F.col("deleted").isNull() & F.col("xmldata").isNotNull())
    fixed = live.select(
        F.col("uri").alias("oaiuri"), F.lit(False).alias("is_deleted"), fix_payload(F.col("xmldata"), names).alias("payload_xml"))
    triples, unread = record_triples(fixed, names)
    tables = extract(triples, names, vocab, now, strict)
    base = written(tables["postings"])
    accepted = base.filter("index = 'itemId'").select("item_id")

    literal = triples.filter(F.col("object_kind") == "literal")
    points = geo_points(literal.filter(F.col("predicate") == names.full("coordinates")).select("item_id", "pos", F.col("object").alias("markup")))
    places = points.select("item_id", F.explode(F.array(
        F.struct(F.lit("_lon").alias("index"), F.col("lon").alias("v")), F.struct(F.lit("_lat").alias("index"), F.col("lat").alias("v")),
    )).alias("_e")).filter(F.col("_e.v").isNotNull()).select("item_id", "_e.index", F.lit(0).alias("pos"), F.col("_e.v").cast("string").alias("value"))
    shown = literal.filter((F.col("predicate") == names.full("presentation")) & (F.col("via") == "")).groupBy("item_id").agg(
        F.min(F.struct("pos", "object"))["object"].alias("_markup"))
    shown = shown.select(
        "item_id", F.lit("_pres").alias("index"), F.lit(0).alias("pos"), F.base64(F.encode("_markup", "UTF-8")).alias("value"))
    created = base.filter("index = 'createdDate'").groupBy("item_id").agg(F.min("value").cast("timestamp_ntz").alias("_created"))
    dated = live.select(F.col("uri").alias("item_id"), "serviceid", "added").join(
        services.select("serviceid", "firstindexdate"), "serviceid", "left").join(created, "item_id", "left")
    entered = scalars.added_date("added", "firstindexdate", "_created", now)
    entered = dated.select("item_id", F.lit("addedToIndexDate").alias("index"), F.lit(0).alias("pos"),
                           F.date_format(entered, "yyyy-MM-dd").alias("value"))
    added = reduce(DataFrame.unionByName, [payload_fields(content), places, shown, entered]).join(accepted, "item_id", "left_semi")
    postings = base.unionByName(added.select(*base.columns))
    tables["postings"] = postings.unionByName(freetext(postings).select(*base.columns))
    tables["rejects"] = tables["rejects"].unionByName(unread.select(F.col("oaiuri").alias("item_id"), "reason"))
    return tables
