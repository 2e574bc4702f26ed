"""Registered queries: column functions over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import geo, scalars
from recordloom.operators import extract
from recordloom.plans.bindings import NAMES, moment, table, text
from recordloom.plans.registry import query
from recordloom.plans.search_queries import projected

_YEARS = "years AS (SELECT p_partkey, CAST(p_partkey - 1000 AS INTEGER) AS y FROM part)"


def _years(spark, folder):
    return table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") - 1000).cast("int").alias("y"))


@query("c01_trim_to_null", """
SELECT doc_id, nullif(trim(CASE lang WHEN 'en' THEN '  ' || source || chr(9) WHEN 'fr' THEN ' ' || chr(10) || '  '
  WHEN 'de' THEN source ELSE NULL END, ' ' || chr(9) || chr(10)), '') AS value FROM documents""")
def trim_to_null(spark, folder):
    value = (
        F.when(F.col("lang") == "en", F.concat(F.lit("  "), F.col("source"), F.lit("\t")))
        .when(F.col("lang") == "fr", " \n  ").when(F.col("lang") == "de", F.col("source"))
    )
    return table(spark, folder, "documents").select("doc_id", scalars.blank_to_null(value).alias("value"))


@query("c02_year_parse", f"""
WITH {_YEARS} SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN y > 0 THEN 1 - y END
  WHEN 1 THEN CASE WHEN y >= 0 THEN y END WHEN 3 THEN y END AS year FROM years""")
def year_parse(spark, folder):
    y, kind = text("y"), F.col("p_partkey") % 6
    stated = (
        F.when(kind == 0, F.concat(y, F.lit(" F.kr"))).when(kind == 1, F.concat(y, F.lit(" e.Kr")))
        .when(kind == 2, F.concat(y, F.lit(" a.kr"))).when(kind == 3, F.concat(y, F.lit("-05-03T10:11:12Z")))
        .when(kind == 4, F.concat(y, F.lit("-13-01"))).otherwise(F.concat(F.lit("ca "), y))
    )
    return _years(spark, folder).select("p_partkey", scalars.year_of(stated).alias("year"))


@query("c03_tidy_year", f"""
WITH {_YEARS}, t AS (SELECT p_partkey, CAST(y * 17 AS VARCHAR) AS s FROM years)
SELECT p_partkey, CASE WHEN length(s) > 5 AND s LIKE '-%' THEN '-9999' WHEN length(s) > 4 AND s NOT LIKE '-%' THEN left(s, 4)
  ELSE s END AS year FROM t""")
def tidy_year(spark, folder):
    return _years(spark, folder).select("p_partkey", scalars.tidy_year(text(F.col("y") * 17)).alias("year"))


@query("c04_decade", f"""
WITH {_YEARS} SELECT p_partkey, CAST(trunc(y / 10.0) * 10 - CASE WHEN y < 0 THEN 10 ELSE 0 END AS INTEGER) AS decade FROM years""")
def decade(spark, folder):
    return _years(spark, folder).select("p_partkey", scalars.decade("y").alias("decade"))


@query("c05_century", f"""
WITH {_YEARS} SELECT p_partkey, CAST(trunc(y / 100.0) * 100 - CASE WHEN y < 0 THEN 100 ELSE 0 END AS INTEGER) AS century FROM years""")
def century(spark, folder):
    return _years(spark, folder).select("p_partkey", scalars.century("y").alias("century"))


@query("c06_expand_interval", """
WITH spans AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 4100 - 2050 AS INTEGER) END AS f,
    CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderkey % 4100 - 2070 + o_custkey % 300 AS INTEGER) END AS t FROM orders
), tidy AS (
  SELECT o_orderkey, greatest(coalesce(f, t), -1999) AS a, least(coalesce(t, f), 2010) AS b FROM spans
  WHERE f IS NOT NULL OR t IS NOT NULL
), steps AS (
  SELECT o_orderkey, a, b, unnest(generate_series(a, b, 10)) AS y FROM tidy
), decades AS (
  SELECT o_orderkey, 'decade' AS index, CAST(trunc(y / 10.0) * 10 - CASE WHEN y < 0 THEN 10 ELSE 0 END AS INTEGER) AS value FROM steps
  UNION ALL
  SELECT o_orderkey, 'century', CAST(trunc(y / 100.0) * 100 - CASE WHEN y < 0 THEN 100 ELSE 0 END AS INTEGER) FROM steps WHERE (y - a) % 100 = 0
), ends AS (
  SELECT o_orderkey, b, CASE WHEN a <= b THEN a + (b - a) // 10 * 10 ELSE a END AS d,
    CASE WHEN a <= b THEN a + (b - a) // 100 * 100 ELSE a END AS c FROM tidy
), closing AS (
  SELECT o_orderkey, 'decade' AS index, CAST(trunc(b / 10.0) * 10 - CASE WHEN b < 0 THEN 10 ELSE 0 END AS INTEGER) AS value,
    CAST(trunc(d / 10.0) * 10 - CASE WHEN d < 0 THEN 10 ELSE 0 END AS INTEGER) AS seen, b FROM ends
  UNION ALL
  SELECT o_orderkey, 'century', CAST(trunc(b / 100.0) * 100 - CASE WHEN b < 0 THEN 100 ELSE 0 END AS INTEGER),
    CAST(trunc(c / 100.0) * 100 - CASE WHEN c < 0 THEN 100 ELSE 0 END AS INTEGER), b FROM ends
)
SELECT * FROM decades UNION ALL SELECT o_orderkey, index, value FROM closing WHERE value <> seen AND b > -1999""")
def expand_interval(spark, folder):
    key = F.col("o_orderkey") % 4100
    start = F.when(F.col("o_orderstatus") != "P", text(key - 2050))
    stop = F.when(F.col("o_orderpriority") != "5-LOW", text(key - 2070 + F.col("o_custkey") % 300))
    rows = table(spark, folder, "orders").select("o_orderkey", start.alias("f"), stop.alias("t"))
    return rows.select("o_orderkey", F.explode(scalars.decades_between("f", "t")).alias("e")).select(
        "o_orderkey", "e.index", "e.value"
    )


@query("c07_iso_date", """
WITH stated AS (SELECT o_orderkey, o_orderdate, o_orderpriority, CASE o_orderpriority
    WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%dT10:20:30')
    WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y') WHEN '5-LOW' THEN strftime(o_orderdate, '%d/%m/%Y')
    ELSE strftime(o_orderdate, '%Y-%m') END AS s FROM orders),
read AS (SELECT o_orderkey, s, CASE o_orderpriority WHEN '1-URGENT' THEN o_orderdate
    WHEN '2-HIGH' THEN o_orderdate + INTERVAL '10 hours 20 minutes 30 seconds' WHEN '3-MEDIUM' THEN date_trunc('year', o_orderdate)
    WHEN '5-LOW' THEN NULL ELSE date_trunc('month', o_orderdate) END AS m FROM stated)
SELECT o_orderkey, CASE WHEN m <= TIMESTAMP '1999-06-15' THEN strftime(m, '%Y-%m-%d') END AS day,
  CASE WHEN m IS NULL THEN 'createdDate is not a date: ' || s WHEN m > TIMESTAMP '1999-06-15'
    THEN 'createdDate of ' || o_orderkey || ' lies in the future: ' || s END AS problem FROM read""")
def iso_date(spark, folder):
    p, day = F.col("o_orderpriority"), F.col("o_orderdate")
    stated = (
        F.when(p == "1-URGENT", F.date_format(day, "yyyy-MM-dd"))
        .when(p == "2-HIGH", F.date_format(day, "yyyy-MM-dd'T'10:20:30"))
        .when(p == "3-MEDIUM", F.date_format(day, "yyyy"))
        .when(p == "5-LOW", F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM"))
    )
    now = moment("1999-06-15 00:00:00")
    return table(spark, folder, "orders").select(
        "o_orderkey", scalars.iso_day(stated, now).alias("day"),
        scalars.iso_problem(F.lit("createdDate"), text("o_orderkey"), stated, now).alias("problem"),
    )


@query("c08_from_date_format", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%d') END AS from_date
FROM events""")
def from_date_format(spark, folder):
    fine = F.when(F.col("event_type").isin("click", "view"), "YYYY-MM-DDThh:mm:ssZ").otherwise("YYYY-MM-DD")
    return table(spark, folder, "events").select("event_id", scalars.from_date("ts", fine).alias("from_date"))


@query("c09_escape_term", r"""
SELECT p_partkey, replace(replace(replace(replace(replace(t, '\', '\\'), '%', '\%'), '_', '\_'), '*', '%'), '?', '_') AS pattern,
  regexp_replace(t, '([\\+\-!():^\[\]"{}~|&;/\s])', '\\\1', 'g') AS escaped
FROM (SELECT p_partkey, p_name || '_' || p_brand || '*(' || p_size || '%)?' || '\' AS t FROM part)""")
def escape_term(spark, folder):
    term = F.concat(F.col("p_name"), F.lit("_"), F.col("p_brand"), F.lit("*("), text("p_size"), F.lit("%)?\\"))
    return table(spark, folder, "part").select(
        "p_partkey", scalars.like_escape(term).alias("pattern"), scalars.escape_term(term).alias("escaped")
    )


@query("c10_suffix_after", """
SELECT s_suppkey, CASE WHEN s_acctbal > 3000 THEN '0' || s_suppkey END AS rest,
  CASE WHEN s_acctbal > 3000 THEN CAST(s_suppkey AS VARCHAR) END AS number FROM supplier""")
def suffix_after(spark, folder):
    prefix = NAMES.area("county")
    uri = F.when(F.col("s_acctbal") > 3000, F.concat(F.lit(prefix + "0"), text("s_suppkey"))).otherwise(
        F.concat(F.lit(NAMES.area("parish")), text("s_suppkey"))
    )
    return table(spark, folder, "supplier").select(
        "s_suppkey", scalars.suffix_after(uri, prefix).alias("rest"),
        scalars.suffix_after(uri, prefix, number=True).alias("number"),
    )


@query("c11_join_auth_id", """
SELECT page_id, url || CASE WHEN ends_with(url, '/') THEN '' ELSE '/' END || page_id AS joined FROM pages""")
def join_auth_id(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", scalars.join_auth_id("url", "/", text("page_id")).alias("joined")
    )


@query("c13_query_params", """
WITH parts AS (SELECT page_id, unnest(string_split(split_part(split_part(url, '#', 1), '?', 2) || '&e=a=b&blank=&plus=x%20y', '&')) AS p FROM pages)
SELECT page_id, split_part(p, '=', 1) AS key, url_decode(substr(p, strpos(p, '=') + 1)) AS value FROM parts
WHERE strpos(p, '=') > 0 AND strpos(p, '=') < length(p)""")
def query_params(spark, folder):
    given = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2))
    asked = F.concat(given, F.lit("&e=a=b&blank=&plus=x%20y"))
    return table(spark, folder, "pages").select("page_id", F.explode(scalars.query_map(asked)))


@query("c14_duration_format", """
WITH t AS (SELECT event_id, event_id * 7919 // 1000 AS s FROM events)
SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS took FROM t""")
def duration_format(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", scalars.duration(F.col("event_id") * 7919).alias("took")
    )


@query("c15_url_clean", """
SELECT page_id, replace(replace(url || ' &"', ' ', '%20'), '&', '%26') AS clean, replace(url || '"', '"', '') AS loc FROM pages""")
def url_clean(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", scalars.clean_url(F.concat("url", F.lit(' &"'))).alias("clean"),
        scalars.without_quotes(F.concat("url", F.lit('"'))).alias("loc"),
    )


@query("c16_format_path", r"""
SELECT page_id, regexp_replace(url, '[^/]*$', '') || 'rdf/' || regexp_extract(url, '[^/]*$') AS with_format,
  CASE WHEN contains(p, '.') THEN NULL WHEN len(s) = 3 THEN array_to_string(s, '/')
    WHEN len(s) = 4 THEN s[1] || '/' || s[2] || '/' || s[4] END AS path,
  CASE WHEN NOT contains(p, '.') AND len(s) = 4 THEN lower(s[3]) END AS format
FROM (SELECT page_id, url, p, string_split(rtrim(substr(p, 2), '/'), '/') AS s FROM (
  SELECT page_id, url, '/org/' || regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/x' END AS p FROM pages))""")
def format_path(spark, folder):
    path = F.concat(
        F.lit("/org/"), F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1),
        F.when(F.col("page_id") % 2 == 0, "").otherwise("/x"),
    )
    parts = scalars.path_parts(path)
    return table(spark, folder, "pages").select(
        "page_id", scalars.insert_format("url", F.lit("rdf")).alias("with_format"),
        parts["path"].alias("path"), parts["format"].alias("format"),
    )


@query("c17_media_type", """
SELECT p_partkey, CASE WHEN p_size < 15 THEN 'image/gif' WHEN p_size < 30 THEN 'image/png' ELSE 'image/jpeg' END AS mime FROM part""")
def media_type(spark, folder):
    name = F.concat("p_name", F.when(F.col("p_size") < 15, ".gif").when(F.col("p_size") < 30, ".png").otherwise(".tif"))
    return table(spark, folder, "part").select("p_partkey", scalars.mime_of(name).alias("mime"))


# ---- projections and rules that are pure columns -----------------------------------------

_EAST, _NORTH = "CAST(300000 + c_custkey % 900 * 500 AS DOUBLE)", "CAST(6200000 + c_custkey % 1100 * 700 AS DOUBLE)"
_R_EAST, _R_NORTH = "CAST(1300000 + c_custkey % 900 * 500 AS DOUBLE)", "CAST(6200000 + c_custkey % 1100 * 700 AS DOUBLE)"
_LON1, _LAT1 = projected(_EAST, _NORTH, 3006)
_LON2, _LAT2 = projected(_R_EAST, _R_NORTH, 3021)


@query("p18_reproject_points", f"""
SELECT c_custkey, round(CASE WHEN c_nationkey < 12 THEN {_LON1} ELSE {_LON2} END, 6) AS lon,
  round(CASE WHEN c_nationkey < 12 THEN {_LAT1} ELSE {_LAT2} END, 6) AS lat FROM customer""")
def reproject_points(spark, folder):
    code = F.when(F.col("c_nationkey") < 12, 3006).otherwise(3021)
    rows = table(spark, folder, "customer").select(
        "c_custkey", code.alias("epsg"),
        (F.when(code == 3006, 300000).otherwise(1300000) + F.col("c_custkey") % 900 * 500).cast("double").alias("x"),
        (6200000 + F.col("c_custkey") % 1100 * 700).cast("double").alias("y"),
    )
    lon, lat = geo.to_wgs84_any("x", "y", "epsg")
    return rows.select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("p17_geo_point", """
SELECT CAST(c_custkey AS VARCHAR) AS item_id,
  round(x + CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1.5 WHEN 'HOUSEHOLD' THEN 1 WHEN 'AUTOMOBILE' THEN 2.5 ELSE 2 END, 6) AS lon,
  round(y + CASE c_mktsegment WHEN 'MACHINERY' THEN 0.5 WHEN 'HOUSEHOLD' THEN 2 WHEN 'AUTOMOBILE' THEN 1.5 ELSE 0 END, 6) AS lat
FROM (SELECT *, CAST(c_custkey % 20 AS DOUBLE) AS x, CAST(50 + c_custkey % 10 AS DOUBLE) AS y FROM customer)""")
def geo_point(spark, folder):
    """Single points, lines of several positions, several lines and points, and a polygon with a hole."""
    x, y = F.col("c_custkey") % 20, 50 + F.col("c_custkey") % 10

    def pairs(mark, *steps):
        return F.concat_ws(" ", *[F.concat_ws(mark, text(x + dx), text(y + dy)) for dx, dy in steps])

    def element(name, *body, code=""):
        return F.concat(F.lit(f"<gml:{name}{code}>"), *body, F.lit(f"</gml:{name}>"))

    def positions(*steps):
        return [element("pos", pairs(" ", step)) for step in steps]

    def ring(name, *steps):
        return element(name, element("LinearRing", element("posList", pairs(" ", *steps))))

    code = ' srsName="EPSG:4326"'
    segment = F.col("c_mktsegment")
    markup = (
        F.when(segment == "BUILDING", element("Point", element("coordinates", pairs(",", (0, 0))), code=code))
        # two sides of a square, each of length 2
        .when(segment == "MACHINERY", element("LineString", *positions((0, 0), (2, 0), (2, 2)), code=code))
        .when(segment == "HOUSEHOLD", element(
            "Polygon", ring("exterior", (0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring("interior", (2, 0), (2, 4), (4, 4), (4, 0), (2, 0)), code=code))
        .when(segment == "AUTOMOBILE", element(
            "MultiLineString", element("LineString", *positions((0, 0), (2, 0))), element("LineString", *positions((0, 2), (6, 2))), code=code))
        .otherwise(element("MultiPoint", element("Point", *positions((0, 0))), element("Point", *positions((4, 0))), code=code))
    )
    later = element("Point", *positions((7, 7)), code=code)
    first = table(spark, folder, "customer").select(
        text("c_custkey").alias("item_id"),
        F.explode(F.array(F.struct(F.lit(1).alias("pos"), markup.alias("markup")),
                          F.struct(F.lit(2).alias("pos"), later.alias("markup")))).alias("e"),
    ).select("item_id", "e.pos", "e.markup")
    points = extract.geo_points(first)
    return points.select("item_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("p06_full_name", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name WHEN c_nationkey < 20 THEN 'F' || c_nationkey || ' S' || c_custkey END AS name
FROM customer""")
def full_name(spark, folder):
    full = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name"))
    first = F.when(F.col("c_nationkey") < 20, F.concat(F.lit("F"), text("c_nationkey")))
    last = F.concat(F.lit("S"), text("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey", scalars.full_name(full, first, last).alias("name"))


_KIND = "c_nationkey % 6"


@query("p07_authority_uri", f"""
SELECT c_custkey, CASE {_KIND} WHEN 0 THEN 'http://libris.kb.se/resource/auth/' || c_custkey
    WHEN 1 THEN 'http://libris.kb.se/resource/auth/' || c_custkey WHEN 2 THEN 'http://viaf.org/viaf/' || c_custkey END AS actor,
  CASE {_KIND} WHEN 3 THEN '{NAMES.own_periods}V' WHEN 4 THEN 'http://mis.historiska.se/rdf/period#' || c_custkey END AS period,
  CASE {_KIND} WHEN 0 THEN 'http://libris.kb.se/resource/auth/' || c_custkey WHEN 1 THEN 'Kungliga biblioteket/' || c_custkey
    WHEN 2 THEN 'VIAF/' || c_custkey WHEN 3 THEN '{NAMES.own_periods}V/' || c_custkey
    WHEN 4 THEN 'http://mis.historiska.se/rdf/period/' || c_custkey ELSE 'other/' || c_custkey END AS place FROM customer""")
def authority_uri(spark, folder):
    kind = F.col("c_nationkey") % 6
    auth = (
        F.when(kind == 0, "http://libris.kb.se/resource/auth/").when(kind == 1, "Kungliga biblioteket")
        .when(kind == 2, "VIAF").when(kind == 3, NAMES.own_periods + "V")
        .when(kind == 4, "http://mis.historiska.se/rdf/period").otherwise("other/")
    )
    return table(spark, folder, "customer").select("c_custkey", *[
        scalars.authority_uri(auth, text("c_custkey"), name, NAMES.own_periods).alias(name)
        for name in ("actor", "period", "place")
    ])


_B = NAMES.base


@query("p09_namespace_fix", f"""
SELECT s_suppkey, CASE s_nationkey % 7 WHEN 0 THEN 'http://xmlns.com/foaf/0.1/'
  WHEN 1 THEN 'http://www.mindswap.org/2003/owl/geo/geoFeatures20040307.owl#' WHEN 2 THEN '{NAMES.own}'
  WHEN 3 THEN 'http://www.cidoc-crm.org/rdfs/cidoc-crm#' WHEN 4 THEN 'http://purl.org/vocab/bio/0.1/'
  WHEN 5 THEN '{_B}resurser/contexttype#' || s_suppkey ELSE 'http://other/' || s_suppkey END AS uri FROM supplier""")
def namespace_fix(spark, folder):
    kind, key = F.col("s_nationkey") % 7, text("s_suppkey")
    uri = (
        F.when(kind == 0, F.concat(F.lit("http://xmlns.com/foaf/0.1/#"), key))
        .when(kind == 1, F.concat(F.lit("http://www.mindswap.org/2003/owl/geo"), key))
        .when(kind == 2, F.concat(F.lit(NAMES.own.rstrip("#")), key))
        .when(kind == 3, F.concat(F.lit("http://www.cidoc-crm.org/rdfs/cidoc-crm"), key))
        .when(kind == 4, F.concat(F.lit("http://purl.org/vocab/bio/0.1"), key))
        .when(kind == 5, F.concat(F.lit(_B + "resurser/contexttyp/contexttype#"), key))
        .otherwise(F.concat(F.lit("http://other/"), key))
    )
    return table(spark, folder, "supplier").select("s_suppkey", extract.fix_namespace(uri, NAMES).alias("uri"))


_VERSIONS = ["0.97", "1.0.0", "1.1", "1.11.0", "1.2", "1.3.0", "1.4", "2.0", "1.x", "11"]


@query("p14_version_route", """
SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN '1.0' WHEN 1 THEN '1.0' WHEN 2 THEN '1.1' WHEN 3 THEN '1.11'
  WHEN 4 THEN '1.2.0' WHEN 5 THEN '1.3.0' END AS rules FROM orders""")
def version_route(spark, folder):
    stated = F.element_at(F.array(*[F.lit(v) for v in _VERSIONS]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", scalars.rule_set(stated).alias("rules"))
