"""Registered queries: filters, counts, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.catalog import INDEXES, index_catalog
from recordloom.functions import geo, scalars
from recordloom.operators import aggregate, filters, search, store
from recordloom.plans.bindings import (
    DOC_CONTENT, DOC_WORDS, POINTS, POSTINGS, RUN_LOG, customer_points, doc_content, doc_postings,
    item_postings, moment, run_log, stamp, table, text, with_ctes,
)
from recordloom.plans.registry import query


def all_items(spark, folder):
    """The item table of ``item_postings``: every order."""
    return table(spark, folder, "orders").select(text("o_orderkey").alias("item_id"))


def projected(x: str, y: str, code: int) -> tuple[str, str]:
    """SQL of longitude and latitude for an easting and a northing."""
    k = geo.series(code)
    xi, eta = f"(({y}) - {k['northing']!r}) / {k['unit']!r}", f"(({x}) - {k['easting']!r}) / {k['unit']!r}"
    xi = f"({xi})"
    eta = f"({eta})"
    xi_p = xi + "".join(f" - {k[f'd{i}']!r} * sin({2 * i} * {xi}) * cosh({2 * i} * {eta})" for i in (1, 2, 3, 4))
    eta_p = eta + "".join(f" - {k[f'd{i}']!r} * cos({2 * i} * {xi}) * sinh({2 * i} * {eta})" for i in (1, 2, 3, 4))
    phi = f"asin(sin({xi_p}) / cosh({eta_p}))"
    lon = f"degrees({k['meridian']!r} + atan(sinh({eta_p}) / cos({xi_p})))"
    s2 = f"pow(sin({phi}), 2)"
    series = f"({k['a']!r} + {s2} * ({k['b']!r} + {s2} * ({k['c']!r} + {s2} * {k['d']!r})))"
    return lon, f"degrees({phi} + sin({phi}) * cos({phi}) * {series})"


# ---- filters -----------------------------------------------------------------------------

@query("f01_term_eq", with_ctes(
    "SELECT DISTINCT item_id FROM postings WHERE index = 'itemType' AND lower(value) = 'f'", POSTINGS))
def term_eq(spark, folder):
    return filters.match(item_postings(spark, folder), "itemType", "=", "F")


@query("f02_wildcard", with_ctes(
    "SELECT DISTINCT item_id FROM (SELECT item_id, unnest(words) AS w FROM doc_words) WHERE w LIKE 'er%_tion'", DOC_WORDS))
def wildcard(spark, folder):
    return filters.match(doc_postings(spark, folder), "text", "=", "er*?tion")


@query("f03_missing_field", with_ctes(
    "SELECT item_id FROM postings GROUP BY item_id HAVING count(*) FILTER (WHERE index = 'itemMaterial') = 0", POSTINGS))
def missing_field(spark, folder):
    return filters.match(item_postings(spark, folder), "itemMaterial", "=", "", all_items(spark, folder))


@query("f04_not_equal", with_ctes(
    "SELECT item_id FROM postings GROUP BY item_id "
    "HAVING count(*) FILTER (WHERE index = 'itemMaterial' AND lower(value) = 'r') = 0", POSTINGS))
def not_equal(spark, folder):
    return filters.match(item_postings(spark, folder), "itemMaterial", "<>", "R", all_items(spark, folder))


@query("f05_any", with_ctes(
    "SELECT item_id FROM doc_words WHERE list_contains(words, 'erblest') OR list_contains(words, 'einenlich')", DOC_WORDS))
def any_word(spark, folder):
    return filters.match(doc_postings(spark, folder), "text", "any", "erblest einenlich")


@query("f06_all", with_ctes(
    "SELECT item_id FROM doc_words WHERE list_contains(words, 'the') AND list_contains(words, 'of') "
    "AND list_contains(words, 'on')", DOC_WORDS))
def all_words(spark, folder):
    return filters.match(doc_postings(spark, folder), "text", "all", "the of ON")


@query("f07_exact_phrase", with_ctes(
    "SELECT item_id FROM doc_words WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' in the ')", DOC_WORDS))
def exact_phrase(spark, folder):
    return filters.match(doc_postings(spark, folder), "text", "exact", "in the")


@query("f08_range", with_ctes(
    "SELECT DISTINCT item_id FROM postings WHERE index = 'fromTime' AND TRY_CAST(value AS INTEGER) >= 1995 "
    "INTERSECT SELECT item_id FROM postings WHERE index = 'createdDate' AND value < '1998-06-15'", POSTINGS))
def value_range(spark, folder):
    postings = item_postings(spark, folder)
    return filters.both(
        filters.match(postings, "fromTime", ">=", "1995"), filters.match(postings, "createdDate", "<", "1998-06-15")
    )


@query("f09_bool_combine", with_ctes(
    "(SELECT item_id FROM postings WHERE index = 'itemType' AND lower(value) = 'f' "
    "UNION SELECT item_id FROM postings WHERE index = 'subject' AND lower(value) = '1-urgent') "
    "EXCEPT SELECT item_id FROM postings WHERE index = 'itemMaterial' AND lower(value) = 'n'", POSTINGS))
def bool_combine(spark, folder):
    return filters.select_items(
        item_postings(spark, folder),
        {"done": ("itemType", "=", "F"), "urgent": ("subject", "=", "1-URGENT"), "new": ("itemMaterial", "=", "N")},
        lambda t: (t["done"] | t["urgent"]) & ~t["new"],
        needs_hit=True,
    )


@query("f09_set_combine", with_ctes(
    "SELECT item_id FROM postings WHERE index = 'itemType' AND lower(value) = 'o' "
    "UNION SELECT item_id FROM postings WHERE index = 'subject' AND lower(value) = '5-low' "
    "EXCEPT SELECT item_id FROM postings WHERE index = 'itemTechnique' AND lower(value) = 'f'", POSTINGS))
def set_combine(spark, folder):
    postings = item_postings(spark, folder)
    one = filters.match(postings, "itemType", "=", "O")
    other = filters.match(postings, "subject", "=", "5-LOW")
    return filters.but_not(filters.either(one, other), filters.match(postings, "itemTechnique", "=", "F"))


_BOX = (400000.0, 6300000.0, 700000.0, 6700000.0)
_LOW, _HIGH = projected(repr(_BOX[0]), repr(_BOX[1]), 3006), projected(repr(_BOX[2]), repr(_BOX[3]), 3006)


@query("f10_bbox", with_ctes(
    f"SELECT DISTINCT item_id FROM points WHERE lat BETWEEN {_LOW[1]} AND {_HIGH[1]} "
    f"AND lon BETWEEN {_LOW[0]} AND {_HIGH[0]}", POINTS))
def bbox(spark, folder):
    return filters.in_box(customer_points(spark, folder), " ".join(str(n) for n in _BOX))


@query("f11_point_distance", with_ctes(
    f"SELECT DISTINCT item_id FROM points WHERE 2 * {geo.EARTH_RADIUS_KM!r} * asin(sqrt(least(1.0, "
    "pow(sin((radians(lat) - radians(59.33)) / 2), 2) + cos(radians(59.33)) * cos(radians(lat)) "
    "* pow(sin((radians(lon) - radians(15.33)) / 2), 2)))) <= 25", POINTS))
def point_distance(spark, folder):
    return filters.within_km(customer_points(spark, folder), 15.33, 59.33, 25)


@query("f12_index_alias", """
SELECT CASE lang WHEN 'en' THEN 'text' WHEN 'fr' THEN 'itemType' WHEN 'de' THEN 'multipleReplaces'
       ELSE 'multipleReplaces' END AS name, count(*) AS n FROM documents GROUP BY 1""")
def index_alias(spark, folder):
    asked = (
        F.when(F.col("lang") == "en", "cql.serverChoice").when(F.col("lang") == "fr", "own.itemType")
        .when(F.col("lang") == "de", "replaces").otherwise("own.replaces")
    )
    names = table(spark, folder, "documents").select(filters.index_alias(asked, "own").alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("f13_url_allow_list",
       "SELECT page_id, url FROM pages WHERE url LIKE '%.example.com/%' OR url LIKE '%.net/en/%'")
def url_allow_list(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return pages.filter(filters.url_allowed(F.col("url"), [".example.com/", ".net/en/"]))


# ---- counts ------------------------------------------------------------------------------

_FACETED = ["itemType", "subject", "itemMaterial"]


@query("a01_facet", with_ctes(
    "SELECT index, value, count(DISTINCT hit) AS n FROM (SELECT p.index, lower(p.value) AS value, m.item_id AS hit "
    "FROM postings p LEFT JOIN (SELECT DISTINCT item_id FROM postings WHERE index = 'createdDate' "
    "AND value >= '2001-01-01') m USING (item_id) "
    "WHERE p.index IN ('itemType', 'subject', 'itemMaterial')) GROUP BY 1, 2", POSTINGS))
def facet(spark, folder):
    postings = item_postings(spark, folder)
    return aggregate.facet(postings, filters.match(postings, "createdDate", ">=", "2001-01-01"), _FACETED)


@query("a01_facet_min_count", with_ctes(
    "SELECT index, value, n FROM (SELECT index, lower(value) AS value, count(DISTINCT item_id) AS n FROM postings "
    "WHERE index = 'itemNumber' AND item_id IN (SELECT item_id FROM postings WHERE index = 'itemType' AND value = 'F') "
    "GROUP BY 1, 2) WHERE n >= 5", POSTINGS))
def facet_min_count(spark, folder):
    postings = item_postings(spark, folder)
    return aggregate.facet(postings, filters.match(postings, "itemType", "=", "F"), ["itemNumber"], 5)


@query("a02_unique_value_count", with_ctes(
    "SELECT index, count(DISTINCT lower(value)) AS n FROM postings WHERE index IN "
    "('subject', 'itemType', 'itemMaterial', 'itemTechnique') AND item_id IN "
    "(SELECT item_id FROM postings WHERE index = 'fromTime' AND TRY_CAST(value AS INTEGER) < 1996) GROUP BY 1", POSTINGS))
def unique_value_count(spark, folder):
    postings = item_postings(spark, folder)
    return aggregate.unique_values(postings, filters.match(postings, "fromTime", "<", "1996"))


@query("a03_terms", with_ctes(
    "SELECT index, value, count(DISTINCT item_id) AS n FROM postings WHERE index = 'itemNumber' AND value LIKE '1%' "
    "GROUP BY 1, 2 HAVING count(DISTINCT item_id) >= 2 ORDER BY n DESC, value LIMIT 40", POSTINGS))
def terms(spark, folder):
    return aggregate.terms(item_postings(spark, folder), "itemNumber", "1*", 2, 40)


@query("a03_text_terms", with_ctes(
    "SELECT 'text' AS index, w AS value, count(DISTINCT item_id) AS n FROM "
    "(SELECT item_id, unnest(words) AS w FROM doc_words) WHERE starts_with(w, 'er') "
    "GROUP BY w ORDER BY n DESC, value LIMIT 1000", DOC_WORDS))
def text_terms(spark, folder):
    return aggregate.terms(doc_postings(spark, folder), "text", "ER*", n=1000)


_COMBOS = """, lists AS (
  SELECT DISTINCT index, lower(value) AS value FROM postings WHERE index IN ('itemType', 'subject', 'itemMaterial')
), product AS (
  SELECT a.value AS v1, b.value AS v2, c.value AS v3 FROM lists a, lists b, lists c
  WHERE a.index = 'itemType' AND b.index = 'subject' AND c.index = 'itemMaterial'
), hits AS (
  SELECT a.item_id, lower(a.value) AS v1, lower(b.value) AS v2, lower(c.value) AS v3 FROM postings a
  JOIN postings b ON a.item_id = b.item_id AND b.index = 'subject'
  JOIN postings c ON a.item_id = c.item_id AND c.index = 'itemMaterial' WHERE a.index = 'itemType'
)"""
_SPECS = {"itemType": "*", "subject": "*", "itemMaterial": "*"}


@query("a04_statistic", with_ctes(
    "SELECT v1, v2, v3, count(DISTINCT h.item_id) AS n FROM product LEFT JOIN hits h USING (v1, v2, v3) "
    "GROUP BY v1, v2, v3", POSTINGS + _COMBOS))
def statistic(spark, folder):
    return aggregate.statistic(item_postings(spark, folder), _SPECS)


@query("a04_statistic_min", with_ctes(
    "SELECT v1, v2, v3, count(DISTINCT item_id) AS n FROM hits GROUP BY v1, v2, v3 "
    "HAVING count(DISTINCT item_id) >= 100", POSTINGS + _COMBOS))
def statistic_min(spark, folder):
    return aggregate.statistic(item_postings(spark, folder), _SPECS, remove_below=100)


@query("a05_statistic_search", with_ctes(
    "SELECT v1, v2, v3, count(DISTINCT h.item_id) AS n FROM product LEFT JOIN (SELECT * FROM hits WHERE item_id IN "
    "(SELECT item_id FROM postings WHERE index = 'fromTime' AND TRY_CAST(value AS INTEGER) = 1999)) h "
    "USING (v1, v2, v3) GROUP BY v1, v2, v3", POSTINGS + _COMBOS))
def statistic_search(spark, folder):
    postings = item_postings(spark, folder)
    return aggregate.statistic(postings, _SPECS, items=filters.match(postings, "fromTime", "=", "1999"))


@query("j06_term_product", with_ctes("SELECT v1, v2, v3 FROM product", POSTINGS + _COMBOS))
def term_product(spark, folder):
    return aggregate.term_product(item_postings(spark, folder), _SPECS)


@query("a06_count_per_source", with_ctes(
    "SELECT coalesce(l.serviceid, d.serviceid) AS serviceid, coalesce(n_live, 0) AS n_live, "
    "coalesce(n_indexed, 0) AS n_indexed, coalesce(n_live, 0) - coalesce(n_indexed, 0) AS drift FROM "
    "(SELECT serviceid, count(*) AS n_live FROM content WHERE deleted IS NULL GROUP BY 1) l FULL OUTER JOIN "
    "(SELECT source AS serviceid, count(*) AS n_indexed FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) d "
    "ON l.serviceid = d.serviceid", DOC_CONTENT))
def count_per_source(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left_semi").select(
        F.col("source").alias("serviceid")
    )
    return store.source_counts(doc_content(spark, folder), docs)


@query("a07_count_total", with_ctes(
    "SELECT 'hits' AS what, count(DISTINCT item_id) AS n FROM postings WHERE index = 'itemType' AND value = 'P' "
    "UNION ALL SELECT 'changed', count(*) FROM content WHERE deleted IS NULL "
    "AND changed > TIMESTAMP '2024-01-15 00:00:00'", POSTINGS, DOC_CONTENT))
def count_total(spark, folder):
    hits = aggregate.total(filters.match(item_postings(spark, folder), "itemType", "=", "P"))
    changed = store.live_rows(store.changed_since(doc_content(spark, folder), moment("2024-01-15 00:00:00")))
    return hits.select(F.lit("hits").alias("what"), "n").unionByName(
        aggregate.total(changed).select(F.lit("changed").alias("what"), "n")
    )


@query("a08_validation_report", r"""
WITH tags AS (SELECT page_id, regexp_extract_all(html, '<(br|img|meta|p)[ >]', 1) AS found FROM pages),
rows AS (SELECT page_id, unnest(found) AS tag, generate_subscripts(found, 1) AS place FROM tags)
SELECT message, n, CAST(first.r AS BIGINT) AS row, CAST(first.c AS BIGINT) AS col FROM (
  SELECT 'element is not closed: ' || tag AS message, count(*) AS n, min({'r': page_id, 'c': place}) AS first
  FROM rows GROUP BY tag)""")
def validation_report(spark, folder):
    tags = F.regexp_extract_all("html", F.lit("<(br|img|meta|p)[ >]"), F.lit(1))
    rows = table(spark, folder, "pages").select("page_id", F.posexplode(tags).alias("place", "tag"))
    return aggregate.message_report(rows.select(
        F.concat(F.lit("element is not closed: "), F.col("tag")).alias("message"),
        F.col("page_id").alias("row"), (F.col("place") + 1).cast("bigint").alias("col"),
    ))


@query("a09_latest_status", with_ctes(
    "SELECT serviceid, strftime(eventts, '%Y-%m-%d %H:%M:%S') AS eventts, message FROM (SELECT *, row_number() OVER "
    "(PARTITION BY serviceid ORDER BY eventts DESC, eventid DESC) AS rn FROM log) WHERE rn = 1 AND eventtype = 1", RUN_LOG))
def latest_status(spark, folder):
    return store.latest_error(run_log(spark, folder)).withColumn("eventts", stamp("eventts"))


@query("a10_run_speed", """
WITH runs AS (SELECT user_id, count(*) AS n, date_diff('millisecond', min(ts), max(ts)) // 1000 AS ms,
  count(*) + user_id AS whole FROM events GROUP BY user_id)
SELECT user_id, n, floor(n * 10.0 / greatest(ms // 1000, 1) + 0.5) / 10.0 AS per_second,
  CASE WHEN whole > 0 AND n > 0 THEN CAST(floor(whole * ms * CAST(1.0 AS DOUBLE) / n + 0.5) AS BIGINT) - ms ELSE -1 END AS ms_left
FROM runs""")
def run_speed(spark, folder):
    span = F.timestamp_diff("MILLISECOND", F.min("ts"), F.max("ts"))
    runs = table(spark, folder, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.floor(span / 1000).cast("bigint").alias("ms")
    ).withColumn("whole", F.col("n") + F.col("user_id"))
    return runs.select(
        "user_id", "n", scalars.speed("n", "ms").alias("per_second"),
        scalars.remaining("ms", "n", "whole").alias("ms_left"),
    )


@query("a11_value_concat", with_ctes(
    "SELECT item_id, index, nullif(trim(string_agg(value, ' ' ORDER BY pos, value)), '') AS value FROM postings "
    "WHERE index IN ('itemMaterial', 'itemNumber') GROUP BY 1, 2", POSTINGS))
def value_concat(spark, folder):
    rows = item_postings(spark, folder).filter(F.col("index").isin("itemMaterial", "itemNumber"))
    return aggregate.joined(rows)


# ---- pages -------------------------------------------------------------------------------

@query("w01_sorted_page", with_ctes(
    "SELECT item_id, sort_value, rank FROM (SELECT item_id, value AS sort_value, row_number() OVER "
    "(ORDER BY value DESC, item_id) AS rank FROM postings WHERE index = 'createdDate' AND item_id IN "
    "(SELECT item_id FROM postings WHERE index = 'itemType' AND value = 'F')) WHERE rank BETWEEN 101 AND 350", POSTINGS))
def sorted_page(spark, folder):
    postings = item_postings(spark, folder)
    items = filters.match(postings, "itemType", "=", "F")
    return search.page(items, postings, "createdDate", desc=True, start=101, size=250)


@query("w01_page_default", with_ctes(
    "SELECT item_id, sort_value, rank FROM (SELECT item_id, value AS sort_value, row_number() OVER "
    "(ORDER BY value, item_id) AS rank FROM postings WHERE index = 'itemType') WHERE rank <= 50", POSTINGS))
def page_default(spark, folder):
    postings = item_postings(spark, folder)
    return search.page(postings.select("item_id"), postings.filter("index = 'itemType'"), "itemType", size=search.page_size(5000)).filter(
        F.col("sort_value").isNotNull()
    )


_BM25 = r""", hit AS (
  SELECT item_id, len(words) AS dl, len(list_filter(words, lambda w: w = 'the')) AS f0,
         len(list_filter(words, lambda w: w = 'und')) AS f1, len(list_filter(words, lambda w: w = 'erblest')) AS f2
  FROM doc_words
), corpus AS (
  SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1,
         count(*) FILTER (WHERE f2 > 0) AS d2 FROM hit
), scored AS (
  SELECT item_id,
    ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / mean))
    + ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / mean))
    + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / mean)) AS score
  FROM hit, corpus WHERE f0 + f1 + f2 > 0
)"""


@query("w02_relevance_topk", with_ctes(
    "SELECT item_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, item_id LIMIT 100", DOC_WORDS + _BM25))
def relevance_topk(spark, folder):
    best = search.bm25(doc_postings(spark, folder), ["the", "und", "erblest"], 100)
    return best.select("item_id", F.round("score", 6).alias("score"))


_SORTABLE = ", ".join(f"'{i.name}'" for i in INDEXES.values() if i.is_sortable)


@query("w03_sortable_check", with_ctes(
    f"SELECT index, n, CASE WHEN index LIKE 'x%' THEN 'unknown' WHEN index IN ({_SORTABLE}) THEN 'sortable' "
    "ELSE 'not sortable' END AS verdict FROM (SELECT CASE WHEN pos > 6 THEN 'x' || index ELSE index END AS index, "
    "count(*) AS n FROM postings GROUP BY 1)", POSTINGS))
def sortable_check(spark, folder):
    asked = F.when(F.col("pos") > 6, F.concat(F.lit("x"), F.col("index"))).otherwise(F.col("index"))
    requests = item_postings(spark, folder).groupBy(asked.alias("index")).agg(F.count(F.lit(1)).alias("n"))
    return search.check_sort(requests, index_catalog(spark))


@query("w04_suggest", with_ctes(
    "SELECT index, value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY index ORDER BY n DESC, value) AS place "
    "FROM (SELECT index, lower(value) AS value, count(DISTINCT item_id) AS n FROM postings "
    "WHERE index IN ('itemNumber', 'subject', 'createdDate') AND starts_with(lower(value), '1') GROUP BY 1, 2)) "
    "WHERE place <= 5", POSTINGS))
def suggest(spark, folder):
    return aggregate.suggest(item_postings(spark, folder), ["itemNumber", "subject", "createdDate"], "1", 5)


@query("w05_problem_log", with_ctes(
    "SELECT serviceid, eventtype, eventid, message FROM (SELECT * FROM log WHERE eventtype > 0 "
    "ORDER BY message DESC, eventid LIMIT 200)", RUN_LOG))
def problem_log(spark, folder):
    return store.problem_log(run_log(spark, folder), 200, "message", "desc").select(
        "serviceid", "eventtype", "eventid", "message"
    )


@query("w06_log_history", with_ctes(
    "SELECT serviceid, eventid, strftime(eventts, '%Y-%m-%d %H:%M:%S') || ': ' || "
    "CASE WHEN eventtype <> 0 THEN '*** ' ELSE '' END || message AS line FROM log", RUN_LOG))
def log_history(spark, folder):
    return store.log_history(run_log(spark, folder)).select("serviceid", "eventid", "line")


@query("w07_service_board", """
WITH services AS (SELECT s_suppkey, s_name, CASE s_suppkey % 5 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'FETCH' WHEN 2 THEN 'STORE'
  WHEN 3 THEN 'INDEX' ELSE 'EMPTYINDEX' END AS step FROM supplier)
SELECT s_name AS name, step, row_number() OVER (ORDER BY CASE step WHEN 'FETCH' THEN 0 WHEN 'STORE' THEN 1 WHEN 'INDEX' THEN 2
  WHEN 'EMPTYINDEX' THEN 3 ELSE 4 END, s_name) AS place FROM services""")
def service_board(spark, folder):
    steps = F.array(*[F.lit(s) for s in ("IDLE", "FETCH", "STORE", "INDEX", "EMPTYINDEX")])
    services = table(spark, folder, "supplier").select(
        text("s_suppkey").alias("serviceid"), F.col("s_name").alias("name"),
        F.element_at(steps, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("step"),
        F.lit(None).cast("string").alias("lastharvestdate"),
    )
    return search.service_board(services).select("name", "step", "place")


@query("w08_first_geometry", with_ctes(
    "SELECT item_id, index, value FROM (SELECT *, row_number() OVER (PARTITION BY item_id, index ORDER BY pos, value) AS rn "
    "FROM postings WHERE index = 'itemNumber') WHERE rn = 1", POSTINGS))
def first_geometry(spark, folder):
    return aggregate.first_value(item_postings(spark, folder).filter(F.col("index") == "itemNumber"))


@query("s10_record_export", with_ctes(
    "SELECT item_id, index AS field, pos, value FROM postings WHERE index IN ('itemType', 'itemNumber', 'createdDate') "
    "AND item_id IN (SELECT item_id FROM postings WHERE index = 'itemMaterial' AND value = 'A')", POSTINGS))
def record_export(spark, folder):
    postings = item_postings(spark, folder)
    items = filters.match(postings, "itemMaterial", "=", "A")
    return search.export_fields(postings, items, ["itemType", "itemNumber", "createdDate"])


@query("g08_keep_distinct", with_ctes(
    "SELECT DISTINCT index, value FROM postings WHERE index IN ('itemType', 'itemMaterial', 'subject')", POSTINGS))
def keep_distinct(spark, folder):
    rows = item_postings(spark, folder).filter(F.col("index").isin("itemType", "itemMaterial", "subject"))
    return search.distinct_values(rows.select("index", "value"))


@query("c12_stem_tokens", with_ctes(r"""
SELECT word, head || CASE WHEN ends_with(second, 'fullt') THEN regexp_replace(second, 'fullt$', 'full')
  WHEN ends_with(second, 'löst') THEN regexp_replace(second, 'löst$', 'lös')
  ELSE regexp_replace(second, '(lig|els|ig)$', '') END AS stem
FROM (SELECT word, head, CASE WHEN regexp_matches(first, '(dd|gd|nn|dt|gt|kt|tt)$') THEN left(first, length(first) - 1)
        ELSE first END AS second
  FROM (SELECT word, head, CASE WHEN plain <> tail THEN plain
          WHEN regexp_matches(head || tail, '[bcdfghjklmnoprtvy]s$') AND ends_with(tail, 's') THEN left(tail, length(tail) - 1)
          ELSE tail END AS first
    FROM (SELECT word, left(word, k) AS head, substr(word, k + 1) AS tail, regexp_replace(substr(word, k + 1),
            '(heterna|hetens|anden|heten|heter|arnas|ernas|ornas|andes|arens|andet|arna|erna|orna|ande|arne|aste|aren|ades|erns|ade|are|ern|ens|het|ast|ad|en|ar|er|or|as|es|at|a|e)$', '') AS plain
      FROM (SELECT word, CASE WHEN h = 0 THEN length(word) ELSE greatest(h, 3) END AS k
        FROM (SELECT word, length(regexp_extract(word, '^[^aeiouyäåö]*[aeiouyäåö]+[^aeiouyäåö]')) AS h
          FROM (SELECT DISTINCT unnest(words) AS word FROM doc_words))))))""", DOC_WORDS))
def stem_tokens(spark, folder):
    return search.stems(doc_postings(spark, folder).filter(F.col("index") == "text"))
