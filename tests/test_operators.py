"""Operators against plain Python on small tables, with hot keys on purpose."""

import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from recordloom import catalog
from recordloom.operators import aggregate, filters, graph, search, shuffle, store

POSTING = "item_id string, index string, pos int, value string"


def rows(df):
    return sorted(tuple(row) for row in df.collect())


@pytest.fixture(scope="module")
def postings(spark):
    """A third of all rows belong to one item, and half of the values are the same."""
    rng = random.Random(7)
    data = []
    for n in range(300):
        item = "hot" if n % 3 == 0 else f"i{n % 40}"
        data.append((item, "itemType", 0, "Photo" if n % 2 else rng.choice(["Map", "Coin"])))
        data.append((item, "itemMaterial", n, rng.choice(["Wood", "wood", "Iron"])))
        data.append((item, "fromTime", n, str(rng.randint(-50, 50))))
    data += [("t1", "text", 0, "The red house, by the SEA"), ("t2", "text", 0, "A house red"), ("t3", "text", 0, "Sea")]
    return spark.createDataFrame(data, POSTING).repartition(7).cache()


@pytest.fixture(scope="module")
def plain(postings):
    return [tuple(row) for row in postings.collect()]


def ids(df):
    got = [row.item_id for row in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_catalogue():
    assert len(catalog.INDEXES) == 189 and len(catalog.inverse_names()) == 140
    assert catalog.index_exists("foo_continentName") and not catalog.index_exists("foo_bar")
    assert catalog.index_type("create_fromTime") == catalog.YEAR
    assert catalog.index_type("has_former_or_current_owner") is None
    assert catalog.resolve_index("cql.serverChoice") == "text"
    assert catalog.resolve_index("own.itemType", "own") == "itemType"
    assert catalog.resolve_index("replaces") == "multipleReplaces"


def test_filters(postings, plain):
    everything = {p[0] for p in plain}
    maps = {i for i, x, _, v in plain if x == "itemType" and v == "Map"}
    iron = {i for i, x, _, v in plain if x == "itemMaterial" and v.lower() == "iron"}
    assert ids(filters.match(postings, "itemType", "=", "MAP")) == maps
    assert ids(filters.match(postings, "itemType", "<>", "map")) == everything - maps
    items = postings.select("item_id").distinct()
    assert ids(filters.match(postings, "itemType", "<>", "map", items)) == everything - maps
    assert ids(filters.match(postings, "itemMaterial", "=", "", items)) == ids(filters.match(postings, "itemMaterial", "=", ""))
    leaves = {"map": ("itemType", "=", "map"), "iron": ("itemMaterial", "=", "iron")}
    assert ids(filters.select_items(postings, leaves, lambda t: ~t["map"] | t["iron"], items)) == (everything - maps) | iron
    assert ids(filters.select_items(postings, leaves, lambda t: t["map"] & ~t["iron"], needs_hit=True)) == maps - iron
    assert ids(filters.match(postings, "itemType", "exact", "map")) == set()
    assert ids(filters.match(postings, "itemMaterial", "=", "w?o*")) == {
        i for i, x, _, v in plain if x == "itemMaterial" and v.lower() == "wood"}
    assert ids(filters.match(postings, "itemType", "=", "")) == {"t1", "t2", "t3"}
    assert ids(filters.match(postings, "fromTime", "<", "-40")) == {
        i for i, x, _, v in plain if x == "fromTime" and int(v) < -40}
    got = filters.select_items(
        postings, {"m": ("itemType", "=", "map"), "i": ("itemMaterial", "=", "iron")}, lambda t: t["m"] & ~t["i"])
    assert ids(got) == maps - iron
    one, other = filters.match(postings, "itemType", "=", "map"), filters.match(postings, "itemMaterial", "=", "iron")
    assert ids(filters.both(one, other)) == maps & iron
    assert ids(filters.either(one, other)) == maps | iron
    assert ids(filters.but_not(one, other)) == maps - iron


def test_words(postings):
    assert ids(filters.match(postings, "text", "=", "Sea")) == {"t1", "t3"}
    assert ids(filters.match(postings, "text", "exact", "red house")) == {"t1"}
    assert ids(filters.match(postings, "text", "all", "house red")) == {"t1", "t2"}
    assert ids(filters.match(postings, "text", "any", "a the")) == {"t1", "t2"}
    assert ids(filters.match(postings, "text", "=", "hou*")) == {"t1", "t2"}


def test_rejected_filters(postings):
    for index, op, value in [("fromTime", "=", "19*"), ("itemType", "<", ""), ("itemType", "within", "x"), ("fromTime", ">", "x")]:
        with pytest.raises(ValueError):
            filters.match(postings, index, op, value)


def test_box_and_distance(spark):
    points = spark.createDataFrame([("a", 15.0, 59.0), ("b", 15.3, 59.1), ("c", 20.0, 65.0)], "item_id string, lon double, lat double")
    assert ids(filters.in_box(points, "14.9 58.9 15.3 59.1", "WGS84")) == {"a", "b"}
    assert ids(filters.within_km(points, 15.0, 59.0, 5)) == {"a"}
    assert ids(filters.within_km(points, 15.0, 59.0, 25)) == {"a", "b"}
    for km in (1.0, 31.0):
        with pytest.raises(ValueError):
            filters.within_km(points, 15.0, 59.0, km)
    with pytest.raises(ValueError):
        filters.in_box(points, "1 2 3")


def test_facet_and_counts(postings, plain):
    items = filters.match(postings, "itemType", "=", "map")
    chosen = ids(items)
    domain, hits = set(), defaultdict(set)
    for i, x, _, v in plain:
        if x in ("itemType", "itemMaterial"):
            domain.add((x, v.lower()))
            if i in chosen:
                hits[x, v.lower()].add(i)
    want = {(x, v, len(hits[x, v])) for x, v in domain}
    assert set(rows(aggregate.facet(postings, items, ["itemType", "itemMaterial"]))) == want
    assert set(rows(aggregate.facet(postings, items, ["itemType", "itemMaterial"], 3))) == {w for w in want if w[2] >= 3}
    assert set(rows(aggregate.unique_values(postings, items, ["itemType", "itemMaterial", "subject"]))) == {
        (x, len({v for y, v in hits if y == x and hits[y, v]})) for x in ("itemType", "itemMaterial")}
    with pytest.raises(ValueError):
        aggregate.facet(postings, None, ["nosuch"])


def test_statistic(postings, plain):
    values = defaultdict(lambda: defaultdict(set))
    for i, x, _, v in plain:
        values[i][x].add(v.lower())
    names = ["itemType", "itemMaterial"]
    lists = [sorted({v for i in values for v in values[i][x]}) for x in names]
    want = {
        (a, b, sum(a in values[i]["itemType"] and b in values[i]["itemMaterial"] for i in values)) for a, b in product(*lists)
    }
    specs = dict.fromkeys(names, "*")
    assert set(rows(aggregate.statistic(postings, specs))) == want
    assert set(rows(aggregate.statistic(postings, specs, remove_below=20))) == {w for w in want if w[2] >= 20}
    only = aggregate.statistic(postings, {"itemType": "ma*", "itemMaterial": None})
    assert set(rows(only)) == {w for w in want if w[0].startswith("ma")}
    assert len(rows(aggregate.term_product(postings, specs))) == len(want)
    with pytest.raises(ValueError):
        aggregate.statistic(postings, specs, cap=3)


def test_statistic_of_an_item_with_many_values(spark):
    """3,000 values in each of three indexes are 27 billion combinations; only what other items share is made."""
    names = ["itemType", "itemMaterial", "itemKeyWord"]
    shared = [(i, x, f"v{k}") for i in ("wide", "a", "b") for x in names for k in range(2 + (i == "b"))]
    lone = spark.range(5, 3005).selectExpr("'wide' AS item_id", f"explode(array{tuple(names)}) AS index", "concat('v', id) AS value")
    few = spark.createDataFrame(shared, "item_id string, index string, value string")
    rare = spark.createDataFrame([("a", "itemType", "x"), ("b", "itemMaterial", "y")], few.schema)
    postings_ = few.unionByName(rare).unionByName(lone).withColumn("pos", F.lit(0))
    got = set(rows(aggregate.statistic(postings_, dict.fromkeys(names), remove_below=2)))
    assert got == {(f"v{a}", f"v{b}", f"v{c}", 3) for a, b, c in product(range(2), repeat=3)}
    assert set(rows(aggregate.statistic(postings_, dict.fromkeys(names), remove_below=4))) == set()


def test_terms_and_suggestions(postings, plain):
    counts = Counter((x, v.lower()) for i, x, v in {(i, x, v.lower()) for i, x, _, v in plain if x == "itemMaterial"})
    want = sorted(((x, v, n) for (x, v), n in counts.items()), key=lambda r: (-r[2], r[1]))
    got = [tuple(r) for r in aggregate.terms(postings, "itemMaterial").collect()]
    assert got == want
    assert [r.value for r in aggregate.suggest(postings, ["itemType", "itemMaterial"], "W", 1).collect()] == ["wood"]


def test_text_report_when_empty(spark):
    empty = spark.createDataFrame([], "message string, row bigint, col bigint")
    assert rows(aggregate.message_report(empty)) == [("no errors", 0, None, None)]


# ---- ranks -------------------------------------------------------------------------------

def test_rank_of_hot_value(spark):
    data = [(0 if n % 3 else n, n) for n in range(2000)]
    df = spark.createDataFrame(data, "k int, id int").repartition(9)
    ranked = shuffle.global_rank(df, [F.col("k"), F.col("id")])
    want = {row: place for place, row in enumerate(sorted(data), 1)}
    assert {(r.k, r.id): r["rank"] for r in ranked.collect()} == want


def test_pages(spark):
    df = spark.createDataFrame([(n % 5, n) for n in range(500)], "k int, id int")
    order = [F.col("k").desc(), F.col("id")]
    want = sorted(((n % 5, n) for n in range(500)), key=lambda r: (-r[0], r[1]))[199:230]
    near = sorted((r["rank"], r.k, r.id) for r in shuffle.page(df, order, 200, 31).collect())
    assert near == [(200 + i, *row) for i, row in enumerate(want)]


def test_top_of_hot_group(spark):
    data = [("hot" if n % 3 else f"g{n % 7}", n * 37 % 1009) for n in range(3000)]
    df = spark.createDataFrame(data, "g string, v int")
    got = shuffle.top_per_group(df, ["g"], [F.col("v")], 5).collect()
    for group in {g for g, _ in data}:
        assert sorted(r.v for r in got if r.g == group) == sorted(v for g, v in data if g == group)[:5]


def test_latest_of_hot_key(spark):
    data = [("hot" if n % 3 else f"k{n % 11}", n, f"v{n}") for n in range(999)]
    got = shuffle.keep_latest(spark.createDataFrame(data, "k string, n int, v string").repartition(8), ["k"], ["n"])
    want = {k: max((n, v) for q, n, v in data if q == k) for k, _, _ in data}
    hits = Counter(k for k, _, _ in data)
    assert {r.k: (r.n, r.v, r.hits) for r in got.collect()} == {k: (*w, hits[k]) for k, w in want.items()}


def test_search_rules(postings):
    assert [search.page_size(n) for n in (None, 0, 1, 1000, 1001)] == [50, 50, 1, 1000, 50]
    items = postings.select("item_id")
    assert search.page(items, postings, "itemType", size=5000).count() == items.distinct().count()
    with pytest.raises(ValueError):
        search.page(items, postings, "itemType", size=0)
    for bad in ("nosuch", "itemName", "create_itemType"):
        with pytest.raises(ValueError):
            search.page(items, postings, bad)
    for bad in ("_rdf", "boundingBox", "nosuch"):
        with pytest.raises(ValueError):
            search.export_fields(postings, items, [bad])


def test_swedish_order(spark):
    names = ["Örebro", "Ånge", "Zorn", "Ärla", "Alnö"]
    services = spark.createDataFrame([(str(i), n, "IDLE", None) for i, n in enumerate(names)] + [("9", "Öland", "FETCH", None)],
                                     "serviceid string, name string, step string, lastharvestdate string")
    board = sorted((r.place, r.name) for r in search.service_board(services).collect())
    assert [n for _, n in board] == ["Öland", "Alnö", "Zorn", "Ånge", "Ärla", "Örebro"]


def test_relevance(spark):
    docs = spark.createDataFrame(
        [("a", "text", 0, "coin coin silver"), ("b", "text", 0, "coin " + "filler " * 40), ("c", "text", 0, "map")], POSTING)
    best = search.bm25(docs, ["Coin"], 5).collect()
    assert [r.item_id for r in best] == ["a", "b"] and best[0].score > best[1].score > 0


# ---- graph -------------------------------------------------------------------------------

def closure(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)],
    [(f"n{i:03}", "n500") for i in range(120)] + [("x1", "x2"), ("x3", "x2")],
    [(f"n{i * 7 % 50:03}", f"n{i * 13 % 50:03}") for i in range(40)],
])
def test_components(spark, edges):
    edges = [(a, b) for a, b in edges if a != b]
    relations = spark.createDataFrame(
        [(a, "sameAs" if i % 2 else "multipleReplaces", b) for i, (a, b) in enumerate(edges)] + [("n001", "hasPart", "zz")],
        "item_id string, rel_type string, target_uri string")
    got = {r.uri: r.component for r in graph.components(relations).collect()}
    assert got == closure(edges)


def brute_relations(edges, request, sources):
    """Reading of the rules edge by edge."""
    inverse, found = catalog.inverse_names(), []
    for item, rel, target in edges:
        here = item in sources and not (rel in ("sameAs", "multipleReplaces") and target == request)
        if here:
            found.append((rel, target, "direct", None))
        elif target in sources and rel in inverse:
            found.append((inverse[rel], item, "reverse", rel))
    one_way = {t for r, t, s, _ in found if s == "direct" and r in catalog.ONE_WAY}
    found = [f for f in found if not (f[0] == "isRelatedTo" and f[2] == "reverse" and f[1] in one_way) and f[1] != request]
    best = {}
    for rel, target, source, original in sorted(found, key=lambda f: (f[2], f[3] or "")):
        best.setdefault(("replaces" if rel == "multipleReplaces" else rel, target), (source, original))
    return best


def test_relations_of_requests(spark):
    rng = random.Random(3)
    names = ["sameAs", "multipleReplaces", "isRelatedTo", "hasImage", "hasPart", "father", "author", "hasBeenUsedIn"]
    nodes = [f"n{i}" for i in range(12)]
    edges = sorted({(rng.choice(nodes), rng.choice(names), rng.choice(nodes)) for _ in range(60)})
    edges = [e for e in edges if e[0] != e[2]]
    relations = spark.createDataFrame(edges, "item_id string, rel_type string, target_uri string")
    requests = spark.createDataFrame([(n,) for n in nodes], "uri string")
    inverses = catalog.inverse_map(spark)
    parts = closure([(a, b) for a, r, b in edges if r in ("sameAs", "multipleReplaces")])

    def mates(node):
        return {n for n in nodes if parts.get(n) == parts.get(node) and n in parts} | {node}

    def table(df):
        out = defaultdict(dict)
        for r in df.collect():
            assert (r.rel_type, r.target_uri) not in out[r.request]
            out[r.request][r.rel_type, r.target_uri] = (r.source, r.original_type)
        return out

    plain = table(graph.get_relations(relations, inverses, requests))
    wide = table(graph.get_relations(relations, inverses, requests, infer="sourceOnly"))
    full = table(graph.get_relations(relations, inverses, requests, infer="targetsOnly", max_count=-1))
    for node in nodes:
        assert plain[node] == brute_relations(edges, node, {node})
        assert wide[node] == brute_relations(edges, node, mates(node))
        reach = {(rel, m) for rel, t in plain[node] for m in mates(t)} | set(plain[node])
        assert set(full[node]) == {(rel, t) for rel, t in reach if t != node or (rel, t) in plain[node]}
    few = graph.get_relations(relations, inverses, requests, rel="hasPart", max_count=1)
    assert max(Counter(r.request for r in few.collect()).values()) == 1
    assert graph.get_relations(relations, inverses, requests, max_count=0).count() == 0
    with pytest.raises(ValueError):
        graph.get_relations(relations, inverses, requests, rel="nosuch")


def test_relation_titles(spark):
    got = {r.name: (r.title, r.reverse) for r in graph.relation_types(catalog.inverse_map(spark), catalog.index_catalog(spark)).collect()}
    assert len(got) == 140
    assert got["author"] == ("Författare (uri)", "authorOf")
    assert got["authorOf"] == ("Är/var författare (uri) för", "author")


def test_resolver(spark):
    rel = spark.createDataFrame([("n1", "multipleReplaces", "o1"), ("n1", "multipleReplaces", "o2"), ("n2", "multipleReplaces", "o2")],
                                "item_id string, rel_type string, target_uri string")
    docs = spark.createDataFrame([("n1", "http://x/1"), ("n2", "http://records.example.org/x"), ("n3", None)], "item_id string, target string")
    content = spark.createDataFrame([("n1",), ("g",)], "uri string")
    asked = spark.createDataFrame([(u,) for u in ("n1", "n2", "n3", "o1", "o2", "g", "no")], "uri string")
    got = {r.uri: (r.decision, r.location) for r in graph.resolve(asked, docs, rel, content, "html", "http://records.example.org/").collect()}
    assert got == {
        "n1": ("redirect", "http://x/1"), "n2": ("bad request", "http://records.example.org/x"), "n3": ("not found", None),
        "o1": ("redirect", "n1"), "o2": ("choices", None), "g": ("gone", None), "no": ("not found", None),
    }


# ---- store -------------------------------------------------------------------------------

def moment(text):
    return F.lit(text).cast("timestamp_ntz")


def make_content(spark, data):
    return spark.createDataFrame(data, "uri string, oaiuri string, serviceid string, xmldata string, deleted string").select(
        "uri", "oaiuri", "serviceid", "xmldata", moment("2020-01-01").alias("changed"), moment("2019-01-01").alias("added"),
        F.col("deleted").cast("timestamp_ntz").alias("deleted"), moment("2020-01-01").alias("datestamp"),
        F.lit(0).cast("bigint").alias("status"), F.lit(None).cast("string").alias("nativeurl"))


def make_records(spark, data):
    return spark.createDataFrame(data, "uri string, oaiuri string, serviceid string, xmldata string, file_pos bigint").withColumns(
        {"datestamp": moment("2021-02-02"), "nativeurl": F.lit(None).cast("string")})


def test_run_in_file_order(spark):
    content = make_content(spark, [("a", "oa", "s", "A", None), ("b", "ob", "s", None, "2018-01-01"), ("c", "oc", "s", "C", None),
                                   ("d", "od", "t", "D", None)])
    records = make_records(spark, [("b", "ob", "s", "B1", 1), ("b", "ob", "s", "B2", 4), ("e", "oe", "s", "E", 2), ("c", "oc", "s", "C2", 9),
                                   ("d", "od", "s", "moved", 3), ("f", "of", "s", "F", 5)])
    headers = spark.createDataFrame([("oa", "s", 1), ("oc", "s", 8), ("of", "s", 6), ("od", "t", 7)], "oaiuri string, serviceid string, file_pos bigint")
    headers = headers.withColumn("datestamp", moment("2021-03-03"))
    run = store.apply_run(content, records, headers, moment("2022-01-01")).collect()
    got = {r.uri: (r.serviceid, r.xmldata, r.deleted is not None, str(r.added)[:4], r.action) for r in run}
    assert got == {
        "a": ("s", None, True, "2019", "d"), "b": ("s", "B2", False, "2019", "u"), "c": ("s", "C2", False, "2019", "u"),
        "d": ("s", "moved", False, "2019", "u"), "e": ("s", "E", False, "2022", "i"), "f": ("s", None, True, "2022", "d"),
    }
    counts = store.run_counters(content, records, headers).filter("serviceid = 's'").first()
    assert (counts.inserted, counts.updated, counts.deleted, counts.changed) == (2, 4, 3, True)


def test_full_sync(spark):
    content = make_content(spark, [("a", "oa", "s", "A", None), ("b", "ob", "s", None, "2018-01-01"), ("c", "oc", "t", "C", None)])
    after = store.full_sync(content, make_records(spark, [("n", "on", "s", "N", 1)]), "s", moment("2022-01-01"))
    got = {r.uri: (str(r.changed)[:4], str(r.deleted)[:4], str(r.datestamp)[:4], r.xmldata) for r in after.collect()}
    assert got == {
        "a": ("2022", "2022", "2022", None), "b": ("2022", "2018", "2018", None), "c": ("2020", "None", "2020", "C"),
        "n": ("2022", "None", "2021", "N"),
    }


def test_problem_cap(spark):
    data = [("s", "store", f"m{n % 300}", n) for n in range(900)] + [("s", "index", "m0", 1)]
    got = store.problems(spark.createDataFrame(data, "serviceid string, operation string, message string, seq long"), 200)
    stored = sorted((r.place, r.message, r.n) for r in got.collect() if r.operation == "store")
    assert [m for _, m, _ in stored[:200]] == [f"m{n}" for n in range(200)] and stored[0][2] == 3
    assert stored[200] == (201, "more problems", 100) and len(stored) == 201


def test_problem_log_arguments(spark):
    log = spark.createDataFrame([], "serviceid string, eventtype long, eventts timestamp, message string, eventid long")
    for n, sort, direction in [(0, "message", "asc"), (1, "password", "asc"), (1, "message", "up")]:
        with pytest.raises(ValueError):
            store.problem_log(log, n, sort, direction)


def test_organisations_keep_empty_ones(spark):
    orgs = spark.createDataFrame([("a", "A"), ("b", "B")], "kortnamn string, namnswe string")
    services = spark.createDataFrame([("s1", "a"), ("s2", "a")], "serviceid string, kortnamn string")
    got = rows(store.org_services(orgs, services).select("kortnamn", F.coalesce("serviceid", F.lit("-")), "namnswe"))
    assert got == [("a", "s1", "A"), ("a", "s2", "A"), ("b", "-", "B")]


def test_pages_at_any_depth(spark):
    """Pages by selection against a sorted list: ties, nulls, both directions, small samples."""
    rng = random.Random(4)
    rows = [(f"i{k:04d}", None if k % 37 == 0 else rng.choice("abcdefgh") * rng.randrange(1, 4)) for k in range(1500)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "item_id string, v string").repartition(5)
    for desc in (False, True):
        valued = sorted((r for r in rows if r[1] is not None), key=lambda r: r[0])
        valued.sort(key=lambda r: r[1], reverse=desc)
        want = valued + sorted(r for r in rows if r[1] is None)
        for start, size in ((1, 5), (700, 30), (1490, 50), (1600, 5)):
            got = shuffle.selected_page(frame, ["v", "item_id"], [desc, False], start, size, most=40, sample=64)
            found = [(r.item_id, r.v, r["rank"]) for r in got.orderBy("rank").collect()]
            assert found == [(*r, start + k) for k, r in enumerate(want[start - 1:start - 1 + size])]
