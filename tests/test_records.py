"""Harvest files to records, postings, relations; streams and written outputs."""

import base64
import os
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.operators import aggregate, extract, filters, search, store
from recordloom.sinks import outputs
from recordloom.sources import harvest, record_cut
from recordloom.streaming import jobs
from recordloom.vocabulary import PUBLIC_NAMESPACES, Names

N = Names()
NOW = "2020-01-01 00:00:00"


def record(number, version, body, nodes=""):
    return f"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:v="{N.own}"
  xmlns:f="http://xmlns.com/foaf/0.1/" xmlns:g="http://www.mindswap.org/2003/owl/geo/geoFeatures20040307.owl#"
  xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:crm="http://www.cidoc-crm.org/rdfs/cidoc-crm#"
  xmlns:bio="http://purl.org/vocab/bio/0.1/">
  <rdf:Description rdf:about="{N.base}item/{number}">
    <rdf:type rdf:resource="{N.own}Entity"/><v:recordVersion>{version}</v:recordVersion>{body}
  </rdf:Description>{nodes}</rdf:RDF>"""


SUPER = f'<v:itemSuperType rdf:resource="{N.resource("EntitySuperType#agent")}"/>'
CONTEXT = f"""<v:context><v:Context>
  <v:contextType rdf:resource="{N.context_type}produce"/><v:contextSuperType rdf:resource="{N.context_supertype}create"/>
  <v:fromTime>1540</v:fromTime><v:toTime>1562-03-04</v:toTime><f:name>Erik &amp; Son</f:name><f:firstName>Erik</f:firstName>
  <f:surname>Ek</f:surname><g:county rdf:resource="{N.area("county")}01"/><v:author rdf:resource="{N.base}agent/7"/>
  <crm:P51F.has_former_or_current_owner rdf:resource="{N.base}agent/8"/>
</v:Context></v:context>"""

RECORDS = {
    "good": record(1, "1.1", SUPER + """<v:itemTitle> Cup </v:itemTitle><v:itemName rdf:nodeID="n"/>
      <v:createdDate>2006-01-01</v:createdDate><v:buildDate>2031-01-01</v:buildDate><f:name>Cup maker</f:name>
      <owl:sameAs rdf:resource="http://other/1"/><bio:child rdf:resource="http://other/2"/>
      <crm:P11B.participated_in rdf:resource="http://other/3"/><v:url>http://www.example.com/1</v:url>
      <v:presentation rdf:parseType="Literal"><p:item xmlns:p="urn:p"><p:a>x</p:a></p:item></v:presentation>""" + CONTEXT,
                   '<rdf:Description rdf:nodeID="n"><v:name>Mug</v:name></rdf:Description>'),
    "old": record(2, "0.97", f'<v:itemTitle>Map</v:itemTitle><v:thumbnail>http://t/2.jpg</v:thumbnail>'
                  f'<v:context><v:Context><v:contextType rdf:resource="{N.context_type}odd"/><v:fromTime>?</v:fromTime>'
                  '<v:placeName>Kil</v:placeName></v:Context></v:context>'),
    "late rules": record(3, "1.3.0", SUPER + f'<v:itemMark><v:M><v:form>Round</v:form></v:M></v:itemMark>'
                         f'<v:media><v:Media><v:mediaLicense rdf:resource="http://l"/><v:byline>B</v:byline></v:Media></v:media>'
                         f'<v:context><v:Context><v:contextType rdf:resource="{N.context_type}produce"/>'
                         f'<v:contextSuperType rdf:resource="{N.context_supertype}create"/>'
                         '<v:agent rdf:resource="http://viaf.org/viaf/9"/></v:Context></v:context>'),
    "no license": record(4, "1.11", SUPER + "<v:image><v:Image><v:thumbnailSource>http://s</v:thumbnailSource></v:Image></v:image>"),
    "no supertype": record(5, "1.1", "<v:itemTitle>x</v:itemTitle>"),
    "two labels": record(6, "1.0", "<v:itemLabel>a</v:itemLabel><v:itemLabel>b</v:itemLabel>"),
    "bad context": record(7, "1.1", SUPER + CONTEXT.replace("#produce", "#nosuch")),
    "bad version": record(8, "7.0", "<v:itemTitle>x</v:itemTitle>"),
    "bad relation": record(9, "1.1", SUPER + CONTEXT.replace("v:author", "v:authorOf")),
    "left out": record(10, "1.0", "<v:itemForIndexing>n</v:itemForIndexing><v:itemTitle>x</v:itemTitle>"),
    "no entity": "<a/>",
    "broken": "<a><b></a>",
}


def vocab(spark):
    return spark.createDataFrame([
        ("1.0", N.context_type + "odd", "Udda"), ("1.1", N.context_type + "produce", "Tillverka"),
        ("1.1", N.resource("EntitySuperType#agent"), "Agent"),
    ], "version string, uri string, label string")


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(k, False, v) for k, v in RECORDS.items()], "oaiuri string, is_deleted boolean, payload_xml string")
    return harvest.record_triples(rows, N)


@pytest.fixture(scope="module")
def corpus(spark, parsed):
    return extract.extract(parsed[0], N, vocab(spark), F.lit(NOW).cast("timestamp_ntz"))


def fields(corpus, number):
    found = {}
    for r in corpus["postings"].filter(F.col("item_id") == f"{N.base}item/{number}").orderBy("pos").collect():
        found.setdefault(r["index"], []).append(r.value)
    return found


def test_unreadable_records(parsed):
    assert {(r.oaiuri, r.reason) for r in parsed[1].collect()} == {("no entity", "no entity"), ("broken", "unreadable record")}
    info = {r.item_id: r.nativeurl for r in harvest.extract_info(parsed[0], N).collect()}
    assert info[f"{N.base}item/1"] == "http://www.example.com/1" and len(info) == 10


def test_rejected_records(corpus):
    got = {(r.item_id.rsplit("/", 1)[1], r.reason) for r in corpus["rejects"].collect()}
    assert got == {
        ("4", "missing media license"), ("5", "no item supertype"), ("6", "several values"), ("7", "unknown context type"),
        ("8", "unsupported version"), ("9", "unknown relation"),
    }
    assert {r.item_id.rsplit("/", 1)[1] for r in corpus["postings"].select("item_id").distinct().collect()} == {"1", "2", "3"}


def test_fields_of_a_record(corpus):
    got = fields(corpus, 1)
    assert got["itemTitle"] == ["Cup"] and got["itemName"] == ["Mug"] and got["itemSuperType"] == ["Agent"]
    assert sorted(got["name"]) == ["Cup maker", "Erik & Son"]
    assert got["create_name"] == got["produce_name"] == ["Erik & Son"]
    assert got["fullName"] == got["produce_fullName"] == ["Erik Ek"]
    assert got["county"] == got["create_county"] == ["1"]
    assert got["fromTime"] == ["1540"] and got["toTime"] == got["produce_toTime"] == ["1562"]
    assert sorted(got["decade"]) == ["1540", "1550", "1560"] and got["create_century"] == ["1500"]
    assert got["contextType"] == ["produce"] and got["contextSuperType"] == ["create"] and got["contextLabel"] == ["Tillverka"]
    assert got["createdDate"] == ["2006-01-01"] and "buildDate" not in got
    assert got["timeInfoExists"] == ["j"] and got["geoDataExists"] == ["n"] and got["thumbnailExists"] == ["n"]
    assert sorted(got["relUri"]) == sorted(["http://other/1", "http://other/2", "http://other/3", f"{N.base}agent/7", f"{N.base}agent/8"])
    assert got["itemId"] == [f"{N.base}item/1"] and got["_htmlurl"] == ["http://www.example.com/1"]


def test_fields_by_version(corpus):
    old, late = fields(corpus, 2), fields(corpus, 3)
    assert old["contextType"] == ["odd"] and old["contextLabel"] == ["Udda"] and old["odd_placeName"] == ["Kil"]
    assert old["timeInfoExists"] == ["n"] and old["thumbnailExists"] == ["j"] and "contextSuperType" not in old
    assert late["itemMark"] == ["Round"] and late["byline"] == ["B"] and late["mediaLicense"] == ["http://l"]
    assert "http://viaf.org/viaf/9" in late["create_agent"] and "itemMark" not in old


def test_relations_and_problems(corpus):
    got = {(r.rel_type, r.target_uri) for r in corpus["relations"].filter(F.col("item_id") == f"{N.base}item/1").collect()}
    assert got == {
        ("sameAs", "http://other/1"), ("child", "http://other/2"), ("participated_in", "http://other/3"),
        ("author", f"{N.base}agent/7"), ("has_former_or_current_owner", f"{N.base}agent/8"),
    }
    messages = {r.message for r in corpus["problems"].collect()}
    assert any("buildDate" in m and "future" in m for m in messages)
    assert "not a date: fromTime (?)" in messages


def test_store_to_index(spark):
    """Faulty namespace, geometry, presentation, dates and free text on the way from the store to the index."""
    wrong = N.own.rstrip("#/") + "-old#"
    body = ('<v:itemTitle>Cup of Kil</v:itemTitle><v:createdDate>2006-01-01</v:createdDate>'
            f'<v:context><v:Context><v:contextType rdf:resource="{N.context_type}produce"/><v:contextSuperType rdf:resource="{N.context_supertype}create"/>'
            '<v:coordinates rdf:parseType="Literal"><gml:Point xmlns:gml="urn:g" srsName="EPSG:4326"><gml:pos>11 60</gml:pos></gml:Point></v:coordinates>'
            '</v:Context></v:context><v:presentation rdf:parseType="Literal"><p>shown</p></v:presentation>')
    good = record(1, "1.1", SUPER + body).replace(f'xmlns:v="{N.own}"', f'xmlns:v="{wrong}"').replace(f'resource="{N.own}Entity"', f'resource="{N.own}Entity"')
    rows = [(f"{N.base}item/1", "s1", good, None), (f"{N.base}item/2", "s1", "<broken", None), (f"{N.base}item/3", "s1", good, NOW)]
    content = spark.createDataFrame(rows, "uri string, serviceid string, xmldata string, deleted string").withColumns(
        {"deleted": F.col("deleted").cast("timestamp_ntz"), "added": F.lit("2010-05-05").cast("timestamp_ntz")})
    services = spark.createDataFrame([("s1", "2009-01-01")], "serviceid string, firstindexdate string").withColumn(
        "firstindexdate", F.col("firstindexdate").cast("timestamp_ntz"))
    got = extract.index_corpus(content, services, N, vocab(spark), F.lit(NOW).cast("timestamp_ntz"))
    assert [(r.item_id, r.reason) for r in got["rejects"].collect()] == [(f"{N.base}item/2", "unreadable record")]
    found = {}
    for r in got["postings"].collect():
        assert r.item_id == f"{N.base}item/1"
        found.setdefault(r["index"], []).append(r.value)
    assert found["_lon"] == ["11.0"] and found["_lat"] == ["60.0"] and found["_service"] == ["s1"]
    assert found["addedToIndexDate"] == ["2010-05-05"] and found["itemTitle"] == ["Cup of Kil"] and "Cup of Kil" in found["text"]
    assert base64.b64decode(found["_pres"][0]).decode() == "<p>shown</p>" and base64.b64decode(found["_rdf"][0]).decode() == good


def test_geometry(spark):
    rows = spark.createDataFrame([
        ("a", 1, '<gml:Point srsName="EPSG:4326"><gml:coordinates>18.072394042188,59.3270266104628</gml:coordinates></gml:Point>'),
        ("a", 2, '<gml:Point srsName="EPSG:4326"><gml:coordinates>1,2</gml:coordinates></gml:Point>'),
        ("b", 1, '<gml:Polygon srsName="http://x/epsg.xml#4326"><gml:posList>0 0 4 0 4 2 0 2 0 0</gml:posList></gml:Polygon>'),
        ("m", 1, '<gml:MultiPoint srsName="EPSG:4326"><gml:Point><gml:pos>0 0</gml:pos></gml:Point><gml:Point><gml:pos>4 2</gml:pos></gml:Point></gml:MultiPoint>'),
        ("l", 1, '<gml:LineString srsName="EPSG:4326"><gml:pos>0 0</gml:pos><gml:pos>4 0</gml:pos></gml:LineString>'),
        ("h", 1, '<gml:Polygon srsName="EPSG:4326"><gml:exterior><gml:LinearRing><gml:posList>0 0 4 0 4 4 0 4 0 0</gml:posList></gml:LinearRing></gml:exterior>'
                 '<gml:interior><gml:LinearRing><gml:posList>2 0 4 0 4 4 2 4 2 0</gml:posList></gml:LinearRing></gml:interior></gml:Polygon>'),
        ("c", 1, '<gml:Point srsName="EPSG:9999"><gml:pos>1 2</gml:pos></gml:Point>'), ("d", 1, "junk"),
    ], "item_id string, pos int, markup string")
    got = {r.item_id: (r.lon, r.lat) for r in extract.geo_points(rows).collect()}
    assert got["a"] == (18.072394042188, 59.3270266104628) and got["b"] == (2.0, 1.0)
    assert got["c"] == got["d"] == (None, None)
    assert got["m"] == (2.0, 1.0) and got["l"] == (2.0, 0.0) and got["h"] == (1.0, 2.0)


def test_namespaces(values):
    cases = {
        "http://xmlns.com/foaf/0.1/#whatever": "http://xmlns.com/foaf/0.1/", N.own + "whatever": N.own, "foo": "foo",
        N.base + "resurser/aut/geo/county/county#1": N.base + "resurser/aukt/geo/county#1",
    }
    assert values(list(cases), extract.fix_namespace(F.col("v"), N)) == list(cases.values())


# ---- harvest files and streams -----------------------------------------------------------

def envelope(ident, stamp="2010-01-02T03:04:05Z", payload=None, gone=False):
    status = ' status="deleted"' if gone else ""
    body = f"<metadata>{payload}</metadata>" if payload else ""
    return f"<record><header{status}><identifier>{ident}</identifier><datestamp>{stamp}</datestamp></header>{body}</record>"


def write_harvest(folder, name, *records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("<harvest><ListRecords>\n" + "\n".join(records) + "\n</ListRecords></harvest>", encoding="utf-8")


def test_harvest_scan(spark, tmp_path):
    write_harvest(tmp_path / "in", "a.xml", envelope("oai:1", payload="<v>a &amp; ö</v>"), envelope("oai:2", "some day", gone=True))
    got = harvest.harvest_scan(spark, str(tmp_path / "in"), F.lit(NOW).cast("timestamp")).orderBy("file_pos").collect()
    assert [(r.oaiuri, str(r.datestamp), r.is_deleted, r.payload_xml) for r in got] == [
        ("oai:1", "2010-01-02 03:04:05", False, "<v>a &amp; ö</v>"), ("oai:2", NOW, True, None)]
    assert got[0].problem is None and "some day" in got[1].problem


def test_envelopes_of_many_forms(spark, tmp_path):
    """Nested elements named record, prefixes, attributes, and namespaces declared outside of the payload."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(
        '<o:OAI xmlns:o="urn:oai" xmlns:r="urn:outer"><o:ListRecords xmlns:s="urn:s">\n'
        '<o:record><o:header><o:identifier>1</o:identifier><o:datestamp>2010-01-02</o:datestamp></o:header>'
        '<o:metadata xmlns:r="urn:inner"><r:v><record>x<record/></record></r:v></o:metadata></o:record>\n'
        '<o:record id="2" ><o:header status="deleted"><o:identifier>2</o:identifier><o:datestamp>2010-01-02</o:datestamp></o:header></o:record>'
        '<o:record><o:header><o:identifier>3</o:identifier><o:datestamp>2010-01-02</o:datestamp></o:header><o:metadata>'
        '<r:v xmlns:r="urn:own" a="1"/></o:metadata></o:record></o:ListRecords></o:OAI>', encoding="utf-8")
    rows = {r.oaiuri: r for r in harvest.harvest_scan(spark, str(tmp_path / "in"), run_ts()).collect()}
    assert set(rows) == {"1", "2", "3"} and rows["2"].is_deleted and rows["2"].payload_xml is None
    assert rows["1"].payload_xml == '<r:v xmlns:o="urn:oai" xmlns:s="urn:s" xmlns:r="urn:inner"><record>x<record/></record></r:v>'
    assert rows["3"].payload_xml == '<r:v xmlns:o="urn:oai" xmlns:s="urn:s" xmlns:r="urn:own" a="1"/>'
    for row in rows.values():
        assert row.payload_xml is None or ET.fromstring(row.payload_xml) is not None


def test_later_file_wins_whatever_its_size(spark, tmp_path):
    work, source = str(tmp_path / "work"), tmp_path / "in"
    jobs.write_version(spark.createDataFrame([], store.CONTENT), f"{work}/store", 0)
    write_harvest(source, "b-early.xml", envelope("1", payload="<v>early</v>"), envelope("2", payload="<v>stays</v>"))
    filler = [envelope(f"x{i}", payload="<v>" + "long " * 200 + "</v>") for i in range(300)]
    write_harvest(source, "a-late.xml", *filler, envelope("1", payload="<v>late</v>"))
    for place, name in enumerate(("b-early.xml", "a-late.xml")):
        os.utime(source / name, (1_700_000_000 + place, 1_700_000_000 + place))
    handler = jobs.upsert_batch(f"{work}/store", split, run_ts)
    jobs.ingest_stream(spark, str(source), f"{work}/state", [handler], run_ts).awaitTermination()
    got = {r.uri: r.xmldata for r in jobs.read_store(spark, f"{work}/store").collect()}
    assert len(got) == 302 and got["u/1"] == "<v>late</v>" and got["u/2"] == "<v>stays</v>"


def test_source_policies(spark, tmp_path):
    work, source = str(tmp_path / "work"), tmp_path / "in"
    services = spark.createDataFrame([("p", "persistent"), ("t", "transient"), ("n", "no")], "serviceid string, deleted_policy string")
    jobs.write_version(spark.createDataFrame([], store.CONTENT), f"{work}/store", 0)

    def by_name(batch):
        rows, headers = split(batch)
        service = F.substr("oaiuri", F.lit(1), F.lit(1))
        return rows.withColumn("serviceid", service), headers.withColumn("serviceid", service)

    handler = jobs.upsert_batch(f"{work}/store", by_name, run_ts, services=services)

    def run(name, *records):
        write_harvest(source, name, *records)
        jobs.ingest_stream(spark, str(source), f"{work}/state", [handler], run_ts).awaitTermination()
        return {r.uri[2:]: r.xmldata for r in jobs.read_store(spark, f"{work}/store").collect()}

    every = [envelope(f"{s}{i}", payload="<v>1</v>") for s in "ptn" for i in (1, 2)]
    assert run("1.xml", *every) == {f"{s}{i}": "<v>1</v>" for s in "ptn" for i in (1, 2)}
    after = run("2.xml", envelope("p1", gone=True), envelope("t1", payload="<v>2</v>"))
    assert after == {"p1": None, "p2": "<v>1</v>", "t1": "<v>2</v>", "t2": None, "n1": "<v>1</v>", "n2": "<v>1</v>"}
    with pytest.raises(Exception, match="delete headers"):
        run("3.xml", envelope("n1", gone=True), envelope("n2", payload="<v>3</v>"))
    assert {r.uri[2:]: r.xmldata for r in jobs.read_store(spark, f"{work}/store").collect()} == after


def test_unread_forms_are_rejected(spark):
    head = f'<rdf:RDF xmlns:rdf="{PUBLIC_NAMESPACES["rdf"]}" xmlns:v="{N.own}">'
    payloads = [("attribute", f'{head}<v:Entity rdf:about="u:1" v:itemTitle="T"/></rdf:RDF>'),
                ("resource", f'{head}<v:Entity rdf:about="u:2"><v:context rdf:parseType="Resource"><v:name>n</v:name></v:context></v:Entity></rdf:RDF>'),
                ("fine", f'{head}<v:Entity rdf:about="u:3"><v:itemTitle>T</v:itemTitle></v:Entity></rdf:RDF>')]
    rows = spark.createDataFrame([(i, p, False) for i, p in payloads], "oaiuri string, payload_xml string, is_deleted boolean")
    triples, rejects = harvest.record_triples(rows, N)
    assert {(r.oaiuri, r.reason) for r in rejects.collect()} == {("attribute", "unread form"), ("resource", "unread form")}
    assert {r.item_id for r in triples.collect()} == {"u:3"}


def split(batch):
    rows = batch.withColumns({"uri": F.concat(F.lit("u/"), "oaiuri"), "serviceid": F.lit("s"), "nativeurl": F.lit(None).cast("string"),
                              "xmldata": F.col("payload_xml")})
    return rows.filter(~F.col("is_deleted")), rows.filter("is_deleted")


def run_ts():
    return F.lit(NOW).cast("timestamp_ntz")


def test_incremental_harvests(spark, tmp_path):
    work, source = str(tmp_path / "work"), tmp_path / "in"
    empty = spark.createDataFrame([], store.CONTENT)
    jobs.write_version(empty, f"{work}/store", 0)
    handler = jobs.upsert_batch(f"{work}/store", split, run_ts)

    def run():
        jobs.ingest_stream(spark, str(source), f"{work}/state", [handler], run_ts).awaitTermination()
        return {r.uri: r.xmldata for r in jobs.read_store(spark, f"{work}/store").collect()}

    write_harvest(source, "1.xml", envelope("1", payload="<v>one</v>"), envelope("2", payload="<v>two</v>"))
    assert run() == {"u/1": "<v>one</v>", "u/2": "<v>two</v>"}
    # an older datestamp that arrives later still wins
    write_harvest(source, "2.xml", envelope("1", "1999-01-01T00:00:00Z", "<v>late</v>"), envelope("2", gone=True))
    assert run() == {"u/1": "<v>late</v>", "u/2": None}
    assert run() == {"u/1": "<v>late</v>", "u/2": None}
    # a replayed batch does not change the result
    replay = harvest.harvest_scan(spark, str(source / "2.xml"), run_ts())
    handler(replay, 1)
    assert {r.uri: r.xmldata for r in jobs.read_store(spark, f"{work}/store").collect()} == {"u/1": "<v>late</v>", "u/2": None}
    jobs.compact(spark, f"{work}/store", f"{work}/compact")
    assert jobs.read_store(spark, f"{work}/compact").count() == 2


def test_newest_datestamp_option(spark, tmp_path):
    path = str(tmp_path / "store")
    jobs.write_version(spark.createDataFrame([], store.CONTENT), path, 0)
    write_harvest(tmp_path / "in", "1.xml", envelope("1", "2012-01-01", "<v>new</v>"), envelope("1", "2011-01-01", "<v>old</v>"))
    rows = harvest.harvest_scan(spark, str(tmp_path / "in"), run_ts())
    jobs.upsert_batch(path, split, run_ts, order_by="datestamp")(rows, 0)
    assert jobs.read_store(spark, path).first().xmldata == "<v>new</v>"


def test_postings_follow_moves_and_deletes(spark, tmp_path):
    path = str(tmp_path / "postings")
    schema = "item_id string, index string, pos int, value string, serviceid string"
    outputs.replace_postings(spark.createDataFrame(
        [("a", "itemType", 0, "x", "s1"), ("b", "itemType", 0, "y", "s1"), ("c", "itemType", 0, "z", "s2"), ("d", "itemType", 0, "w", "s3")],
        schema), path)
    changed = spark.createDataFrame([("a", "s2"), ("c", "s2"), ("d", "s3")], "uri string, serviceid string")
    fresh = spark.createDataFrame([("a", "itemType", 0, "moved", "s2")], schema)
    outputs.update_postings(fresh, changed, path, 1)

    def held(where):
        return {(r.item_id, r.value, r.serviceid) for r in outputs.read_postings(spark, where).collect()}

    assert held(path) == {("a", "moved", "s2"), ("b", "y", "s1")}
    outputs.update_postings(fresh, changed, path, 1)  # a repeated batch replaces its own version
    assert held(path) == {("a", "moved", "s2"), ("b", "y", "s1")}
    outputs.replace_postings(spark.createDataFrame([("e", "itemType", 0, "e", "a#b/c:1")], schema), path, 2)
    outputs.drop_postings(spark.createDataFrame([("s1",)], "serviceid string"), path, 3)
    assert held(path) == {("a", "moved", "s2"), ("e", "e", "a#b/c:1")}
    outputs.compact_postings(spark, path, path + "-compact")
    assert held(path + "-compact") == held(path)
    outputs.drop_postings(spark.createDataFrame([("a#b/c:1",)], "serviceid string"), path + "-compact", 1)
    assert held(path + "-compact") == {("a", "moved", "s2")}


def test_written_postings_hold_search_forms_and_row_marks(spark, tmp_path, capsys):
    path = str(tmp_path / "postings")
    schema = "item_id string, index string, pos int, value string, serviceid string"
    many = [(f"i{n}", "itemType", 0, "Foto" if n % 2 else "Karta", f"s{n % 3}") for n in range(40_000)]
    words = [("i1", "text", 0, "The RED house", "s1"), ("i2", "text", 1, "", "s2"), ("i3", "ctx_text", 0, "red sea", "s0")]
    years = [("i1", "create_fromTime", 0, "1850", "s1"), ("i2", "create_fromTime", 0, "bad", "s2"), ("i4", "_lon", 0, "17.5", "s1"), ("i5", "itemType", 0, None, "s2")]
    plain = spark.createDataFrame(many + words + years, schema)
    outputs.replace_postings(plain, path)
    read = outputs.read_postings(spark, path)
    for index, op, value in (
        ("itemType", "=", "FOTO"), ("itemType", "<>", "foto"), ("itemType", "=", "kar*"), ("itemType", ">", "foto"), ("itemType", "exact", "Foto"),
        ("text", "=", "red"), ("text", "exact", "red house"), ("text", "any", "sea house"), ("text", "all", "house the"), ("text", "=", "h?use"),
        ("ctx_text", "=", "sea"), ("create_fromTime", "<", "1900"), ("_lon", ">=", "17.5"), ("text", "=", ""),
    ):
        got, want = (
            {r.item_id for r in filters.match(table, index, op, value).collect()} for table in (read, plain))
        assert got == want, (index, op, value)
    for indexes in (["itemType", "text"], ["ctx_text", "create_fromTime"]):
        both = [{tuple(r) for r in aggregate.facet(table, None, indexes).collect()} for table in (read, plain)]
        assert both[0] == both[1]
    assert search.bm25(read, ["red"], 3).collect() == search.bm25(plain, ["red"], 3).collect()

    # rows of many blocks and files are taken back one by one, without a join by item when they are read
    changed = spark.createDataFrame([(f"i{n}",) for n in range(0, 40_000, 7)], "uri string")
    outputs.update_postings(spark.createDataFrame([("i0", "itemType", 0, "new", "s9")], schema), changed, path, 1)
    left = {r.item_id for r in outputs.read_postings(spark, path).filter("index = 'itemType'").collect()}
    assert left == {f"i{n}" for n in range(40_000) if n % 7} | {"i0"}
    found = outputs.read_postings(spark, path)
    found.filter(filters.condition("itemType", "=", "FOTO", ready=True)).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(term,foto)" in plan
    assert not any("keys [" in line and ("item_id" in line or "serviceid" in line) for line in plan.splitlines())
    filters.match(read, "create_fromTime", "<", "1900").explain("formatted")
    assert "LessThan(number,1900.0)" in capsys.readouterr().out
    filters.match(read, "text", "=", "red").explain("formatted")
    assert "regexp_extract_all" not in capsys.readouterr().out


def test_versions_repeated_out_of_order_and_unfinished(spark, tmp_path):
    path = str(tmp_path / "postings")
    schema = "item_id string, index string, pos int, value string, serviceid string"

    def version(number, value, *items):
        fresh = spark.createDataFrame([(i, "itemType", 0, value, "s") for i in items], schema)
        outputs.update_postings(fresh, spark.createDataFrame([(i,) for i in items], "uri string"), path, number)

    def held():
        return sorted((r.item_id, r.value) for r in outputs.read_postings(spark, path).collect())

    version(0, "zero", "a", "b", "c")
    version(1, "one", "a", "b")
    version(2, "two", "b")
    want = [("a", "one"), ("b", "two"), ("c", "zero")]
    assert held() == want
    version(1, "one", "a", "b")  # a repeated run gets new files, and the later version still takes its row back
    assert held() == want
    version(0, "zero", "a", "b", "c")
    assert held() == want
    rows = spark.createDataFrame([("a", "itemType", 0, "half", "s")], schema)
    outputs.terms.with_forms(outputs._rows(rows, "p")).write.parquet(f"{path}/version=3")  # a run that failed before its note
    assert held() == want
    outputs.replace_postings(rows.limit(0), path, 3)
    assert held() == want


def test_sitemap_documents(spark):
    content = spark.createDataFrame([(f"u{i}", f'"http://x/{i}"', None) for i in range(5)], "uri string, nativeurl string, deleted string").select(
        "uri", "nativeurl", F.col("deleted").cast("timestamp_ntz").alias("deleted"), run_ts().alias("changed"))
    urls, index = outputs.sitemap(content, ["http://x/"], size=2)
    assert sorted((r.batch, r.n_urls) for r in index.collect()) == [(1, 2), (2, 2), (3, 1)]
    documents = {r.batch: r.document for r in outputs.sitemap_documents(urls).collect()}
    assert documents[3].count("<url>") == 1 and "<![CDATA[http://x/4]]>" in documents[3] and "2020-01-01" in documents[1]


def test_log_folder(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.createDataFrame([("s", 0, "2019-12-30 00:00:00", "new"), ("s", 1, "2019-12-01 00:00:00", "old")],
                                "serviceid string, eventtype long, eventts string, message string")
    outputs.append_log(log.withColumn("eventts", F.col("eventts").cast("timestamp_ntz")), path)
    assert [r.message for r in outputs.read_log(spark, path, run_ts()).collect()] == ["new"]


def test_vocabulary_files(spark, tmp_path):
    for name, label in (("1.rdf", "first"), ("2.rdf", "second")):
        (tmp_path / name).write_text(
            f'<rdf:RDF xmlns:rdf="urn:r" xmlns="urn:v"><Term rdf:ID="t"><name>{label}</name></Term></rdf:RDF>', encoding="utf-8")
    entries = harvest.read_vocab_files(spark, {"1.1": [str(tmp_path / "1.rdf"), str(tmp_path / "2.rdf")]}, "Term", "name", "http://b")
    assert [tuple(r) for r in harvest.load_vocab(entries).collect()] == [("1.1", "http://b#t", "second")]


def test_validation(spark, tmp_path):
    (tmp_path / "r.xsd").write_text("""<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="record"><xs:complexType>
      <xs:sequence><xs:element name="year" type="xs:integer"/></xs:sequence></xs:complexType></xs:element></xs:schema>""")
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.xml").write_text(
        "<l><record><year>1900</year></record><record><year>old</year></record><record><age>3</age></record></l>")
    from recordloom.operators.aggregate import message_report

    messages = harvest.validation_messages(spark, str(source), "record", str(tmp_path / "r.xsd"), "year string")
    assert [tuple(r) for r in message_report(messages).collect()] == [("record does not match the schema", 2, 2, 1)]


def test_a_run_of_many_batches_ends_once(spark, tmp_path):
    """Silent source: rows stay while a batch of the run mentions them, and go when the run ends without them."""
    work, source = str(tmp_path / "work"), tmp_path / "in"
    services = spark.createDataFrame([("t", "transient"), ("p", "persistent"), ("u", "transient")], "serviceid string, deleted_policy string")
    jobs.write_version(spark.createDataFrame([], store.CONTENT), f"{work}/store", 0)

    def by_name(batch):
        rows, headers = split(batch)
        service = F.substr("oaiuri", F.lit(1), F.lit(1))
        return rows.withColumn("serviceid", service), headers.withColumn("serviceid", service)

    clock = ["2024-05-01 00:00:00"]
    handler = jobs.upsert_batch(f"{work}/store", by_name, lambda: F.lit(clock[0]).cast("timestamp_ntz"), services=services)

    def files(place, *batches):
        for k, records in enumerate(batches):
            write_harvest(source, f"{place}-{k}.xml", *records)
            os.utime(source / f"{place}-{k}.xml", (1_700_000_000 + 10 * place + k,) * 2)

    def run():
        jobs.ingest_stream(spark, str(source), f"{work}/state", [handler], run_ts, max_files=1).awaitTermination()
        return {r.uri[2:]: r for r in jobs.read_store(spark, f"{work}/store").collect()}

    def alive(rows):
        return {name for name, r in rows.items() if r.deleted is None}

    files(1, [envelope("t1"), envelope("t2"), envelope("p1"), envelope("u1")], [envelope("t3"), envelope("t4")])
    assert alive(run()) == {"t1", "t2", "t3", "t4", "p1", "u1"}
    clock[0] = "2024-06-01 00:00:00"
    files(2, [envelope("t1")], [envelope("t3"), envelope("p2")], [envelope("t5")])
    rows = run()
    assert alive(rows) == {"t1", "t3", "t5", "p1", "p2", "u1"}  # u took no part in the run
    assert str(rows["t2"].deleted) == str(rows["t2"].changed) == clock[0] and rows["t2"].xmldata is None
    clock[0] = "2024-07-01 00:00:00"
    assert run() == rows  # nothing came, nothing ends
    files(3, [envelope("t1")], [envelope("t2")])
    rows = run()
    assert alive(rows) == {"t1", "t2", "p1", "p2", "u1"}
    assert (str(rows["t4"].deleted), str(rows["t4"].changed)) == ("2024-06-01 00:00:00", clock[0])  # an old tombstone keeps its date
    assert [(r.first, r.last, r.closing) for r in jobs.runs(spark, f"{work}/store").orderBy("closing").collect()] == [(1, 3, 4), (5, 9, 10), (11, 13, 14)]


def test_a_run_that_fails_goes_on_at_the_next_start(spark, tmp_path):
    work, source = str(tmp_path / "work"), tmp_path / "in"
    services = spark.createDataFrame([("s", "transient")], "serviceid string, deleted_policy string")
    jobs.write_version(spark.createDataFrame([], store.CONTENT), f"{work}/store", 0)
    broken = [False]

    def fails(batch, batch_id):
        if broken[0] and batch_id == 2:
            raise ValueError("power cut")

    handler = jobs.upsert_batch(f"{work}/store", split, run_ts, services=services)

    def run():
        jobs.ingest_stream(spark, str(source), f"{work}/state", [handler, fails], run_ts, max_files=1).awaitTermination()

    def alive():
        return {r.uri for r in store.live_rows(jobs.read_store(spark, f"{work}/store")).collect()}

    write_harvest(source, "1.xml", envelope("1"), envelope("2"), envelope("3"))
    run()
    for k in (1, 2):
        write_harvest(source, f"2-{k}.xml", envelope(str(k)))
        os.utime(source / f"2-{k}.xml", (1_900_000_000 + k,) * 2)
    broken[0] = True
    with pytest.raises(Exception, match="power cut"):
        run()
    assert alive() == {"u/1", "u/2", "u/3"}  # the run is open: nothing is missing yet
    broken[0] = False
    run()
    assert alive() == {"u/1", "u/2"}


def test_a_batch_does_not_read_old_payloads(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("u/1", "1", "s", "<v/>", None, None, None, None, 0, None)]
    jobs.write_version(spark.createDataFrame(rows, store.CONTENT), path, 0)
    records = spark.createDataFrame([("u/1", "1", "s", "<w/>", None, None, 5)], "uri string, oaiuri string, serviceid string, xmldata string, "
                                    "datestamp timestamp_ntz, nativeurl string, file_pos bigint")
    changes = jobs.changed_rows(jobs._versions(spark, path), records, records.limit(0), run_ts())
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation" in line and "parquet" in line]
    assert changes.first().xmldata == "<w/>" and scans
    read = changes._jdf.queryExecution().executedPlan().toString()
    assert all("xmldata" not in line for line in read.splitlines() if "ReadSchema" in line)


# ---- cutting of harvest files ------------------------------------------------------------

def cut_texts(text, state=record_cut.TEXT):
    found, after = record_cut.marks(text, state)
    depth, begin, out = 0, None, []
    for at, step in found:
        begin = at if step > 0 and not depth else begin
        depth = max(0, depth + step)
        if step < 0 and not depth and begin is not None:
            out.append(text[begin:at])
            begin = None
    return out, after, depth


def test_marks_of_records():
    cases = {
        "<record>a</record >x<record>b</record>": ["<record>a</record >", "<record>b</record>"],
        "<!-- <record> --><record>a</record>": ["<record>a</record>"],
        "<record><![CDATA[</record>]]></record><record/>": ["<record><![CDATA[</record>]]></record>", "<record/>"],
        "<record a='/>' b=\"</record>\">x</record>": ["<record a='/>' b=\"</record>\">x</record>"],
        "<?x <record> ?><a:record\n k='1' />": ["<a:record\n k='1' />"],
        "<recordList><record><records/><record>1</record></record></recordList>": ["<record><records/><record>1</record></record>"],
        "</record></record><record>a</record>": ["<record>a</record>"],
    }
    for text, want in cases.items():
        assert cut_texts(text) == (want, record_cut.TEXT, 0)
    assert cut_texts("<record>a<!-- x")[1:] == (record_cut.COMMENT, 1)
    assert cut_texts("<record a='x")[1:] == (record_cut.SINGLE, 1)


HARD = [
    lambda i: envelope(i, payload="<v>plain</v>"),
    lambda i: envelope(i, payload="<v>1</v>").replace("</record>", "</record >"),
    lambda i: envelope(i, payload="<v><!-- a <record> in a comment --></v>"),
    lambda i: "<!-- <record>" + envelope("gone") + "-->" + envelope(i, payload="<v/>"),
    lambda i: envelope(i, payload="<v><![CDATA[</record></metadata><record>]]></v>"),
    lambda i: envelope(i, payload="<v a='</record>' b=\"<record>\">q</v>".replace("<record>", "&lt;record>").replace("</record>", "/record>")),
    lambda i: envelope(i, payload="<v><record>in<record/></record></v>").replace("<record><header", "<record\n k='>record>' ><header", 1),
    lambda i: envelope(i, payload="<v>" + "long record> " * 400 + "</v>"),
]


@pytest.mark.parametrize("split_bytes", ["64m", "900b"])
def test_no_record_is_lost(spark, tmp_path, split_bytes):
    """Whatever the blocks are, all records of all files come, in order; broken files cost no neighbour."""
    source, want = tmp_path / "in", []
    for name in ("a", "c", "e"):
        records = [HARD[k % len(HARD)](f"{name}{k}") for k in range(24)]
        want += [f"{name}{k}" for k in range(24)]
        write_harvest(source, f"{name}.xml", *records)
    for name, end in (("b", "<record><header><identifier>half</identifier>"), ("d", "<!-- never closed <record> </record>")):
        write_harvest(source, f"{name}.xml", *[envelope(f"{name}{k}") for k in range(3)], end)
        want += [f"{name}{k}" for k in range(3)]
    for place, name in enumerate("abcde"):
        os.utime(source / f"{name}.xml", (1_700_000_000 + place,) * 2)
    want = sorted(want, key=lambda x: (x[0], int(x[1:])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = harvest.harvest_scan(spark, str(source), run_ts()).orderBy("file_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    good = [r for r in rows if r.oaiuri is not None]
    assert [r.oaiuri for r in good] == want and all(r.problem is None for r in good)
    assert {r.problem for r in rows if r.oaiuri is None} == {"record without an end", "comment without an end"} and len(rows) == len(good) + 2
    payloads = {r.oaiuri: r.payload_xml for r in good}
    assert payloads["a4"] == "<v><![CDATA[</record></metadata><record>]]></v>" and payloads["a1"] == "<v>1</v>"
    assert payloads["a6"] == "<v><record>in<record/></record></v>" and payloads["c7"].count("long") == 400


def test_blocks_are_cut_piece_by_piece():
    """Records leave a block before its end is read, and only the open one is held."""
    pieces = ["<x><record>" + "a" * 5_000_000 + "</", "<record>b</", "<record>c"]
    read = []

    def batches():
        for piece in pieces:
            read.append(piece)
            yield pa.RecordBatch.from_pylist([{
                "value": piece, "file": "f", "block": 0, "modified": 1, "state": record_cut.TEXT, "depth": 0, "start": None, "first": True,
                "last": None}], schema=pa.schema([
                    ("value", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("modified", pa.int64()), ("state", pa.int64()),
                    ("depth", pa.int64()), ("start", pa.int64()), ("first", pa.bool_()), ("last", pa.string())]))

    found = record_cut._cutter("record>")(batches())
    rows = next(found).to_pylist()
    assert len(read) == 1 and [r["kind"] for r in rows] == ["head", "record"] and rows[0]["text"] == "<x>"
    rest = [r for batch in found for r in batch.to_pylist()]
    assert [(r["kind"], r["text"]) for r in rest] == [("record", "<record>b</record>"), ("part", "<record>crecord>")]
    assert rest[0]["place"] == len(pieces[0]) + len("record>")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_move_no_values(spark):
    vocab = spark.createDataFrame([("1.0", "u#a", "A")], "version string, uri string, label string")
    values = spark.createDataFrame(
        [("u#a", "uri", True, 0), (None, "uri", True, 0), ("u#a", "literal", True, 0), ("u#a", "uri", True, 1)],
        "value string, object_kind string, lookup boolean, rules int").repartition(4)
    looked = extract.lookup_uri(values, vocab, Names())
    assert "SortMergeJoin" not in _plan(looked) and "BroadcastHashJoin" in _plan(looked)
    assert sorted((r.value or "", r.rules) for r in looked.collect()) == [("", 0), ("A", 0), ("u#a", 0), ("u#a", 1)]


def test_barred_records_are_joined_not_gathered(spark):
    names = Names()
    gate = names.full("itemForIndexing")
    rows = [("a", "", gate, " n "), ("a", "", "p", "x"), ("b", "", gate, "y"), ("b", "", "p", "x"), (None, "", "p", "x"), ("c", "v", gate, "n")]
    triples = spark.createDataFrame(rows, "item_id string, via string, predicate string, object string")
    left = extract.indexable(triples, names)
    assert "Window" not in _plan(left) and left.columns == triples.columns
    assert sorted(r.item_id or "" for r in left.collect()) == ["", "b", "b", "c"]
    unknown = spark.createDataFrame([(None, "", gate, "n"), (None, "", "p", "x"), ("d", "", "p", "x")], triples.schema)
    assert [r.item_id for r in extract.indexable(unknown, names).collect()] == ["d"]
