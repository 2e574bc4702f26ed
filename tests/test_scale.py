"""What keeps tasks and shuffles small on large tables, beside the same rows as before."""

import datetime
import glob
import random
from collections import defaultdict

from pyspark.sql import functions as F

from recordloom.operators import aggregate, extract, filters
from recordloom.plans import extract_queries, stream_queries
from recordloom.plans.bindings import NAMES


def test_unique_values_sorts_bounded_parts(spark, monkeypatch):
    """F11"""
    data = [(f"i{n % 90}", "itemType", n, f"v{n % 7}") for n in range(300)] + [(f"i{n}", "fromTime", 0, str(n)) for n in range(90)]
    postings = spark.createDataFrame(data + [(None, "itemType", 0, "lost")], "item_id string, index string, pos int, value string")
    monkeypatch.setattr(aggregate, "JOIN_ROWS", 50)
    got = aggregate.unique_values(postings, filters.match(postings, "fromTime", "<", "5"), ["itemType"])
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert ", 7), REPARTITION_BY_NUM" in plan
    items = {f"i{n}" for n in range(5)}
    assert [tuple(r) for r in got.collect()] == [("itemType", len({v for i, x, _, v in data if x == "itemType" and i in items}))]


def test_single_values_are_checked_by_node(spark, monkeypatch):
    """F12"""
    rng = random.Random(3)
    singles = [r for r in extract.field_rules(spark, NAMES).collect() if r.single]
    fields = sorted({(r.via, r.predicate) for r in singles})
    rows = []
    for n in range(400):
        for via, predicate in rng.sample(fields, rng.randint(1, 6)):
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                kind = rng.choice(["literal"] * 12 + ["uri", "blank", None])
                rows.append((f"i{n // 3}" if n > 4 else None, f"s{n % 2}", via, predicate, "o", kind, 0, rng.choice([0, 1, 4])))
    rows += [("x", None, *fields[0], "o", kind, 0, 4) for kind in ("literal", "blank")] + [("x", None, *fields[1], "o", "uri", 0, 4)] * 3
    counts, nodes = defaultdict(int), set()
    for item, subject, via, predicate, _, kind, _, rules in rows:
        for r in singles:
            if (r.via, r.predicate) == (via, predicate) and r.since <= rules:
                counts[item, subject, via, predicate] += 1
                if kind == "blank":
                    nodes.add((item, subject, via, predicate))
    want = {(k[0], "value is a node" if k in nodes else "several values") for k, n in counts.items() if n > 1 or k in nodes}
    kept, written = [], extract.written
    monkeypatch.setattr(extract, "written", lambda df: kept.append(df) or written(df))
    triples = spark.createDataFrame(
        rows, "item_id string, subject string, via string, predicate string, object string, object_kind string, pos int, rules int").repartition(5)
    got = extract.single_value_check(triples, NAMES).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    plan = kept[0]._jdf.queryExecution().toString()  # one row per node is shuffled, not one per statement
    assert "keys=[item_id" in plan and "via" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)


def test_batches_of_several_files(spark, tmp_path, monkeypatch):
    """F13"""
    kinds, at = ["view", "click", "error", "purchase"], datetime.datetime(2024, 1, 1)
    rng = random.Random(1)
    rows = [(n, at + datetime.timedelta(minutes=100 * n), rng.randint(0, 9), rng.choice(kinds), 1.0, f'{{"k": {rng.randint(0, 5)}}}') for n in range(400)]
    folder = str(tmp_path / "tables")
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").repartition(3).write.parquet(
        f"{folder}/events.parquet")
    spark.createDataFrame([(1,), (2,)], "s_suppkey bigint").write.parquet(f"{folder}/supplier.parquet")
    # a stream of the whole table reads files of that name only
    found = {}
    for each in (10**9, 30):
        work = str(tmp_path / f"work{each}")
        monkeypatch.setattr(stream_queries, "work_folder", lambda spark, name: work)
        monkeypatch.setattr(stream_queries, "_FILE_EVENTS", each)
        found[each] = sorted(tuple(map(str, r)) for r in stream_queries.synced_index(spark, folder).collect())
        assert len(glob.glob(f"{work}/spool/*.parquet")) == (4 if each > 30 else 12)
        assert {f.rpartition("=")[2] for f in glob.glob(f"{work}/store/version=*")} == {"0", "1", "3", "5", "7", "8"}  # four batches and the run's end
    assert found[30] == found[10**9] and found[30]


def test_rules_are_found_once_per_record(spark, tmp_path, monkeypatch):
    """F15"""
    day, folder = datetime.datetime(1996, 1, 2), str(tmp_path)
    spark.createDataFrame(
        [(n, 1, "FOP"[n % 3], day, "2-HIGH") for n in range(14)],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        [(n, 4, 60, 3, "A", day) for n in range(14)],
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_shipdate timestamp").write.parquet(
        f"{folder}/lineitem.parquet")
    asked, versioned = [], extract.versioned
    monkeypatch.setattr(extract, "versioned", lambda rows, names: asked.append(rows.columns) or versioned(rows, names))
    got = extract_queries._usable(spark, folder)
    assert asked and not any("predicate" in columns for columns in asked)
    want = versioned(extract_queries.all_triples(spark, folder), NAMES).filter(F.col("rules").isNotNull())
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and got.count() > 200


def test_versions_below_one(values):
    cases = {"0.97": 0, "0.0": 0, "0.1.2.": 0, "00.5": 0, "0.": 0, "0": None, "0.x": None, "0.97 ": None, "1.0": 0, "1.1.0": 1, "2.0": None}
    assert values(list(cases), extract._rule_place(F.col("v"))) == list(cases.values())
