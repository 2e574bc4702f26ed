"""Time the registered queries: one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_QUERIES (comma separated prefixes)
a selection; without it the headline queries run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recordloom.plans import all_queries  # noqa: E402
from recordloom.session import build_session  # noqa: E402

HEADLINE = [
    "f01_term_eq", "f07_exact_phrase", "f09_bool_combine", "a01_facet", "a03_terms", "a04_statistic", "w01_sorted_page",
    "w02_relevance_topk", "m01_upsert", "s04_change_feed", "m07_run_counters", "p01_extract_fields", "p10_relation_extract",
    "s02_record_triples", "g01_direct_relations", "g02_sameas_sources", "g06_resolve", "s08_sitemap_sink",
    "c06_expand_interval", "c12_stem_tokens", "t02_streaming_upsert",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries = all_queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = [n for n in queries if n.startswith(tuple(wanted.split(",")))] if wanted else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
        },
    )
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
