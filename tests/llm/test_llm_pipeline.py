"""The pipeline stage by stage, and the package without it."""

import os
import re
import subprocess
import sys

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        folder = str(tmp_path / re.sub(r"\W", "_", name))
        docs.write.parquet(folder)
        docs = spark.read.parquet(folder)
        kept.append(docs)
        assert stage is corpus_pipeline.STAGES[-1][1] or docs.columns == columns
    good, single, clean, mixed, ids = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    stayed = {r.doc_id for r in good.collect()}
    assert sum((i in stayed) == (q == 1) for i, q in labels.items()) > 0.95 * len(labels)

    def runs(text):
        w = tuple(re.findall(r"\w+", text.lower()))
        return {w[k:k + 5] for k in range(max(1, len(w) - 4))}

    left = [runs(r.text) for r in single.collect()]
    by_run = {}
    for i, s in enumerate(left):
        for x in s:
            by_run.setdefault(x, []).append(i)
    for i, s in enumerate(left):
        for j in {j for x in s for j in by_run[x] if j < i}:
            assert len(s & left[j]) < 0.8 * len(s | left[j])
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(t in r.text for r in clean.collect() for t in items)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    assert ids.count() == mixed.count()
    total = ids.agg({"n_tokens": "sum"}).first()[0]
    assert max(r.start + r.n_tokens for r in ids.collect()) == total


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['recordloom.llm'] = None; import __spark_entry__ as e; names = e.queries(); " \
           "assert 'a01_facet' in names and not any(n.startswith('op') for n in names) and 'pipeline' not in names; e.oracle_sql()"
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
