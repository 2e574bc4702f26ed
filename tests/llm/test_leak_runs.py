"""Long runs of one kind of token: the expression that finds tokens must not take a frame of the stack for each round."""

from pyspark.sql import functions as F

from recordloom.llm import template_leaks

PASSAGE = "how many litres of water does the old pump move from the lower to the upper basin in one hour"


def test_long_runs_of_names_and_numbers(spark):
    texts = ["Abc " * 30_000, "12," * 30_000, "Abc def " * 30_000]
    rows = [(i, f"{text} . {PASSAGE} . {text}") for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {r.doc_id: r.n for r in docs.select("doc_id", F.size(template_leaks.filled(F.col("text"))).alias("n")).collect()}
    words = len(PASSAGE.split())
    assert sizes == {0: 2 + words, 1: 2 + words, 2: 120_000 + words}
    items = spark.createDataFrame([(7, PASSAGE), (8, "a passage that no text of these holds in any place of it")], "item_id long, text string")
    got = template_leaks.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(0, 7, 1.0), (1, 7, 1.0), (2, 7, 1.0)]
