"""Every operator on empty tables, nulls, empty and very long texts, repeated rows and clashing columns."""

import pytest

from recordloom.llm import (
    compact_windows, forest_join, language_backoff, permutation_index, pfor_files, quality_trees, separator_scan, site_templates,
    temperature_mix, template_leaks,
)
from recordloom.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
TEXT = "The quick brown fox jumps over the lazy dog while seven sleepy cats watch from the warm window sill above"

# names that the operators use themselves
CLASHES = "key string, rep string, block int, _leak int, text_key int, window int, k1 int, count int, n int, share int, epoch int, labels int"
SHAPE = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"


def rows(*docs):
    return [(*d, "x", "y", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for d in docs]


DOCS = rows(
    (1, TEXT, "en", "a", 1), (1, TEXT, "en", "a", 1), (2, TEXT, "en", None, 1), (3, None, None, "a", None), (4, "", "en", "b", 0),
    (None, TEXT, "en", "a", 1), (None, None, None, None, None), (5, LONG, "en", "b", 2), (6, "!!! 123 ...", "de", "b", 3), (7, "one", "de", "c", 3),
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, TEXT, 1), (1, TEXT, 2), (None, None, 3), (2, "", 4), (3, "too short", 5)], "item_id bigint, text string, key int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (7, 0), (7, 1), (None, 1), (5, None), (99, 1)], "doc_id bigint, quality int")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ngram_join(docs, nothing):
    by_id = {r.doc_id: r for r in forest_join.ngram_join(docs).collect()}
    got = forest_join.ngram_join(docs)
    assert got.count() == len(DOCS) and got.columns == ["doc_id", "class_id", "copy_of", "n_copies", "n_links"]
    assert (by_id[2].class_id, by_id[2].copy_of, by_id[2].n_copies, by_id[2].n_links) == (1, 1, 3, 0)
    assert [by_id[i].class_id for i in (3, 4, 5, 6, 7)] == [3, 4, 5, 6, 7]
    assert by_id[None].class_id is None and by_id[None].n_links == 0
    kept = forest_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "None", "None"]
    assert forest_join.ngram_join(nothing).count() == 0 and forest_join.keep_one(nothing).count() == 0


def test_language(docs, nothing):
    got = language_backoff.identify(docs, language_backoff.fit(docs)).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out is not None
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 6)} == {"und"}
    untaught = language_backoff.fit(nothing)
    assert language_backoff.identify(nothing, untaught).count() == 0
    assert {r.lang_pred for r in language_backoff.identify(docs, untaught).collect()} == {"und"}


def test_quality(spark, docs, nothing, labels):
    trees = quality_trees.fit(docs, labels)
    got = quality_trees.score(docs, trees).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality_trees.keep_good(docs, trees).columns == docs.columns
    none = quality_trees.fit(docs, labels.limit(0))
    assert {r.score for r in quality_trees.score(docs, none).collect()} == {0.5}
    one = quality_trees.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int"))
    assert all(r.score > 0.99 for r in quality_trees.score(docs, one).collect())
    assert quality_trees.keep_good(nothing, quality_trees.fit(nothing, labels)).count() == 0


def test_token_files(docs, nothing):
    got = sorted(pfor_files.token_files(docs, tokenizer_path()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.n_tokens for r in got if r.doc_id in (3, 4)] == [1, 1]
    assert pfor_files.token_files(nothing, tokenizer_path()).count() == 0


def test_token_counts(docs, nothing):
    got = separator_scan.count_tokens(docs, tokenizer_path()).collect()
    assert len(got) == len(DOCS)
    ids = {r.doc_id: r.n_tokens for r in pfor_files.token_files(docs, tokenizer_path()).collect()}
    assert all(r.n_tokens + 1 == ids[r.doc_id] for r in got if r.doc_id is not None)
    assert separator_scan.count_tokens(nothing, tokenizer_path()).count() == 0


def test_passages(spark, docs, nothing):
    assert compact_windows.repeated_passages(nothing).count() == 0
    assert compact_windows.repeated_passages(docs).count() == 0  # the shared text is shorter than a passage
    two = spark.createDataFrame([(1, LONG), (2, LONG), (3, None), (None, LONG), (2, LONG)], "doc_id bigint, text string")
    got = compact_windows.repeated_passages(two).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(1, 2), (2, 1)}
    assert all(r.similarity == 1.0 for r in got)


def test_leaks(docs, nothing, benchmark):
    got = template_leaks.leaks(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 1), (None, 1)}
    kept = template_leaks.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "7", "None"]
    assert template_leaks.leaks(nothing, benchmark).count() == 0
    assert template_leaks.leaks(docs, benchmark.limit(0)).count() == 0
    assert template_leaks.keep_clean(docs, benchmark.limit(0)).count() == len(DOCS)


def test_mix(docs, nothing):
    got = temperature_mix.mix(docs).collect()
    assert len([r for r in got if r.epoch == 0]) == len(DOCS) and all(0 <= r.turn <= 1 for r in got)
    mixed = temperature_mix.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(got)
    assert {r.key for r in mixed.collect()} == {"x"} and {r.epoch for r in mixed.collect()} == {9}
    assert temperature_mix.mix(nothing).count() == 0 and temperature_mix.mixed_rows(nothing).count() == 0


def test_nearest(spark):
    kind = "vec_id bigint, embedding array<float>, label int, k1 int, chunk int"
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]),
            (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (None, [1.0, 1.0]), (100, [0.0, 2.0]), (200, None), (10, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in data], kind)
    got = sorted(tuple(r) for r in permutation_index.nearest(table).collect())
    root5 = 5**0.5
    assert [(q, r, v) for q, r, v, _ in got] == [
        (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 100), (100, 1, 3), (100, 2, 0), (100, 3, 1), (100, 4, 2)]
    assert [round(x[3], 12) for x in got] == [0, 0, round(2**0.5, 12), round(root5, 12), 1, *[round(root5, 12)] * 3]
    assert permutation_index.nearest(table.limit(0)).count() == 0


def test_pages(spark):
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>text &amp; more</article></body></html>"
    table = spark.createDataFrame(
        [(1, "http://a.example/1", page, 1, "h"), (1, "http://a.example/1", page, 1, "h"), (2, None, page, 1, "h"), (3, "no url", page, 1, "h"),
         (4, "http://a.example/2", None, 1, "h"), (5, "http://a.example/3", "", 1, "h"), (None, "http://b.example", "<p>x " * 50_000, 1, "h")],
        "page_id bigint, url string, html string, hashes int, host string")
    got = site_templates.extract(table).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, 3)} == {"T\n\ntext & more"}
    assert {r.text for r in got if r.page_id in (4, 5)} == {""}
    assert [r.text.count("x") for r in got if r.page_id is None] == [50_000]
    assert site_templates.extract(table.limit(0)).count() == 0
