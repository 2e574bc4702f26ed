"""Operators against brute force, exact round trips and held-out accuracy."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from recordloom.llm import (
    compact_windows, forest_join, language_backoff, permutation_index, pfor_files, quality_trees, queries, separator_scan, site_templates,
    temperature_mix, template_leaks,
)
from recordloom.llm.common import components
from recordloom.llm.queries import tokenizer_path
from recordloom.llm.tokens import Encoder, write_file

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def invented(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


# ---- near copies -------------------------------------------------------------------------

def brute_join(docs, threshold=0.8):
    words = {i: tuple(re.findall(r"\w+", t.lower())) for i, t in docs}
    sets = {i: {w[k:k + 5] for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    first, copies = {}, Counter(words.values())
    for i in sorted(words):
        first.setdefault(words[i], i)
    texts, links, near = sorted(first.values()), Counter(), defaultdict(set)
    for k, a in enumerate(texts):
        for b in texts[k + 1:]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                near[a].add(b)
                near[b].add(a)
    label = {}
    for a in texts:
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = a
                todo += near[x]
    return {i: (label[first[w]], first[w], copies[w], links[first[w]]) for i, w in words.items()}


def test_join_finds_every_link_of_a_hot_group(spark):
    rng = random.Random(3)
    base, docs = invented(rng, 120), []
    for i in range(90):  # near copies, in many blocks of the grid
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = "edit" + str(rng.random())[2:]
        docs.append((i, " ".join(own)))
    docs += [(100 + i, docs[0][1].upper()) for i in range(40)]
    docs += [(200 + i, " ".join(invented(rng, rng.randrange(1, 90)))) for i in range(80)]
    want = brute_join(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_copies, r.n_links) for r in forest_join.ngram_join(frame, trees=24, block=16).collect()}
    assert got == want
    kept = {r.doc_id for r in forest_join.keep_one(frame, trees=24, block=16).collect()}
    assert kept == {w[0] for w in want.values()}


def test_a_repeated_id_with_other_texts(spark):
    rng = random.Random(8)
    a, b, c, d = (invented(rng, 80) for _ in range(4))
    near = [*b[:79], "edited"]
    docs = [(3, a), (5, a), (5, b), (6, b), (7, near), (5, c), (8, c), (9, d), (9, [*d[:79], "edited"]), (9, d)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string").repartition(3)
    kept = sorted((r.doc_id, r.text) for r in forest_join.keep_one(frame, trees=24).collect())
    assert sum(i == 9 for i, _ in kept) == 1
    assert [k for k in kept if k[0] != 9] == sorted([(3, " ".join(a)), (5, " ".join(b)), (5, " ".join(c))])
    got = Counter((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in forest_join.ngram_join(frame, trees=24).collect())
    assert got == Counter([(3, 3, 2, 0), (5, 3, 2, 0), (5, 5, 2, 1), (6, 5, 2, 1), (7, 5, 1, 1), (5, 5, 2, 0), (8, 5, 2, 0), (9, 9, 2, 1),
                           (9, 9, 1, 1), (9, 9, 2, 1)])


def test_stop_depth_shortens_prefixes_to_the_recall():
    for recall in (0.5, 0.9, 0.99):
        depth = forest_join.stop_depth(10, 6, 0.8, recall)
        assert 1 - (1 - 0.8**depth) ** 10 >= recall
        assert depth == 6 or 1 - (1 - 0.8 ** (depth + 1)) ** 10 < recall


def test_components(spark):
    chain = [(i + 1, i) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{200 + i: 100 for i in range(50)}, 300: 300, 301: 300}


# ---- passages ----------------------------------------------------------------------------

def test_compact_windows_are_the_wide_nodes_of_the_tree():
    rng = np.random.default_rng(1)
    for n in (5, 40, 200):
        for high in (4, 2**40):
            values = rng.integers(1, high, n).astype(np.uint64)
            values[rng.integers(0, n, 2)] = 0
            want = set()
            for c in range(n):
                if values[c]:
                    left = c
                    while left and values[left - 1] > values[c]:
                        left -= 1
                    right = c
                    while right < n - 1 and values[right + 1] >= values[c] and (values[right + 1] > values[c]):
                        right += 1
                    want.add((left, c, right))
            want = {w for w in want if w[2] - w[0] + 1 >= 7}
            got = set(zip(*(x.tolist() for x in compact_windows.compact(values, 7))))
            if high > 4:
                assert got == want
            else:  # of equal values the first is the smaller one: its window reaches over the others
                assert all(values[w[0]:w[2] + 1].min() == values[w[1]] for w in got)


def test_single_partners_at_the_threshold(spark):
    rng = random.Random(9)
    rows, edited, exact = [], set(), set()
    for i in range(300):  # exactly 50 words; an edited inner word gives 41 of 51 runs: similarity 0.804
        one = invented(rng, 50)
        two = list(one)
        if i % 3:
            two[rng.randrange(5, 45)] = "edited"
        (edited if i % 3 else exact).add(2 * i)
        for k, own in enumerate((one, two)):
            rows.append((2 * i + k, " ".join([*invented(rng, rng.randint(20, 90)), *own, *invented(rng, rng.randint(20, 90))])))
    got = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert all(r.doc_id // 2 == r.other_id // 2 for r in got)
    found = {r.doc_id for r in got}
    assert exact <= found
    assert len(edited & found) >= 0.97 * len(edited)


def test_planted_passages(spark):
    rng = random.Random(5)
    passages, rows, planted = [invented(rng, 60) for _ in range(10)], [], defaultdict(list)
    for i in range(300):
        text = invented(rng, rng.randint(60, 200))
        if i < 120:
            own = list(passages[i % 10])
            if i % 3 == 0:
                own[rng.randrange(5, 55)] = "edited"
            at = rng.randrange(len(text))
            text[at:at] = own
            planted[i % 10].append((i, at))
        rows.append((i, " ".join(text)))
    got = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    found = {r.doc_id for r in got}
    assert found <= set(range(120)) and {i for i in range(120) if i % 3} <= found
    assert len(found) >= 116  # an edited passage of 60 words has similarity 0.84: few are missed
    where = {i: at for group in planted.values() for i, at in group}
    for r in got:
        assert r.doc_id % 10 == r.other_id % 10 and r.n_words >= 50 and r.similarity >= 0.8
        assert where[r.doc_id] - 2 <= r.start and r.start + r.n_words <= where[r.doc_id] + 62
    label = {r.node: r.component for r in components(spark.createDataFrame([(r.doc_id, r.other_id) for r in got], "a bigint, b bigint")).collect()}
    assert all(len({label[i] for i in found if i % 10 == k}) == 1 for k in range(10))


# ---- token files -------------------------------------------------------------------------

ODD = ["a<|endoftext|>b x", "don't we'll I'M O'Neil's ab's,", "İstanbul Straße ΣΑΣ café é", "x\x1cy \x85z\xa0q w\tt", "中文字 12² ½ Ⅷ 3.14,",
       "a  b\n\n c", "", None, "!!! ... ?,; a.b.c,,", "ﬃ ẞ K Å  xy", " ̸ lead"]


@pytest.mark.parametrize("as_text", [False, True])
def test_encoder_equals_the_library(as_text):
    coder = Encoder(tokenizer_path(), as_text)
    coder.CHUNKS = 40  # forgets on the way
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["The", "the,", *invented(rng, 2), "Édition", "x1", "--"]) for _ in range(50)) for _ in range(30)]
    for part in (texts[:7], texts[7:20], texts[20:]):
        ids, sizes = coder.encode(part, 1)
        want = [e.ids + [1] for e in coder.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_packed_blocks_round_trip():
    rng = np.random.default_rng(4)
    kinds = [rng.integers(0, 2**16, 5000), rng.integers(7, 8, 2048), np.append(rng.integers(0, 9, 3000), 2**32 - 1), rng.integers(0, 2**32, 1025), [0]]
    for ids in kinds:
        ids = np.array(ids, np.uint32)
        raw = pfor_files.encode(np.array([5, pfor_files.NO_ID]), np.array([1, len(ids) - 1]), ids)
        doc_ids, lengths, offsets, n = pfor_files.contents(raw)
        assert doc_ids.tolist() == [5, pfor_files.NO_ID] and lengths.tolist() == [1, len(ids) - 1] and n == len(ids)
        assert (pfor_files.decode(raw, offsets).ravel()[:n] == ids).all()
        alone = pfor_files.decode(raw, offsets[-1:])[0]  # one block by the index
        assert (alone[:n - (len(offsets) - 1) * pfor_files.BLOCK] == ids[(len(offsets) - 1) * pfor_files.BLOCK:]).all()
    spiky = np.full(4096, 3, np.uint32)
    spiky[::200] = 2**31
    assert len(pfor_files.encode(np.array([1]), np.array([4096]), spiky)) < 1200  # outliers do not widen the block


@needs_data
def test_token_files_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sorted(pfor_files.token_files(docs, tokenizer_path()).collect(), key=lambda r: r.start)
    coder, start = Encoder(tokenizer_path()).tokenizer, 0
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    for r, d in zip(got, rows, strict=True):
        ids = np.array(coder.encode(d.text, add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng, files, want = np.random.default_rng(6), [], set()
    for k, sizes in enumerate(([0, 3, 200, 0, 1], [500], [], [0], [31, 32, 33])):
        for ended in (True, False):
            ids = [x for n in sizes for x in (*rng.integers(0, 100, n), 7777)]
            ids = ids if ended else ids[:-1]
            path = str(tmp_path / f"f{k}{ended}.u16")
            write_file(path, np.array(ids, "<u2").tobytes())
            files.append((path, 2 * len(ids)))
            start = 0
            for o, n in enumerate(sizes):
                last = o == len(sizes) - 1
                if not (last and not ended and n == 0):
                    want.add((path, o, start, n, ended or not last))
                start += n + 1
    frame = spark.createDataFrame(files, "path string, bytes bigint")
    for block in (2, 64, 1 << 20):
        assert {tuple(r) for r in separator_scan.scan(frame, 7777, block_bytes=block).collect()} == want


# ---- learned models ----------------------------------------------------------------------

def test_trees_learn_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality_trees.train(x[:3000], y[:3000], rounds=30, levels=3)
    assert ((trees.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    one = quality_trees.Trees(0.0, np.array([[1, 0, 0]]), np.array([[0.5, np.inf, 2.0]]), np.array([[1.0, 9.0, 2.0, 3.0]]))
    got = one.score(np.array([[0, 0.5], [1, 0.6], [3, 0.6]]))
    assert np.allclose(np.log(got / (1 - got)), [1, 2, 3])


@needs_data
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = [r for r in queries.op2_language_id(spark, DATA).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in found]) > 0.97
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    found = [r for r in queries.op4_quality_classifier(spark, DATA).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in found)
    assert np.mean([labels[r.doc_id] == r.predicted for r in found if r.doc_id in labels]) > 0.95


def test_unseen_words_back_off_to_shorter_grams():
    model = language_backoff.Model(
        ["aa", "bb"], [("known", {"aa": 9})], [("xyz", {"bb": 5}), ("x", {"aa": 4, "bb": 1}), ("q", {"aa": 1, "bb": 1})], 3)
    assert model.predict("known")[0] == "aa" and model.predict("xyz")[0] == "bb"
    assert model.predict("x")[0] == "aa" and model.predict("ω")[0] == "aa"  # nothing known: the first language
    assert model.predict("12 !")[0] == "und"


def test_languages_of_very_unequal_size(spark):
    """A rare language in its own script keeps its items, and its size does not make it likelier."""
    rng = random.Random(6)
    latin = invented(rng, 6000)
    thai = ["".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(latin, k=60)), "en") for i in range(1200)]
    rows += [(2000 + i, " ".join(rng.choices(thai, k=6)), "th") for i in range(40)]
    rows += [(3000 + i, " ".join(rng.choices(latin[:50], k=6)), "xx") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    for kept in (100_000, 600):
        model = language_backoff.fit(docs, kept, kept)
        found = [(r.doc_id, r.lang_pred) for r in language_backoff.identify(docs, model).collect() if r.held_out]
        assert all(lang == "en" for i, lang in found if i < 2000)
        assert all(lang == "th" for i, lang in found if 2000 <= i < 3000) and any(i >= 2000 for i, _ in found)
        assert model.predict("กขค")[0] == "th"  # letters known, word not


def test_letters():
    assert language_backoff.letters("² ½ Ⅷ 12 _") == []
    low = "".join(map(chr, range(0x300)))
    assert language_backoff._FAR.sub(" ", low).lower() and language_backoff.letters(language_backoff._FAR.sub(" ", low)) == [
        w for w in language_backoff._LETTERS.findall(language_backoff._FAR.sub(" ", low).lower())]
    assert language_backoff.letters("हिन्दी Straße l'été x2y") == ["हिन्दी", "straße", "l", "été", "x", "y"]


# ---- search ------------------------------------------------------------------------------

@needs_data
@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.01", "0.1")])
def test_recall(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in queries.op3_nearest_neighbours(spark, folder).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        exact = permutation_index.distances(x, x[i])
        order = [j for j in np.lexsort((ids, exact)) if j != i][:10]
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert mine == [(k + 1, *p) for k, p in enumerate(sorted([m[1:] for m in mine], key=lambda p: (p[1], p[0])))]
        by_id = dict(zip(ids.tolist(), exact))
        assert all(abs(by_id[m[1]] - m[2]) < 1e-12 for m in mine)
        hits += len({ids[j] for j in order} & {m[1] for m in mine})
    assert hits >= 0.9 * sum(len(v) for v in got.values())


@pytest.mark.parametrize("noise", [1e-3, 1e-4])
def test_recall_in_a_tight_cluster(noise):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 32))
    x[:1365] = x[0] + noise * rng.normal(size=(1365, 32))
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 40)
    found = permutation_index.search_block(x, ids, x[asked], permutation_index.choose_pivots(x, permutation_index.PIVOTS), 11)
    hits = []
    for q, (at, exact) in zip(asked, found):
        every = permutation_index.distances(x, x[q])
        assert np.array_equal(every[at], exact)
        hits.append(len(set(at) & set(np.lexsort((ids, every))[:11])) / 11)
    assert np.mean([h for q, h in zip(asked, hits) if q < 1365]) >= 0.99 and np.mean(hits) >= 0.9


# ---- pages -------------------------------------------------------------------------------

def test_passages_of_texts_that_share_an_id(spark):
    """One side of every pair repeats its doc_id with an unrelated text, before or after the true one; long texts among them."""
    rng = random.Random(11)
    rows = []
    for n in range(100):
        shared = invented(rng, 60)
        rows.append((2 * n, " ".join(invented(rng, 30) + shared + invented(rng, 30))))
        other = [(2 * n + 1, " ".join(invented(rng, 20) + shared + invented(rng, 20))), (2 * n + 1, " ".join(invented(rng, 2000 if n < 3 else 100)))]
        rows += other if n % 2 else other[::-1]
    rows += rows[:7]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {(r.doc_id, r.other_id) for r in compact_windows.repeated_passages(docs).collect()}
    assert got == {pair for n in range(100) for pair in ((2 * n, 2 * n + 1), (2 * n + 1, 2 * n))}
    with pytest.raises(ValueError):
        compact_windows.repeated_passages(docs, hashes=5)


def test_site_templates(spark):
    pages = []
    for i in range(40):
        body = f"<div><p>Own words of page {i} with number {i}.</p><p>Shared by two pages {i // 2}.</p></div>"
        pages.append((i, "https://one.example/p", f"<body><div class=top><p>Welcome to our site</p></div>{body}<div><p>All rights kept</p></div>"))
    pages += [(100 + i, "https://two.example/p", "<article><h1>Same</h1><p>A copied article.</p><div>Sign up for letters <a href=x>here</a></div>"
               f"<p>end {i}</p></article>") for i in range(10)]
    pages += [(200 + i, "https://three.example/p", "<body><p>Copied page.</p><p>Copied page, too.</p></body>") for i in range(9)]
    got = {r.page_id: r.text for r in site_templates.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for i in range(40):
        assert got[i] == f"Own words of page {i} with number {i}.\n\nShared by two pages {i // 2}."
    for i in range(10):
        assert got[100 + i] == f"Same\n\nA copied article.\n\nend {i}"
        assert got[200 + min(i, 8)] == "Copied page.\n\nCopied page, too."


def test_pages_without_article_keep_a_shared_passage(spark):
    shared = " ".join(invented(random.Random(4), 90))
    pages = [(i, "https://plain.example/p", "<body><div><a href=/>Home</a> <a href=/b>Blog</a></div>"
              f"<div><h2>A shared title</h2><p>{shared}</p><p>One sentence of its own {i % 5}.</p></div><ul><li>{shared}</li></ul></body>")
             for i in range(40)]
    pages += [(100 + i, "https://flat.example/p", f"<p>{shared}</p><blockquote>{shared}</blockquote><p>own {i}</p>") for i in range(20)]
    got = {r.page_id: r.text for r in site_templates.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for i in range(40):
        assert got[i] == f"A shared title\n\n{shared}\n\nOne sentence of its own {i % 5}.\n\n{shared}"
    for i in range(20):
        assert got[100 + i] == f"{shared}\n\n{shared}\n\nown {i}"


def test_blocks_by_kind():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav>
    <div id="cookie-notice">We use cookies</div><main><article class="post"><header><h1>Title &amp; more</h1></header><div class="share">me</div>
    <p><b>One&nbsp; two<br>three <a href="x>y">link</a>.<p>next</p><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><form>Sub</form>
    <aside>side</aside><blockquote><p>q</blockquote>tail<!-- no --></article><section id="comments"><article class="comment">
    <p>a comment that is much longer than the whole article, and goes on and on, and then some more words after that</p></article></section></main>
    <footer>f</footer><script>var a="<p>x</p>"</script><p>after"""
    assert site_templates.Page(page).blocks() == ["Title & more", "One two three link.", "next", "a", "b", "1 2", "3", "q", "tail"]
    assert site_templates.Page("plain &lt;b").blocks() == ["plain <b"] and site_templates.Page("<p>a<p").blocks() == ["a"]


@pytest.mark.parametrize(("page", "want"), [
    ('<body><div class="page has-sidebar"><article><p>one</p></article><div class="sidebar">no</div></div>', ["one"]),
    ('<div class="single no-comments"><p>one</p></div>', ["one"]),
    ('<form id="all"><div class="nav">no</div><article><p>one</p><form>no</form></article></form>', ["one"]),
    ('<nav>no</nav><form><p>one</p><p>two <button>no</button></p></form><footer>no</footer>', ["one", "two"]),
    ('<article><div class="search-results-analysis">one</div><p class="alert-fires">two</p><div class="ad-slot-3">no</div></article>', ["one", "two"]),
    ('<article><p>one</p></article><div>no</div><article><p>two, longer</p></article><aside><article>no</article></aside>', ["one", "two, longer"]),
    ('<p>no</p><main><h1>title</h1><p>lead</p><article>tiny</article></main>', ["title", "lead", "tiny"]),
    ('<article><p>one</p><article><p>in it</p></article>end</article><div class="post-comments"><article>a long comment of a reader</article></div>',
     ["one", "in it", "end"]),
    ('<div class="comments"><article class="comment">no</article></div><p>one</p>', ["one"]),
    ('<div id="site-footer">no</div><div class="comment-list">no</div><p>one</p>', ["one"]),
    ('<nav>no</nav><form><input></form><footer>no</footer>', []), ('', []),
])
def test_wrappers_articles_and_whole_names(page, want):
    assert site_templates.Page(page).blocks() == want


# ---- leaks and mixing --------------------------------------------------------------------

def test_parameterised_questions(spark):
    docs = spark.createDataFrame([
        (1, "Well. A train leaves Paris at 30 km per hour and John meets 12 friends after 30 minutes there"),
        (2, "A train leaves Paris at 30 km per hour and John meets 12 friends after 31 minutes there"),  # 20 km and 20 minutes are two slots
        (3, "A TRAIN LEAVES AT ONCE"), (4, "a train leaves late and nobody meets friends after hours there")], "doc_id bigint, text string")
    items = spark.createDataFrame(
        [(7, "A train leaves Oslo at 20 km per hour and Mia meets 9 friends after 20 minutes there")], "item_id bigint, text string")
    got = template_leaks.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(1, 7, 1.0), (2, 7, 1.0)]


def test_one_value_stands_for_one(spark):
    """A number without unit that became two numbers costs the windows that hold it; the others count."""
    docs = spark.createDataFrame([(1, "we add 5 to them and then we take 6 from the rest")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "we add 3 to them and then we take 3 from the rest")], "item_id bigint, text string")
    assert [(r.n_windows, r.n_matched) for r in template_leaks.leaks(docs, items, coverage=0.1).collect()] == [(9, 2)]
    docs = docs.unionByName(spark.createDataFrame([(2, "we add 9 to them and then we take 9 from the rest")], docs.schema))
    assert [(r.doc_id, r.coverage) for r in template_leaks.leaks(docs, items, coverage=0.5).collect()] == [(2, 1.0)]


@pytest.mark.parametrize(("item", "text", "leaks"), [
    ("Anna Smith walks home. Carla sees her there and Anna Smith waves back to Carla twice",
     "Mary Jane Watson walks home. Zoe sees her there and Mary Jane Watson waves back to Zoe twice", True),
    ("Tom Riddle asks who was there before", "so: \"Peter Pan asks who was there before\"", True),
    ("why grass is green", "he asked Why Grass is green", False),  # a short item is met word for word
    ("why grass is green", "he asked why grass is green, twice", True),
    ("it costs 3 dollars", "it costs 4 dollars", False),
    ("it costs 3 dollars", "now it costs 3 dollars", True),
    ("Oslo Bergen", "Oslo Bergen", False),  # one name says too little
])
def test_names_and_short_items(spark, item, text, leaks):
    docs = spark.createDataFrame([(1, text), (2, "nothing of it"), (3, None), (4, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert [r.doc_id for r in template_leaks.leaks(docs, items).collect()] == ([1] if leaks else [])


def test_one_edited_slot_costs_its_windows_only(spark):
    item = ("The bridge over the river was opened in 1907 by the mayor of the old town and it was closed again for long repairs in 1907 "
            "because the northern pillar of it had sunk deep into the soft ground")
    docs = [(1, item), (2, item[::-1].replace("7091", "8091", 1)[::-1]), (3, item.replace("1907", "1950", 1).replace("1907", "1960", 1)),
            (4, "opened in 1907 by the mayor and closed again in 1950")]
    got = {r.doc_id: r for r in template_leaks.leaks(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert set(got) == {1, 2, 3}
    n = len(item.split()) - 4
    assert (got[1].n_windows, got[1].n_matched, got[2].n_matched, got[3].n_matched) == (n, n, n - 5, n - 10)


def test_a_slot_stands_for_the_value_of_most_places(spark):
    item = "take 5 red apples then add 5 green pears then add 5 ripe plums and cook all of it"
    doc = "take 8 red apples then add 8 green pears then add 9 ripe plums and cook all of it"
    got = template_leaks.leaks(
        spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert [(r.n_windows, r.n_matched) for r in got] == [(15, 10)]


@needs_data
def test_verbatim_leaks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()
    windows = {i.item_id: [w[k:k + 5] for w in [tuple(re.findall(r"[^\W_]+", i.text.lower()))] for k in range(len(w) - 4)] for i in items}
    want = set()
    for d in docs:
        w = tuple(re.findall(r"[^\W_]+", d.text.lower()))
        own = {w[k:k + 5] for k in range(len(w) - 4)}
        want |= {(d.doc_id, i) for i, ws in windows.items() if sum(x in own for x in ws) >= 0.7 * len(ws)}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, DATA).collect()}
    assert want and want <= got and len(got) <= 1.2 * len(want)


def test_mixture_meets_its_targets(spark):
    sizes = {"a": 1000, "b": 100, "c": 10, None: 50, "z": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, tokens bigint")
    got = {r.source: r for r in temperature_mix.mixture(frame, max_repeat=3.0).collect()}
    reads = {s: r.weight * (1000 / got["a"].weight) / r.tokens for s, r in got.items() if r.tokens}
    assert min(reads.values()) == pytest.approx(1) and max(reads.values()) == pytest.approx(3)
    assert all(r.target == r.epochs * r.tokens + r.rest for r in got.values() if r.tokens) and got["z"].weight == 0
    flat = temperature_mix.mixture(frame, entropy=1.2, budget=6000).collect()
    assert -sum(r.weight * np.log(r.weight) for r in flat if r.weight) == pytest.approx(1.2)
    assert abs(sum(r.target for r in flat) - 6000) <= len(flat)


def test_blocks_fill_the_budget(spark):
    rng = random.Random(1)
    docs = [(i, "hot" if i % 3 else f"s{i % 7}", "w " * rng.randrange(30)) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(6)
    got = temperature_mix.mix(frame, max_repeat=2.5).collect()
    own = Counter()
    for _, s, t in docs:
        own[s] += len(t.split())
    plan = {r.source: r for r in temperature_mix.mixture(
        spark.createDataFrame(list(own.items()), "source string, tokens bigint"), max_repeat=2.5).collect()}
    read = Counter()
    for r in got:
        read[r.source] += r.n_tokens
    assert all(0 <= read[s] - p.target < 30 for s, p in plan.items())
    seen = Counter((r.doc_id, r.epoch) for r in got)
    assert max(seen.values()) == 1 and {i for i, e in seen if e == 0} == {d[0] for d in docs}


@needs_data
def test_mix_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    frame = queries.op10_source_mix(spark, DATA)
    columns = sorted(frame.columns)
    result = con.execute(queries.ORACLES["op10_source_mix"])
    names = [d[0] for d in result.description]
    want = sorted(tuple(x[names.index(c)] for c in columns) for x in result.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in frame.collect()) == want
