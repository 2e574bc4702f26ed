"""SentencePiece ids by distinct words, and alignment of two tokenizers, against the libraries on whole texts."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np

from recordloom.llm import pair_counts, word_table
from recordloom.llm.marked_words import byte_level, marked_words, pack_ints, pack_texts, sentence_piece, spelled, unpack_ints, unpack_texts
from recordloom.llm.perfect_hash import PerfectHash, tree_sum
from recordloom.llm.queries import BYTES, PIECES, tokenizer_path

LETTERS = [" ", " ", " ", "\n", "\n", "\t", "\r", "▁", "a", "b", "foo", "The", "é", "漢", "😀", ".", ",", "'s", "1", "23", "\x00", "\x1c", "　",
           "<s>", "<|endoftext|>", "</s>", "<0x0A>", "́", "ﬁ", "Ａ"]
LONG = " ".join(f"word{i % 977}\nand" for i in range(60_000))


def strange(rng, n, size=14):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, size))) for _ in range(n)]


def test_marked_words_give_the_ids_of_the_whole_text():
    pieces, letters = sentence_piece(tokenizer_path(PIECES)), byte_level(tokenizer_path(BYTES))
    for text in strange(random.Random(1), 4000):
        words = marked_words(text)
        assert "".join(map(spelled, words)) == " " + text
        ids = pieces.encode(words)
        whole = [i for x in ids for i in x]
        assert whole == pieces.model.encode(text)
        assert pieces.model.decode(ids[0]) + "".join(pieces.decode(ids[1:])) == pieces.model.decode(whole)
        assert [i for x in letters.encode(words) for i in x] == letters.tokenizer.encode(" " + text, add_special_tokens=False).ids


def test_packed_numbers_and_texts():
    rng = random.Random(2)
    for n in (0, 1, 1000):
        numbers = [rng.randrange(2 ** rng.randrange(1, 33)) for _ in range(n)]
        assert unpack_ints(pack_ints(np.array(numbers, "u4"))).tolist() == numbers
        texts = strange(rng, n) + ["", "😀"]
        assert unpack_texts(pack_texts(texts)) == texts


def test_ids_and_texts_of_whole_texts(spark):
    model = sentence_piece(tokenizer_path(PIECES)).model
    texts = [None, "", " ", "\n", "a", " a ", "same text", "same text", LONG, "x" * 50_000, *strange(random.Random(3), 300, 60)]
    rows = [(i if i != 4 else None, t, "x", 1) for i, t in enumerate(texts)] + [(6, "same text", "x", 1), (6, "other text", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string, batch int").repartition(3)
    want = []
    for key, text, _, _ in rows:
        ids = model.encode(text or "")
        decoded = model.decode(ids)
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    path = tokenizer_path(PIECES)
    small = word_table.encoded(docs, path, letters=3000, buckets=5, remembered=50)
    assert small.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert sorted((tuple(r) for r in small.collect()), key=repr) == sorted(want, key=repr)
    assert sorted((tuple(r) for r in word_table.digests(docs, path).collect()), key=repr) == sorted((w[:4] for w in want), key=repr)
    assert word_table.digests(docs.limit(0), path).count() == 0


def brute_alignment(rows):
    """Links by comparing every end of one side with the other's."""
    pieces, letters = sentence_piece(tokenizer_path(PIECES)), byte_level(tokenizer_path(BYTES))
    a_bytes, b_bytes = letters.token_bytes(), pieces.token_bytes()
    cut, count = [], Counter()
    for text in rows:
        a = letters.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.model.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            a, b = [], []
        ends_a, ends_b = list(accumulate(len(a_bytes[i]) for i in a)), list(accumulate(len(b_bytes[i]) for i in b))
        links = [(i, j) for i, j in zip(a, map(dict(zip(ends_b, b)).get, ends_a)) if j is not None]
        count.update(links)
        both, groups = sorted(set(ends_a) & set(ends_b)), []
        for low, high in zip([0, *both], both):
            groups.append(",".join(str(i) for i, e in zip(a, ends_a) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(b, ends_b) if low < e <= high))
        cut.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    for n_a, n_b, groups, links in cut:
        text = ";".join(groups)
        yield (n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
               hashlib.sha256(text.encode()).hexdigest() if groups else "", text)


def test_alignment_of_two_tokenizers(spark):
    texts = [None, "", " ", "\n", "a", "same text", "same text", "<|endoftext|> is text", "▁", LONG[:40_000], "x" * 3000, *strange(random.Random(5), 150, 40)]
    texts += ["naïve café 漢字 " + str(i) for i in range(30)]
    rows = [(i if i != 4 else None, t, "x", 1) for i, t in enumerate(texts)] + [(5, "same text", "x", 1), (5, "other text", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string, batch int").repartition(3)
    paths = tokenizer_path(BYTES), tokenizer_path(PIECES)
    want = [(k, *w) for (k, *_), w in zip(rows, brute_alignment([r[1] for r in rows]))]
    got = pair_counts.aligned(docs, *paths, letters=2000, buckets=5, remembered=50, keys=300)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert sorted((tuple(r) for r in pair_counts.digests(docs, *paths).collect()), key=repr) == sorted((w[:-1] for w in want), key=repr)
    assert pair_counts.digests(docs.limit(0), *paths).count() == 0
    assert {tuple(r) for r in pair_counts.digests(docs.filter("text is null or text = '▁'"), *paths).collect()} == {(0, *[0] * 6, ""), (8, *[0] * 6, "")}


def test_perfect_hash():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        found = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
        assert found.size == n and sorted(found.numbers(keys).tolist()) == list(range(n))


def test_vectors_are_added_in_a_tree(spark):
    rng = np.random.default_rng(8)
    vectors = rng.integers(0, 2**40, (50, 9))
    rows = [(block, part, pair_counts._pack(vectors[part] * (block + 1))) for block in range(3) for part in range(50)]
    frame = spark.createDataFrame(rows, "block bigint, part bigint, vector binary")
    got = {r.block: pair_counts._unpack(r.vector).tolist() for r in tree_sum(frame, 50, pair_counts._unpack, pair_counts._pack, fan=4).collect()}
    assert got == {block: (vectors.sum(axis=0) * (block + 1)).tolist() for block in range(3)}
