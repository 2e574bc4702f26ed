"""Alignment of two tokenizers over a corpus: which ids end together, and how often they do so everywhere.

A text with a space before it is encoded by a byte-level BPE (A) and by a sentencepiece model (B).  Byte offsets at which a token of each
ends cut both into groups; the two tokens that end there are linked.  The count of a pair of ids is the number of its links in all texts.

First pass.  Neither tokenizer looks across the space before a word, so words are told apart by batch and bucket as in ``word_table``: each
distinct word is encoded by both once.  A batch aligns its words, and from its texts has the number of links of each of its pairs.
The distinct pairs of all batches, dealt into shards of about ``KEYS``, get numbers from a minimal perfect hash each; the pair of each
number is kept beside it.  A batch's counts become dense vectors by these numbers, a shard at a time, and are added in a tree.

Second pass.  Texts are aligned again, batch by batch; each distinct pair of a batch is looked up by its hash, its kept key is compared, and
per text the counts are added.  The highest count for each B id is one number for each entry of B's vocabulary: all that goes to every task.

Scale.  Texts are read once and packed (``word_table``); only the ids of a batch's words are shuffled to them in each pass.  Shards are files in the shared folder; a task holds
at most ``SHARDS_HELD`` of them (12 bytes and some bits for a pair), however many pairs there are.  Pairs are at most the product of the two vocabularies.
A word that fills a third of all text is one entry of its batch, a pair that has a third of all links one number of a vector.

Results.  One row per row of the table: ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest of their B
id; ties count), ``count_sum``, ``groups_sha256`` of ``a1,a2|b1;a3|b2,b3``.  Texts that are null or empty, or whose tokens do not spell the text again (a
letter U+2581 becomes a space), have no tokens: zeros and an empty string, and no share in the counts.  Texts of any length are aligned whole; repeated
rows count each time; a null doc_id stays null; an empty table gives no row.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import mix, new_folder, stored
from recordloom.llm.marked_words import byte_level, pack_ints, sentence_piece, spelled, unpack_ints, unpack_texts
from recordloom.llm.perfect_hash import PerfectHash, tree_sum
from recordloom.llm.tokens import read_file, write_file
from recordloom.llm.word_table import BUCKETS, LETTERS, REMEMBERED, coded_words

KEYS, SHARDS_HELD, PART_LETTERS = 1 << 18, 64, LETTERS // 2

_HIGH = np.uint64(32)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << _HIGH) | b.astype(np.uint64)


def _segmenter(a_path: str, b_path: str, remembered: int):
    """Ids of A and B for each distinct word; a word that they do not both spell has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_model, b_model = byte_level(a_path), sentence_piece(b_path)
        a_bytes, b_bytes = a_model.token_bytes(), b_model.token_bytes()
        known: dict[str, tuple[list[int], list[int]]] = {}
        for rows in batches:
            out: list[list] = [[], [], [], []]
            for words in rows.column("words").to_pylist():
                words = unpack_texts(words)
                if len(known) > remembered:
                    known = {}
                new = [w for w in words if w not in known]
                if new:
                    for word, a, b in zip(new, a_model.encode(new), b_model.encode(new)):
                        text = spelled(word).encode("utf-8", "surrogatepass")
                        same = b"".join([a_bytes[i] for i in a]) == text == b"".join([b_bytes[i] for i in b])
                        known[word] = (a, b) if same else ([], [])
                for side in (0, 1):
                    ids = [known[w][side] for w in words]
                    lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
                    out[2 * side].append(pack_ints(lengths))
                    out[2 * side + 1].append(pack_ints(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))))
            yield pa.RecordBatch.from_arrays(
                [rows.column("batch"), rows.column("places"), *(pa.array(c, pa.binary()) for c in out)],
                names=["batch", "places", "a_lengths", "a_ids", "b_lengths", "b_ids"])
    return run


@lru_cache(2)
def _sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each entry of the two vocabularies."""
    a, b = byte_level(a_path).token_bytes(), sentence_piece(b_path).token_bytes()
    return np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))


class Aligned:
    """The distinct words of a batch, aligned: flat ids of both sides and the groups they fall into."""

    def __init__(self, words: pa.Table, sizes: tuple[np.ndarray, np.ndarray]):
        columns = {c: [unpack_ints(x) for x in words.column(c).to_pylist()] for c in words.column_names if c != "batch"}
        flat = {c: np.concatenate(x) if x else np.zeros(0, np.uint32) for c, x in columns.items()}
        self.index = np.empty(len(flat["places"]), np.int64)  # of a place, the word
        self.index[flat["places"]] = np.arange(len(self.index))
        self.a, self.b = flat["a_ids"].astype(np.int64), flat["b_ids"].astype(np.int64)
        self.n_a, self.n_b = flat["a_lengths"].astype(np.int64), flat["b_lengths"].astype(np.int64)
        ends_a, ends_b = np.cumsum(sizes[0][self.a]), np.cumsum(sizes[1][self.b])
        at = np.searchsorted(ends_b, ends_a)
        both = ends_b[at] == ends_a if len(ends_b) else np.zeros(0, bool)
        self.last_a, self.last_b = np.flatnonzero(both), at[both]  # the tokens that end each group
        self.word = np.repeat(np.arange(len(self.n_a)), self.n_a)[self.last_a]  # the word of each group
        self.n_groups = np.bincount(self.word, minlength=len(self.n_a))
        self.pairs, self.which = np.unique(pair_keys(self.a[self.last_a], self.b[self.last_b]), return_inverse=True)

    def texts(self, decimals: list[str]) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each word; ``decimals`` has the ids with each sign in front (``_decimals``)."""
        groups = len(self.last_a)
        of_a = np.searchsorted(self.last_a, np.arange(len(self.a)))
        of_b = np.searchsorted(self.last_b, np.arange(len(self.b)))
        ends_a, ends_b = np.append(0, self.last_a + 1), np.append(0, self.last_b + 1)
        step = len(decimals) // 4
        out = np.empty(len(self.a) + len(self.b), np.int64)
        sign = np.full(len(self.a), 1)  # , inside a group
        sign[ends_a[:-1]] = 2  # ; before a group
        starts = (np.cumsum(self.n_a) - self.n_a)[self.n_a > 0]
        sign[starts] = 0  # nothing before a word
        out[np.arange(len(self.a)) + ends_b[of_a]] = sign * step + self.a
        sign = np.full(len(self.b), 1)
        sign[ends_b[:groups]] = 3  # | between the sides
        out[np.arange(len(self.b)) + ends_a[of_b + 1]] = sign * step + self.b
        parts = list(map(decimals.__getitem__, out.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(parts[x:y]) for x, y in zip([0, *ends], ends)]


@lru_cache(2)
def _decimals(size: int) -> list[str]:
    return [f"{sign}{i}" for sign in ("", ",", ";", "|") for i in range(size)]


def _whole(places: np.ndarray, ends: np.ndarray, n_a: np.ndarray) -> np.ndarray:
    """Which texts have a word, and only words that both sides spell."""
    bad = np.append(0, np.cumsum(n_a[places] == 0))
    starts = np.append(0, ends)[:-1]
    return (ends > starts) & (bad[ends] == bad[starts])


def _texts(texts: pa.Table, aligned: Aligned) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, words of all texts one after the other, ends, and which texts have tokens."""
    for keys, numbers, places in zip(*(texts.column(c).to_pylist() for c in ("keys", "numbers", "places"))):
        places = aligned.index[unpack_ints(places)]
        ends = np.cumsum(unpack_ints(numbers), dtype=np.int64)
        yield keys, places, ends, _whole(places, ends, aligned.n_a)


def _counter(a_path: str, b_path: str):
    """The first pass over a batch: its pairs and the number of their links."""
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        aligned = Aligned(words, _sizes(a_path, b_path))
        uses = np.zeros(len(aligned.n_a), np.int64)
        for _, places, ends, whole in _texts(texts, aligned):
            uses += np.bincount(places[np.repeat(whole, np.diff(ends, prepend=0))], minlength=len(uses))
        counts = np.bincount(aligned.which, weights=uses[aligned.word], minlength=len(aligned.pairs)).astype(np.int64)
        met = counts > 0
        batch = texts.column("batch").slice(0, 1)
        return pa.table({
            "part": batch, "pairs": pa.array([aligned.pairs[met].astype(np.int64)][:len(batch)], pa.list_(pa.int64())),
            "counts": pa.array([counts[met]][:len(batch)], pa.list_(pa.int64())),
        })
    return run


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5BD1E995)) % np.uint64(shards)).astype(np.int64)


def _dealer(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = rows.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(keys.astype(np.uint64), shards)), rows.column("pair")], names=["shard", "pair"])
    return run


def _builder(folder: str):
    """Write a shard: its hash, and the pair of each number."""
    def run(rows: pa.Table) -> pa.Table:
        keys = rows.column("pair").to_numpy().astype(np.uint64)
        found = PerfectHash.build(keys)
        ordered = np.empty(found.size, np.uint64)
        ordered[found.numbers(keys)] = keys
        head = found.to_bytes()
        shard = int(rows.column("shard")[0].as_py())
        write_file(f"{folder}/hash-{shard}", len(head).to_bytes(8, "little") + head + ordered.astype("<u8").tobytes())
        return pa.table({"shard": [shard], "n": [found.size]})
    return run


@lru_cache(SHARDS_HELD)
def _shard(folder: str, shard: int) -> tuple[PerfectHash, np.ndarray]:
    raw = read_file(f"{folder}/hash-{shard}")
    cut = 8 + int.from_bytes(raw[:8], "little")
    return PerfectHash.from_bytes(raw[8:cut]), np.frombuffer(raw, "<u8", -1, cut)


@lru_cache(SHARDS_HELD)
def _counts(folder: str, shard: int) -> np.ndarray:
    return np.frombuffer(read_file(f"{folder}/counts-{shard}"), "<i8")


def _verified(found: PerfectHash, kept: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Number of each key, or -1 if another key is kept there."""
    numbers = found.numbers(keys)
    numbers[(numbers >= 0) & (kept[numbers] != keys)] = -1
    return numbers


def _vectors(folder: str, shards: int):
    """Dense vectors of a part's counts, one per shard that it has pairs of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, keys, counts in zip(*(rows.column(c) for c in ("part", "pairs", "counts"))):
                keys, counts = (x.values.to_numpy() for x in (keys, counts))
                keys = keys.astype(np.uint64)
                of = _shard_of(keys, shards)
                for shard in np.unique(of).tolist():
                    mine = of == shard
                    found, kept = _shard(folder, shard)
                    numbers = _verified(found, kept, keys[mine])
                    if (numbers < 0).any():
                        raise ValueError("a pair is not in the hash that was built from it")
                    vector = np.zeros(found.size, np.int64)
                    vector[numbers] = counts[mine]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard]), pa.array([part.as_py()]), pa.array([_pack(vector)], pa.binary())], names=["block", "part", "vector"])
    return run


def _pack(vector: np.ndarray) -> bytes:
    """Two halves of 32 bits: the upper one is mostly zero and costs nothing."""
    low = pack_ints(vector & 0xFFFFFFFF)
    return len(low).to_bytes(8, "little") + low + pack_ints(vector >> 32)


def _unpack(packed: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(packed[:8], "little")
    return unpack_ints(packed[8:cut]).astype(np.int64) | unpack_ints(packed[cut:]).astype(np.int64) << 32


def _publisher(folder: str):
    """Write a shard's summed vector, and tell the highest count of each B id in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for block, packed in zip(rows.column("block").to_pylist(), rows.column("vector").to_pylist()):
                vector = _unpack(packed)
                _, keys = _shard(folder, block)
                write_file(f"{folder}/counts-{block}", vector.astype("<i8").tobytes())
                b = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
                order = np.lexsort((vector, b))
                last = np.append(np.flatnonzero(np.diff(b[order])), len(b) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(b[order][last]), pa.array(vector[order][last])], names=["b", "best"])
    return run


def _joiner(a_path: str, b_path: str, folder: str, shards: int, best: np.ndarray, full: bool):
    """The second pass over a batch."""
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        sizes = _sizes(a_path, b_path)
        aligned = Aligned(words, sizes)
        counts = np.zeros(len(aligned.pairs), np.int64)
        of = _shard_of(aligned.pairs, shards)
        for shard in np.unique(of).tolist():
            mine = np.flatnonzero(of == shard)
            found, kept = _shard(folder, shard)
            numbers = _verified(found, kept, aligned.pairs[mine])
            known = numbers >= 0  # a pair may stand in texts only that have no tokens
            counts[mine[known]] = _counts(folder, shard)[numbers[known]]
        top = counts == best[(aligned.pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        flat = np.append(0, np.cumsum(counts[aligned.which]))
        ends = np.cumsum(aligned.n_groups)
        sums = flat[ends] - flat[ends - aligned.n_groups]
        n_best = np.bincount(aligned.word, weights=top[aligned.which], minlength=len(ends)).astype(np.int64)
        per_word = [aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_groups, n_best, sums]
        named = aligned.texts(_decimals(max(map(len, sizes))))
        columns: list[list] = [[] for _ in range(9 if full else 8)]
        for keys, places, ends, whole in _texts(texts, aligned):
            columns[0] += keys
            for column, values in zip(columns[1:7], per_word):
                total = np.append(0, np.cumsum(values[places]))
                column += np.where(whole, total[ends] - np.append(0, total[ends])[:-1], 0).tolist()
            for start, end, fine in zip([0, *ends.tolist()], ends.tolist(), whole.tolist()):
                text = ";".join([named[i] for i in places[start:end].tolist()]) if fine else ""
                columns[7].append(hashlib.sha256(text.encode()).hexdigest() if fine else "")
                if full:
                    columns[8].append(text)
        names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names[:len(columns)])
    return run


def aligned(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", column: str = "text", full: bool = True, letters: int = PART_LETTERS,
    buckets: int = BUCKETS, remembered: int = REMEMBERED, keys: int = KEYS,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and with ``full`` the groups themselves; see the module."""
    spark = docs.sparkSession
    texts, listed = coded_words(docs, key, column, letters, buckets)
    kind = "batch bigint, places binary, a_lengths binary, a_ids binary, b_lengths binary, b_ids binary"
    words = stored(listed.mapInArrow(_segmenter(a_path, b_path, remembered), kind), "aligned")

    def by_batch():
        return texts.groupBy("batch").cogroup(words.groupBy("batch"))

    parts = stored(by_batch().applyInArrow(_counter(a_path, b_path), "part bigint, pairs array<bigint>, counts array<bigint>"), "parts")
    pairs = stored(parts.select(F.explode("pairs").alias("pair")).distinct(), "pairs")
    shards = max(1, -(-pairs.count() // keys))
    folder = new_folder(spark, "pairs")
    dealt = pairs.mapInArrow(_dealer(shards), "shard bigint, pair bigint")
    built = stored(dealt.groupBy("shard").applyInArrow(_builder(folder), "shard bigint, n bigint"), "shards")
    built.count()
    vectors = parts.mapInArrow(_vectors(folder, shards), "block bigint, part bigint, vector binary")
    summed = tree_sum(vectors, parts.count(), _unpack, _pack)
    highest = stored(summed.mapInArrow(_publisher(folder), "b bigint, best bigint"), "highest").groupBy("b").agg(F.max("best").alias("best"))
    best = np.zeros(len(_sizes(a_path, b_path)[1]), np.int64)
    for row in highest.collect():  # at most an entry of B's vocabulary each
        best[row.b] = row.best
    kind = "key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    out = by_batch().applyInArrow(_joiner(a_path, b_path, folder, shards, best, full), kind + (", groups string" if full else ""))
    return out.withColumnRenamed("key", key)


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return aligned(docs, a_path, b_path, full=False)
