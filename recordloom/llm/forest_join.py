"""N-gram Jaccard join by MinHash bands.

Every text is the set of its runs of five words.  ``trees`` labels of ``depth`` min-hash values each are its signature.  From
the parameters, not from the data, follows the longest prefix of a label at which a pair at the threshold meets in some label
with the target recall (``stop_depth``).  Prefixes of that one length are the bands; texts that share a band are a candidate
group.  The rest of a label only orders the members of a group.
Inside a group the members are compared exactly, as sets.

Scale.  Texts with the same words are one node, with a number of its own, before any signature is grouped.  A group of more than ``block``
members becomes a grid of pairs of blocks, so one task holds at most two blocks however many near copies there are.
Pairs are never rows: a block pair gives each member's number of links and one edge to the smallest member it hangs
together with.  A pair that meets in several tries counts in the first of them only.

Results.  ``doc_id``; ``class_id`` the smallest doc_id reachable by links; ``copy_of`` the smallest doc_id with the same
words; ``n_copies`` rows with the same words; ``n_links`` other texts at the threshold or above.  A text without
words (null, empty, only signs) is its own class with no links; a text of one to four words is a single run.
A row without doc_id keeps null class and no links.  Rows that repeat a doc_id with other words are nodes of their own.
Extra columns are ignored.  Recall is probabilistic, by default at least 0.99 at similarity 0.8; what is linked is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import (
    components, mix, run_bounds, shingle_hashes, side, slices, stored, whole_groups, word_hashes,
)

WORDS, THRESHOLD, TREES, DEPTH, RECALL, BLOCK = 5, 0.8, 10, 6, 0.99, 256


def stop_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """Longest prefix at which a pair at the threshold meets in some trie with the wanted probability."""
    for length in range(depth, 0, -1):
        if 1 - (1 - threshold ** length) ** trees >= recall:
            return length
    raise ValueError("more trees are needed for this recall")


def min_hashes(runs: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima over a set of hashed runs, in slices so that a long text needs no large matrix."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, n, dtype=np.uint64)
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(runs), 4096):
        np.minimum(best, (runs[i:i + 4096, None] * factors + shifts).min(axis=0), out=best)
    return best


def text_keys(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits for a sequence of words."""
    place = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    first = mix(hashes + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    second = mix(mix(hashes) ^ (place * np.uint64(0xD1B54A32D192ED03))).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


_SIGNED = "doc_id bigint, text_key bigint, k1 bigint, k2 bigint, prefixes array<bigint>, tails array<bigint>"


def _signer(words: int, trees: int, depth: int, stop: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys, prefixes, tails = [], [], []
            for text in part.column("text").to_pylist():
                hashes = word_hashes(text)
                if not len(hashes):
                    keys.append((None, None)), prefixes.append(None), tails.append(None)
                    continue
                keys.append(text_keys(hashes))
                labels = min_hashes(np.unique(shingle_hashes(hashes, words)), trees * depth).reshape(trees, depth)
                prefix = np.zeros(trees, np.uint64)
                for d in range(stop):
                    prefix = mix(prefix + labels[:, d])
                tail = np.zeros(trees, np.uint64)
                for d in range(stop, depth):  # the rest of the label, for the order inside a node
                    tail = (tail << np.uint64(16)) | (labels[:, d] >> np.uint64(48))
                prefixes.append(prefix.astype(np.int64)), tails.append(tail.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("text_key"), pa.array([k[0] for k in keys], pa.int64()),
                 pa.array([k[1] for k in keys], pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(tails, pa.list_(pa.int64()))], ["doc_id", "text_key", "k1", "k2", "prefixes", "tails"])
    return sign


def _set_maker(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashed = [word_hashes(t) for t in part.column("text").to_pylist()]
            keys = [text_keys(h) for h in hashed]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                 pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([np.unique(shingle_hashes(h, words)).astype(np.int64) for h in hashed], pa.list_(pa.int64()))],
                ["rep", "k1", "k2", "runs"])
    return sets


def compare(ids, home, prefixes, tree, sets, offsets, cross, threshold):
    """Links of one task: (id, number of links, smallest id it hangs together with) for members that have links.

    ``sets[offsets[i]:offsets[i+1]]`` holds member i.  With ``cross`` only members of different blocks (``home``) are
    compared.  Pairs that share a prefix in an earlier trie are left to that one.
    """
    sizes = np.diff(offsets)
    codes = np.unique(sets, return_inverse=True)[1]
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    for i in range(len(ids) - 1):
        own = codes[offsets[i]:offsets[i + 1]]
        mark[own] = 1
        rest = slice(i + 1, None)
        shared = np.add.reduceat(mark[codes[offsets[i + 1]:]], offsets[i + 1:-1] - offsets[i + 1])
        mark[own] = 0
        near = shared >= threshold * (sizes[i] + sizes[rest] - shared) - 1e-9
        near &= ids[rest] != ids[i]
        if cross:
            near &= home[rest] != home[i]
        if tree and near.any():
            near &= ~(prefixes[rest, :tree] == prefixes[i, :tree]).any(axis=1)
        found = np.flatnonzero(near) + i + 1
        if len(found):
            links[i] += len(found)
            links[found] += 1
            joined = np.unique(np.append(root[found], root[i]))
            root[np.isin(root, joined)] = joined[0]
    linked = np.flatnonzero(links)
    least = {}
    for i in linked:
        least[root[i]] = min(least.get(root[i], ids[i]), ids[i])
    return ids[linked], links[linked], np.array([least[root[i]] for i in linked], np.int64)


def _comparer(threshold: float):
    keys = ["node", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, keys):
            cols = {c: part.column(c).to_numpy() for c in (*keys, "number", "tree", "home", "tail")}
            prefixes = part.column("prefixes").combine_chunks()
            prefixes = prefixes.flatten().to_numpy().reshape(part.num_rows, -1)
            runs = part.column("runs").combine_chunks()
            values = runs.flatten().to_numpy()
            ends = np.append(0, np.cumsum(runs.value_lengths().to_numpy()))
            bounds = run_bounds([cols[k] for k in keys])
            out = []
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s < 2:
                    continue
                order = s + np.lexsort((cols["number"][s:e], cols["tail"][s:e]))  # the trie's order
                order = order[np.sort(np.unique(cols["number"][order], return_index=True)[1])]
                if len(order) < 2:
                    continue
                sets = np.concatenate([values[ends[i]:ends[i + 1]] for i in order])
                offsets = np.append(0, np.cumsum(ends[order + 1] - ends[order]))
                out.append(compare(
                    cols["number"][order], cols["home"][order], prefixes[order], int(cols["tree"][s]), sets, offsets,
                    cols["low"][s] != cols["high"][s], threshold))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(3)], ["number", "links", "other"])
    return run


def _placed(
    docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
    recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """Every row of ``docs`` as (doc_id, text_key) with its node and class; ``stays``: the row that stands for its class."""
    stop = stop_depth(trees, depth, threshold, recall)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_signer(words, trees, depth, stop), _SIGNED), "signed")
    texts = signed.filter("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "text_key")).alias("least"), F.count(F.lit(1)).alias("n_copies"),
        F.first("prefixes").alias("prefixes"), F.first("tails").alias("tails"))
    texts = stored(
        texts.select("k1", "k2", F.col("least.doc_id").alias("rep"), F.col("least.text_key").alias("rep_key"), "n_copies", "prefixes", "tails")
        .withColumn("number", F.monotonically_increasing_id()), "texts")

    own = ["number", "rep", "k1", "k2"]  # a doc_id can have several texts: only with its keys it names one
    nodes = texts.select(*own, "prefixes", "tails", F.posexplode("prefixes").alias("tree", "prefix")).select(
        *own, "tree", F.xxhash64("tree", "prefix").alias("node"), F.element_at("tails", F.col("tree") + 1).alias("tail"),
        "prefixes")
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sizes = stored(sizes, "sizes")
    crowd = stored(nodes.join(side(sizes), "node"), "crowd")
    wanted = stored(crowd.select("rep").distinct(), "wanted")
    sets = docs.join(side(wanted.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(
        _set_maker(words), "rep bigint, k1 bigint, k2 bigint, runs array<bigint>")
    blocks = F.ceil(F.col("size") / block).cast("int")
    spread = (
        crowd.withColumn("home", F.pmod(F.xxhash64("number"), blocks).cast("int"))
        .withColumn("mate", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*own, "tree", "node", "tail", "home", "prefixes",
                F.least("home", "mate").alias("low"), F.greatest("home", "mate").alias("high"))
    )
    tasks = spread.join(sets, ["rep", "k1", "k2"]).drop("rep", "k1", "k2")
    found = (
        tasks.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high")
        .mapInArrow(_comparer(threshold), "number bigint, links bigint, other bigint")
    )
    found = stored(found, "found")
    links = stored(found.groupBy("number").agg(F.sum("links").alias("n_links")), "links")
    classes = components(found.select(F.col("number").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "number")
    classes = stored(classes.join(texts.select("number", "rep", "rep_key"), "number"), "members")
    heads = stored(classes.groupBy("component").agg(F.min(F.struct("rep", "rep_key")).alias("head")), "heads")
    classes = classes.join(side(heads), "component").select("number", "head")

    linked = texts.select("k1", "k2", "number", "rep", "rep_key", "n_copies").join(links, "number", "left").join(classes, "number", "left")
    linked = linked.withColumn("head", F.coalesce("head", F.struct("rep", "rep_key"))).drop("number", "rep_key")
    linked = stored(linked, "linked")
    alone = F.col("doc_id").isNull() | F.col("head").isNull()
    return signed.select("doc_id", "text_key", "k1", "k2").join(linked, ["k1", "k2"], "left").withColumn(
        "stays", alone | ((F.col("doc_id") == F.col("head.rep")) & (F.col("text_key") == F.col("head.rep_key"))))


def ngram_join(docs: DataFrame, **options) -> DataFrame:
    """Near-copy classes of ``docs`` (doc_id, text), one row per row of ``docs``; see the module."""
    known = F.col("rep").isNotNull()
    return _placed(docs, **options).select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("head.rep", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("copy_of"),
        F.when(known & F.col("doc_id").isNotNull(), F.col("n_copies")).otherwise(1).alias("n_copies"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but the first row (smallest doc_id) of each class; rows without doc_id stay.

    Rows that repeat both doc_id and text are one document; of a doc_id with several texts each is judged by its own class.
    """
    found = stored(_placed(docs, **options).select("doc_id", "text_key", "stays"), "classes")
    spare = stored(
        found.filter("not stays").select(F.col("doc_id").alias("_spare"), F.col("text_key").alias("_key")).distinct(), "spare")
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = side(stored(again, "again"))
    spare = side(spare)
    same = (docs["doc_id"].cast("bigint") == spare["_spare"]) & (F.xxhash64(docs["text"].cast("string")) == spare["_key"])
    kept = docs.join(spare, same, "left_anti").select(*docs.columns)
    once = kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
