"""Approximate nearest neighbours: a permutation index.

A vector is represented by the order in which it sees the pivots, nearest first.  It is posted in the inverted files of its ``NEAR`` nearest
pivots.  A query reads the files of its own ``NEAR`` nearest pivots; what stands in at least ``SHARED`` of them is a candidate.  Candidates are ranked by
footrule distance (sum of the differences of the pivots' places in the two orders), and the best of them again by exact Euclidean distance in double
precision on the original vectors: ``LEAST`` first, then ``GROW`` times as many, until ``GROW`` times as many bring nothing nearer.  So the footrule decides
what is compared, and a tight cluster, whose members it cannot tell apart, is searched as far as it helps.

Scale.  Pivots are chosen far apart from a bounded sample (the ``SAMPLE`` vectors with the smallest hash); every vector is indexed.  Equal vectors are one
entry, so a vector that a third of all rows share is one entry and one query; of its ids the smallest ``k`` + 1 are kept, which is all a
result can hold.  Entries are sorted by the prefix of their order and cut into blocks of ``BLOCK``, queries into chunks of ``CHUNK``, so that a block holds
vectors with the same nearest pivots.  Files are kept at two levels: for each pair of pivots, the blocks that hold a vector posted under both, and inside a
block the vectors.  A chunk of queries visits the blocks with which it shares a pair, no other block can hold a candidate; how many these are
follows from how the vectors cluster, not from the size of the table (vectors without any structure share pairs with all blocks).  One
task holds one block and one chunk, and answers with k + 1 rows per query.  A query that found fewer than k visits all blocks, without files.

Results.  For each query row (vec_id divisible by ``every``) its ``k`` nearest found, never itself: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``
(distance); ties go to the smaller vec_id.  Vectors that are null, empty, zero, of another length than most or that hold null or non-finite
components take no part, neither do rows without vec_id.  A row repeated with the same id and vector counts once.  If one id has several vectors,
each is searched, and each is found.  With fewer candidates than k all are returned; an empty table gives no row.  Columns besides vec_id and the vector,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import stored
from recordloom.operators.shuffle import global_rank

SAMPLE, PIVOTS, NEAR, SHARED, LEAST, GROW, BLOCK, CHUNK = 4096, 256, 20, 2, 64, 3, 8192, 1024


def distances(vectors: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - one) ** 2).sum(axis=1))


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of every pivot in each vector's order, nearest first (ties: the first pivot)."""
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T
    order = np.argsort(squares, axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(len(pivots))[None], axis=1)
    return out.astype(np.int16)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` vectors far from each other: always the one farthest from those chosen (ties: the first), so near copies give one."""
    if len(sample) <= n:
        return sample
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def search_block(
    vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, near: int = NEAR, shared: int = SHARED, least: int = LEAST,
    all_of_it: bool = False,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places in ``vectors`` of its k nearest found, and their distances; ``all_of_it`` ranks the whole block."""
    own, asked = places(vectors, pivots), places(queries, pivots)
    files = [np.flatnonzero(own[:, p] < near) for p in range(len(pivots))]
    results = []
    for query, order in zip(queries, asked):
        at = np.arange(len(vectors))
        if not all_of_it:
            read = [files[p] for p in np.flatnonzero(order < near)]
            posted = np.flatnonzero(np.bincount(np.concatenate(read), minlength=len(vectors)) >= shared)
            at = posted if len(posted) >= k else at
        footrule = np.abs(own[at] - order).sum(axis=1, dtype=np.int32)
        at = at[np.argsort(footrule, kind="stable")]
        best, exact, size = at[:0], np.zeros(0), 0
        while size < len(at):
            more = at[size:len(at) if all_of_it else max(GROW * size, least, k)]
            size += len(more)
            known, best = best, np.append(best, more)
            exact = np.append(exact, distances(vectors[more], query))
            first = np.lexsort((ids[best], exact))[:k]
            best, exact = best[first], exact[first]
            if len(known) and not np.isin(best, more).any():
                break
        results.append((best, exact))
    return results


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _searcher(pivots: np.ndarray, k: int, options: dict):
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        if block.num_rows and queries.num_rows:
            first, second = (block.column(c).to_numpy() for c in ("k1", "k2"))
            found = search_block(_matrix(block.column("vector")), first, _matrix(queries.column("vector")), pivots, k, **options)
            for q1, q2, (at, exact) in zip(queries.column("k1").to_pylist(), queries.column("k2").to_pylist(), found):
                for column, values in zip(columns, ([q1] * len(at), [q2] * len(at), first[at], second[at], exact)):
                    column.extend(values)
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("q1", "q2", "k1", "k2", "score"), columns, kinds)})
    return run


def _orderer(pivots: np.ndarray, near: int):
    """Add the nearest pivots of each vector, in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            order = np.zeros((rows.num_rows, 0), np.int16)
            if rows.num_rows:
                order = np.argsort(places(_matrix(pa.chunked_array([rows.column("vector")])), pivots), axis=1)[:, :near].astype(np.int16)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(order), pa.list_(pa.int16()))], names=[*rows.schema.names, "near"])
    return run


def _pairs(name: str):
    """The pairs of near pivots that occur in a block (or chunk), once per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            near = np.sort(np.array(rows.column("near").to_pylist(), np.int64).reshape(rows.num_rows, -1), axis=1)
            i, j = np.triu_indices(near.shape[1], 1)
            if not len(i):  # a single pivot
                i = j = np.zeros(min(1, near.shape[1]), np.int64)
            group = np.repeat(rows.column(name).to_numpy(), len(i))
            found = np.unique(np.stack([group, (near[:, i] << 16 | near[:, j]).ravel()]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=[name, "pair"])
    return run


def in_blocks(entries: DataFrame, name: str, size: int) -> DataFrame:
    """Written rows in the order of their nearest pivots, with the number of the block of ``size`` that each lies in, however they are partitioned."""
    first = [F.get("near", F.lit(i)) for i in range(4)]
    ranked = global_rank(entries, [*first, F.col("k2"), F.col("k1")], "_rank")
    return stored(ranked.withColumn(name, F.floor((F.col("_rank") - 1) / size)).drop("_rank"), name)


def valid(table: DataFrame, column: str) -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part."""
    vector = F.col(column).cast("array<double>")
    fine = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")).filter(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0))
    length = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.filter(F.size("vector") == (length.n if length else 0))


def nearest(
    table: DataFrame, k: int = 10, every: int = 100, column: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK, **options,
) -> DataFrame:
    """(query_id, rank, vec_id, score); see the module."""
    rows = valid(table, column).withColumn("k2", F.xxhash64("vector"))
    rows = stored(rows.dropDuplicates(["vec_id", "k2"]), "vectors")
    # an entry per distinct vector, named by its smallest id, and as many of its ids as a result can hold
    named = rows.groupBy("k2", "vector").agg(F.min("vec_id").alias("k1"), F.max(F.col("vec_id") % every == 0).alias("asks"))
    by_id = Window.partitionBy("k2", "vector").orderBy("vec_id")
    held = rows.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1).drop("n")
    some = named.select("k1", "k2", "vector").orderBy("k2", "k1").limit(max(SAMPLE, pivots)).select("vector").toArrow()  # a bounded number of rows
    matrix = choose_pivots(_matrix(some.column("vector")), pivots) if some.num_rows else np.zeros((0, 1))
    kind = "k1 bigint, k2 bigint, vector array<double>, asks boolean, near array<smallint>"
    ordered = named.select("k1", "k2", "vector", "asks").mapInArrow(_orderer(matrix, options.get("near", NEAR)), kind)
    entries = in_blocks(ordered, "block", block)
    asked = in_blocks(entries.filter("asks").drop("asks", "block"), "chunk", chunk)

    # which chunks and blocks share a pair of pivots, and their search
    of_blocks = entries.select("block", "near").mapInArrow(_pairs("block"), "block bigint, pair bigint").distinct()
    of_chunks = asked.select("chunk", "near").mapInArrow(_pairs("chunk"), "chunk bigint, pair bigint").distinct()
    meets = stored(of_blocks.join(of_chunks, "pair").select("block", "chunk").distinct(), "meets")
    shape = "q1 bigint, q2 bigint, k1 bigint, k2 bigint, score double"

    def search(queries: DataFrame, meets: DataFrame, **more) -> DataFrame:
        left = entries.select("k1", "k2", "vector", "block").join(meets, "block")
        right = queries.select("k1", "k2", "vector", F.col("chunk").alias("c")).join(
            meets.select(F.col("block").alias("b"), F.col("chunk").alias("c")), "c")
        found = left.groupBy("block", "chunk").cogroup(right.groupBy("b", "c")).applyInArrow(_searcher(matrix, k + 1, options | more), shape)
        best = Window.partitionBy("q1", "q2").orderBy("score", "k1")
        return stored(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n"), "found")

    found = search(asked, meets)
    full = found.groupBy("q1", "q2").count().filter(F.col("count") > k).select(F.col("q1").alias("k1"), F.col("q2").alias("k2"))
    short = stored(asked.join(full, ["k1", "k2"], "left_anti"), "short")
    if not short.isEmpty():
        everywhere = short.select("chunk").distinct().crossJoin(entries.select("block").distinct())  # names of chunks and blocks only
        found = found.join(short.select(F.col("k1").alias("q1"), F.col("k2").alias("q2")), ["q1", "q2"], "left_anti").unionByName(
            search(short, everywhere, all_of_it=True))

    # the ids of the entries found, then each query without itself
    members = held.join(named.select("k2", "vector", "k1"), ["k2", "vector"]).select("k1", "k2", "vec_id")
    near = found.join(members, ["k1", "k2"]).select("q1", "q2", "vec_id", "score").withColumn(
        "n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "vec_id"))).filter(F.col("n") <= k + 1)
    asking = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "k2", "vector")
    keyed = asking.join(asked.select("k1", "k2", "vector"), ["k2", "vector"]).select("query_id", F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    ranked = keyed.join(stored(near.drop("n"), "near"), ["q1", "q2"]).filter("vec_id <> query_id").dropDuplicates(
        ["query_id", "vec_id", "score"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
