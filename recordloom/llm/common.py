"""What several operators share: written tables, size checks, word hashes, whole groups, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tasks of a stage over files or blocks: beyond it a task takes more of them.
MOST_TASKS = 50_000

# Rows of a side that may be broadcast; every use counts the side first and has a shuffled join beyond it.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _own_folder() -> str:
    """One folder per process, for tests; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="recordloom-llm-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; a machine-local one only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors do not replay what made it."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write ``df`` in buckets of ``key``: a join by it, or its groups, read the buckets where they lie and shuffle nothing.

    Only a table of the catalogue has buckets; its entry goes at once, the files stay where they are read from.
    """
    spark = df.sparkSession
    entry, buckets = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", new_folder(spark, name)).saveAsTable(entry)
    found = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return found


def side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The small side of a join: broadcast if it was counted to fit, else left to a shuffled join.

    ``df`` should be a written table: it is counted here and read again by the join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


@lru_cache(1)
def _is_word() -> np.ndarray:
    """By code point: part of a word, as in the regular expression for word characters."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        powers = np.full(1 << bits, factor, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def word_places(lowered: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a text in lower case, and where its words start and end."""
    letters = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(letters) + 2, bool)
    inside[1:-1] = _is_word()[letters]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return letters, edges[::2], edges[1::2]


def hashes_at(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each stretch of letters, the same wherever it stands."""
    up, down = _powers(max(20, len(letters).bit_length()))
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * up[:len(letters)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each lower-case word of a whole text, in order; a null text has none.

    The hash of a word is a polynomial of its letters, taken as the difference of two sums over the text's letters: no string
    is made for it.
    """
    if not text:
        return np.zeros(0, np.uint64)
    return hashes_at(*word_places(text.lower()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash per run of ``n`` words, in order; a text of fewer words, but not none, is one run."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    size = len(hashes) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + size]
    return mix(out + np.uint64(n))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: texts become Python strings a slice at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Cut sorted batches anew so that no run of equal integer keys spans two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            changed[0] = any(last.column(k)[last.num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys)
        cuts = np.flatnonzero(changed)
        if not len(cuts):
            held.append(batch)
            continue
        cut = int(cuts[-1])
        ready = [*held, batch.slice(0, cut)] if cut else held
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_bounds(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Start of every run of equal keys, and the end."""
    n = len(columns[0])
    changed = np.ones(n, bool)
    changed[1:] = False
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(changed), n)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (node, component); the component is its smallest node.

    Alternating large-star and small-star rounds until nothing moves.  Each round is a written table, so
    the joins read plain files on both sides and adaptive execution can split a hub.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
