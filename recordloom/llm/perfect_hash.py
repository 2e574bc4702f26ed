"""Minimal perfect hashing of 64-bit keys, and sums of count vectors in a tree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import mix, stored

ROOM = 2  # places in a level for each key that reaches it


class PerfectHash:
    """Distinct keys to the numbers from 0 on, each once; levels of bits, as long as keys are left.

    In a level each key has a place by its hash.  A key that is alone in its place sets the bit there; the others go to the next level.  The
    number of a key is the number of bits set before its own, over all levels.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(words) for words in levels]
        sums = np.cumsum(np.concatenate(counts), dtype=np.int64) if counts else np.zeros(0, np.int64)
        before = np.append(0, sums)[:-1] if len(sums) else sums
        self.before = np.split(before, np.cumsum([len(x) for x in levels])[:-1]) if levels else []
        self.size = int(sums[-1]) if len(sums) else 0

    @staticmethod
    def _places(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        salted = mix(keys ^ mix(np.full(1, level + 1, np.uint64)))
        return salted % np.uint64(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys)
        while len(left):
            words = -(-ROOM * len(left) // 64)
            places = cls._places(left, len(levels), words)
            _, which, count = np.unique(places, return_inverse=True, return_counts=True)
            alone = count[which] == 1
            bits = np.zeros(64 * words, np.uint8)
            bits[places[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; a key that was not built in gets any number or -1, so callers compare the key kept there."""
        out = np.full(len(keys), -1, np.int64)
        at, one = np.arange(len(keys)), np.uint64(1)
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            places = self._places(keys[at], level, len(words))
            word, bit = (places >> np.uint64(6)).astype(np.int64), places & np.uint64(63)
            hit = (words[word] >> bit) & one == one
            below = np.bitwise_count(words[word[hit]] & ((one << bit[hit]) - one))
            out[at[hit]] = before[word[hit]] + below
            at = at[~hit]
            if not len(at):
                break
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u8")
        return sizes.tobytes() + b"".join(x.astype("<u8").tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        count = int.from_bytes(raw[:8], "little")
        sizes = np.frombuffer(raw, "<u8", count, 8).astype(np.int64)
        body = np.frombuffer(raw, "<u8", int(sizes.sum()), 8 + 8 * count).astype(np.uint64)
        return cls(np.split(body, np.cumsum(sizes)[:-1]) if count else [])


def _adder(unpack: Callable[[bytes], np.ndarray], pack: Callable[[np.ndarray], bytes]):
    def run(rows: pa.Table) -> pa.Table:
        total = None
        for packed in rows.column("vector"):
            vector = unpack(packed.as_py())
            total = vector if total is None else total + vector
        first = rows.slice(0, 1)
        return pa.table({"block": first.column("block"), "part": first.column("part"), "vector": pa.array([pack(total)], pa.binary())})
    return run


def tree_sum(
    vectors: DataFrame, parts: int, unpack: Callable[[bytes], np.ndarray], pack: Callable[[np.ndarray], bytes], fan: int = 32,
) -> DataFrame:
    """(block, vector): sums by block of (block, part, vector), about ``fan`` vectors at a time.

    ``parts`` is about the number of vectors of a block; a task adds one group of them, however many there are.
    """
    kind = "block bigint, part bigint, vector binary"
    groups = 1
    while groups * fan < parts:
        groups *= fan
    rows = vectors.select("block", F.xxhash64("part").alias("part"), "vector")
    while True:
        rows = rows.withColumn("part", F.pmod("part", F.lit(groups)))
        rows = rows.groupBy("block", "part").applyInArrow(_adder(unpack, pack), kind)
        if groups == 1:
            return rows.drop("part")
        rows, groups = stored(rows, "sums"), groups // fan
