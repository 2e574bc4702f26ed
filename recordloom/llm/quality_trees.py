"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

``train`` grows trees on binned statistics (logistic loss, depth-wise, one histogram per node and statistic) and flattens
them into complete binary trees held in three arrays; ``Trees.score`` walks all rows of a batch through a tree at once
by array indexing.

Scale.  The model is fitted on at most ``sample`` labelled documents (a documented bound: those with the smallest hash
of doc_id, so the choice does not depend on order), which is all that reaches the driver.  Scoring is one pass
over the texts without a shuffle; the model is a few kilobytes.

Results.  One row per document: ``held_out`` (never used for learning), ``score`` in 0..1 (higher: label 1 likelier),
``predicted`` = 1 where the score reaches ``CUT``.  A null text counts as empty and has a score like any other; a
document may be scored whether or not it has a label.  Null labels and labels other than 0 and 1 are ignored; of several
labels of one document the lowest counts.  A row without doc_id is scored and not held out.  Without labels the score is 0.5, with
labels of one kind their share.  Only ``text`` enters a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import slices

SAMPLE, ROUNDS, LEVELS, BINS, RATE, CUT = 40_000, 80, 5, 64, 0.15, 0.3
FOLDS, HELD_OUT = 5, 0

_SIGNS = [ord(c) for c in ".,!?|&$#%*:;-_/'\"()[]{}<>=+@"]
FEATURES = (
    "chars", "words", "lines", "word_length", "longest_word", "upper", "lower", "digit", "space", "other_sign", "wide",
    "distinct_words", "top_word", "top_three", "repeated_next", "line_length", "repeated_lines", "ended_lines", "short_words",
    "once_words", *(f"sign_{chr(c)}" for c in _SIGNS),
)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; all zero for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words = text.split()
    n = max(len(words), 1)
    kinds = Counter(words)
    top = [c for _, c in kinds.most_common(3)] or [0]
    lines = [line for line in text.split("\n") if line.strip()]
    m = max(len(lines), 1)
    signs = count[_SIGNS]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), float(lengths.mean()), np.log1p(float(lengths.max())),
        count[65:91].sum() / size, count[97:123].sum() / size, count[48:58].sum() / size, (count[9:14].sum() + count[32]) / size,
        (count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum() - signs.sum()) / size,
        count[128:].sum() / size, len(kinds) / n, top[0] / n, sum(top) / n, sum(map(eq, words, words[1:])) / n,
        np.log1p(len(text) / m), 1 - len(set(lines)) / m if lines else 0.0,
        sum(line.rstrip().endswith((".", "!", "?")) for line in lines) / m, float((lengths <= 2).sum()) / n,
        sum(1 for c in kinds.values() if c == 1) / n, *(signs / size),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """``feature`` and ``cut`` by tree and inner node (children of i: 2i+1, 2i+2), ``leaf`` by tree and leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        levels = (self.leaf.shape[1] - 1).bit_length()
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(levels):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(
    x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, levels: int = LEVELS, bins: int = BINS, rate: float = RATE,
    least: float = 3.0, ridge: float = 1.0,
) -> Trees:
    """Boosted trees for labels 0 and 1.  ``least``: smallest sum of second derivatives on a side of a split."""
    inner, leaves = 2**levels - 1, 2**levels
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        base = 0.0 if len(y) == 0 else (40.0 if share else -40.0)
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    place = binned + np.arange(width) * bins  # cell of a histogram over all statistics
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    model = Trees(base, np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves)))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)  # place within the level
        for level in range(levels):
            many, first = 2**level, 2**level - 1
            cells = (node[:, None] * (width * bins) + place).ravel()
            shape = (many, width, bins)
            g = np.bincount(cells, np.repeat(slope, width), many * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(cells, np.repeat(bend, width), many * width * bins).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
            f, b = best // bins, best % bins
            for k in np.flatnonzero(good):
                if b[k] < len(edges[f[k]]):
                    model.feature[r, first + k], model.cut[r, first + k] = f[k], edges[f[k]][b[k]]
            feature, cut = model.feature[r, first + node], model.cut[r, first + node]
            node = 2 * node + (x[np.arange(n), feature] > cut)
        g, h = np.bincount(node, slope, leaves), np.bincount(node, bend, leaves)
        model.leaf[r] = rate * g / (h + ridge)
        margin += model.leaf[r][node]
    return model


def fold(name: str, folds: int) -> F.Column:
    return F.crc32(F.col(name).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Trees:
    """Trees for the labels outside the held-out fold, from at most ``sample`` labelled documents."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(fold("doc_id", FOLDS) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # ``chosen`` has at most ``sample`` rows of two numbers, and so has what comes back
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", "text").mapInArrow(
        _measure, "doc_id bigint, label int, x array<double>")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("_row")).select("_row.label", "_row.x").toArrow()
    y = got.column("label").to_numpy().astype(float)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the same model whatever the order of the rows
    return train(x[order], y[order], **options)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        x = matrix(part.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").cast(pa.int64()), part.column("_label"), pa.array(list(x), pa.list_(pa.float64()))],
            ["doc_id", "label", "x"])


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = trees.score(matrix(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs`` that are not rejected, whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            good = trees.score(matrix(part.column("text").to_pylist())) >= CUT
            yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
