"""Whitening of embeddings along the leading eigenvectors of their covariance, found by slicing the spectrum.

Entries become integers, x = floor(256 c).  The covariance is that of the distinct vectors of integers: their sums S are exact, each vector is
centred at the integers nearest to S / n, the products of centred entries are added exactly, and what the rounding of the centre leaves is taken off
exactly, so every entry of the covariance is rounded once.

Eigenvalues are found by counting.  The LDL' factors of V - s I (Bunch-Kaufman pivots) have as many positive pivots as V has eigenvalues above s.
Bisection by these counts isolates the k-th eigenvalue from the top; inverse iteration from the middle of its interval and Rayleigh quotient iteration
give it and its vector, cubically; if it leaves the interval, the interval is cut further.  Two more counts, just above and just below, certify that it is
the k-th.  Eigenvalues that no shift can tell apart get orthogonal vectors of their common space.

Scale.  One shuffle makes the vectors distinct (a vector that many rows share is one group that shrinks before the shuffle); two passes over
the written list add sums in a tree, a third measures the covariance of the result.  The driver holds d x d numbers and the factors, whatever the
number of rows; a task holds a batch and d x d numbers.

Results.  One row per row that takes part and component: ``vec_id``, ``component`` (from 1), ``n`` (distinct vectors), ``deviation`` (exact sum of (n x - S)^2;
null beyond 64 bits), ``whitened``, ``explained``, ``identity_error``.  Rows whose vector is null, empty, of another length than most (ties: the shorter) or
holds null or non-finite entries are dropped.  A repeated row comes again; vec_id may be null.  Equal eigenvalues may be numbered either way.  Only components of positive
variance exist: equal vectors throughout, or an empty table, give no row.  Columns besides vec_id and the vector, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import stored
from recordloom.llm.perfect_hash import tree_sum

COMPONENTS, SCALE = 4, 256
EPS = float(np.finfo(float).eps)
_ALPHA = (1 + math.sqrt(17)) / 8
_LIMBS, _MASK = 5, (1 << 32) - 1


# ---- eigenvalues by counting ------------------------------------------------------------

class Factors:
    """P (A) P' = L D L' of a symmetric matrix, with blocks of one and two in D."""

    def __init__(self, matrix: np.ndarray):
        a = self.a = matrix.copy()
        n = len(a)
        self.order, self.blocks = np.arange(n), []
        k = 0
        while k < n:
            size = self._pivot(k)
            block, below = a[k:k + size, k:k + size], a[k + size:, k:k + size]
            if size == 2 or block[0, 0] != 0:
                left = below @ np.linalg.inv(block)
                a[k + size:, k + size:] -= left @ below.T
                a[k + size:, k:k + size] = left
            self.blocks.append((k, size))
            k += size

    def _pivot(self, k: int) -> int:
        """Bring a good pivot to place k; the number of its rows."""
        a = self.a
        if k == len(a) - 1:
            return 1
        column = np.abs(a[k + 1:, k])
        r = k + 1 + int(column.argmax())
        most, own = column[r - k - 1], abs(a[k, k])
        if own >= _ALPHA * most:
            return 1
        row = np.abs(a[r, k:])
        row[r - k] = 0
        other = row.max()
        if own * other >= _ALPHA * most**2:
            return 1
        size = 1 if abs(a[r, r]) >= _ALPHA * other else 2
        self._swap(k + size - 1, r)
        return size

    def _swap(self, i: int, j: int) -> None:
        if i != j:
            self.a[[i, j]] = self.a[[j, i]]
            # earlier columns hold L, whose rows move; later ones are the rest of the matrix, whose columns move, too
            done = self.blocks[-1][0] + self.blocks[-1][1] if self.blocks else 0
            self.a[done:, [i, j]] = self.a[done:, [j, i]]
            self.order[[i, j]] = self.order[[j, i]]

    def positive(self) -> int:
        """Number of positive eigenvalues (Sylvester: that of D)."""
        return sum(int((np.linalg.eigvalsh(self.a[k:k + s, k:k + s]) > 0).sum()) for k, s in self.blocks)

    def solve(self, right: np.ndarray, floor: float) -> np.ndarray:
        """x of A x = right; pivots smaller than ``floor`` are taken as ``floor``."""
        a, x = self.a, right[self.order].copy()
        for k, s in self.blocks:
            x[k + s:] -= a[k + s:, k:k + s] @ x[k:k + s]
        for k, s in self.blocks:
            values, vectors = np.linalg.eigh(a[k:k + s, k:k + s])
            values = np.where(np.abs(values) < floor, np.where(values < 0, -floor, floor), values)
            x[k:k + s] = vectors @ ((vectors.T @ x[k:k + s]) / values)
        for k, s in reversed(self.blocks):
            x[k:k + s] -= a[k + s:, k:k + s].T @ x[k + s:]
        out = np.empty_like(x)
        out[self.order] = x
        return out


class Slicer:
    """Leading eigenvalues and eigenvectors of a positive semidefinite matrix, numbered from the top."""

    def __init__(self, matrix: np.ndarray):
        self.v = matrix
        self.norm = max(float(np.abs(matrix).sum(axis=1).max()), np.finfo(float).tiny)
        self.close = 8 * len(matrix) * EPS * self.norm  # shifts nearer than that count alike
        self.counts: dict[float, int] = {self.norm * 1.01: 0, -self.close: len(matrix)}
        self.found: list[tuple[float, np.ndarray]] = []

    def above(self, shift: float) -> int:
        """Number of eigenvalues above ``shift``."""
        if shift not in self.counts:
            self.counts[shift] = Factors(self.v - shift * np.eye(len(self.v))).positive()
        return self.counts[shift]

    def _free(self, x: np.ndarray) -> np.ndarray:
        """Unit vector of x without its parts along the eigenvectors found."""
        for _ in range(2):
            for _, u in self.found:
                x = x - (u @ x) * u
        return x / np.linalg.norm(x)

    def _step(self, shift: float, x: np.ndarray) -> np.ndarray:
        y = Factors(self.v - shift * np.eye(len(self.v))).solve(x, EPS * self.norm)
        return self._free(y / np.abs(y).max())

    def next(self) -> tuple[float, np.ndarray]:
        """The next eigenvalue from the top, and its unit vector (its largest entry positive)."""
        k = len(self.found) + 1
        low = max(s for s, c in self.counts.items() if c >= k)
        high = min(s for s, c in self.counts.items() if c < k)
        seed = np.random.default_rng(k).normal(size=len(self.v))
        while True:
            middle = (low + high) / 2
            alone = self.above(low) == k and self.above(high) == k - 1
            narrow = high - low <= self.close
            if alone or narrow:
                value, x = self._refine(middle, self._free(seed), narrow)
                if low - self.close <= value <= high + self.close and self._settled(value, x) and self._certified(value, k):
                    break
                if narrow:
                    raise ArithmeticError(f"eigenvalue {k} was not found in its interval")
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
        x = x * np.sign(x[np.abs(x).argmax()])
        self.found.append((value, x))
        return value, x

    def _refine(self, shift: float, x: np.ndarray, narrow: bool) -> tuple[float, np.ndarray]:
        for _ in range(4 if narrow else 2):
            x = self._step(shift, x)
        value = float(x @ self.v @ x)
        for _ in range(0 if narrow else 12):
            if self._settled(value, x):
                break
            x = self._step(value, x)
            value = float(x @ self.v @ x)
        return value, x

    def _settled(self, value: float, x: np.ndarray) -> bool:
        return float(np.linalg.norm(self.v @ x - value * x)) <= self.close

    def _certified(self, value: float, k: int) -> bool:
        return self.above(value + 2 * self.close) < k <= self.above(value - 2 * self.close)


def leading(matrix: np.ndarray, components: int) -> list[tuple[float, np.ndarray]]:
    """At most so many (eigenvalue, vector) with positive eigenvalue, the largest first."""
    if not len(matrix) or not matrix.any():
        return []
    slicer = Slicer(matrix)
    least = 4 * slicer.close
    count = min(components, slicer.above(least))
    return [slicer.next() for _ in range(count)]


# ---- exact sums in Spark ----------------------------------------------------------------

def _limbs(values: np.ndarray) -> np.ndarray:
    """Integers as sums of limbs times powers of 2**32, so that sums of limbs stay within 64 bits."""
    out = np.zeros((_LIMBS, len(values)), np.int64)
    if values.dtype == object:
        for k in range(_LIMBS):
            out[k] = [(int(v) >> 32 * k) & _MASK if k < _LIMBS - 1 else int(v) >> 32 * k for v in values]
    else:
        out[0], out[1] = values & _MASK, values >> 32
    return out


def _integers(limbs: np.ndarray) -> list[int]:
    return [sum(int(x) << 32 * k for k, x in enumerate(column)) for column in limbs.reshape(_LIMBS, -1).T]


def _pack(vector: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(vector.tobytes())


def _unpack_as(kind: str):
    def unpack(packed: bytes) -> np.ndarray:
        import zstandard

        return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)
    return unpack


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


def _partial(block: int, vector: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part]), pa.array([_pack(vector)], pa.binary())], names=["block", "part", "vector"])


_PARTIAL = "block bigint, part bigint, vector binary"


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: number of vectors, and limbs of the sums of their entries."""
    count, total = 0, None
    for rows in batches:
        x = _matrix(rows.column(0))
        if not len(x):
            continue
        count += len(x)
        part = np.concatenate([(x & _MASK).sum(axis=0), (x >> 32).sum(axis=0)])
        total = part if total is None else total + part
    if total is not None:
        yield _partial(0, np.append(count, total))


def _squares(y: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Exact products of entries, summed over slices of the rows that double precision can add without rounding."""
    most = max(abs(int(y.max())), abs(int(y.min())))
    rows = (1 << 53) // max(1, most * most)
    if rows == 0:
        wide = y.astype(object)
        yield wide[:, :least].T @ wide
        return
    for start in range(0, len(y), rows):
        z = y[start:start + rows].astype(np.float64)
        yield (z.T @ z).astype(np.int64)


def _multiplier(centre: list[int]):
    """Per task and dimension: limbs of the sums of centred products, and of the centred sums in a block of their own."""
    shift = np.array(centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(shift)
        total = np.zeros((d, _LIMBS, d), np.int64)
        sums = np.zeros((_LIMBS, d), np.int64)
        seen = False
        for rows in batches:
            x = _matrix(rows.column(0))
            if not len(x):
                continue
            seen = True
            y = _centred(x, shift)
            for products in _squares(y, d):
                for i in range(d):
                    total[i] += _limbs(products[i])
            sums += _limbs(y.sum(axis=0))
        if seen:
            for i in range(d):
                yield _partial(i, total[i])
            yield _partial(d, sums)
    return run


def _centred(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift; as Python integers where 64 bits would not hold it."""
    if x.size and max(abs(int(x.max())), abs(int(x.min()))) >= 1 << 62:
        return x.astype(object) - shift.astype(object)
    return x - shift


def _whitened(y: np.ndarray, offset: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (y.astype(np.float64) - offset) @ axes


def _measurer(centre: list[int], offset: np.ndarray, axes: np.ndarray):
    """Per task: sums of the products of whitened coordinates, whose mean is zero by construction."""
    shift = np.array(centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((axes.shape[1], axes.shape[1]))
        for rows in batches:
            x = _matrix(rows.column(0))
            if len(x):
                w = _whitened(_centred(x, shift), offset, axes)
                total += w.T @ w
        yield _partial(0, total.ravel())
    return run


def _deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sums of (n y - rest)**2, exact; None beyond 64 bits."""
    most = max((abs(int(v)) for v in (y.max(), y.min())), default=0) if y.size else 0
    far = max(map(abs, rest))
    if y.dtype == object or len(rest) * max(most, 1) * max(most, far) >= 1 << 62:
        y = y.astype(object)
    own = np.array(rest, object) if y.dtype == object else np.array(rest, np.int64)
    squares, crossed, constant = (y * y).sum(axis=1), (y * own).sum(axis=1), sum(r * r for r in rest)
    out = [n * n * int(a) - 2 * n * int(b) + constant for a, b in zip(squares.tolist(), crossed.tolist())]
    return [v if v < 1 << 63 else None for v in out]


def _writer(centre: list[int], rest: list[int], n: int, axes: np.ndarray, explained: list[float], error: float):
    shift, offset, k = np.array(centre, np.int64), np.array([r / n for r in rest]), axes.shape[1]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = _matrix(rows.column(1))
            if not len(x):
                continue
            y = _centred(x, shift)
            count = len(x) * k
            yield pa.RecordBatch.from_arrays([
                rows.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(count, n)),
                pa.array([v for v in _deviations(y, n, rest) for _ in range(k)], pa.int64()),
                pa.array(_whitened(y, offset, axes).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(count, error)),
            ], names=names)
    return run


def integer_vectors(table: DataFrame, column: str) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    vector = F.col(column).cast("array<double>")
    fine = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("v")).filter(
        (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    length = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    whole = F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(0).cast("bigint"))
    return fine.filter(F.size("v") == (length.n if length else 0)).select("vec_id", whole.alias("x"))


def whiten(table: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error); see the module."""
    spark = table.sparkSession
    rows = integer_vectors(table, column)
    kind = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = stored(rows.select("x").distinct(), "fit")
    sums = stored(fit.mapInArrow(_adder, _PARTIAL), "sums")
    parts = sums.count()
    if not parts:
        return spark.createDataFrame([], kind)
    whole = _unpack_as("<i8")
    total = whole(bytes(tree_sum(sums, parts, whole, _pack).first().vector))
    n, low, high = int(total[0]), *np.split(total[1:], 2)
    sums = [int(a) + (int(b) << 32) for a, b in zip(low, high)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = tree_sum(stored(fit.mapInArrow(_multiplier(centre), _PARTIAL), "products"), parts, whole, _pack)
    by_row = {r.block: _integers(whole(bytes(r.vector))) for r in products.collect()}  # a row per dimension
    d = len(sums)
    rest = by_row.pop(d)  # the sums of what is left after centring: S - n centre
    covariance = np.array([[(n * by_row[i][j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    found = leading(covariance, components)
    if not found:
        return spark.createDataFrame([], kind)
    axes = np.stack([u / math.sqrt(e) for e, u in found], axis=1)
    offset = np.array([r / n for r in rest])
    measured = fit.mapInArrow(_measurer(centre, offset, axes), _PARTIAL)
    again = _unpack_as("<f8")
    cross = again(bytes(tree_sum(measured, parts, again, _pack).first().vector)).reshape(len(found), -1) / n
    error = float(np.abs(cross - np.eye(len(found))).max())
    explained = [e / float(np.trace(covariance)) for e, _ in found]
    return rows.mapInArrow(_writer(centre, rest, n, axes, explained, error), kind)
