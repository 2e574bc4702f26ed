"""Building blocks that keep work balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from recordloom.session import durable

_ROW_BITS = 33


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one that is last in ``order``, with ``hits`` = rows seen for the key.

    An aggregate rather than a window: each task first reduces its own rows of a hot key to one.
    """
    rest = [name for name in df.columns if name not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"),
        F.count(F.lit(1)).alias("hits"),
    )
    return picked.select(*keys, *[F.col("_row")[name].alias(name) for name in rest], "hits")


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in the total order, without sorting in one task.

    ``order`` must end in a unique key: it then splits ties over the range partitions too.  The
    sorted rows are written to the checkpoint folder, so the numbering cannot change when a lost
    executor makes Spark sample the ranges again.
    """
    ordered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    ordered = durable(ordered)
    part = F.shiftright("_place", _ROW_BITS)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition, so this window and the broadcast are bounded by their number
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, row + F.col("_offset") + 1)
        .drop("_part", "_place", "_offset")
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "place", salts: int = 64
) -> DataFrame:
    """First ``n`` rows of every group, numbered.  A hot group is first cut down inside salts.

    A row among the first ``n`` of its group is among the first ``n`` of its salt, so nothing is lost
    and one task never sorts more than ``salts * n`` rows of a group.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    local = Window.partitionBy(*group, "_salt").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_local", F.row_number().over(local))
        .filter(F.col("_local") <= n)
        .withColumn(name, F.row_number().over(final).cast("bigint"))
        .filter(F.col(name) <= n)
        .drop("_salt", "_local")
    )


def parts_for(rows: DataFrame, each: int) -> int:
    """Partitions of at most about ``each`` rows, so that what a task holds does not grow with the table; the session's number at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def page(df: DataFrame, order: Sequence[Column], start: int, size: int, name: str = "rank") -> DataFrame:
    """Rows ``start`` .. ``start + size - 1`` of any total order, all of which is numbered; ``selected_page`` sorts less."""
    return global_rank(df, order, name).filter(F.col(name).between(start, start + size - 1))


def _before(names: Sequence[str], descending: Sequence[bool], bound: Row) -> Column:
    """Whether a row stands before ``bound`` in the order of some columns, nulls last."""
    earlier, equal = F.lit(False), F.lit(True)
    for name, desc, value in zip(names, descending, bound):
        column, other = F.col(name), F.lit(value)
        ahead = column.isNotNull() if value is None else F.coalesce(column > other if desc else column < other, F.lit(False))
        earlier = earlier | (equal & ahead)
        equal = equal & column.eqNullSafe(other)
    return earlier


def _sorting(names: Sequence[str], descending: Sequence[bool]) -> list[Column]:
    return [F.col(n).desc_nulls_last() if desc else F.col(n).asc_nulls_last() for n, desc in zip(names, descending)]


def selected_page(
    df: DataFrame, names: Sequence[str], descending: Sequence[bool], start: int, size: int, name: str = "rank", most: int = 100_000,
    sample: int = 4096,
) -> DataFrame:
    """Rows ``start`` .. ``start + size - 1`` in the order of some columns (nulls last), the last of them unique.

    What fits into ``most`` rows from the top is taken by a top-k in every task.  A deeper page is selected: of a bounded sample two rows are
    taken between which the page should lie, an exact count says whether it does, and the rows between them are searched
    in the same way until at most ``most`` are left to sort.  Nothing else is sorted and nothing is written.
    """
    order, last = _sorting(names, descending), start + size - 1
    ranked = F.row_number().over(Window.orderBy(*order))  # over a bounded number of rows
    if last <= most:
        return df.orderBy(*order).limit(last).withColumn(name, ranked.cast("bigint")).filter(F.col(name) >= start)
    rows, before, left = df, 0, df.count()
    if left < start:
        return df.limit(0).withColumn(name, F.lit(0).cast("bigint"))
    margin, last = 3 * sample**0.5, min(last, left)
    while left > most and margin < sample:
        some = rows.select(*names).orderBy(F.xxhash64(*names), *order).limit(sample).orderBy(*order).collect()
        low = int((start - 1 - before) / left * len(some) - margin)
        high = int((last - before) / left * len(some) + margin) + 1
        kept = F.lit(True)
        if low > 0:
            kept = kept & ~_before(names, descending, some[low])
        if high < len(some):
            kept = kept & _before(names, descending, some[high])
        ahead = _before(names, descending, some[low]) if low > 0 else F.lit(False)
        found = rows.agg(F.count_if(ahead).alias("ahead"), F.count_if(kept).alias("kept")).first()
        inside = before + found.ahead < start and last <= before + found.ahead + found.kept
        if inside and found.kept < left:
            rows, before, left = rows.filter(kept), before + found.ahead, found.kept
        else:
            margin *= 2
    if left > most:
        return global_rank(rows, order, name).withColumn(name, F.col(name) + before).filter(F.col(name).between(start, last))
    return rows.withColumn(name, ranked.cast("bigint") + before).filter(F.col(name).between(start, last))
