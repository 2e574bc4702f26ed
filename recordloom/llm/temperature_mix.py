"""Mixing sources to target weights: temperature mixing.

The share of a source is raised to an exponent (1/temperature) and normalised.  The exponent is bisected: the flattest mixture
in which no document is read more than ``max_repeat`` times, or, with ``entropy``, the mixture nearest to the natural one whose entropy (in
nats) reaches the target.  The token budget is split by the weights; without a budget it is the smallest in which every document is
read at least once.

Weights become documents by budgeted block permutations.  A source's target is a number of full epochs and a rest.  In every epoch the
documents have an order of their own, given by a hash of doc_id and epoch and cut into ``BLOCKS`` blocks by its first digits.
The rest is filled block by block: whole blocks while they fit, and in the block that reaches the target, document by document up to
and including the one that reaches it.  ``turn`` (0..1) places each block in the run so that the sources stay mixed in every stretch.

Only DataFrame functions are used.

Scale.  A source of any size is never ordered as a whole: only token sums of ``BLOCKS`` blocks per source are, and the documents of one block.
Sums are made inside tasks first.  Sources are assumed to be few enough for one row of numbers (weights are set by hand or
by name); their table is counted before it is broadcast.

Results.  One row per reading of a document: ``doc_id``, ``source``, ``n_tokens`` (runs of characters that are not blank), ``epoch`` (from 0),
``block``, ``turn``.  Rows without source are a source of their own (null).  Documents without tokens (null, empty) weigh nothing: they
are read once per full epoch of their source, in the rest by their place.  A source without any token is read once.  Repeated
rows are read each, from the same place; a row without doc_id has its place from its text.  An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import side, stored

MAX_REPEAT, BLOCKS, STEPS = 2.0, 4096, 60
_TOKEN = r"[^ \t\r\n]+"


def _weights(sizes: Column, exponent: Column) -> Column:
    powers = F.transform(sizes, lambda n: F.pow(n, exponent))
    total = F.aggregate(powers, F.lit(0.0), lambda a, p: a + p)
    return F.transform(powers, lambda p: p / total)


def _bisect(good, towards_zero: bool) -> Column:
    """Exponent in 0..1 at the edge of ``good``: the smallest good one, or the largest."""
    def step(s, _):
        middle = (s["low"] + s["high"]) / 2
        ok = good(middle)
        down = ok if towards_zero else ~ok
        return F.struct(
            F.when(down, s["low"]).otherwise(middle).alias("low"), F.when(down, middle).otherwise(s["high"]).alias("high"))

    ends = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), step)
    return ends["high"] if towards_zero else ends["low"]


def mixture(sources: DataFrame, max_repeat: float = MAX_REPEAT, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, tokens) -> source, tokens, exponent, weight, target (tokens to read), epochs, rest.

    ``sources`` has one row per source; the weights are worked out in one row of numbers.
    """
    some = sources.filter("tokens > 0")
    row = some.agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("sizes"))
    sizes = F.col("sizes")

    def amount(exponent):  # tokens of the whole run
        if budget is not None:
            return F.lit(float(budget))
        pairs = F.zip_with(sizes, _weights(sizes, exponent), lambda n, w: n / w)
        return F.array_max(pairs)

    def repeats_fit(exponent):
        all_tokens = amount(exponent)
        reads = F.zip_with(sizes, _weights(sizes, exponent), lambda n, w: w * all_tokens / n)
        return F.array_max(reads) <= max_repeat

    def spread(exponent):
        return F.aggregate(_weights(sizes, exponent), F.lit(0.0), lambda a, w: a - w * F.log(w)) >= entropy

    edge = _bisect(repeats_fit, True) if entropy is None else _bisect(spread, False)
    row = row.select("sizes", edge.alias("exponent"))
    row = row.select(
        "exponent", amount(F.col("exponent")).alias("all_tokens"),
        F.aggregate(F.transform(sizes, lambda n: F.pow(n, F.col("exponent"))), F.lit(0.0), lambda a, p: a + p).alias("scale"))
    numbers = row.first()  # three numbers
    exponent, all_tokens, scale = (F.lit(n if n is None else float(n)) for n in (numbers[0], numbers[1], numbers[2] or 1.0))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), exponent) / scale).otherwise(0.0)
    mixed = sources.withColumn("exponent", exponent.cast("double")).withColumn("weight", weight).withColumn(
        "target", F.round(F.coalesce(F.col("weight") * all_tokens, F.lit(0.0))).cast("bigint"))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(1)
    return mixed.withColumn("epochs", epochs.cast("bigint")).withColumn(
        "rest", F.col("target") - F.when(F.col("tokens") > 0, F.col("epochs") * F.col("tokens")).otherwise(F.col("target"))).select(
        "source", "tokens", "exponent", "weight", "target", "epochs", "rest")


def _key() -> Column:
    """What places a row: its doc_id, or its text if it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def _digest(epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", epoch.cast("string"), F.col("__mix_key")).cast("binary"))


def _block(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("bigint")


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, _source, _n) of every row, written: the only pass that counts tokens."""
    count = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_TOKEN)), F.lit(0)).cast("bigint")
    return stored(docs.select("doc_id", _key().alias("__mix_key"), F.col("source").alias("__mix_source"), count.alias("__mix_n")), "sizes")


def readings(rows: DataFrame, sizes: DataFrame, columns: list[str], **options) -> DataFrame:
    """``columns`` of every reading of ``rows`` (with _key, _source), and _source, _epoch, _block, _turn."""
    sources = sizes.groupBy(F.col("__mix_source").alias("source")).agg(F.sum("__mix_n").alias("tokens"))
    mixed = stored(mixture(stored(sources, "sources"), **options), "mixture")
    plan = side(mixed.select(
        F.col("source").alias("__mix_p_source"), F.col("epochs").alias("__mix_epochs"), F.col("rest").alias("__mix_rest"),
        F.when(F.col("tokens") > 0, F.col("target") / F.col("tokens")).otherwise(1.0).alias("__mix_reads")))
    own = F.col("__mix_source").eqNullSafe(F.col("__mix_p_source"))

    # how far each source gets in the epoch that is not full
    last = sizes.join(plan, own).filter("__mix_rest > 0").withColumn("digest", _digest(F.col("__mix_epochs"))).withColumn(
        "block", _block(F.col("digest")))
    blocks = last.groupBy("__mix_source", "__mix_rest", "block").agg(F.sum("__mix_n").alias("tokens"))
    before = Window.partitionBy("__mix_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    reached = blocks.filter("before < __mix_rest and before + tokens >= __mix_rest").groupBy("__mix_source").agg(
        F.max_by("block", "before").alias("edge"), F.max("before").alias("edge_before"))
    reached = stored(reached.select(F.col("__mix_source").alias("e_source"), "edge", "edge_before"), "edges")
    inside = last.join(side(reached), F.col("__mix_source").eqNullSafe(F.col("e_source"))).filter("block = edge")
    order = Window.partitionBy("__mix_source").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.withColumn("sofar", F.col("edge_before") + F.coalesce(F.sum("__mix_n").over(order), F.lit(0))).filter(
        "sofar < __mix_rest").groupBy("__mix_source").agg(F.max("digest").alias("__mix_c_digest"))
    cut = side(stored(cut.withColumnRenamed("__mix_source", "__mix_c_source"), "cuts"))

    read = rows.join(plan, own).join(cut, F.col("__mix_source").eqNullSafe(F.col("__mix_c_source")), "left")
    extra = F.coalesce(_digest(F.col("__mix_epochs")) <= F.col("__mix_c_digest"), F.lit(False))
    read = read.withColumn("__mix_times", F.col("__mix_epochs") + extra.cast("bigint")).filter("__mix_times > 0").withColumn(
        "__mix_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__mix_times") - 1)))
    read = read.withColumn("__mix_block", _block(_digest(F.col("__mix_epoch"))))
    turn = F.least((F.col("__mix_epoch") + (F.col("__mix_block") + 0.5) / BLOCKS) / F.greatest("__mix_reads", F.lit(1e-9)), F.lit(1.0))
    return read.select(*columns, "__mix_source", "__mix_epoch", "__mix_block", turn.alias("__mix_turn"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The readings: doc_id, source, n_tokens, epoch, block, turn; see the module."""
    sizes = sizes_of(docs)
    return readings(sizes, sizes, ["doc_id", "__mix_n"], **options).select(
        "doc_id", F.col("__mix_source").alias("source"), F.col("__mix_n").alias("n_tokens"), F.col("__mix_epoch").alias("epoch"),
        F.col("__mix_block").alias("block"), F.col("__mix_turn").alias("turn"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is read."""
    rows = docs.withColumns({"__mix_key": _key(), "__mix_source": F.col("source")})
    return readings(rows, sizes_of(docs), list(docs.columns), **options).select(*docs.columns)
