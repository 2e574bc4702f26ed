"""Token counts: a separator scan over flat, unindexed token files.

A flat file is nothing but little-endian 16-bit ids; each document ends with the end-of-document id.  ``scan`` cuts files into
blocks of a fixed number of bytes without looking inside, searches each block for the separator with one vectorised comparison, and
stitches documents that span blocks with a prefix scan: the number of separators before a block numbers its documents, and the
last separator before it is where its first document starts.

Scale.  A block is a task's unit whatever the file sizes, so one huge document or file spreads over many tasks.  The prefix scan
runs over one row per block, first inside a file; nothing but the blocks' separators leaves a task.  ``write_flat`` is
one pass without a shuffle; its files have a bounded size and the order of documents inside is kept.

Results of ``scan``.  One row per document: ``path``, ``ordinal`` (from 0 in its file), ``start`` (in ids), ``n_tokens`` without the
separator, ``ended`` (false for a piece after the last separator).  Null and empty texts have 0 tokens; an empty table or file gives no
row.  The separator's own string inside a text is ordinary text and never ends a document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import MOST_TASKS, new_folder, slices, stored
from recordloom.llm.tokens import batches_of, encoder, read_file, write_file

SEPARATOR, BLOCK_BYTES, FILE_IDS = 49407, 1 << 20, 8_000_000
_ID = np.dtype("<u2")


def _writer(folder: str, tokenizer: str, separator: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, doc_ids, n = encoder(tokenizer, specials_are_text=True), [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/tokens-{uuid.uuid4().hex}.u16"
            content = np.concatenate(held).tobytes()
            write_file(path, content)
            return pa.RecordBatch.from_pydict({
                "path": [path], "bytes": [len(content)], "doc_ids": pa.array([doc_ids], pa.list_(pa.int64()))})

        for batch in slices(batches):
            texts, own = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for cut in batches_of(texts):
                ids, _ = coder.encode(texts[cut], separator)
                held.append(ids.astype(_ID))
                doc_ids.extend(own[cut])
                n += len(ids)
                if n >= FILE_IDS:
                    yield flush()
                    held, doc_ids, n = [], [], 0
        if held:
            yield flush()
    return write


def write_flat(docs: DataFrame, folder: str, tokenizer: str, separator: int = SEPARATOR) -> DataFrame:
    """Flat files of ``docs`` (doc_id, text); a row per file: path, bytes, doc_ids in the order of the file.

    A repeated task writes under new names; the returned table, written once, names the files that count.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(
        ids.mapInArrow(_writer(folder, tokenizer, separator), "path string, bytes bigint, doc_ids array<bigint>"), "flat")


def _searcher(separator: int, block_bytes: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["block"] * block_bytes
                size = min(block_bytes, row["bytes"] - start)
                ids = np.frombuffer(read_file(row["path"], start, size), _ID)
                found = np.flatnonzero(ids == separator) + start // _ID.itemsize
                last = start + size == row["bytes"]
                open_end = last and ids[-1] != separator
                if open_end:
                    found = np.append(found, row["bytes"] // _ID.itemsize)
                yield pa.RecordBatch.from_pydict({
                    "path": [row["path"]], "block": [row["block"]], "ends": pa.array([found], pa.list_(pa.int64())),
                    "open_end": [bool(open_end)]})
    return search


def scan(files: DataFrame, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES, blocks_per_task: int = 16) -> DataFrame:
    """Documents of flat files (path, bytes); see the module.  ``block_bytes`` is a multiple of an id's two bytes."""
    blocks = stored(
        files.filter("bytes > 0").select(
            "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.ceil(F.col("bytes") / block_bytes) - 1).cast("bigint"))).alias("block")),
        "blocks")
    tasks = max(1, min(MOST_TASKS, -(-blocks.count() // blocks_per_task)))
    found = stored(
        blocks.repartition(tasks, "path", "block").mapInArrow(
            _searcher(separator, block_bytes), "path string, block bigint, ends array<bigint>, open_end boolean"), "ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "path", "ends", "open_end",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max(F.array_max("ends")).over(before) + 1, F.lit(0)).alias("start"))
    starts = F.concat(F.array("start"), F.transform("ends", lambda e: e + 1))
    pairs = F.arrays_zip(F.slice(starts, 1, F.size("ends")).alias("start"), F.col("ends").alias("end"))
    return carried.select("first", "path", "open_end", F.size("ends").alias("n"), F.posexplode(pairs).alias("k", "doc")).select(
        "path", (F.col("first") + F.col("k")).cast("bigint").alias("ordinal"), F.col("doc.start").alias("start"),
        (F.col("doc.end") - F.col("doc.start")).alias("n_tokens"),
        (~F.col("open_end") | (F.col("k") < F.col("n") - 1)).alias("ended"))


def count_tokens(docs: DataFrame, tokenizer: str, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``: flat files written, scanned, and numbered as they were written."""
    files = write_flat(docs, new_folder(docs.sparkSession, "flat"), tokenizer, separator)
    found = scan(files.select("path", "bytes"), separator)
    order = files.select("path", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    return order.join(found, ["path", "ordinal"]).select("doc_id", "n_tokens")
