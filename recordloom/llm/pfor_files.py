"""Token-ID / binary output: patched frame-of-reference blocks.

A file holds the ids of consecutive documents.  Blocks of ``BLOCK`` ids subtract their minimum and are packed at one width
in bits: the width of a percentile of the block, the cheapest of ``PERCENTILES``.  Ids that need more bits keep their low bits in
place and their high bits in the block's exception list.  The header is followed by the byte offset of every block, so one block
can be read alone (``decode``).

    header    8 bytes magic, then little-endian u64: documents, ids, blocks
    documents i64 doc_id (NO_ID: none), u32 number of ids
    index     u64 offset of each block from the start of the file
    block     u32 minimum, u8 width, u8 0, u16 exceptions; packed 64-bit words; u16 places; u32 high bits

Scale.  Texts are range-partitioned by doc_id (ties by hash of text, so repeated ids do not meet in one task) and sorted inside
partitions.  A task writes files of about ``FILE_IDS`` ids and forgets them, so its memory does not grow with its share; blocks are packed
and unpacked ``PIECE`` at a time, so beside the ids of a file (4 bytes each) it holds their packed bytes only.
Starts come from a prefix sum over files, first inside a partition and then over partitions.

Lost executors.  A file is written under a name of its own and then moved, so a repeated task replaces it whole.  The list of files is
written once as a table; only files in it are read.

Results.  ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` (with the end id), ``ids_crc32``.  Null and empty texts
have the end id alone.  Rows without doc_id come first, with null doc_id; repeated doc_ids are written each,
ordered by text.  An empty table gives no file and no row.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import MOST_TASKS, new_folder, slices, stored
from recordloom.llm.tokens import batches_of, encoder, read_file, write_file

MAGIC = b"PFORIDS1"
BLOCK, PIECE, FILE_IDS, END = 1024, 128, 4_000_000, 1
PERCENTILES = (50, 75, 90, 95, 98, 100)
NO_ID = -(2**63)

_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("none", "u1"), ("exceptions", "<u2")])


def bits(x: np.ndarray) -> np.ndarray:
    """Bits that a number below 2**32 needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of 64-bit words; a row is a multiple of 64 values."""
    rows, size = values.shape
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        words[word] |= lanes[k] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(rows, width * size // 64)


def unpack(words: np.ndarray, width: int, size: int) -> np.ndarray:
    rows = len(words)
    lanes = np.ascontiguousarray(words.reshape(-1, width).T) if width else words
    out = np.zeros((64, rows * size // 64), np.uint64)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        out[k] = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            out[k] |= lanes[word + 1] << np.uint64(64 - shift)
    out &= np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(rows, size).astype(np.uint32)


def _packed(ids: np.ndarray, size: int) -> list[bytes]:
    """The blocks of consecutive ids, as bytes."""
    blocks = -(-len(ids) // size)
    padded = np.full(blocks * size, ids[-1] if len(ids) else 0, np.uint32)
    padded[:len(ids)] = ids
    padded = padded.reshape(blocks, size)
    least = padded.min(axis=1, initial=0 if not size else np.iinfo(np.uint32).max)
    rest = padded - least[:, None]
    ordered = np.sort(rest, axis=1)
    width, cheapest = np.zeros(blocks, np.int64), np.full(blocks, np.iinfo(np.int64).max)
    for p in PERCENTILES:
        own = bits(ordered[:, min(size - 1, size * p // 100)])
        outside = (rest >> own[:, None].astype(np.uint32) > 0).sum(axis=1) if p < 100 else np.zeros(blocks, np.int64)
        cost = own * size + outside * 48
        better = cost < cheapest
        width[better], cheapest[better] = own[better], cost[better]
    high = np.where(width[:, None] < 32, rest >> np.minimum(width, 31)[:, None].astype(np.uint32), 0).astype(np.uint32)
    row, place = np.nonzero(high)
    exceptions = np.bincount(row, minlength=blocks)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        low = rest[own] & np.uint32((1 << int(w)) - 1)
        for i, words in zip(own, pack(low, int(w)).astype("<u8")):
            packed[i] = words.tobytes()
    heads = np.zeros(blocks, _HEAD)
    heads["least"], heads["width"], heads["exceptions"] = least, width, exceptions
    cuts = np.append(0, np.cumsum(exceptions))
    places, highs = place.astype("<u2"), high[row, place].astype("<u4")
    return [
        heads[i].tobytes() + packed[i] + places[cuts[i]:cuts[i + 1]].tobytes() + highs[cuts[i]:cuts[i + 1]].tobytes()
        for i in range(blocks)
    ]


def encode(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, size: int = BLOCK) -> bytes:
    """The content of a file; ``PIECE`` blocks are packed at a time."""
    parts = [p for start in range(0, len(ids), PIECE * size) for p in _packed(ids[start:start + PIECE * size], size)]
    before = len(MAGIC) + 24 + 12 * len(doc_ids) + 8 * len(parts)
    offsets = before + np.append(0, np.cumsum([len(p) for p in parts]))[:len(parts)]
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(ids), len(parts)], "<u8").tobytes(), doc_ids.astype("<i8").tobytes(),
        lengths.astype("<u4").tobytes(), offsets.astype("<u8").tobytes(), *parts])


def contents(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, numbers of ids, offsets of blocks, number of ids."""
    if raw[:8] != MAGIC:
        raise ValueError("not a file of packed ids")
    docs, ids, blocks = (int(n) for n in np.frombuffer(raw, "<u8", 3, 8))
    at = 32
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    lengths = np.frombuffer(raw, "<u4", docs, at + 8 * docs)
    return doc_ids, lengths, np.frombuffer(raw, "<u8", blocks, at + 12 * docs).astype(np.int64), ids


def decode(raw: bytes, offsets: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """The ids of the blocks at ``offsets``, one row each; ``PIECE`` blocks are unpacked at a time."""
    out = np.zeros((len(offsets), size), np.uint32)
    for start in range(0, len(offsets), PIECE):
        out[start:start + PIECE] = _unpacked(raw, offsets[start:start + PIECE], size)
    return out


def _unpacked(raw: bytes, offsets: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(offsets), size), np.uint32)
    heads = np.array([np.frombuffer(raw, _HEAD, 1, int(o))[0] for o in offsets], _HEAD)
    for w in np.unique(heads["width"]):
        own = np.flatnonzero(heads["width"] == w)
        words = int(w) * size // 64
        packed = np.stack([np.frombuffer(raw, "<u8", words, int(offsets[i]) + _HEAD.itemsize) for i in own])
        out[own] = unpack(packed.astype(np.uint64), int(w), size)
    for i in np.flatnonzero(heads["exceptions"]):
        n, w = int(heads["exceptions"][i]), int(heads["width"][i])
        at = int(offsets[i]) + _HEAD.itemsize + w * size // 8
        places = np.frombuffer(raw, "<u2", n, at)
        out[i, places] |= np.frombuffer(raw, "<u4", n, at + 2 * n) << np.uint32(w)
    return out + heads["least"][:, None]


def _writer(folder: str, tokenizer: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, n, place, part = encoder(tokenizer), [], 0, 0, None

        def flush() -> pa.RecordBatch:
            doc_ids, lengths, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
            path = f"{folder}/ids-{part:06d}-{place:05d}.pfor"
            write_file(path, encode(doc_ids, lengths, ids))
            return pa.RecordBatch.from_pydict({"part": [part], "place": [place], "path": [path], "ids": [len(ids)]})

        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            doc_ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            if part is None and batch.num_rows:
                part = batch.column("part")[0].as_py()
            for cut in batches_of(texts):
                ids, sizes = coder.encode(texts[cut], end)
                held.append((doc_ids[cut], sizes, ids))
                n += len(ids)
                if n >= FILE_IDS:
                    yield flush()
                    held, n, place = [], 0, place + 1
        if held:
            yield flush()
    return write


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; the files as (path, before, ids)."""
    order = ["doc_id", "_tie", "text"]
    ranged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "_tie", F.xxhash64("text"))
    ranged = ranged.repartitionByRange("doc_id", "_tie").sortWithinPartitions(*order).select(
        "doc_id", "text", F.spark_partition_id().cast("bigint").alias("part"))
    files = stored(
        ranged.mapInArrow(_writer(folder, tokenizer, end), "part bigint, place bigint, path string, ids bigint"), "files")
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("ids").alias("all_ids"))  # one row per task that wrote
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all_ids").over(earlier), F.lit(0)).alias("base"))
    return files.withColumn("inside", F.coalesce(F.sum("ids").over(before), F.lit(0))).join(parts, "part").select(
        "path", (F.col("base") + F.col("inside")).alias("before"), "ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
            raw = read_file(path)
            doc_ids, lengths, offsets, n = contents(raw)
            ids = decode(raw, offsets).ravel()[:n].astype("<u4", copy=False)
            ends = np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(starts + before), pa.array(lengths.astype(np.int64)),
                 pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(files: DataFrame, per_task: int = 2) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = stored(files, "list")
    tasks = max(1, min(MOST_TASKS, -(-files.count() // per_task)))
    return files.repartition(tasks, "path").select("path", "before").mapInArrow(
        _read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write ``docs`` to packed files in the shared folder and read them back."""
    return read_back(write_ids(docs, new_folder(docs.sparkSession, "ids"), tokenizer, end))
