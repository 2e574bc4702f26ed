"""SentencePiece ids of whole texts by a table of distinct marked words.

Pieces do not cross the mark before a word (``marked_words`` says where a text may be cut), so each distinct marked word is segmented once:

1. Texts are read in batches of at most about ``LETTERS`` letters.  A batch lists its distinct words, the most frequent first, and
   writes its texts as places in that list.  The list goes to ``BUCKETS`` buckets by a hash of the word.
2. A bucket holds a word wherever it occurs, so one task segments it, once, for all batches; the ids return with the word's place in
   the batch's list.
3. Ids and texts of a batch are joined by those places.

Scale.  What is shuffled is packed: the distinct words of each batch, and their ids; texts are read once and, as compressed places,
never shuffled: they lie in buckets by batch, so only ids move to them.  A batch is bounded by its letters (a single longer text is a batch of its own), a bucket is read as a stream, and the words a
task remembers are bounded by ``REMEMBERED``: beyond it, it forgets and segments again, with the same ids.  A word that fills a third of a text is one entry
of its batch.  Step 1 is a written table.

Results.  One row per row of the table: the key columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and, from ``encoded``, ``ids`` and ``decoded``).  Null and
empty texts have no ids and an empty decoded text; texts of any length are encoded whole; repeated rows and equal words give equal ids, so ties cannot arise; a null key stays null; an
empty table gives no row.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import slices, stored_by
from recordloom.llm.marked_words import marked_words, pack_ints, pack_texts, sentence_piece, unpack_ints, unpack_texts

LETTERS, BUCKETS, REMEMBERED = 32_000_000, 512, 500_000

_CODED = "batch bigint, bucket int, keys array<bigint>, numbers binary, places binary, words binary"
_CODED_ARROW = pa.schema([
    ("batch", pa.int64()), ("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("numbers", pa.binary()), ("places", pa.binary()),
    ("words", pa.binary()),
])


class _Batch:
    """Texts as places in a list of distinct words."""

    def __init__(self) -> None:
        self.keys: list = []
        self.numbers: list[int] = []
        self.parts: list[np.ndarray] = []
        self.words: dict[str, int] = {}
        self.letters = 0

    def add(self, keys: list, texts: list) -> None:
        found = [marked_words(t) if t else [] for t in texts]
        numbers = list(map(len, found))
        words = self.words
        for w in set(chain.from_iterable(found)).difference(words):
            words[w] = len(words)
        self.parts.append(np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.uint32, sum(numbers)))
        self.keys += keys
        self.numbers += numbers
        self.letters += sum(len(t) for t in texts if t)

    def rows(self, batch: int, buckets: int) -> Iterator[tuple]:
        codes = np.concatenate(self.parts)
        by_count = np.argsort(-np.bincount(codes, minlength=len(self.words)), kind="stable")
        place = np.empty(len(by_count), np.uint32)
        place[by_count] = np.arange(len(by_count))
        yield batch, None, self.keys, pack_ints(np.array(self.numbers, np.uint32)), pack_ints(place[codes]), None
        listed = list(self.words)
        words = [listed[i] for i in by_count.tolist()]
        bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)) % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for at in np.split(order, cuts):
            if len(at):
                yield batch, int(bucket[at[0]]), None, None, pack_ints(at), pack_texts([words[i] for i in at.tolist()])


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CODED_ARROW.types)], schema=_CODED_ARROW)


def _coder(letters: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId() << 32, 0
        batch = _Batch()
        for rows in slices(batches):
            batch.add(rows.column(0).to_pylist(), rows.column(1).to_pylist())
            if batch.letters >= letters:
                yield _arrow(list(batch.rows(part + count, buckets)))
                batch, count = _Batch(), count + 1
        if batch.keys:
            yield _arrow(list(batch.rows(part + count, buckets)))
    return run


def _segmenter(path: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentence_piece(path)
        known: dict[str, list[int]] = {}
        for rows in batches:
            out = []
            for words in rows.column("words").to_pylist():
                words = unpack_texts(words)
                if len(known) > remembered:
                    known = {}
                new = [w for w in words if w not in known]
                if new:
                    known.update(zip(new, model.encode(new)))
                ids = [known[w] for w in words]
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
                out.append((pack_ints(lengths), pack_ints(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))))
            lengths, ids = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [rows.column("batch"), rows.column("places"), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())],
                names=["batch", "places", "lengths", "ids"])
    return run


def _joiner(path: str, full: bool):
    """Ids and texts of a batch's rows, from the ids of its words."""
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        model = sentence_piece(path)
        by_place: dict[int, list[int]] = {}
        for places, lengths, ids in zip(*(words.column(c).to_pylist() for c in ("places", "lengths", "ids"))):
            ids, ends = unpack_ints(ids).tolist(), np.cumsum(unpack_ints(lengths), dtype=np.int64).tolist()
            by_place.update(zip(unpack_ints(places).tolist(), (ids[a:b] for a, b in zip([0, *ends], ends))))
        found = [by_place[i] for i in range(len(by_place))]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        decimals = [",".join(map(str, x)) for x in found]
        inner = model.decode(found)
        columns: list[list] = [[] for _ in range(6 if full else 4)]
        for keys, numbers, places in zip(*(texts.column(c).to_pylist() for c in ("keys", "numbers", "places"))):
            places = unpack_ints(places)
            ends = np.cumsum(unpack_ints(numbers), dtype=np.int64).tolist()
            sums = np.append(0, np.cumsum(counts[places]))
            for key, start, end in zip(keys, [0, *ends], ends):
                at = places[start:end].tolist()
                first = model.model.decode(found[at[0]]) if at else ""
                decoded = first + "".join([inner[i] for i in at[1:]])
                text = ",".join([decimals[i] for i in at])
                row = [key, int(sums[end] - sums[start]), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                if full:
                    row += [[i for w in at for i in found[w]], decoded]
                for column, value in zip(columns, row):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names[:len(columns)])
    return run


def coded_words(docs: DataFrame, key: str, column: str, letters: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Texts as places (batch, keys, numbers, places), and the lists they point to (batch, bucket, places, words), bucket by bucket."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(column).cast("string").alias("text"))
    coded = stored_by(rows.mapInArrow(_coder(letters, buckets), _CODED), "coded", "batch")
    listed = coded.filter("bucket is not null").select("batch", "bucket", "places", "words").repartition("bucket")
    return coded.filter("bucket is null").select("batch", "keys", "numbers", "places"), listed


def encoded(
    docs: DataFrame, path: str, key: str = "doc_id", column: str = "text", full: bool = True, letters: int = LETTERS, buckets: int = BUCKETS,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and with ``full`` also ids and decoded; see the module."""
    texts, listed = coded_words(docs, key, column, letters, buckets)
    words = listed.mapInArrow(_segmenter(path, remembered), "batch bigint, places binary, lengths binary, ids binary")
    kind = "key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return texts.groupBy("batch").cogroup(words.groupBy("batch")).applyInArrow(_joiner(path, full), kind).withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts."""
    return encoded(docs, path, full=False)
