"""Language ID: word-first backoff.

A known word adds its log frequency in every language.  An unseen word is read letter by letter: at each place the
longest known character n-gram that ends there (``LONGEST`` letters, then one fewer, down to one) adds its log frequency.
Each word adds the same kind of number for every language, so the sums compare; ``score`` is their softmax.

Learning counts the words of every training text (Spark sums them by language and word); the n-grams are counted over the
distinct words of each language, which is what unseen words resemble.  Only text and lang of rows outside fold ``HELD_OUT`` of
``FOLDS`` are read for it.  A frequency is a share of all that a language has, whether the model keeps it or not; what a language never had
gets the same floor in every language, large or small.

Scale.  Words are first summed inside a task, so a common word is a few rows whatever the corpus.  The model that is sent to
the tasks has a documented size: ``words`` words and ``grams`` n-grams, of which every language has an equal part for its most frequent ones, and every single
letter of every language.  Which these are follows from how often counts occur, so nothing is sorted, and only items of the model
reach the driver.  A word outside is an unseen word and is still scored.  Prediction is one pass without a shuffle.

Results.  One row per document: ``held_out``, ``lang_pred``, ``score``.  A text that is null or has no letter (numerals such as half or a Roman
eight are none) is ``und`` with score 0, and so is every text if nothing was learned.  Ties go to the language first in the alphabet, which
decides, too, where a text shares no letter with any language.  Rows of null lang teach nothing.  A row without doc_id is predicted, teaches nothing and is
not held out.  Repeated rows are predicted, and teach, each time.  Whole texts count, of any length.  An empty table gives no row.  Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import slices, stored

WORDS, GRAMS, LONGEST, FLOOR = 100_000, 100_000, 5, 0.01  # FLOOR: part of all frequency that is spread evenly
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"



def _class(kinds: str) -> str:
    """Ranges of a character class of all letters of some Unicode categories."""
    inside = [unicodedata.category(chr(i))[0] in kinds and not 0xD800 <= i < 0xE000 for i in range(sys.maxunicode + 1)] + [False]
    edges = [i for i in range(1, len(inside)) if inside[i] != inside[i - 1]]
    return "".join(f"\\U{low:08x}-\\U{high - 1:08x}" for low, high in zip(edges[::2], edges[1::2]))


_LETTERS = re.compile(f"[{_class('L')}][{_class('LM')}]*")  # marks belong to the letter before them
# Below U+0300 there are no marks, and but for a few numerals the quicker rule says the same.
_QUICK, _FAR = re.compile(r"[^\W\d_]+"), re.compile("[²³¹¼-¾\u0300-\U0010ffff]")
_FLUSH = 200_000


def letters(text: str | None) -> list[str]:
    """Runs of letters, lower case."""
    if not text:
        return []
    text = text.lower()
    return (_QUICK if text.isascii() or _FAR.search(text) is None else _LETTERS).findall(text)


def grams(word: str, longest: int) -> Iterator[str]:
    """All n-grams of a word with its two ends marked."""
    marked = f"^{word}$"
    for n in range(1, longest + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i:i + n]


def _summed(counts: Counter) -> pa.RecordBatch:
    pairs = list(counts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()),
         pa.array(counts.values(), pa.int64())], ["lang", "item", "n"])
    counts.clear()
    return batch


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, Counter] = {}
    for batch in slices(batches):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            kept.setdefault(lang, Counter()).update(letters(text))
            if len(kept[lang]) > _FLUSH:
                yield _summed(Counter({(lang, w): n for w, n in kept.pop(lang).items()}))
    for lang, own in kept.items():
        yield _summed(Counter({(lang, w): n for w, n in own.items()}))


def _gram_counter(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, word in zip(batch.column("lang").to_pylist(), batch.column("item").to_pylist()):
                counts.update((lang, g) for g in grams(word, longest))
                if len(counts) > _FLUSH:
                    yield _summed(counts)
        if counts:
            yield _summed(counts)
    return run


def _kept(counts: DataFrame, n: int, langs: list[str], always: F.Column | None = None) -> list:
    """(item, {lang: n}) of the most frequent items of each language, an equal part of ``n`` for each, and of those that always count.

    How many items have a count tells the least count that a language keeps; of items with that count all or none.
    """
    part = max(1, n // max(1, len(langs)))
    sizes = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("items"))  # a few rows: counts that occur
    above = F.sum("items").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    least = sizes.withColumn("above", above).filter(F.col("above") <= part).groupBy("lang").agg(F.min("n").alias("least"))
    chosen = counts.join(least, "lang", "left").filter((F.col("n") >= F.col("least")) | (F.lit(False) if always is None else always))
    items = chosen.select("item").distinct()
    by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")
    return counts.join(items, "item", "left_semi").groupBy("item").agg(by_lang).collect()


def _totals(counts: DataFrame) -> dict[str, int]:
    """All that was counted, by language."""
    return {row.lang: row.n for row in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}


class Model:
    """Log frequencies of known words and n-grams: one row per item, one column per language."""

    def __init__(
        self, langs: list[str], words: list, pieces: list, longest: int, word_totals: dict[str, int] | None = None,
        piece_totals: dict[str, int] | None = None,
    ):
        self.langs, self.longest = langs, longest
        self.words, self.word_logs = self._logs(words, word_totals)
        self.grams, self.gram_logs = self._logs(pieces, piece_totals)

    def _logs(self, rows: list, totals: dict[str, int] | None) -> tuple[dict[str, int], np.ndarray]:
        place = {row[0]: i for i, row in enumerate(rows)}
        counts = np.zeros((len(rows), len(self.langs)))
        at = {lang: j for j, lang in enumerate(self.langs)}
        for i, (_, by_lang) in enumerate(rows):
            for lang, n in by_lang.items():
                counts[i, at[lang]] = n
        if not len(rows):
            return place, counts
        whole = counts.sum(axis=0) if totals is None else np.array([totals.get(lang, 0) for lang in self.langs], float)
        return place, np.log((1 - FLOOR) * counts / np.maximum(whole, 1) + FLOOR / len(rows))

    def unseen(self, word: str) -> list[int]:
        """For each place of a word the longest known n-gram that ends there."""
        marked, known, longest = f"^{word}$", self.grams, self.longest
        found = []
        for end in range(2, len(marked) + 1):
            for start in range(max(0, end - longest), end):
                at = known.get(marked[start:end])
                if at is not None:
                    found.append(at)
                    break
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(letters(text))
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        at, times, parts, part_times = [], [], [], []
        for word, n in counts.items():
            i = self.words.get(word)
            if i is not None:
                at.append(i)
                times.append(n)
            else:
                found = self.unseen(word)
                parts += found
                part_times += [n] * len(found)
        total = np.zeros(len(self.langs))
        for places, weights, logs in ((at, times, self.word_logs), (parts, part_times, self.gram_logs)):
            if places:
                total += np.array(weights, float) @ logs[places]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, words: int = WORDS, pieces: int = GRAMS, longest: int = LONGEST) -> Model:
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(fold() != HELD_OUT).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shape = "lang string, item string, n bigint"
    counts = stored(known.mapInArrow(_count_words, shape).groupBy("lang", "item").agg(F.sum("n").alias("n")), "words")
    by_gram = counts.mapInArrow(_gram_counter(longest), shape).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    by_gram = stored(by_gram, "grams")
    word_totals, gram_totals = _totals(counts), _totals(by_gram)
    langs = sorted(word_totals)
    letter = F.char_length("item") == 1
    return Model(langs, _kept(counts, words, langs), _kept(by_gram, pieces, langs, letter), longest, word_totals, gram_totals)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``; reads doc_id and text only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches):
            found = [own.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id bigint, lang_pred string, score double").select(
        "doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
