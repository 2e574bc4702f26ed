"""Ids of whole texts from the tokenizers library, and files in the shared folder."""

from __future__ import annotations

import os
import string
import uuid
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow.fs as pafs


MARK = "\ue000"  # a private-use character
SIGNS = "".join(c for c in string.punctuation if c not in "'<|>")  # an apostrophe may take letters with it, the others mark special tokens
PLAIN = "\u0250"  # below it a letter has one form, and its lower case is one letter but for U+0130

# How byte-level tokenizers write bytes as letters: printable ones as themselves, the others from 256 on in order.
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


class _Places(dict):
    """chunk -> place in the tables; a new chunk gets the next place and waits to be encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.letters = 0

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        self.new.append(chunk)
        self.letters += len(chunk)
        return place


class Encoder:
    """Ids of whole texts for a tokenizer that splits at white space and drops it.

    Such a tokenizer never looks across a space (``__init__`` and ``_encode_new`` check what they rely on), so each distinct chunk between spaces is encoded once and remembered, up
    to a bound; texts are then gathered from the remembered ids.  The ids equal those of the whole text.
    """

    CHUNKS, LETTERS = 600_000, 24_000_000

    def __init__(self, path: str, specials_are_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_are_text
        probe = self.tokenizer.encode("(Abß\u0160é,", add_special_tokens=False).ids  # letters lower case and cut off from signs
        self.sign_ids: dict[str, list[int]] = {"": []}
        if probe != self._sign_ids("(") + self._letter_ids("Abß\u0160é") + self._sign_ids(","):
            raise ValueError("made for tokenizers in lower case that split letters from signs")
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.sign_ids = {"": []}
        self.lengths, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self) -> None:
        found, lengths = self._encode_new(self.places.new)
        total = len(found)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + total] = found
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += total
        self.places.new = []

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and each one's number of ids.

        A chunk of plain letters between signs goes straight to the library's merges.  The others go through the whole
        of it, as one text with a mark between them that none of them holds.
        """
        found: list = [None] * len(chunks)
        rest = []
        for i, chunk in enumerate(chunks):
            stem = chunk.strip(SIGNS)
            if stem.isalpha() and (stem.isascii() or max(stem) < PLAIN and "\u0130" not in stem):
                ids = self._letter_ids(stem)
                if len(stem) < len(chunk):
                    at = chunk.index(stem)
                    ids = self._sign_ids(chunk[:at]) + ids + self._sign_ids(chunk[at + len(stem):])
                found[i] = ids
            elif MARK in chunk:
                found[i] = self._ids(chunk)
            else:
                rest.append(i)
        if rest:
            mark = self._ids(MARK)
            ids = np.concatenate([self._ids(f" {MARK} ".join([chunks[i] for i in rest])), mark])
            at = np.ones(len(ids) - len(mark) + 1, bool)
            for k, m in enumerate(mark):
                at &= ids[k:len(ids) - len(mark) + 1 + k] == m
            ends = np.flatnonzero(at).tolist()
            if len(ends) != len(rest):
                raise ValueError("the tokenizer does not keep chunks apart at spaces")
            start, ids = 0, ids.tolist()
            for i, end in zip(rest, ends):
                found[i] = ids[start:end]
                start = end + len(mark)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _letter_ids(self, letters: str) -> list[int]:
        """Ids of a run of plain letters: lower case, its bytes as letters, merged by the library."""
        letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.tokenizer.model.tokenize(letters)]

    def _sign_ids(self, signs: str) -> list[int]:
        if signs not in self.sign_ids:
            self.sign_ids[signs] = self._ids(signs).tolist()
        return self.sign_ids[signs]

    def encode(self, texts: Sequence[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, each text followed by ``end``; and each text's number of ids."""
        if len(self.places) > self.CHUNKS or self.places.letters > self.LETTERS:
            self._forget()
        chunks = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        numbers = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(chunks)), np.int64, int(numbers.sum()))
        if self.places.new:
            self._learn()
        lengths = self.lengths[at]
        before = np.append(0, np.cumsum(lengths))
        text_ends = before[np.cumsum(numbers)]
        sizes = np.diff(text_ends, prepend=0) + 1
        out = np.full(int(sizes.sum()), end, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(sizes) - 1] = False
        total = int(before[-1])
        out[body] = self.ids[np.repeat(self.starts[at] - before[:-1], lengths) + np.arange(total)]
        return out, sizes


@lru_cache(2)
def encoder(path: str, specials_are_text: bool = False) -> Encoder:
    """One per worker process, kept from task to task."""
    return Encoder(path, specials_are_text)


def batches_of(texts: Sequence[str | None], letters: int = 1_000_000) -> list[slice]:
    """Consecutive slices of about so many letters."""
    cuts, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= letters:
            cuts.append(slice(start, i + 1))
            start, size = i + 1, 0
    if start < len(texts):
        cuts.append(slice(start, len(texts)))
    return cuts


def write_file(uri: str, content: bytes) -> None:
    """Write under a name of its own, then move: a reader never sees half a file, and a repeated task replaces it whole."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, path)


def read_file(uri: str, start: int = 0, size: int | None = None) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as source:
        return source.read_at(source.size() - start if size is None else size, start)
