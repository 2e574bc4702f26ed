"""Texts as marked words: pieces that begin with the space or line feed before a word, which two public tokenizers never look across.

``SentencePiece`` (sentencepiece models) writes a space as U+2581, puts one before the text, and has no piece in which U+2581 follows
another letter, and none with a line feed; byte-level BPE cuts before every run of white space.  So a text with a space before it may be cut
at each space or line feed that follows neither white space nor U+2581, and the ids of the pieces, one after the other, are the ids of
the text.  The encoders check what they rely on.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

SPACE = "▁"

_CUT = re.compile(rf"(?<=[^\s{SPACE}])(?=[ \n])")
_RUN = re.compile(rf"[\s{SPACE}][ \n]")


def marked_words(text: str) -> list[str]:
    """The pieces of a text that is not empty, with a space before it; ``spelled`` gives what each stands for.

    The single space before a word is left out, so ``foo bar`` gives ``foo``, ``bar``.
    """
    if _RUN.search(text) is None and not text[0].isspace() and text[0] != SPACE:
        return text.replace("\n", " \n").split(" ")
    return [x[1:] if x[0] == " " and x[1:2] not in (" ", "\n") else x for x in _CUT.split(" " + text)]


def spelled(word: str) -> str:
    return word if word[:1] in (" ", "\n") else " " + word


class SentencePiece:
    """Ids of marked words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [p for i, p in enumerate(self.pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        probe = "Ａ ﬁ  x\ny "
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain) or not any(map(model.is_byte, range(size))):
            raise ValueError("made for models with byte fallback whose pieces cross neither spaces nor lines")
        if b"".join(map(self.token_bytes().__getitem__, model.encode(probe))) != (" " + probe).encode():
            raise ValueError("made for models that change no letter and put a space first")
        self.space = model.piece_to_id(SPACE)
        self.probe = model.encode("a")

    def encode(self, words: Sequence[str]) -> list[list[int]]:
        ids = self.model.encode([w[1:] if w[:1] == " " else w for w in words], num_threads=1)
        for i, word in enumerate(words):
            if word[:1] == "\n":  # without the space that the library put first
                ids[i] = ids[i][1:]
            elif not word:
                ids[i] = [self.space]
        return ids

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids that stand within a text, not at its start."""
        return [x[1:] for x in self.model.decode([self.probe + list(x) for x in ids])]

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]


class ByteLevel:
    """Ids of marked words for a byte-level BPE of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        probe = " foo  bar\nbaz  \n x\t\ty."
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        if whole != [i for x in self.encode(marked_words(probe[1:])) for i in x] or b"".join(map(self.token_bytes().__getitem__, whole)) != probe.encode():
            raise ValueError("made for byte-level tokenizers that cut before white space")

    def encode(self, words: Sequence[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([spelled(w) for w in words], add_special_tokens=False)
        return [x.ids for x in found]

    @lru_cache(1)  # noqa: B019
    def token_bytes(self) -> list[bytes]:
        from recordloom.llm.tokens import BYTE_LETTERS

        letters = {chr(BYTE_LETTERS.get(b, b)): b for b in range(256)}
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            if all(c in letters for c in token):
                out[i] = bytes(letters[c] for c in token)
        return out


@lru_cache(2)
def sentence_piece(path: str) -> SentencePiece:
    """One per worker process, kept from task to task."""
    return SentencePiece(path)


@lru_cache(2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def pack_ints(values: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed byte plane by byte plane."""
    import zstandard

    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpack_ints(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pack_texts(texts: Sequence[str]) -> bytes:
    import zstandard

    lengths = np.fromiter(map(len, texts), "<u4", len(texts))
    body = "".join(texts).encode("utf-8", "surrogatepass")
    return zstandard.ZstdCompressor(level=3).compress(len(texts).to_bytes(4, "little") + lengths.tobytes() + body)


def unpack_texts(packed: bytes) -> list[str]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    count = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", count, 4), dtype=np.int64).tolist()
    text = raw[4 + 4 * count:].decode("utf-8", "surrogatepass")
    return [text[a:b] for a, b in zip([0, *ends], ends)]
