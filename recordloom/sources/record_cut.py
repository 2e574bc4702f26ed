"""Cutting harvest files into records by an automaton that works on all blocks of a file at once.

What a tag means depends on what stands before it: in a comment, a CDATA section, a processing instruction or the quotes of an attribute, the letters
``<record>`` are text.  So a block is read from every state it may begin in.  Runs from different states soon meet, and go on as one.  For each
state a block tells the state that it ends in, and how it moves the depth of open records: by ``net``, after it went as low as ``low``.  These
compose, so one pass over a few numbers per block gives the state and depth at the start of each; then all blocks are cut side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import written

TEXT, COMMENT, CDATA, INSTRUCTION, DOUBLE, SINGLE = range(6)  # the last two: in the quotes of a record's own start tag
STATES = 6
UNFINISHED = ("record without an end", "comment without an end", "CDATA section without an end", "instruction without an end",
              "attribute without an end", "attribute without an end")

_START = re.compile(r"<!--|<!\[CDATA\[|<\?|<(/?)(?:[\w.-]+:)?record(?=[\s/>])")
_END = {COMMENT: "-->", CDATA: "]]>", INSTRUCTION: "?>"}
_KIND = {"<!--": COMMENT, "<![CDATA[": CDATA, "<?": INSTRUCTION}
_BARE = re.compile(r"""[^>"']*""")
_SENT = 4_000_000  # letters of finished records that are sent on at once


def _tag(text: str, at: int, quote: str | None) -> tuple[int, str | None]:
    """Read on in a start tag: where it ends and None, or the end of the text and the quote that is open (blank: none)."""
    while True:
        if quote:
            at = text.find(quote, at)
            if at < 0:
                return len(text), quote
            at += 1
        at = _BARE.match(text, at).end()
        if at == len(text):
            return at, ""
        if text[at] == ">":
            return at + 1, None
        quote, at = text[at], at + 1


def marks(text: str, state: int) -> tuple[list[tuple[int, int]], int]:
    """Starts (place, 1) and ends (place after, -1) of records in a text read from ``state``, and the state at its end."""
    found, at = [], 0

    def start_tag(at: int, quote: str | None) -> tuple[int, int | None]:
        at, open_quote = _tag(text, at, quote)
        if open_quote is not None:
            return at, SINGLE if open_quote == "'" else DOUBLE
        if text[at - 2:at - 1] == "/":
            found.append((at, -1))
        return at, None

    if state in (DOUBLE, SINGLE):
        at, left = start_tag(0, '"' if state == DOUBLE else "'")
        if left is not None:
            return found, left
        state = TEXT
    while True:
        if state != TEXT:
            end = text.find(_END[state], at)
            if end < 0:
                return found, state
            at, state = end + len(_END[state]), TEXT
        match = _START.search(text, at)
        if match is None:
            return found, TEXT
        at = match.end()
        if match[0] in _KIND:
            state = _KIND[match[0]]
        elif match[1]:
            end = text.find(">", at)
            at = len(text) if end < 0 else end + 1
            found.append((at, -1))
        else:
            found.append((match.start(), 1))
            at, left = start_tag(at, None)
            if left is not None:
                return found, left


# ---- blocks ------------------------------------------------------------------------------

def _summaries(cut: str):
    """Per block and entry state: the state at its end, and net and lowest change of depth."""
    names = ["file", "block", "exit", "net", "low"]

    def row(key: tuple, states: list, nets: list, lows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, states, nets, lows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, nets, lows = None, [], [], []
        for batch in batches:
            for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
                if (file, block) != key:
                    if key is not None:
                        yield row(key, states, nets, lows)
                    key, states, nets, lows = (file, block), list(range(STATES)), [0] * STATES, [0] * STATES
                read = {}
                for entry, state in enumerate(states):
                    if state not in read:  # runs that have met are read once
                        found, after = marks(value + cut, state)
                        net = low = 0
                        for _, step in found:
                            net += step
                            low = min(low, net)
                        read[state] = after, net, low
                    after, net, low = read[state]
                    lows[entry] = min(lows[entry], nets[entry] + low)
                    nets[entry] += net
                    states[entry] = after
        if key is not None:
            yield row(key, states, nets, lows)
    return run


def _entries(blocks: pa.Table) -> pa.Table:
    """State, depth and start of the open record at the start of each block of a file; ``last`` tells how the file ends."""
    order = sorted(zip(*(blocks.column(c).to_pylist() for c in ("block", "exit", "net", "low"))))
    file, state, depth, start = blocks.column("file")[0].as_py(), TEXT, 0, None
    rows = []
    for block, exits, nets, lows in order:
        row = [file, block, state, depth, start, not rows]
        if depth + lows[state] <= 0:
            start = None
        # ends beyond the first level are not records: the depth does not fall below zero
        depth = max(depth + nets[state], nets[state] - lows[state])
        state = exits[state]
        if depth and start is None:
            start = block
        rows.append([*row, None])
    if state != TEXT or depth:
        rows[-1][-1] = UNFINISHED[state]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "block", "state", "depth", "start", "first", "last"])


class _Block:
    """One block, cut piece by piece: only the text of the open record is held."""

    def __init__(self, state: int, depth: int, start: int | None, first: bool, block: int):
        self.state, self.depth, self.start, self.block = state, depth, start, block
        self.held: list[str] = []  # text of the open record, or of what stands before the first one
        self.begin = 0 if depth or first else None
        self.head = first
        self.offset = 0

    def read(self, text: str) -> list[tuple]:
        found, self.state = marks(text, self.state)
        rows, at_open = [], 0
        for at, step in found:
            if step > 0:
                if self.head:
                    self.held.append(text[:at])
                    rows.append(("head", None, 0, "".join(self.held)))
                    self.held, self.head, self.begin = [], False, None
                if self.depth == 0:
                    self.begin, self.start, at_open = self.offset + at, None, at
                self.depth += 1
            elif self.depth:
                self.depth -= 1
                if self.depth == 0:
                    whole = "".join(self.held) + text[at_open:at]
                    rows.append(("record" if self.start is None else "end", self.start, self.begin, whole))
                    self.held, self.begin = [], None
        if self.depth or self.head:
            self.held.append(text[at_open:])
        self.offset += len(text)
        return rows

    def close(self) -> list[tuple]:
        if self.head:
            return [("head", None, 0, "".join(self.held))]
        if self.depth:
            return [("part", self.block if self.start is None else self.start, self.begin, "".join(self.held))]
        return []


def _cutter(cut: str):
    """Records of a block, the parts of records that cross its edges, and what stands before the first record of a file.

    The pieces of a block come in their order, as they are read.
    """
    def rows_of(found: list[tuple], where: tuple) -> pa.RecordBatch:
        kinds, starts, places, texts = zip(*found)
        file, modified, block, last = where
        n = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.repeat(modified, n), pa.array([block] * n, pa.int64()), pa.array(kinds, pa.string()),
             pa.array(starts, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string()), pa.array([last] * n, pa.string())],
            ["file", "modified", "block", "kind", "start", "place", "text", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, where, here = None, None, None
        found, size = [], 0
        for batch in batches:
            for i, (value, file, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block")))):
                if (file, block) != key:
                    if key is not None:
                        found += here.close()
                    if found:
                        yield rows_of(found, where)
                        found, size = [], 0
                    state, depth, start, first, last = (
                        batch.column(c)[i].as_py() for c in ("state", "depth", "start", "first", "last"))
                    key, where = (file, block), (file, batch.column("modified")[i], block, last)
                    here = _Block(state, depth, start, first, block)
                more = here.read(value + cut)
                found += more
                size += sum(len(row[3]) for row in more)
                if size > _SENT:
                    yield rows_of(found, where)
                    found, size = [], 0
        if key is not None:
            found += here.close()
        if found:
            yield rows_of(found, where)
    return run


def cut_records(pieces: DataFrame, cut: str) -> tuple[DataFrame, DataFrame]:
    """Records (file, modified, block, place, text, unfinished) and what stands before them (file, text).

    ``pieces`` (value, file, modified, block) are the parts of files between the letters ``cut``, in the order of each block.  ``unfinished`` is null, or says
    why a file's last record has no end; other files are cut as if it were not there.  Texts are never shuffled: each block is read twice where it lies,
    piece by piece, the second time with its entry (one row per block) beside each piece; a task holds the record that is open.  A record that crosses
    blocks is put together from its parts.
    """
    kind = "file string, block bigint, exit array<bigint>, net array<bigint>, low array<bigint>"
    blocks = pieces.select("value", "file", "block").mapInArrow(_summaries(cut), kind)
    entries = written(blocks.groupBy("file").applyInArrow(
        _entries, "file string, block bigint, state bigint, depth bigint, start bigint, first boolean, last string"))
    # a broadcast join keeps the pieces of a block in their order; parts are read three times below
    given = pieces.select("value", "file", "modified", "block")
    placed = given.join(F.broadcast(entries), ["file", "block"])
    kind = f"file string, modified {dict(pieces.dtypes)['modified']}, block bigint, kind string, start bigint, place bigint, text string, last string"
    parts = written(placed.mapInArrow(_cutter(cut), kind))

    whole = parts.filter("kind = 'record'").select("file", "modified", "block", "place", "text", F.lit(None).cast("string").alias("unfinished"))
    crossing = parts.filter("kind in ('part', 'end')").groupBy("file", "modified", "start").agg(
        F.array_sort(F.collect_list(F.struct("block", "place", "text"))).alias("parts"), F.max("last").alias("last"),
        F.max((F.col("kind") == "end").cast("int")).alias("ended"))
    crossing = crossing.select(
        "file", "modified", F.col("start").alias("block"), F.get("parts", F.lit(0))["place"].alias("place"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
        F.when(F.col("ended") == 0, F.coalesce("last", F.lit(UNFINISHED[TEXT]))).alias("unfinished"))
    # a file may also end inside a comment or the like after its last record
    open_end = entries.filter("last is not null and depth = 0").select("file", "block", "last")
    trailing = parts.filter("kind = 'head'").select("file", "modified").join(open_end, "file").join(
        crossing.filter("unfinished is not null").select("file"), "file", "left_anti")
    trailing = trailing.select(
        "file", "modified", "block", F.lit((1 << 62)).cast("bigint").alias("place"), F.lit("").alias("text"), F.col("last").alias("unfinished"))
    return whole.unionByName(crossing).unionByName(trailing), parts.filter("kind = 'head'").select("file", "text")
