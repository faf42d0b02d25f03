"""Packing documents into windows of one length by the sum-of-squares rule.

The windows of a task that are neither empty nor full are counted by fill level.  A document goes where the sum of the
squared counts grows least: into a window of some level, or into a new one.  That keeps no level crowded, so that most
levels have a window which a later document fills exactly.  What a document has beyond whole windows is placed; the
whole windows stand alone.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ROWS_AT_ONCE, Bounded, field, held

ID_BYTES = 4
CACHED = 1_000_000
SIMPLE = 0x300  # below this code point, normal forms and lower case are the same in all Unicode versions


def _class(*categories: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(SIMPLE) if unicodedata.category(chr(i))[0] in categories)


class WordTokenizer:
    """Ids of a text, as little-endian 32-bit words, for a tokenizer whose merges never leave a word.

    Words are cut as the tokenizer's own pattern does and looked up; new words are encoded together.  A text with
    characters beyond the simple range or with a special token is given to the tokenizer whole.
    """

    SPACE = "\t-\r \x85\xa0"
    COMPLEX = re.compile(f"[^\x00-{chr(SIMPLE - 1)}]|<\\|")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        size = self.encoder.get_vocab_size()
        self.ends = [(self.encoder.id_to_token(i) or "").endswith("</w>") for i in range(size)]
        letters, numbers = _class("L"), _class("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{self.SPACE}{letters}{numbers}]+")
        self.known = Bounded(CACHED)

    def whole(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        ids, start, made = self.encoder.encode(" ".join(words), add_special_tokens=False).ids, 0, []
        flat = np.array(ids, "<u4").tobytes()
        for i, token in enumerate(ids, 1):
            if self.ends[token]:
                made.append(flat[start * ID_BYTES : i * ID_BYTES])
                start = i
        if len(made) != len(words):
            made = [self.whole(w) for w in words]
        self.known.update(zip(words, made, strict=True))

    def __call__(self, text: str) -> bytes:
        if self.COMPLEX.search(text):
            return self.whole(text)
        words, known = self.words.findall(text.lower()), self.known
        parts = list(map(known.get, words))
        if None in parts:
            self.learn(sorted({w for w, p in zip(words, parts, strict=True) if p is None}))
            parts = list(map(known.get, words))
            known.make_room()
        return b"".join(parts)


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // ID_BYTES

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head, tail = self.ids[: n * ID_BYTES], self.ids[n * ID_BYTES :]
        return Piece(self.doc, self.start, head, self.total), Piece(self.doc, self.start + n, tail, self.total)


def _fill(pieces: list[Piece], room: int) -> list[Piece]:
    """Take pieces off the end of a list, the last one cut, until the room is used or the list is empty."""
    taken = []
    while room and pieces:
        piece = pieces.pop()
        if len(piece) > room:
            piece, rest = piece.cut(room)
            pieces.append(rest)
        taken.append(piece)
        room -= len(piece)
    return taken


class Packer:
    """Windows of one task.  Full windows are returned as they fill; the open ones are all that is held."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]

    def level_for(self, size: int) -> int:
        """The level to put a piece on: 0 for a new window."""
        n, top = self.levels, self.capacity - size
        growth = 2 * (n[size:] - n[: top + 1]) + 2  # from level h to h + size
        growth[top] = 1 - 2 * n[top]  # a full window is counted no more
        growth[0] = 2 * n[size] + 1 if size < self.capacity else 0
        growth[1:][n[1 : top + 1] == 0] = sys.maxsize
        return top - int(np.argmin(growth[::-1]))

    def add(self, doc, ids: bytes) -> Iterator[list[Piece]]:
        piece = Piece(doc, 0, ids, len(ids) // ID_BYTES)
        while len(piece) > self.capacity:
            head, piece = piece.cut(self.capacity)
            yield [head]
        size = len(piece)
        if not size:
            return
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        self.levels[level] -= bool(level)
        window.append(piece)
        if level + size == self.capacity:
            yield window
        else:
            self.open[level + size].append(window)
            self.levels[level + size] += 1

    def finish(self) -> Iterator[list[Piece]]:
        """Close what is open: the emptiest windows are cut up to fill the fullest, the last has powers of two."""
        left = [w for level in reversed(self.open) for w in level]
        at, end = 0, len(left) - 1
        while at < end:
            room = self.capacity - sum(map(len, left[at]))
            while room and end > at:
                taken = _fill(left[end], room)
                left[at] += taken
                room -= sum(map(len, taken))
                end -= not left[end]
            if room:
                break
            yield left[at]
            at += 1
        rest = left[at] if left and at <= end else []
        total = sum(map(len, rest))
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                yield _fill(rest, 1 << bit)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """(id, start, length, ids_crc32, ids, doc_tokens, sequence_id, offset) for each piece of a document.

    ``ids`` are little-endian unsigned 32-bit words, null without ``with_ids``.  Documents are packed as they come, in each partition of ``docs`` for itself: read it from a table, so that a task
    that is repeated meets the same rows in the same order.  Sequence ids are unique, not gapless.  Every sequence is
    ``capacity`` long, but for the last ones of a partition, whose lengths are powers of two, so none needs padding.

    Null counts as the empty text, which is ``end_id`` alone; without an end id it has no piece.  Repeated rows are packed
    each; an empty table gives an empty one; further columns are ignored.
    """
    schema = T.StructType(
        [
            field(docs, id_col),
            *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")),
            T.StructField("ids", T.BinaryType()),
            *(T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")),
        ]
    )
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, first = to_arrow_schema(schema), TaskContext.get().partitionId() << 40
        encode, packer, rows, made = held(("words", tokenizer), lambda: WordTokenizer(tokenizer)), Packer(capacity), [], 0

        def note(window: list[Piece]) -> None:
            nonlocal made
            offset = 0
            for p in window:
                rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.ids if with_ids else None, p.total, first + made, offset))
                offset += len(p)
            made += 1

        def out() -> pa.RecordBatch:
            arrays = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for window in packer.add(doc, encode(text or "") + tail):
                    note(window)
                if len(rows) >= ROWS_AT_ONCE:
                    yield out()
        for window in packer.finish():
            note(window)
        if rows:
            yield out()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
