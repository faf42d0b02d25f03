"""Encoding and decoding with a SentencePiece model of merge type, without running the merges.

For every prefix of a chunk there is one last token.  It is the one token that ends there, is itself what merging makes
of its characters, and may stand behind the last token of the prefix before it: no merge across the border would have
come before the merges within the two.  An automaton over all tokens gives those that end at each place; ids are read
off the table backwards.  Chunks are cut where no token of the model can reach across.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Bounded, held, per_row

MARK = "▁"  # what a model writes for a space; here both are a space
NEVER = 1 << 60
CACHED = 400_000


class PieceModel:
    """A merge-type model with byte fallback, a leading mark and no normalisation."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        self.end_id = lib.eos_id()
        self.byte_ids = {int(lib.id_to_piece(i)[3:5], 16): i for i in ids if lib.is_byte(i)}
        self.ids = {
            lib.id_to_piece(i).replace(MARK, " "): i
            for i in ids
            if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))
        }
        self.texts: dict[int, bytes] = {i: p.encode() for p, i in self.ids.items()}
        self.texts |= {i: bytes([b]) for b, i in self.byte_ids.items()}
        by_score = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -lib.get_score(self.ids[p]))
        self.rank = {p: i for i, p in enumerate(by_score)}
        self.halves: dict[str, tuple[str, str]] = {}
        self.in_order = True
        self.tokens = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self._derive(piece):
                self.tokens.add_word(piece, (self.ids[piece], len(piece)))
        self.tokens.make_automaton()
        lone = "" if any("\n" in p for p in self.rank) else "\n"
        self.chunks = re.compile(rf" *[^ {lone}]+| +" + (rf"|{lone}+" if lone else ""))
        if any(" " in p.lstrip(" ") for p in self.rank):
            self.chunks = re.compile(r"[\s\S]+")
        self.known = Bounded(CACHED)
        self.altered: dict[str, str] = {}  # chunks that decode to something else
        self.names = {i: p for p, i in self.ids.items()}
        self.pairs = Bounded(CACHED)  # whether one token may follow another

    def merge(self, text: str) -> list[str]:
        """Tokens by running the merges: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = min(((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(NEVER, 0))
            if best[0] == NEVER:
                return parts
            i = best[1]
            self.last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _derive(self, piece: str) -> bool:
        """Note the two halves a token is merged from; False if merging never makes it."""
        if self.merge(piece) != [piece]:
            return False
        self.halves[piece] = self.last
        if any(self.rank.get(h, -1) >= self.rank[piece] for h in self.last):
            self.in_order = False
        return True

    def _edge(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """Tokens that stood at an edge of this one as it was merged: (token, made at, used up at)."""
        edge, used = [], NEVER
        while token in self.halves:
            made = self.rank[token]
            edge.append((token, made, used))
            token, used = self.halves[token][side], made
        return [*edge, (token, -1, used)]

    def _follows(self, left: str, right: str) -> bool:
        """Whether merging the joined characters gives just these two tokens."""
        if not self.in_order:
            return self.merge(left + right) == [left, right]
        for a, a_made, a_used in self._edge(left, 1):
            for b, b_made, b_used in self._edge(right, 0):
                if max(a_made, b_made) < min(a_used, b_used):
                    joined = self.rank.get(a + b, NEVER)
                    # the merge within the left token comes first if it is as good
                    if joined < a_used and joined <= b_used and joined != NEVER:
                        return False
        return True

    def encode_chunk(self, chunk: str) -> list[int]:
        last, pairs = [-1] * (len(chunk) + 1), self.pairs
        for at, (token, size) in self.tokens.iter(chunk):
            if last[at + 1] >= 0:
                continue
            before = last[at + 1 - size]
            if before >= 0:  # else the chunk begins here, or a character that no token has is before it
                fits = pairs.get(before << 32 | token)
                if fits is None:
                    fits = pairs[before << 32 | token] = self._follows(self.names[before], self.names[token])
                if not fits:
                    continue
            last[at + 1] = token
        ids, end = [], len(chunk)
        while end:
            token = last[end]
            if token < 0:
                ids += [self.byte_ids[b] for b in reversed(chunk[end - 1].encode())]
                end -= 1
            else:
                ids.append(token)
                end -= len(self.names[token])
        return ids[::-1]

    def decode_bytes(self, ids: list[int]) -> str:
        return b"".join(self.texts.get(i, b"") for i in ids).decode("utf-8", "replace")

    def cut(self, text: str) -> list[str]:
        return self.chunks.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, chunks: set[str]) -> None:
        for chunk in chunks:
            ids = self.encode_chunk(chunk)
            self.known[chunk] = " ".join(map(str, ids))
            if (back := self.decode_bytes(ids)) != chunk:
                self.altered[chunk] = back

    def digits(self, text: str) -> tuple[str, str]:
        """The ids as decimal text, and what they decode to."""
        chunks, known = self.cut(text), self.known
        parts = list(map(known.get, chunks))
        if None in parts:
            self.learn({c for c, p in zip(chunks, parts, strict=True) if p is None})
            parts = list(map(known.get, chunks))
        back = "".join(map(self.altered.get, chunks, chunks) if self.altered else chunks)
        if len(self.altered) > CACHED:
            known.clear()
            self.altered.clear()
        known.make_room()
        self.pairs.make_room()
        return " ".join(parts), back.removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.cut(text) for i in self.encode_chunk(chunk)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).removeprefix(" ")


def load(path: str) -> PieceModel:
    return held(("pieces", path), lambda: PieceModel(path))


def encode_decode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """(id, n_tokens, ids, decoded, ids_sha256, decoded_sha256) for each row; the ids end with the model's end id.

    ``with_ids=False`` leaves ids and decoded text null and gives their digests alone.  Null counts as the empty text,
    which is the end id.  Repeated rows give repeated results, an empty table an empty one; further columns are ignored.
    """

    def make():
        codec = load(model)

        def work(texts):
            out: list[list] = [[], [], [], [], []]
            for text in texts:
                ids, back = codec.digits(text or "")
                ids = f"{ids} {codec.end_id}".lstrip()
                row = (
                    ids.count(" ") + 1, list(map(int, ids.split())) if with_ids else None, back if with_ids else None,
                    hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ]
    return per_row(docs, id_col, text_col, fields, make)
