"""How the tokens of two tokenizers correspond, over a whole corpus.

Both tokenizers cut the same bytes.  Offsets where both end a token cut the text into groups; a link joins the two
tokens that end a group.  Most groups are one token of each with the same bytes, and which token of B that is follows
from the token of A alone.  So an array from ids of A to ids of B with the same bytes is made once, such groups are
counted in vectors as long as the vocabulary, and only links of other groups are shuffled as pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS_AT_ONCE, field, held, joined_counts, stored

SPACE = " "
#: Texts of these characters and at most this length are cut alike by the quick library; others go to the tokenizer itself.
SIMPLE = re.compile("[\x00-ɏ‐-‧]*")
SIMPLE_LENGTH = 100_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Ids of a byte-level BPE file and the bytes of each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        letters = _byte_letters()
        self.bytes = [b""] * self.whole.get_vocab_size()
        for piece, i in self.whole.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.quick = self._quick(path)

    def _quick(self, path: str):
        """The same merges in a quicker library, if the file is of the plain kind, in which ids are in the order of merges."""
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = {t["id"] for t in made["added_tokens"]}
        ids = [made["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in made["model"]["merges"]]
        cut = made["pre_tokenizer"] or {}
        usual = made["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if not usual or any(a >= b for a, b in zip(ids, ids[1:])) or min(ids, default=0) < 256:
            return None
        import public_tokenizers
        import tiktoken

        ranks = {b: i for i, b in enumerate(self.bytes) if i not in special}
        return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.quick and len(text) <= SIMPLE_LENGTH and SIMPLE.fullmatch(text):
            return self.quick.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids of a sentencepiece model, which puts a space before the text, and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", SPACE).encode()

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text)


class Aligner:
    """Groups and links of one text; made in each task."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.a_len, self.b_len = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        same: dict[bytes, int] = {}
        for i in reversed(range(len(self.b.bytes))):
            if not self.b.model.is_byte(i) and not self.b.model.is_control(i):
                same[self.b.bytes[i]] = i
        #: for each id of A the id of B with the same bytes, or -1
        self.same = np.array([same.get(x, -1) for x in self.a.bytes], np.int64)
        texts = [[f"{i}{mark}" for i in range(len(t.bytes))] for t, marks in ((self.a, ",|"), (self.b, ",;")) for mark in marks]
        self.written = np.array([s for part in texts for s in part], object)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:
            return None
        raw = (SPACE + text).encode("utf-8", "surrogatepass")
        a = self.a(SPACE + text)
        if b"".join(map(self.a.bytes.__getitem__, a)) != raw:
            return None
        b = self.b(text)
        if b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def __call__(self, text: str | None) -> dict | None:
        found = self.tokens(text)
        if found is None:
            return None
        a, b = found
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends = np.zeros(int(a_end[-1]) + 1, np.int8)
        ends[a_end] = 1
        ends[b_end] += 1
        a_cut, b_cut = ends[a_end] == 2, ends[b_end] == 2
        # groups before each token; a token is written after all of A of its group and of earlier groups, and so on
        a_group, b_group = (np.cumsum(c) - c for c in (a_cut, b_cut))
        a_upto, b_upto = np.flatnonzero(a_cut) + 1, np.r_[0, np.flatnonzero(b_cut) + 1]
        place = np.empty(len(a) + len(b), np.int64)
        n_a, n_b = len(self.a.bytes), len(self.b.bytes)
        place[np.arange(len(a)) + b_upto[a_group]] = a + n_a * a_cut
        place[np.arange(len(b)) + a_upto[b_group]] = 2 * n_a + b + n_b * b_cut
        groups = "".join(self.written[place].tolist())[:-1]
        last_a, last_b = a[a_cut], b[b_cut]
        exact = self.same[last_a] == last_b
        ids, counts = np.unique(last_a[exact], return_counts=True)
        pairs, times = np.unique(last_a[~exact] << 32 | last_b[~exact], return_counts=True)
        return {
            "n_a": len(a), "n_b": len(b), "n_groups": len(last_a), "groups": groups,
            "groups_sha256": hashlib.sha256(groups.encode()).hexdigest(),
            "exact": np.concatenate([ids, counts]).astype("<u4").tobytes(),
            "pairs": [{"a": int(p >> 32), "b": int(p & 0xFFFFFFFF), "n": int(n)} for p, n in zip(pairs, times, strict=True)],
        }


PAIRS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())]))
NUMBERS = ("n_a", "n_b", "n_groups")
EMPTY = {"n_a": 0, "n_b": 0, "n_groups": 0, "groups": "", "groups_sha256": "", "exact": b"", "pairs": []}


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def groups_of(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, exact, pairs[, groups]) for each row: exact links as ids of A with counts, others as pairs."""
    made = [*map(_long, NUMBERS), T.StructField("groups_sha256", T.StringType()), T.StructField("exact", T.BinaryType()), T.StructField("pairs", PAIRS)]
    made += [T.StructField("groups", T.StringType())] if with_groups else []
    schema = T.StructType([field(docs, id_col), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, aligner = to_arrow_schema(schema), held(("align", a_path, b_path), lambda: Aligner(a_path, b_path))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = [aligner(t.as_py()) or EMPTY for t in part.column(1)]
                arrays = [pa.array([r[f.name] for r in rows], arrow.field(i).type) for i, f in enumerate(made, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *arrays], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _read(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(packed, "<u4").astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def exact_counts(found: DataFrame, size: int) -> np.ndarray:
    """How many exact links each id of A has: a vector in each task, then one sum for each id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                ids, counts = _read(packed.as_py())
                total[ids] += counts
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], names=["a", "n"])

    total = np.zeros(size, np.int64)
    for r in found.select("exact").mapInArrow(count, "a int, n bigint").groupBy("a").agg(F.sum("n").alias("n")).collect():
        total[r["a"]] = r["n"]
    return total


def align_tokens(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True
) -> tuple[DataFrame, DataFrame]:
    """How tokenizer A (byte-level BPE file) and B (sentencepiece model) cut each text, and which tokens go together.

    First: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) for each row.  A link's count is
    how many links of all texts hold its pair of ids; ``n_best`` are links whose count is the highest of their id of B,
    ties included, ``count_sum`` adds the counts up.  ``groups`` is written ``a1,a2|b1;a3|b2,b3``.  Second: (a, b, n),
    the count of each pair.

    A text that is null, empty or not given back byte for byte by both tokenizers has no tokens: zeros, ''.  Repeated
    rows each count and each have a result, null ids too; an empty table gives empty ones; further columns are ignored.
    """
    spark = docs.sparkSession
    found = stored(groups_of(docs, a_path, b_path, id_col, text_col, with_groups).withColumn("row", F.monotonically_increasing_id()), "token-groups")
    same = Aligner(a_path, b_path).same
    exact = exact_counts(found, len(same))
    rows = found.select("row", F.explode("pairs").alias("p")).select("row", "p.a", "p.b", "p.n")
    counts = stored(rows.groupBy("a", "b").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("texts")), "token-pairs")
    # both are no longer than a vocabulary
    best = np.zeros(max(int(same.max(initial=0)), 0) + 1, np.int64)
    np.maximum.at(best, same[exact > 0], exact[exact > 0])
    seen = {r["b"]: r["n"] for r in counts.groupBy("b").agg(F.max("count").alias("n")).collect()}
    best = np.pad(best, (0, max(0, max(seen, default=0) + 1 - len(best))))
    for b, n in seen.items():
        best[b] = max(best[b], n)
    tops = spark.createDataFrame([(int(b), int(n)) for b, n in enumerate(best) if n], "b int, best bigint")
    marked = counts.join(F.broadcast(tops), "b").select("a", "b", "count", "texts", (F.col("count") == F.col("best")).alias("top"))
    total = counts.agg(F.sum("texts")).first()[0] or 0
    irregular = joined_counts(rows, marked, ["a", "b"], "texts", total, "row")
    irregular = irregular.groupBy(F.col("row").alias("of")).agg(
        F.sum(F.when(F.col("top"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum")
    )
    top = np.zeros(len(same), bool)
    top[exact > 0] = exact[exact > 0] == best[same[exact > 0]]
    kept = [c for c in found.columns if c not in ("exact", "pairs")]
    schema = T.StructType([*[found.schema[c] for c in kept], _long("exact_best"), _long("exact_sum")])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[], []]
            for packed in batch.column(len(kept)):
                ids, n = _read(packed.as_py())
                made[0].append(int(n[top[ids]].sum()))
                made[1].append(int((n * exact[ids]).sum()))
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(m, pa.int64()) for m in made]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "exact_best", "exact_sum"])

    per_text = found.select(*kept, "exact").mapInArrow(sums, schema).join(irregular, F.col("row") == F.col("of"), "left")
    per_text = per_text.withColumn("n_links", F.col("n_groups"))
    for name in ("best", "sum"):
        per_text = per_text.withColumn(f"all_{name}", F.col(f"exact_{name}") + F.coalesce(f"more_{name}", F.lit(0)))
    out = [id_col, *NUMBERS, "n_links", F.col("all_best").alias("n_best"), F.col("all_sum").alias("count_sum"), "groups_sha256"]
    regular = spark.createDataFrame([(int(a), int(same[a]), int(exact[a])) for a in np.flatnonzero(exact)], "a int, b int, n bigint")
    return per_text.select(*out, *(["groups"] if with_groups else [])), regular.unionByName(counts.select("a", "b", F.col("count").alias("n")))
