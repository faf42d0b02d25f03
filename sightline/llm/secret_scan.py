"""Secrets, found by patterns and by how little of them a primed compressor knows.

A string in a sensitive context (near a word like "key" or "bearer") is compressed by zstandard between the text around
it, primed with a dictionary of the identifiers that the corpus uses most.  The bytes that it adds are its novelty:
names, paths and repeated values add few, random strings about one a character.  What stays incompressible is reported
beside the plain patterns.  All positions are code points, the end is exclusive.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, per_row
from .pii import SPANS, Span

KINDS = ("assign", "access", "hex")
NOVEL = "novel"

ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
LEAST_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters and more; runs are as long as they go
HEX = re.compile(r"[0-9a-f]{16,}")

SENSITIVE = re.compile(
    r"(?i:(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secrets?|tokens?|(?:api|access|private|signing|encryption|account|auth)[_ -]?keys?"
    r"|auth(?:orization|entication)?|bearer|basic|credentials?|signature|session[_ -]?id|cookie|client[_ -]?id|webhook|salt|seed"
    r"|connection[_ -]?string|dsn|ssh-[a-z0-9]+)(?![a-z]))",
    re.A,
)
BEFORE, AFTER = 40, 120  # code points around a sensitive word in which a candidate starts
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{8,}={0,2}")
ASSIGNED = re.compile(r"(?:[:=]\s{0,4}[\"'`]?|[\"'`])$")
DIGIT, LETTER, PATH = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[./]")

CONTEXT = 256  # code points on either side that prime the compressor
NOVELTY = 0.75  # bytes added for each byte of the candidate, from which it is reported
DICTIONARY_WORDS = 4000
DICTIONARY_BYTES = 32_000
DICTIONARY_PARTS = 16
TAIL = b"\n\n# end of the excerpt\n"  # the compressor looks for no matches in its last bytes


def plain(text: str) -> list[Span]:
    """Spans of the plain patterns, leftmost and not overlapping within a kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings in a sensitive context that are shaped like a value: letters with digits, or one word that is assigned.

    The neighbourhoods of sensitive words are joined before they are read, so each string is looked at once.
    """
    found, done = [], 0
    for word in SENSITIVE.finditer(text):
        stop = word.end() + AFTER
        while (m := CANDIDATE.search(text, max(done, word.start() - BEFORE), stop + 8)) and m.start() < stop:
            m = CANDIDATE.match(text, m.start())  # to its own end, which may lie further on
            done = m.end()
            value = m.group()
            if LETTER.search(value) and (
                DIGIT.search(value) or (not PATH.search(value) and ASSIGNED.search(text, max(0, m.start() - 6), m.start()))
            ):
                found.append(m.span())
    return found


class Novelty:
    """Marginal compressed bytes of strings; made in each task, as compressors cannot be sent."""

    def __init__(self, dictionary: bytes):
        params = zstandard.ZstdCompressionParameters(
            compression_level=3, strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=16, chain_log=17, search_log=6, min_match=3,
            target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        primed = zstandard.ZstdCompressionDict(dictionary or TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=params)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, compression_params=params)

    def size(self, *parts: str) -> int:
        return len(self.compressor.compress("".join(parts).encode("utf-8", "replace") + TAIL))

    def __call__(self, text: str, a: int, b: int) -> float:
        """Bytes that the string adds to its surroundings, for each of its own; other places of the same string count for nothing."""
        value = text[a:b]
        before, after = (t.replace(value, "") for t in (text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]))
        return (self.size(before, value, after) - self.size(before, after)) / len(value)


def _order(spans) -> list[Span]:
    kinds = (*KINDS, NOVEL)
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def find(text: str | None, novelty: Novelty) -> tuple[list[Span], list[Span]]:
    """Plain spans, and plain with novel ones; a novel span within a plain one is left out."""
    text = text or ""
    base, more, at = _order(plain(text)), [], 0
    by_start = sorted({(a, b) for a, b, _ in base})
    reach: list[int] = []  # the furthest end of the spans up to each
    for _, b in by_start:
        reach.append(max(b, reach[-1] if reach else 0))
    for a, b in candidates(text):
        while at < len(by_start) and by_start[at][0] <= a:
            at += 1
        if (not at or reach[at - 1] < b) and novelty(text, a, b) >= NOVELTY:
            more.append((a, b, NOVEL))
    return base, _order([*base, *more])


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with ``[SECRET]`` in place of the spans; spans that meet become one."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def identifier_dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS, most: int = DICTIONARY_BYTES) -> bytes:
    """The identifiers (letters and underscores, 4 to 24) that most texts hold, the most frequent last.

    Counted over all texts; only the ``words`` most frequent reach the driver.
    """
    found = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z0-9_]++"), F.lit(0)))
    names = docs.select(F.explode(found).alias("w")).where(F.col("w").rlike("^[A-Za-z_]{4,24}$"))
    counted = names.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # each of a few parts is cut to the words that can matter, so that what the driver gets does not grow with the tasks
    part = Window.partitionBy(F.pmod(F.xxhash64("w"), F.lit(DICTIONARY_PARTS))).orderBy(F.desc("n"), "w")
    most_frequent = counted.withColumn("place", F.row_number().over(part)).where(F.col("place") <= words)
    top = [r["w"] for r in most_frequent.orderBy(F.desc("n"), "w").limit(words).collect()]
    return " ".join(reversed(top)).encode()[-most:]


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, kept columns, base, spans, redacted) for each row: plain spans, all spans, the text without them.

    ``dictionary`` primes the compressor; where none is given it is made from the identifiers of all texts.  Null has no
    spans and stays null when redacted; the empty text has none either.  Spans that start together are ordered by kind,
    then end.  Repeated rows give repeated results, an empty table an empty one; further columns are ignored.
    """
    primed = identifier_dictionary(docs, text_col) if dictionary is None else dictionary

    def make():
        novelty = held(("secrets", primed), lambda: Novelty(primed))

        def work(texts):
            found = [find(t, novelty) for t in texts]
            as_rows = [[[{"start": a, "end": b, "kind": k} for a, b, k in f[i]] for f in found] for i in (0, 1)]
            return [*as_rows, [redact(t, f[1]) for t, f in zip(texts, found, strict=True)]]

        return work

    fields = [T.StructField("base", SPANS), T.StructField("spans", SPANS), T.StructField("redacted", T.StringType())]
    return per_row(docs, id_col, text_col, fields, make, keep)
