"""Personal data, also where it is disguised.

Plain identifiers are found in the text as it is.  Then small transducers rewrite the text (look-alike characters,
spelled digits, "at" and "dot"), each keeping for every character where it came from; what is found in the rewritten
text is mapped back to places of the source.  All positions are code points, the end is exclusive.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import per_row

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХабеѕіјкмнорстухԁһӏԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχ‐‑‒–−․﹒",
        "ABESIJKMHOPCTYXabesijkmhopctyxdhlqwABEZHIKMNOPTYXaiKvoptux-----..",
        strict=True,
    )
)
HIDDEN = "­​‌‍⁠﻿"
NUMERALS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}
ODD = re.compile(f"[{''.join(LOOKALIKES)}{HIDDEN}！-～]|(?![0-9])\\d")
NUMBER_WORD = "(?:" + "|".join(NUMERALS) + ")"
AT_WORD = r"(?:[ ]at[ ]|[ ]?[(\[{<][ ]?at[ ]?[)\]}>][ ]?)"
DOT_WORD = r"(?:[ ]dot[ ]|[ ]?[(\[{<][ ]?dot[ ]?[)\]}>][ ]?)"
UNIT = rf"(?:{NUMBER_WORD}|[0-9]+)"
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[ -]?)?{UNIT}(?:(?:[ .()-]{{1,3}}|{DOT_WORD}){UNIT})+(?![A-Za-z0-9])", re.I)
ONE_NUMBER = re.compile(NUMBER_WORD, re.I)
PLUS = re.compile(r"plus[ -]?", re.I)
IN_BRACKETS = re.compile(r"[ ]?[(\[{<][ ]?(at|dot)[ ]?[)\]}>][ ]?", re.I)
# the end of an email from its "at" on, each "at" and "dot" spelled or not, and not the beginning of another one
DOMAIN_PART = rf"[A-Za-z0-9-]++(?:(?:\.|{DOT_WORD})[A-Za-z0-9-]++)++"
AT_DOMAIN = re.compile(rf"(?:@|({AT_WORD})){DOMAIN_PART}(?![@_%+]|{AT_WORD}{DOMAIN_PART})", re.I)
ONE_DOT = re.compile(DOT_WORD, re.I)
DOT_BEFORE = re.compile(rf"{DOT_WORD}\Z", re.I)
DOT_ROOM = len(" ( dot ) ")
# "look at example.com": words that stand before a place, where neither "at" nor "dot" shows that an email is meant
BEFORE_PLACE = frozenset(
    "a an and are at available be been call find found go here him her hosted i in is it join look looked looking me meet more on online or read "
    "see seen site that the them there they this up us visit was we web website were you".split()
)
IP_PART = "(?:[0-9]{1,3}|[0-9](?:[ -][0-9]){1,2})"
SPOKEN_IP = re.compile(rf"(?<![0-9.]){IP_PART}(?:(?:\.|{DOT_WORD}){IP_PART}){{3}}(?!\.?[0-9])", re.I)
IN_IP = re.compile(rf"({DOT_WORD})|(?<=[0-9])[ -](?=[0-9])", re.I)

def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, free := m.end(), "email"))
        # places before this one are in no later match
        free = max(free, at + 1)
        at = text.find("@", free)
    return found


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def identifiers(text: str) -> list[Span]:
    """Plain identifiers of every kind, leftmost and not overlapping within a kind."""
    found = _emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if m.group(1) and all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
                found.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


class Source:
    """A text that was rewritten, with the place in the source of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | None = None
        self.end: list[int] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in place of slices; edits are in order and do not overlap."""
        if not edits:
            return
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _plain(c: str) -> str:
    if c in HIDDEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    return chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else str(unicodedata.digit(c, 0))


def _odd(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), _plain(m.group())) for m in ODD.finditer(text)]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Digits for number words beside other numbers; whether they make an identifier shows in the rewritten text."""
    low = text.lower()
    if "plus" not in low and not any(w in low for w in NUMERALS):
        return []
    edits = []
    for run in SPELLED.finditer(text):
        words = [(*w.span(), NUMERALS[w.group().lower()]) for w in ONE_NUMBER.finditer(text, *run.span())]
        if p := PLUS.match(text, *run.span()):
            edits.append((*p.span(), "+"))
        edits += words
    return edits


def _spoken(text: str) -> list[tuple[int, int, str]]:
    """Emails in which "at" or a "dot" is spelled, in any mix with plain ones."""
    low = text.lower()
    if not ("@" in text or " at " in low or IN_BRACKETS.search(low)):
        return []
    edits, free = [], 0
    for m in AT_DOMAIN.finditer(text):
        start, dots = m.start(), []
        while True:
            end = start
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            room = max(free, start - DOT_ROOM)
            d = DOT_BEFORE.search(text[room:start]) if start < end else None
            if not d or room + d.start() <= free or text[room + d.start() - 1] not in LOCAL:
                break
            dots.insert(0, (room + d.start(), start, "."))
            start = room + d.start()
        if start == m.start():
            continue
        at = m.end(1) if m.group(1) else m.start() + 1
        dots += [(*d.span(), ".") for d in ONE_DOT.finditer(text, at, m.end())]
        if not dots and (m.group(1) or "").lower() == " at ":
            *_, name, last = text[at : m.end()].split(".")
            if text[start : m.start()].lower() in BEFORE_PLACE or len(last) < 2 or not last.isalpha() or (last.istitle() and name[:1].islower()):
                continue
        before = [d for d in dots if d[0] < m.start()]
        edits += [*before, *([(m.start(1), m.end(1), "@")] if m.group(1) else []), *dots[len(before) :]]
        free = m.end()
    return edits


def _spoken_ip(text: str) -> list[tuple[int, int, str]]:
    return [(*d.span(), "." if d.group(1) else "") for m in SPOKEN_IP.finditer(text) for d in IN_IP.finditer(text, *m.span())]


def _in_brackets(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@" if m.group(1).lower() == "at" else ".") for m in IN_BRACKETS.finditer(text)]


def disguised(text: str) -> list[Span]:
    """Identifiers of the rewritten text, as places of the source; empty where nothing was to rewrite."""
    source = Source(text)
    for edits in (_odd, _spelled, _spoken, _spoken_ip, _in_brackets):
        source.rewrite(edits(source.text))
    if source.text == text:
        return []
    return [(*source.span(a, b), kind) for a, b, kind in identifiers(source.text)]


def _order(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and plain with disguised ones; a disguised span within a plain one of its kind is left out."""
    text = text or ""
    base = identifiers(text)
    more = [s for s in disguised(text) if not any(b[2] == s[2] and b[0] <= s[0] and s[1] <= b[1] for b in base)]
    return _order(base), _order({*base, *more})


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with ``[EMAIL]`` and the like in place of the spans; spans that meet become one, named by the first."""
    if text is None or not spans:
        return text
    merged: list[list] = []
    for a, b, kind in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    out, at = [], 0
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, base, spans, redacted) for each row: plain spans, all spans, the text without them.

    Null has no spans and stays null when redacted; the empty text has none either.  Repeated rows give repeated
    results, an empty table an empty one; further columns are ignored.
    """

    def make():
        def work(texts):
            found = [find(t) for t in texts]
            as_rows = [[[{"start": a, "end": b, "kind": k} for a, b, k in f[i]] for f in found] for i in (0, 1)]
            return [*as_rows, [redact(t, f[1]) for t, f in zip(texts, found, strict=True)]]

        return work

    fields = [T.StructField("base", SPANS), T.StructField("spans", SPANS), T.StructField("redacted", T.StringType())]
    return per_row(docs, id_col, text_col, fields, make, keep)
