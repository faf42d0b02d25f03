"""Text rules as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and the same set as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# What is cut off the end of a question.
TRAILING_PUNCTUATION = rf"[{WS_CLASS}?!.,;:…]+$"
# one word: letters, marks of letters, digits of any script, underscore
NOT_WORD = r"[^\p{L}\p{N}_]+"


def strip_ws(c: Column) -> Column:
    """Cut white space of any script off both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def normalize_query(q: Column) -> Column:
    """Trim, one blank between words, lower case, no trailing punctuation; NULL gives ''."""
    one_blank = F.regexp_replace(strip_ws(F.coalesce(q, F.lit(""))), f"[{WS_CLASS}]+", " ")
    return F.regexp_replace(F.lower(one_blank), TRAILING_PUNCTUATION, "")


def tokens(c: Column) -> Column:
    """Words of a text, lower case, in order, with repeats."""
    return F.filter(F.split(F.lower(c), NOT_WORD), lambda t: t != "")


def contains_brand(q: Column, brand: Column) -> Column:
    """Every word of the brand is a whole word of the question; a brand without words is never named."""
    wanted = tokens(F.coalesce(brand, F.lit("")))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens(normalize_query(q)))) == 0)


def normalize_brand_name(n: Column) -> Column:
    """Display form of a brand name: single blanks, trimmed."""
    return F.regexp_replace(strip_ws(n), f"[{WS_CLASS}]+", " ")


def brand_match_key(n: Column) -> Column:
    """Key under which two spellings are one brand.

    Upper case first, so that letters whose upper case is longer (ß, ligatures) fold as in full case folding.
    """
    return F.lower(F.upper(normalize_brand_name(n)))


def split_phrase_text(s: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(strip_ws(s), F.lit(""))
