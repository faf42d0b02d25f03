"""Fingerprints of documents by consistent weighted sampling.

A document is a set of words with their counts as weights.  For each of the samples a word of weight S draws r and c, both
gamma distributed with shape 2, and b, uniform, from hashes of the word and the sample's number, the same in every document.
With t = floor(ln S / r + b) and y = exp(r (t - b)), the word of least c / (y exp r) is the sample, together with its t.  Two
documents have the same sample with the probability of their generalised Jaccard similarity, the sum of the smaller weights
over the sum of the larger ones; weights need not be whole numbers.  What is compared is the logarithm,
ln c - r (t - b + 1), in steps of 2^-40; a gamma value of shape 2 is -ln of the product of two uniform ones.  Everything is
columns and SQL functions.

Most words are ruled out without a logarithm.  With c = -ln(v1 v2) and r = -ln(u1 u2) no word compares lower than the logarithm
of (2 - v1 - v2) u1 u2 / S, as -ln v >= 1 - v and r (t - b + 1) <= ln S + r; for S = 1, where t = 0, of that over
1 - b (1 - u1 u2), as a geometric mean is not below the harmonic one.  The least of a document of n words is below
REACH / n but once in e^REACH samples; only words that may be are worked out, and all words of a document where none was.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLES = 64
REACH = 20.0
SLACK = 1.00001
CELLS = 256
MOST_BUCKETS = 1 << 20
ROWS_IN_BUCKET = 2000


def _terms(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, n_words, term, weight, w): number of words, a hash of each word, its count and the logarithm of that.

    Texts without a word have one row with 0 and null.
    """
    words = F.filter(F.split(F.translate(F.col(text), "\n\r\t", "   "), " "), lambda w: w != "")
    hashed = df.select(*keys, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("hs"))
    n = F.greatest(F.size("hs"), F.lit(0))
    begins = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get("hs", i) != F.get("hs", i - 1)))
    runs = hashed.select(*keys, "hs", n.alias("n_words"), F.when(n > 0, begins).otherwise(F.array(F.lit(0))).alias("at"))
    pairs = F.transform(
        F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(1))),
        lambda s, i: F.struct(F.get("hs", s).alias("term"), (F.get("at", i + 1) - s).alias("weight")),
    )
    rows = runs.select(*keys, "n_words", F.explode(pairs).alias("p")).select(*keys, "n_words", "p.term", "p.weight")
    return rows.withColumn("w", F.ln(F.col("weight").cast("double")))


def _draw(k: int) -> tuple[str, str]:
    """SQL of a condition and a whole number for (term, w) and a sample, of ``_terms`` and a limit ``most``, with ``once`` 1 or 0.

    The condition holds where the value to compare, or rather its exponential times S, may be up to ``most``.  The number is
    that value, and in the lower 16 bits what names word and t; null without a word.  Two hashes give five uniform numbers: 21
    bits each for r and b, 31 bits each for c.
    """
    h1, h2 = f"xxhash64(term, {k})", f"xxhash64(term, {k}, 1)"
    part = lambda h, at, bits: f"((shiftrightunsigned({h}, {at}) & {(1 << bits) - 1}) + 0.5D) * {2.0**-bits!r}D"
    u1, u2, v1, v2 = part(h1, 0, 21), part(h1, 21, 21), part(h2, 0, 31), part(h2, 32, 31)
    r = f"(- ln({u1} * {u2}))"
    b = f"({part(h1, 42, 21)})"
    c = f"ln(- ln({v1} * {v2}))"
    t = f"CAST(w / {r} + {b} AS BIGINT)"  # not negative, so cut off is rounded down

    # the bits drawn and counts of 31 bits keep values between -74 and 4
    value = f"CAST(({c} - {r} * ({t} - {b} + 1D) + 80D) * {2.0**40!r}D AS BIGINT)"
    drawn = f"shiftleft({value}, 16) | ((shiftrightunsigned({h2}, 7) + {t} * 40503L) & 65535L)"
    return f"(2D - ({v1}) - ({v2})) * ({u1} * {u2}) <= most * (1D - once * {b} * (1D - ({u1} * {u2})))", drawn


def _drawn(df: DataFrame, text: str, keys: list[str], reach: float | None) -> DataFrame:
    """(keys, sig, sure): signatures from the words that may compare below ``reach`` / n, or from all without it.

    ``sure`` is false where a sample has no value below that limit, so that a word left out might have a lower one.
    """
    found = _terms(df, text, keys)
    conditions, draws = zip(*(_draw(k) for k in range(SAMPLES)), strict=True)
    if reach is not None:
        found = found.withColumn("most", F.lit(reach * SLACK) * F.col("weight") / F.col("n_words"))
        found = found.withColumn("once", F.when(F.col("weight") == 1, 1.0).otherwise(0.0))
        draws = [f"CASE WHEN {may} THEN {draw} END" for may, draw in zip(conditions, draws, strict=True)]
    drawn = found.groupBy(*keys).agg(F.max("n_words").alias("n_words"), *(F.min(F.expr(d)).alias(f"s{k}") for k, d in enumerate(draws)))
    of = [F.col(f"s{k}") for k in range(SAMPLES)]
    limit = F.lit(2.0**40) * (F.ln(F.lit(reach or 1.0) / F.col("n_words")) + 80)
    below = F.coalesce(F.shiftright(F.greatest(*of), 16) < limit, F.lit(False)) & reduce(and_, [s.isNotNull() for s in of])
    sure = F.lit(True) if reach is None else (F.col("n_words") == 0) | below
    sig = F.when(F.col("n_words") > 0, F.array(*(s.bitwiseAND(F.lit(0xFFFF)).cast("int") for s in of)))
    return drawn.select(*keys, sig.alias("sig"), sure.alias("sure"))


def signatures(df: DataFrame, text: str, keys: list[str], reach: float = REACH) -> DataFrame:
    """(keys, sig) with one row for each value of the keys, none of them null; sig has SAMPLES numbers of 16 bits, null without a word.

    Signatures are written to the shared folder; those of documents with an unsure sample are then drawn from all words.
    """
    most = stored(_drawn(df, text, keys, reach), "signatures")
    unsure = most.where("NOT sure")
    if unsure.isEmpty():
        return most.drop("sure")
    whole = stored(_drawn(df.join(unsure.select(*keys), keys, "left_semi"), text, keys, None), "signatures")
    return most.where("sure").union(whole).drop("sure")


def as_text(sig: Column) -> Column:
    """Four hex digits a sample; the empty string for a text without a word."""
    return F.coalesce(F.array_join(F.transform(sig, lambda s: F.lower(F.lpad(F.hex(s), 4, "0"))), ""), F.lit(""))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal samples; 1 for two texts without a word, 0 for one of them."""
    same = F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e))
    none = F.when(x.isNull() & y.isNull(), 1.0).otherwise(0.0)
    return F.when(x.isNull() | y.isNull(), none).otherwise(same / float(SAMPLES))


def _bucket(bounds: list, parts: int, id_col: str) -> Column:
    """A number that grows with the id: cells between quantiles, each cut into parts of equal width."""
    held = F.expr(f"CAST(split('{','.join(map(str, bounds))}', ',') AS ARRAY<BIGINT>)")
    cell = F.greatest(F.least(F.size(F.filter(held, lambda b: b <= F.col(id_col))) - 1, F.lit(len(bounds) - 2)), F.lit(0))
    low, high = F.get(held, cell), F.get(held, cell + 1)
    part = F.floor((F.col(id_col) - low).cast("double") * parts / (high - low + 1).cast("double"))
    return (cell * parts + F.greatest(F.least(part, F.lit(parts - 1)), F.lit(0))).cast("bigint")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(b, rn, id, text, next_text, next_b, next_rn): each document with the next one, in descending order of the id.

    After the last comes the first.  Texts are shuffled once, by buckets of neighbouring ids; the first document of a
    bucket also goes, as a guest, to the end of the bucket before.  Of each bucket only the largest id comes to the driver.
    Rows of one id are in the order of a hash of their text; rows without an id are left to the caller.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    probs = [i / CELLS for i in range(1, CELLS)]
    s = rows.agg(
        F.count("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.percentile_approx("id", probs, 10000).alias("q")
    ).first()
    bounds = sorted({s["lo"], *(s["q"] or []), s["hi"]}) if s["n"] else [0, 1]
    bounds = bounds if len(bounds) > 1 else [bounds[0], bounds[0] + 1]
    wanted = max(s["n"] // ROWS_IN_BUCKET, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, min(-(-wanted // (len(bounds) - 1)), MOST_BUCKETS // len(bounds)))
    placed = rows.where("id IS NOT NULL").withColumn("home", _bucket(bounds, parts, "id"))
    heads = sorted((r["home"], r["top"]) for r in placed.groupBy("home").agg(F.max("id").alias("top")).collect())
    guests = [(top, heads[(i + 1) % len(heads)][0]) for i, (_, top) in enumerate(heads)]
    guests = spark.createDataFrame(guests, "top bigint, at bigint")  # MOST_BUCKETS rows at most
    placed = placed.join(F.broadcast(guests), placed["id"] == guests["top"], "left")
    here, there = F.struct(F.col("home").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("at").alias("b"), F.lit(True).alias("guest"))
    spots = F.when(F.col("at").isNull(), F.array(here)).otherwise(F.array(here, there))
    placed = placed.select("id", "text", "home", F.explode(spots).alias("s")).select("id", "text", "home", "s.b", "s.guest")
    order = Window.partitionBy("b").orderBy("guest", F.desc("id"), F.xxhash64("text"))
    ranked = placed.select(
        "b", F.row_number().over(order).alias("rn"), "id", "text", "guest", F.lead("text").over(order).alias("next_text"),
        F.lead("home").over(order).alias("next_b"), F.lead("guest").over(order).alias("next_guest"),
    ).where(~F.col("guest"))
    numbered = ranked.select(
        "b", "rn", "id", "text", "next_text", "next_b", F.when(F.col("next_guest"), 1).otherwise(F.col("rn") + 1).alias("next_rn")
    )
    return numbered


def edited(text: Column, following: Column) -> Column:
    """The text whose last third is replaced by the first characters of another one, as many or all of them."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text ends with the beginning of the next document (see ``with_next``); near_edited and near_next are the
    likeness to the fingerprints of the edited text and of the next document.  Null counts as the empty text, whose
    fingerprint is empty.  A table of one row is its own next one.  Rows with a null id have a null edited digest, a null
    edited fingerprint and null likenesses.  Repeated rows are rows of their own; an empty table gives an empty one;
    further columns are ignored.  Ids are integers.
    """
    id_type = docs.schema[id_col].dataType
    numbered = with_next(docs, id_col, text_col).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    both = F.array(
        F.struct(F.lit(0).alias("v"), F.col("text").alias("t"), F.lit("").alias("sha")),
        F.struct(F.lit(1).alias("v"), F.col("edit").alias("t"), F.sha2("edit", 256).alias("sha")),
    )
    keys = ["b", "rn", "id", "n_chars", "next_b", "next_rn", "v", "sha"]
    versions = numbered.select(
        "b", "rn", "id", F.char_length("text").cast("bigint").alias("n_chars"), "next_b", "next_rn", F.explode(both).alias("x")
    ).select(*keys[:6], "x.v", "x.sha", "x.t")
    sigs = signatures(versions, "t", keys)
    own = sigs.where("v = 0").select("b", "rn", "id", "n_chars", "next_b", "next_rn", F.col("sig").alias("own"))
    edit = sigs.where("v = 1").select("b", "rn", "sha", F.col("sig").alias("edit"))
    after = own.select(F.col("b").alias("next_b"), F.col("rn").alias("next_rn"), F.col("own").alias("after"))
    joined = own.join(edit, ["b", "rn"]).join(after, ["next_b", "next_rn"])
    made = joined.select(
        F.col("id").cast(id_type).alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
    lost = docs.where(F.col(id_col).isNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lost = lost.withColumn("key", F.sha2("t", 256))
    copies = lost.groupBy("key").agg(F.count("*").alias("copies"), F.first("t").alias("t"))
    lost = signatures(copies.select("key", "copies", F.char_length("t").cast("bigint").alias("n"), "t"), "t", ["key", "copies", "n"])
    lost = lost.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        F.lit(None).cast(id_type).alias(id_col), F.col("n").alias("n_chars"), F.lit(None).cast("string").alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"), F.lit(None).cast("string").alias("edited_fingerprint"),
        F.lit(None).cast("double").alias("near_edited"), F.lit(None).cast("double").alias("near_next"),
    )
    return made.union(lost)
