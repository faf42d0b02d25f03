"""Building clean question sets out of candidate questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contains_brand, normalize_query, strip_ws, tokens
from ..schemas import LENSES
from ..session import discard, scratch_path
from .skew import first_per_key, top_per_key
from .validation import coerce_lens, coerce_text, let, read_fields

_BLANK = "Value error, must be a non-empty string"
HOT_TOKEN_ROWS = 50_000
# near copies: up to how many texts of a set hold a rare word, and up to how many words a text has its frequent words paired
RARE_ROWS = 48
PAIRED_WORDS = 96


def _filled(v: Column) -> Column:
    """Text with something in it, trimmed."""
    return let(coerce_text(v), lambda t: let(strip_ws(t["value"]), lambda text: F.struct(
        text.alias("value"), F.coalesce(t["error"], F.when(text == "", _BLANK)).alias("error")
    )))


_FIELDS = {
    "query": (_filled, "string"),
    "lens": (coerce_lens, "string"),
    "segment": (_filled, "string"),
    "signal": (_filled, "string"),
    "source_url": (_filled, "string"),
    "note": (lambda v: coerce_text(v, True), "string"),
}


def validate_candidates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw`` VARIANT candidates to (typed and trimmed, errors(index, query, field, msg))."""
    keys = [c for c in raw.columns if c != "raw"]
    refusal = F.struct(
        F.lit("?").alias("field"),
        F.lit("Input should be a valid dictionary or instance of QuestionCandidate").alias("msg"),
    )
    checked = read_fields(raw, _FIELDS, refusal)
    good = checked.where(F.col("field_error").isNull()).drop("field_error", "echoed_query")
    bad = checked.where(F.col("field_error").isNotNull()).select(
        *keys, F.col("echoed_query").alias("query"), "field_error.field", "field_error.msg"
    )
    return good, bad


def lens_brand_guard(df: DataFrame, brand: Column) -> tuple[DataFrame, DataFrame]:
    """General questions must not name the brand, branded ones must; without a brand all pass."""
    named = contains_brand(F.col("query"), brand)
    given = F.coalesce(brand, F.lit("")) != ""
    msg = F.when(
        given & (F.col("lens") == "general") & named, "general lens must not name the brand"
    ).when(given & (F.col("lens") == "branded") & ~named, "branded lens must name the brand")
    judged = df.withColumn("msg", msg)
    errors = judged.where(F.col("msg").isNotNull()).withColumn("field", F.lit("lens"))
    keys = [c for c in ("set_id", "index") if c in df.columns]
    return judged.where(F.col("msg").isNull()).drop("msg"), errors.select(*keys, "query", "field", "msg")


def dedupe_questions(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First question by index per normalized text (and set)."""
    keyed = df.withColumn("_key", normalize_query(F.col("query")))
    return first_per_key(keyed, [*keys, "_key"], [F.col("index")]).drop("_key")


def questions_by_lens(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Questions per lens, zero where there are none."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("written"), *[F.count_if(F.col("lens") == lens).alias(lens) for lens in LENSES]
    )


def build_question_set(
    raw: DataFrame, brand: Column, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validate, guard, dedupe: (kept, errors, counts with dropped duplicates and errors)."""
    typed, invalid = validate_candidates(raw)
    accepted, misplaced = lens_brand_guard(typed, brand)
    kept = dedupe_questions(accepted, keys)
    columns = [*keys, "index", "query", "field", "msg"]
    errors = invalid.select(*columns).unionByName(misplaced.select(*columns))
    # counts need only the key columns of each side
    tally = (
        kept.select(*keys, "lens", F.lit("kept").alias("what"))
        .unionByName(accepted.select(*keys, "lens", F.lit("accepted").alias("what")))
        .unionByName(errors.select(*keys, F.lit(None).cast("string").alias("lens"), F.lit("error").alias("what")))
    )
    what = F.col("what")
    written = F.count_if(what == "kept")
    counts = tally.groupBy(*keys).agg(
        written.alias("written"),
        *[F.count_if((what == "kept") & (F.col("lens") == lens)).alias(lens) for lens in LENSES],
        (F.count_if(what == "accepted") - written).alias("dropped_dups"),
        F.count_if(what == "error").alias("errors"),
    )
    return kept, errors, counts


def grounded_only(df: DataFrame) -> DataFrame:
    """Candidates with a signal and a source."""
    def has(c: str) -> Column:
        return strip_ws(F.coalesce(c, F.lit(""))) != ""

    return df.where(has("signal") & has("source_url"))


def near_duplicate_questions(
    df: DataFrame, threshold: float = 0.8, hot_rows: int = HOT_TOKEN_ROWS, keys: Sequence[str] = ()
) -> DataFrame:
    """Questions without an earlier one of their set whose words overlap theirs by ``threshold`` (Jaccard) or more.

    A set is what ``keys`` tell apart (null keys are equal); ``index`` tells the questions of a set apart.
    Exact, without comparing all pairs.  Equal word sets collapse by an aggregate; ``_candidates`` gives the pairs of
    others that can overlap enough.  Of these every question first meets its likeliest earlier one, so a large group of
    near copies costs one comparison of words each; only those that this leaves open meet all others.  Word lists and
    verdicts are stored while this runs, the keys of what stays (``spark.checkpoint.dir``) for whoever reads the result.
    """
    spark = df.sparkSession
    words = F.sort_array(F.array_distinct(tokens(normalize_query(F.col("query")))))
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    sets = df.select(key.alias("set"), "index", words.alias("words")).where(F.col("words").isNotNull() & F.col("index").isNotNull())
    # without words no question is like another
    alone = F.when(F.size("words") == 0, F.col("index")).alias("alone")
    firsts = sets.groupBy("set", "words", alone).agg(F.min("index").alias("index"))
    paths = {name: scratch_path(spark, f"questions-{name}") for name in ("words", "verdicts", "kept")}

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(paths[name])
        return spark.read.schema(rows.schema).parquet(paths[name])

    def same(x: str, y: str, at: str = "index") -> Column:
        return F.col(f"{x}.set").eqNullSafe(F.col(f"{y}.set")) & (F.col(f"{x}.{at}") == F.col(f"{y}.{at}"))

    try:
        texts = stored(_ordered_words(firsts, min(RARE_ROWS, hot_rows)), "words")
        pairs = _candidates(texts.where("n > 0"), threshold, hot_rows)

        def judged(some: DataFrame) -> DataFrame:
            """Pairs (set, later, earlier) with ``alike``: whether their words overlap enough."""
            for role in ("later", "earlier"):
                side = texts.select(F.col("set").alias("of"), F.col("index").alias("at"), F.col("words.word").alias(f"{role}_words"))
                some = some.join(side, F.col("set").eqNullSafe(F.col("of")) & (F.col(role) == F.col("at"))).drop("of", "at")
            sizes = F.size("later_words") + F.size("earlier_words")
            common = F.size(F.array_intersect("later_words", "earlier_words"))
            return some.withColumn("alike", _enough(common, sizes, threshold)).drop("later_words", "earlier_words")

        likeliest = pairs.groupBy("set", "later").agg(
            F.min_by("earlier", "apart").alias("earlier"), (F.min("earlier") != F.max("earlier")).alias("others")
        )
        verdicts = stored(judged(likeliest), "verdicts")
        repeats = verdicts.where("alike").select("set", "later")
        unsure = verdicts.where("others AND NOT alike")
        if not unsure.isEmpty():
            rest = pairs.alias("p").join(unsure.alias("u"), same("p", "u", "later"), "left_semi")
            repeats = repeats.unionByName(judged(rest.select("set", "later", "earlier").distinct()).where("alike").select("set", "later"))
        repeats = repeats.withColumnRenamed("later", "index")
        kept = stored(texts.select("set", "index").alias("t").join(repeats.alias("r"), same("t", "r"), "left_anti"), "kept")
    finally:
        discard(spark, paths["words"])
        discard(spark, paths["verdicts"])
    own = F.struct(*[F.col(f"q.{k}") for k in keys]) if keys else F.lit(0)
    return df.alias("q").join(kept.alias("k"), own.eqNullSafe(F.col("k.set")) & (F.col("q.index") == F.col("k.index")), "left_semi")


def _enough(common: Column, sizes: Column, threshold: float) -> Column:
    """Whether two word sets of ``sizes`` words in all with so many in common overlap by ``threshold``."""
    return common >= (sizes - common) * threshold - 1e-9


def _ordered_words(firsts: DataFrame, rare_rows: int) -> DataFrame:
    """``firsts(set, index, words)`` as (set, index, words(rows, word), n, bits_0, bits_64).

    ``rows`` is the number of texts of the set with the word, 0 for up to ``rare_rows``; the words are in the order of both.
    The bits are 128 places by hash, set where a word falls.
    """
    words = firsts.select("set", "index", F.xxhash64("words").alias("text"), F.explode_outer("words").alias("word"))
    frequent = words.groupBy("set", "word").agg(F.count(F.lit(1)).cast("int").alias("rows")).where(F.col("rows") > rare_rows)
    frequent = frequent.select(F.col("set").alias("of"), F.col("word").alias("the"), "rows")
    counted = words.join(frequent, F.col("set").eqNullSafe(F.col("of")) & (F.col("word") == F.col("the")), "left")
    place = F.pmod(F.xxhash64("word"), F.lit(128)).cast("int")
    one = F.when(F.col("word").isNotNull(), F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), F.col("word")))
    return counted.withColumn("place", place).groupBy("set", "index", "text").agg(
        F.sort_array(F.collect_list(one)).alias("words"),
        F.bit_or(F.expr("IF(place < 64, shiftleft(1L, place), 0L)")).alias("bits_0"),
        F.bit_or(F.expr("IF(place >= 64, shiftleft(1L, place - 64), 0L)")).alias("bits_64"),
    ).select("set", "index", "words", F.size("words").alias("n"), "bits_0", "bits_64")


def _candidates(texts: DataFrame, threshold: float, hot_rows: int) -> DataFrame:
    """(set, later, earlier, apart): every pair of ``texts`` that overlaps enough, and few others; pairs can come more than once.

    A pair that needs c words in common has the first of them among the first n - c + 1 words of both texts and the second
    among the first n - c + 2, in the one order in which all words stand, rare ones first.  A rare word is a join key of its
    own, a frequent one only together with one behind it, so few texts share a key however many texts there are.  The smaller
    text of a pair needs more of its words than the larger, so each text has keys for either part.  Frequent words stand
    alone where one common word can do, and where the larger text has more than ``PAIRED_WORDS`` words, as their pairs grow
    with the square of those.  What can still be in common from the place of the key on and the bits of the words exclude
    nearly all other pairs before any words are fetched; ``apart`` is the share of words by which the bits differ at least.
    Keys of words that stand in more than ``hot_rows`` texts are cut into salted parts.
    """
    n, t = F.col("n"), threshold

    def keys(least: float, small: Column, paired: Column, large: Column) -> Column:
        """(key, most, parts) for texts that share at least that part of their words; ``most`` is what can be in common from there on."""
        places = F.greatest(n - F.greatest(F.ceil(n * least - 1e-8).cast("int"), F.lit(1)) + 1, F.lit(0))

        def one(kind: str, x: Column, i: Column, *more: Column) -> Column:
            parts = F.greatest(F.ceil(x["rows"] / hot_rows).cast("int"), F.lit(1))
            return F.struct(F.xxhash64(F.lit(kind), "set", x["word"], *more).alias("key"), (n - i).alias("most"), parts.alias("parts"))

        def at(x: Column, i: Column) -> Column:
            both = F.transform(F.slice("words", i + 2, places - i), lambda y, j: one("both", x, i + j, y["word"]))
            none = F.slice(F.array(one("", x, i)), 1, 0)
            return F.when(x["rows"] == 0, F.array(one("rare", x, i))).otherwise(F.concat(
                F.when(paired, both).otherwise(none),
                F.when(small, F.array(one("small", x, i))).otherwise(none),
                F.when(large, F.array(one("large", x, i))).otherwise(none),
            ))

        return F.flatten(F.transform(F.slice("words", F.lit(1), places), at))

    # one word in common can do only where the larger text has no more than 1 / t
    tiny = n * t <= 1 + 1e-8
    smaller = keys(2 * t / (1 + t), tiny, n <= PAIRED_WORDS, n > t * PAIRED_WORDS - 1e-8)
    larger = keys(t, tiny, ~tiny & (n <= PAIRED_WORDS), ~tiny & (n > PAIRED_WORDS))

    def side(prefix: str, made: Column) -> DataFrame:
        rows = texts.select("set", "index", "n", "bits_0", "bits_64", F.inline(made))
        if prefix == "l":
            part = F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0))))
        else:
            part = F.pmod(F.xxhash64("index"), F.col("parts").cast("bigint")).cast("int")
        return rows.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("set", "index", "n", "bits_0", "bits_64", "key", "most")], part.alias(f"{prefix}_part"))

    sizes = F.col("l_n") + F.col("s_n")
    differ = F.bit_count(F.col("l_bits_0").bitwiseXOR(F.col("s_bits_0"))) + F.bit_count(F.col("l_bits_64").bitwiseXOR(F.col("s_bits_64")))
    met = side("l", larger).join(
        side("s", smaller),
        (F.col("l_key") == F.col("s_key"))
        & (F.col("l_part") == F.col("s_part"))
        & F.col("l_set").eqNullSafe(F.col("s_set"))
        & (F.col("s_index") != F.col("l_index"))
        & ((F.col("s_n") < F.col("l_n")) | ((F.col("s_n") == F.col("l_n")) & (F.col("s_index") < F.col("l_index"))))
        & _enough(F.floor((sizes - differ) / 2), sizes, t)
        & _enough(F.least("l_most", "s_most"), sizes, t)
        & _enough(F.col("s_n"), sizes, t),
    )
    return met.select(
        F.col("l_set").alias("set"), F.greatest("l_index", "s_index").alias("later"), F.least("l_index", "s_index").alias("earlier"),
        (differ / sizes).alias("apart"),
    )


def balance_questions(df: DataFrame, quota: Mapping[str, int]) -> DataFrame:
    """At most ``quota[lens]`` questions per lens, spread over the segments: every segment gives its first
    question before any gives its second.

    Both ranks are compared with a literal, so no task receives more than the quota per task and group.
    """
    most = max(quota.values())
    in_segment = top_per_key(df, ["lens", "segment"], [F.col("index")], most).withColumnRenamed(
        "position", "segment_position"
    )
    in_lens = top_per_key(
        in_segment, ["lens"], [F.col("segment_position"), F.col("segment"), F.col("index")], most
    )
    limit = F.coalesce(*[F.when(F.col("lens") == lens, F.lit(n)) for lens, n in quota.items()], F.lit(0))
    return in_lens.where(F.col("position") <= limit).drop("segment_position")
