"""JSON array files of any size, read in splits.

Files are cut at every comma, so Spark deals out byte ranges of them as it does for lines.  Whether a comma parts two
elements depends on what came before: on whether a string is open and how deep the brackets are.  Each piece of text
says how it would change that state from either side of a quote; the pieces of a split add up to the change that the
split makes, and a running sum over the splits of a file, a few numbers each, tells every piece where it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE_FILE = 4 << 20  # bytes; files up to this are read whole, and cut only if they are no JSON array
LARGEST_ELEMENT = 64 << 20  # characters; what is longer cannot be held as one VARIANT and is reported instead


def _depth(outside: Column) -> Column:
    """Brackets opened less those closed in text outside of strings."""
    return F.length(F.translate(outside, "}]", "")) - F.length(F.translate(outside, "{[", ""))


def _small_files(spark: SparkSession, path: str, bound: int) -> DataFrame:
    """Files of no more than ``bound`` bytes, one row each, with their elements, NULL where they are no JSON array.

    A text is parsed as the first of two elements of another array; where the second one, a hash of the text, does not come
    out again, there was something before or after its own array.
    """
    text = spark.read.text(path, wholetext=True).where((F.col("_metadata.file_size") <= bound) & (F.col("value") != ""))
    mark = F.xxhash64("value")
    both = F.try_parse_json(F.concat(F.lit("["), "value", F.lit(","), mark.cast("string"), F.lit("]")))
    read = text.select(
        F.col("_metadata.file_path").alias("file"), "value", mark.alias("_mark"), F.try_variant_get(both, "$", "array<variant>").alias("_both")
    )
    marked = (F.size("_both") == 2) & (F.try_variant_get(F.get("_both", F.lit(1)), "$", "bigint") == F.col("_mark"))
    return read.select("file", "value", F.when(marked, F.try_variant_get(F.get("_both", F.lit(0)), "$", "array<variant>")).alias("elements"))


def _cut_texts(spark: SparkSession, path: str, bound: int) -> DataFrame:
    """Text between commas with the split it is in and its place there, of larger files and of small ones that are no array."""
    large = spark.read.option("lineSep", ",").text(path).where(F.col("_metadata.file_size") > bound).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value",
    )
    parts = F.split(F.regexp_replace("value", ",$", ""), ",", -1)
    # dealt out once more, so that the plan looks for faulty files once, however often their pieces are read
    faulty = _small_files(spark, path, bound).where("elements IS NULL").select("file", "value").repartition("file")
    small = faulty.select("file", F.posexplode(parts).alias("place", "value"))
    return large.unionByName(small.select("file", F.lit(0).cast("bigint").alias("block"), F.col("place").cast("bigint").alias("place"), "value"))


def _pieces(text: DataFrame) -> DataFrame:
    """Pieces of text with their quotes, and their brackets if a string is closed or open before."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    strings = r'"[^"]*("|$)'
    after = F.regexp_replace(F.col("_plain"), r'^[^"]*("|$)', "")
    return text.withColumn("_plain", plain).select(
        "file", "block", "place", "value",
        (F.length("_plain") - F.length(F.translate("_plain", '"', ""))).alias("quotes"),
        _depth(F.regexp_replace("_plain", strings, "")).alias("closed"),
        _depth(F.regexp_replace(after, strings, "")).alias("open"),
        (F.length("value") + 1).alias("size"),
    )


def read_array(spark: SparkSession, path: str, largest: int = LARGEST_ELEMENT, whole_file: int = WHOLE_FILE) -> DataFrame:
    """Elements of JSON array files as (file, index, raw VARIANT), in any number of splits a file.

    Files of no more than ``whole_file`` bytes that are a JSON array are parsed at once; nothing of them is shuffled.
    Larger ones, and those with a fault in them, are cut at commas.

    What is no JSON gives a NULL ``raw`` under its index, as does an element of more than ``largest`` characters; a file
    that holds no array gives one row with its own value, or NULL, and the index -1.  An array without elements gives no
    row, nor does a file without a character.
    """
    bound = min(whole_file, largest)
    at_once = _small_files(spark, path, bound).where("elements IS NOT NULL").select(
        "file", F.posexplode("elements").alias("index", "raw")
    )
    in_split, of_file = Window.partitionBy("file", "block").orderBy("place"), Window.partitionBy("file").orderBy("block")
    upto, before = in_split.rowsBetween(Window.unboundedPreceding, 0), of_file.rowsBetween(Window.unboundedPreceding, -1)
    pieces = _pieces(_cut_texts(spark, path, bound)).withColumn("quotes_upto", F.sum("quotes").over(upto))
    within = (F.col("quotes_upto") - F.col("quotes")) % 2 == 1  # a string is open before the piece, if none was before the split
    pieces = pieces.withColumns({
        "down": F.sum(F.when(within, F.col("open")).otherwise(F.col("closed"))).over(upto),
        "up": F.sum(F.when(within, F.col("closed")).otherwise(F.col("open"))).over(upto),
        "size_upto": F.sum("size").over(upto),
    })
    # the last row of a split has its sums; what a split does depends on whether a string is open where it starts
    splits = pieces.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.max_by("down", "place").alias("down"), F.max_by("up", "place").alias("up"),
        F.sum("size").alias("size"), F.min_by("value", "place").alias("first"),
    )
    splits = splits.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).select(
        F.col("file").alias("of"), F.col("block").alias("at"), "in_string",
        F.coalesce(F.sum(F.when(F.col("in_string"), F.col("up")).otherwise(F.col("down"))).over(before), F.lit(0)).alias("depth_before"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"),
        F.first(F.col("first").rlike(r"^\uFEFF?\s*\[")).over(of_file).alias("listed"),
    )
    known = pieces.join(splits, (F.col("file") == F.col("of")) & (F.col("block") == F.col("at"))).withColumns({
        "depth": F.col("depth_before") + F.when(F.col("in_string"), F.col("up")).otherwise(F.col("down")),
        "offset": F.col("size_before") + F.col("size_upto"),
    })
    closed = (F.col("quotes_upto") + F.col("in_string").cast("int")) % 2 == 0
    known = known.withColumn("ends", F.col("listed") & closed & (F.col("depth") == 1))
    # elements ended, and where the last one did, before each piece: first in its split, then over the splits of the file
    so_far = in_split.rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumns({
        "ended": F.coalesce(F.count_if("ends").over(so_far), F.lit(0)), "from": F.max(F.when(F.col("ends"), F.col("offset"))).over(so_far),
    })
    totals = known.groupBy(F.col("of").alias("file"), F.col("at").alias("block")).agg(
        F.count_if("ends").alias("n"), F.max(F.when(F.col("ends"), F.col("offset"))).alias("last"))
    totals = totals.select(
        F.col("file").alias("of_"), F.col("block").alias("at_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended_before"),
        F.coalesce(F.max("last").over(before), F.lit(0)).alias("from_before"))
    placed = known.join(totals, (F.col("file") == F.col("of_")) & (F.col("block") == F.col("at_")))
    fits = F.col("offset") - F.greatest(F.coalesce("from", F.lit(0)), "from_before") <= largest
    # of an element that is too long only the beginning and one mark are sent on
    parts = placed.select(
        "file", (F.col("ended_before") + F.col("ended")).alias("index"), "block", "place", "depth", "listed", fits.alias("fits"),
        F.when(fits, F.col("value")).alias("value"),
    )
    return at_once.unionByName(_elements(parts))


def _elements(parts: DataFrame) -> DataFrame:
    """Pieces put together to elements; those beyond the size are one row a task and element before they are sent."""
    order = F.struct("block", "place")
    whole = parts.groupBy("file", "index").agg(
        F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("block", "place", "value")))).alias("parts"),
        F.bool_and("fits").alias("fits"), F.max_by("depth", order).alias("depth"), F.first("listed").alias("listed"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["value"]), ",")
    bare = F.when(F.col("index") == 0, F.regexp_replace("text", r"^\uFEFF?\s*\[", "")).otherwise(F.col("text"))
    bare = F.when(F.col("depth") == 0, F.regexp_replace(bare, r"\]\s*$", "")).otherwise(bare)
    made = whole.withColumn("text", F.when(F.col("fits"), text)).withColumn("text", F.when(F.col("listed"), bare).otherwise(F.col("text")))
    nothing = F.col("listed") & (F.col("index") == 0) & (F.col("depth") == 0) & F.col("text").rlike(r"^\s*$")
    closed = F.col("text").isNotNull() & ~F.coalesce(nothing, F.lit(False)) | ~F.col("fits")
    return made.where(closed).select(
        "file", F.when(F.col("listed"), F.col("index")).otherwise(-1).cast("int").alias("index"), F.try_parse_json("text").alias("raw")
    )
