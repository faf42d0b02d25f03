"""From raw documents to packed training sequences: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import line_dedup, ngram_join, packing, pii, toxicity
from sightline.llm.common import id_crc, stored, table
from sightline.operators.skew import first_per_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECTED_FROM = 0.7
TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def _documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, the length that of the text as it is now."""
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below the limit; the scorer learns from two thirds of the labels.

    A null or empty text has the score 0 and stays, as does every document where a label has no example.
    """
    learned = table(spark, sf_dir, "labels").where(id_crc("doc_id") % 3 != 1)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "documents"), learned, keep=COLUMNS[1:])
    return scored.where(F.col("score") < REJECTED_FROM).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later occurrences of passages of three lines; one that has lost all its text goes.

    Null and empty texts stay.  Of rows that repeat one (id, text) pair the order is that of the operator.
    """
    found = line_dedup.dedup_lines(docs, keep=COLUMNS[2:])
    return _documents(found.where(F.col("text").isNull() | (F.col("text") != "") | (F.col("n_removed") == 0)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: words in fives, similarity 0.8.

    Rows of one id are one document, so one of them stays, that of the smallest text.  A row without an id takes part
    under a hash of its text, behind all ids.  Rows without a word are in no group and all stay.
    """
    named = F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62))
    keyed = docs.withColumn("key", named)
    found = stored(ngram_join.ngram_join(keyed, id_col="key"), "near-copies").where("n_shingles > 0")
    of = found.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("first"))
    marks = stored(of.where("key <> first OR rows > 1").select(F.col("key").alias("id"), (F.col("key") == F.col("first")).alias("stays")), "marks")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    met, alone = ngram_join.sifted(keyed.where(worded), "key", marks)  # texts that no mark can concern are not shuffled
    marked = met.join(marks, met["key"] == marks["id"], "left")  # an anti join would be moved in front of the filter
    kept = marked.where("id IS NULL")
    once = first_per_key(marked.where("stays"), ["key"], [F.col(c) for c in ("text", "lang", "source", "n_chars")])
    return reduce(DataFrame.union, [df.select(*COLUMNS) for df in (keyed.where(~worded), alone, kept, once)])


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; null stays null, repeated rows stay as many."""
    return _documents(pii.find_pii(docs, keep=COLUMNS[2:4]).withColumn("n_chars", F.lit(0)), "redacted")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, in sequences of 2048; a null text is an empty one, its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_passages),
    ("ngram_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: SQL cannot state scores of a fitted classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
