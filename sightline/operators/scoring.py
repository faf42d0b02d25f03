"""Scoring extracted captures against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_domain, ratio
from .validation import ROW_RULES

CHANNELS = ("sources", "citations")
GATES = {
    "schema": "schema_valid",
    "gate": "overview_present_ok",
    "brand": "brand_in_answer_text_ok",
    "sent-null": "sentiment_nullness_ok",
    "src-ranks": "target_source_ranks_ok",
    "cit-ranks": "target_citation_ranks_ok",
    "no-fabrication": "no_fabrication",
}


def _url_domains(links: Column) -> Column:
    return F.transform(links, lambda x: normalize_domain(x["url"]))


def _domain_rows(df: DataFrame, keys: list[str], channel: str, count: str) -> DataFrame:
    exploded = df.select(*keys, F.lit(channel).alias("channel"), F.explode(_url_domains(F.col(channel))).alias("domain"))
    return exploded.groupBy(*keys, "channel", "domain").agg(F.count(F.lit(1)).alias(count))


def score_multiset_join(cand: DataFrame, truth: DataFrame) -> DataFrame:
    """Per candidate, channel and domain: how often it was read, how often it is there, and the overlap."""
    expected = cand.select("candidate_id", "fixture_id").join(
        truth.select("fixture_id", *CHANNELS), "fixture_id"
    )
    read = _domain_rows(cand, ["candidate_id"], "sources", "n_read").unionByName(
        _domain_rows(cand, ["candidate_id"], "citations", "n_read")
    )
    there = _domain_rows(expected, ["candidate_id"], "sources", "n_true").unionByName(
        _domain_rows(expected, ["candidate_id"], "citations", "n_true")
    )
    both = read.join(there, ["candidate_id", "channel", "domain"], "full")
    zero = F.lit(0)
    n_read, n_true = F.coalesce("n_read", zero), F.coalesce("n_true", zero)
    return both.select(
        "candidate_id", "channel", "domain",
        n_read.alias("n_read"), n_true.alias("n_true"), F.least(n_read, n_true).alias("n_common"),
    )


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two short arrays."""
    return F.aggregate(
        F.transform(
            F.array_distinct(a),
            lambda d: F.least(F.size(F.filter(a, lambda x: x == d)), F.size(F.filter(b, lambda x: x == d))),
        ),
        F.lit(0),
        lambda total, n: total + n,
    )


def _f1(name: str, read: Column, there: Column) -> list[Column]:
    common = _overlap(read, there)
    precision = F.when(F.size(read) > 0, ratio(common, F.size(read))).otherwise(
        F.when(F.size(there) == 0, 1.0).otherwise(0.0)
    )
    recall = F.when(F.size(there) > 0, ratio(common, F.size(there))).otherwise(F.lit(1.0))
    f1 = F.coalesce(ratio(precision * recall * 2, precision + recall), F.lit(0.0))
    return [
        F.bround(value, 3).alias(f"{name}_{part}")
        for part, value in (("precision", precision), ("recall", recall), ("f1", f1))
    ]


def _probe(url: Column) -> Column:
    return F.rtrim(F.substring_index(F.coalesce(url, F.lit("")), "?", 1), F.lit("/"))


def _fabricated(links: Column, corpus: Column) -> Column:
    return F.filter(
        F.transform(links, lambda x: x["url"]),
        lambda u: (_probe(u) != "") & ~F.contains(corpus, _probe(u)),
    )


def fabricated_links(cand: DataFrame, corpus: DataFrame) -> DataFrame:
    """Links whose address (no query, no final '/') stands nowhere in the text they were read from.

    The text is looked through inside the row; it is not copied to every link.
    """
    joined = cand.select("candidate_id", "fixture_id", *CHANNELS).join(corpus, "fixture_id")
    return joined.select(
        "candidate_id", F.posexplode(_fabricated(F.concat(*CHANNELS), F.col("text"))).alias("pos", "url")
    )


def score_extraction(cand: DataFrame, truth: DataFrame, corpus: DataFrame) -> DataFrame:
    """One score row per candidate capture."""
    facts = (
        "sources", "citations", "target_source_ranks", "target_citation_ranks",
        "overview_present", "brand_in_answer_text", "sentiment",
    )
    invalid = F.coalesce(*[rule() for rule in ROW_RULES.values()])
    checked = cand.withColumn("schema_error", invalid)
    right = truth.select("fixture_id", *[F.col(c).alias(f"true_{c}") for c in facts])
    joined = checked.join(right, "fixture_id").join(corpus, "fixture_id")
    # worked out once per list; the overlap looks at them once per domain
    rows = joined.withColumns(
        {f"_{c}": _url_domains(F.col(c)) for channel in CHANNELS for c in (channel, f"true_{channel}")}
    )

    def same(c: str) -> Column:
        return F.col(c).eqNullSafe(F.col(f"true_{c}"))

    def same_ranks(c: str) -> Column:
        none = F.array().cast("array<int>")
        return F.coalesce(F.col(c), none) == F.coalesce(F.col(f"true_{c}"), none)

    links = F.concat(*CHANNELS)
    right_domain = F.size(
        F.filter(links, lambda x: F.lower(F.coalesce(x["domain"], F.lit(""))) == normalize_domain(x["url"]))
    )
    fabricated = F.size(_fabricated(links, F.col("text")))
    scores = []
    for channel in CHANNELS:
        read, there = F.col(f"_{channel}"), F.col(f"_true_{channel}")
        scores += _f1(channel, read, there)
        scores += [(read == there).alias(f"{channel}_exact_order"), F.size(channel).alias(f"n_{channel}")]
    return rows.select(
        "candidate_id", "fixture_id",
        F.col("schema_error").isNull().alias("schema_valid"), "schema_error",
        same("overview_present").alias("overview_present_ok"),
        same("brand_in_answer_text").alias("brand_in_answer_text_ok"),
        (F.col("sentiment").isNull() == F.col("true_sentiment").isNull()).alias("sentiment_nullness_ok"),
        same_ranks("target_source_ranks").alias("target_source_ranks_ok"),
        same_ranks("target_citation_ranks").alias("target_citation_ranks_ok"),
        *scores,
        F.bround(ratio(right_domain, F.size(links)), 3).alias("domain_field_accuracy"),
        fabricated.alias("n_fabricated"),
        (fabricated == 0).alias("no_fabrication"),
        (F.coalesce("answer_text_md", F.lit("")) != "").alias("answer_text_present"),
    )


def score_gates(scores: DataFrame) -> DataFrame:
    """Names of the hard gates a candidate fails."""
    gates = F.array(
        *[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(name)) for name, c in GATES.items()]
    )
    failed = F.array_compact(gates)
    return scores.select("candidate_id", failed.alias("failed_gates"), (F.size(failed) == 0).alias("passed"))
