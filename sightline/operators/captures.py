"""Assembling captures, matching them to targets, and the resume joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    drop_ads, effective_link, links_of_ranked, normalize_domain, normalize_target, renumber,
    target_prefixes, unwrap_redirects,
)
from ..functions.links import is_ad_link
from ..schemas import LINKS
from .skew import first_per_key, latest_per_key

CAPTURE_KEY = ["run_id", "query", "lens"]


def drop_ad_links(links: DataFrame) -> DataFrame:
    """Link rows that are neither flagged as promo nor on the host of paid links."""
    flagged = F.coalesce(F.col("is_ad"), F.lit(False)) if "is_ad" in links.columns else F.lit(False)
    return links.where(~flagged & ~is_ad_link(F.col("url")))


def assemble_captures(answers: DataFrame, links: DataFrame) -> DataFrame:
    """Answers with their ranked link arrays.

    ``links(capture_id, channel, position, url)`` in display order; repeated links are kept.  One shuffle
    on the capture; an answer holds tens of links, so the arrays are small.
    """
    item = F.struct(F.col("position"), unwrap_redirects(F.col("url")).alias("url"))
    arrays = links.groupBy("capture_id").agg(
        *[
            F.collect_list(F.when(F.col("channel") == channel, item)).alias(channel)
            for channel in ("sources", "citations")
        ]
    )
    ranked = arrays.select(
        "capture_id",
        *[links_of_ranked(F.sort_array(F.col(c))).alias(c) for c in ("sources", "citations")],
    )
    none = F.array().cast(LINKS)
    return answers.join(ranked, "capture_id", "left").withColumns(
        {c: F.coalesce(F.col(c), none) for c in ("sources", "citations")}
    )


def fold_citations_into_sources(captures: DataFrame) -> DataFrame:
    """Append cited links whose domain is no source, one per domain, and renumber."""
    known = F.transform(F.col("sources"), lambda s: normalize_domain(s["domain"]))
    cited = F.transform(F.col("citations"), lambda c: normalize_domain(c["domain"]))
    tagged = F.zip_with(
        F.col("citations"), cited, lambda c, d: F.struct(c.alias("link"), d.alias("domain"))
    )
    fresh = F.filter(
        tagged,
        lambda t, i: ~F.array_contains(known, t["domain"]) & (F.array_position(cited, t["domain"]) == i + 1),
    )
    return captures.withColumn(
        "sources", renumber(F.concat(F.col("sources"), F.transform(fresh, lambda t: t["link"])))
    )


def without_ads(captures: DataFrame) -> DataFrame:
    """Captures whose link arrays hold no paid links."""
    return captures.withColumns({c: drop_ads(F.col(c)) for c in ("sources", "citations")})


def dedupe_captures(captures: DataFrame) -> DataFrame:
    """Lowest id per (run, query, lens)."""
    return first_per_key(captures, CAPTURE_KEY, [F.col("id")])


def _link_domains(channel: str):
    return F.array_distinct(F.transform(F.col(channel), lambda x: normalize_domain(x["domain"])))


def uncited_sources(captures: DataFrame) -> DataFrame:
    """Set difference per capture, both ways: cited but no source, and sourced but never cited."""
    sourced, cited = _link_domains("sources"), _link_domains("citations")
    return captures.select(
        "id",
        "run_id",
        F.sort_array(F.array_except(cited, sourced)).alias("cited_not_sourced"),
        F.sort_array(F.array_except(sourced, cited)).alias("sourced_not_cited"),
    )


def all_domains(captures: DataFrame) -> DataFrame:
    """Every domain of a run over both channels."""
    both = F.array_union(_link_domains("sources"), _link_domains("citations"))
    return (
        captures.select("run_id", F.explode(both).alias("domain")).where(F.col("domain") != "").distinct()
    )


def capture_links(captures: DataFrame) -> DataFrame:
    """One row per link of either channel."""
    def of(channel: str) -> Column:
        return F.transform(
            F.col(channel),
            lambda x: F.struct(
                F.lit(channel).alias("channel"), x["rank"].alias("rank"), x["url"].alias("url"),
                x["domain"].alias("domain"),
            ),
        )

    tagged = F.concat(of("sources"), of("citations"))
    return captures.select(F.col("id").alias("capture_id"), F.inline(tagged))


def match_links_to_targets(links: DataFrame, brands: DataFrame) -> DataFrame:
    """Ranks of every brand in every capture: (capture_id, channel, brand_id, ranks).

    A link lies under a target exactly when the target is one of the link's own path prefixes, so the
    prefix test is an equi-join: no pair is built that is not a match, however many targets share a
    domain.  Links on domains no brand has are dropped before they are multiplied by their prefixes.
    """
    targets = brands.select("brand_id", normalize_target(F.col("domain")).alias("prefix")).where(
        F.col("prefix") != ""
    )
    domains = targets.select(F.substring_index("prefix", "/", 1).alias("link_domain")).distinct()
    # the domain of a link decides first; its location is worked out only where some brand has the domain
    near = links.withColumn("link_domain", normalize_domain(F.col("domain"))).join(
        domains, "link_domain", "left_semi"
    )
    location = normalize_target(effective_link(F.col("url"), F.col("domain")))
    keyed = near.select("capture_id", "channel", "rank", location.alias("location")).select(
        "capture_id", "channel", "rank", F.explode(target_prefixes(F.col("location"))).alias("prefix")
    )
    return (
        keyed.join(targets, "prefix")
        .groupBy("capture_id", "channel", "brand_id")
        .agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    )


def live_n_ok(captures: DataFrame) -> DataFrame:
    """Stored captures per run."""
    return captures.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_ok"))


def missing_questions(questions: DataFrame, captures: DataFrame, runs: DataFrame) -> DataFrame:
    """What unfinished runs still have to ask: the brand's question set minus the captured keys.

    ``questions(brand_id, query, lens)``.
    """
    open_runs = runs.where(F.col("status") == "running").select("run_id", "brand_id", "engine")
    wanted = open_runs.join(questions, "brand_id").select("run_id", "brand_id", "engine", "query", "lens")
    return wanted.join(captures.select(*CAPTURE_KEY), CAPTURE_KEY, "left_anti")


def resumable_runs(runs: DataFrame, captures: DataFrame, questions: DataFrame) -> DataFrame:
    """The latest running run per brand and engine, if all it has captured still is in the question set."""
    latest = latest_per_key(
        runs.where(F.col("status") == "running"), ["brand_id", "engine"], ["run_at", "run_id"],
        ["run_id", "run_at"],
    )
    keys = captures.select(*CAPTURE_KEY).join(latest.select("run_id", "brand_id"), "run_id")
    strangers = keys.join(questions, ["brand_id", "query", "lens"], "left_anti").select("run_id").distinct()
    return latest.join(strangers, "run_id", "left_anti").select("run_id", "brand_id", "engine", "run_at")


def capture_agreement(reads_a: DataFrame, reads_b: DataFrame) -> DataFrame:
    """Two independent reads of the same answers compared source by source.

    ``agree`` needs the same domains in the same order; an empty read against a non-empty one is
    ``empty_read``, never proof that nothing was there; ``reordered`` has the same domains in another order.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *CAPTURE_KEY, F.transform(F.col("sources"), lambda x: normalize_domain(x["domain"])).alias(name)
        )

    both = side(reads_a, "a").join(side(reads_b, "b"), CAPTURE_KEY)
    verdict = (
        F.when(F.col("a") == F.col("b"), "agree")
        .when((F.size("a") == 0) | (F.size("b") == 0), "empty_read")
        .when(F.sort_array("a") == F.sort_array("b"), "reordered")
        .otherwise("drift")
    )
    return both.select(
        *CAPTURE_KEY, F.size("a").alias("n_a"), F.size("b").alias("n_b"), verdict.alias("verdict")
    )
