"""robots.txt as data: groups of agents and rules, worked out inside the row of the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...sources.dims import bot_array, gating_ua

_GROUP_MARK = "\x01"
# a pattern that a request for "/" falls under: only stars around at most one slash
_COVERS_ROOT = r"^(?:\*+\$?|\**/\**\$?)$"
SITEMAP_LINE = r"(?im)^[ \t\x0b\f]*sitemap[ \t]*:[ \t]*(\S+)"


def state_of(text: Column, status: Column, malformed: Column | None = None) -> Column:
    fetched = F.coalesce(status == 200, F.lit(False))
    present = fetched & (F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) != "")
    return F.struct(
        fetched.alias("fetched"),
        present.alias("present"),
        (~present & (status.isNull() | (status >= 500) | (status == 429))).alias("unreadable"),
        (present & (F.lit(False) if malformed is None else malformed)).alias("malformed"),
    )


def _directive(line: Column) -> Column:
    """'U' + agent, 'A' + path or 'D' + path; NULL for any other line."""
    bare = F.regexp_replace(line, "#.*$", "")
    name = F.lower(F.trim(F.substring_index(bare, ":", 1)))
    value = F.trim(F.regexp_replace(bare, r"^[^:]*:", ""))
    return F.when(F.contains(bare, F.lit(":")),
        F.when(name == "user-agent", F.concat(F.lit("U"), F.lower(value)))
        .when(name == "allow", F.concat(F.lit("A"), value))
        .when(name == "disallow", F.concat(F.lit("D"), value))
    )


def groups_of(text: Column) -> Column:
    """Groups of a robots file: ARRAY<STRUCT<agents ARRAY<STRING>, rules ARRAY<STRUCT<allow, path>>>>.

    A group starts at an agent line that does not follow another one.  Starts are marked in the text of
    the kept lines, which is then cut at the marks: linear in the file, no window, no shuffle.
    """
    flat = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"[\x01\t\x0b\f]", " ")
    lines = F.split(flat, r"\r\n|\n|\r")
    kept = F.filter(F.transform(lines, _directive), lambda d: d.isNotNull())
    before = F.concat(F.array(F.lit("")), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
    marked = F.zip_with(
        kept,
        before,
        lambda d, b: F.when(
            F.startswith(d, F.lit("U")) & ~F.startswith(b, F.lit("U")), F.concat(F.lit(_GROUP_MARK), d)
        ).otherwise(d),
    )
    blocks = F.filter(F.split(F.array_join(marked, "\n"), _GROUP_MARK), lambda b: F.startswith(b, F.lit("U")))

    def tail(d: Column) -> Column:
        return F.substring(d, 2, 2**31 - 1)

    def group(block: Column) -> Column:
        items = F.split(block, "\n")
        return F.struct(
            F.transform(F.filter(items, lambda d: F.startswith(d, F.lit("U"))), tail).alias("agents"),
            F.transform(
                F.filter(items, lambda d: F.startswith(d, F.lit("A")) | F.startswith(d, F.lit("D"))),
                lambda d: F.struct(F.startswith(d, F.lit("A")).alias("allow"), tail(d).alias("path")),
            ).alias("rules"),
        )

    return F.transform(blocks, group)


def _specificity(agent: Column, name: Column) -> Column:
    return F.when(agent == "*", 1).when((agent != "") & F.contains(name, agent), F.length(agent) + 1).otherwise(0)


def policies_of(groups: Column) -> Column:
    """Whether each crawler may fetch '/': the most specific agent's rules, the longest rule, allow on a tie."""
    # only rules that cover "/" matter; they are picked once, not once per crawler
    compact = F.transform(
        groups,
        lambda g: F.struct(
            g["agents"].alias("agents"),
            F.transform(
                F.filter(g["rules"], lambda r: F.rlike(r["path"], F.lit(_COVERS_ROOT))),
                lambda r: F.struct(F.length(r["path"]).alias("length"), r["allow"].alias("allow")),
            ).alias("rules"),
        ),
    )

    def policy(bot: Column) -> Column:
        name = F.lower(bot["ua"])
        scored = F.transform(
            compact,
            lambda g: F.struct(
                F.array_max(F.transform(g["agents"], lambda a: _specificity(a, name))).alias("score"),
                F.array_max(g["rules"]).alias("rule"),
            ),
        )
        hits = F.filter(scored, lambda s: s["score"] > 0)
        # the best score first, then the strongest rule under it; a group without rules loses to one with
        strongest = F.array_max(
            F.transform(
                hits,
                lambda s: F.struct(
                    s["score"], F.coalesce(s["rule"]["length"], F.lit(0)).alias("length"),
                    F.coalesce(s["rule"]["allow"], F.lit(True)).alias("allow"),
                ),
            )
        )
        return F.struct(
            bot["ua"].alias("ua"), bot["operator"].alias("operator"), bot["tier"].alias("tier"),
            F.coalesce(strongest["allow"], F.lit(True)).alias("allowed"),
        )

    return F.transform(bot_array(), policy)


def robots_sitemaps(text: Column) -> Column:
    """Addresses of the Sitemap lines in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SITEMAP_LINE), F.lit(1)))


def robots_of(text: Column, status: Column, malformed: Column | None = None) -> Column:
    """State, sitemaps and crawler policies of one robots response; nothing readable allows everything."""
    state = state_of(text, status, malformed)
    read = F.when(state["present"] & ~state["malformed"], text)
    return F.struct(
        state["fetched"].alias("fetched"), state["present"].alias("present"),
        state["unreadable"].alias("unreadable"), state["malformed"].alias("malformed"),
        robots_sitemaps(read).alias("sitemaps"),
        policies_of(groups_of(F.coalesce(read, F.lit("")))).alias("policies"),
    )


def no_robots() -> Column:
    """What is known of a site whose robots file was never answered: unreadable, nobody shut out."""
    allowed = F.transform(bot_array(), lambda b: F.struct(
        b["ua"].alias("ua"), b["operator"].alias("operator"), b["tier"].alias("tier"), F.lit(True).alias("allowed")
    ))
    no, yes = F.lit(False), F.lit(True)
    return F.struct(
        no.alias("fetched"), no.alias("present"), yes.alias("unreadable"), no.alias("malformed"),
        F.array().cast("array<string>").alias("sitemaps"), allowed.alias("policies"),
    )


def _robots_rows(fetch: DataFrame) -> DataFrame:
    return fetch.where(F.col("kind") == "robots")


def robots_state(fetch: DataFrame) -> DataFrame:
    return _robots_rows(fetch).select("target", F.inline(F.array(state_of(F.col("text"), F.col("status")))))


def robots_rules(fetch: DataFrame) -> DataFrame:
    """One row per (target, group, agent, rule) of a readable robots file."""
    rows = _robots_rows(fetch).where(F.col("status") == 200)
    groups = rows.select("target", F.posexplode(groups_of(F.col("text"))).alias("group_no", "g"))
    return groups.select("target", "group_no", F.explode("g.agents").alias("agent"), "g.rules").select(
        "target", "group_no", "agent", F.inline_outer("rules")
    )


def robots_policies(fetch: DataFrame) -> DataFrame:
    """State, sitemaps and the policies of all crawlers, one row per robots response."""
    return _robots_rows(fetch).select(
        "target", F.inline(F.array(robots_of(F.col("text"), F.col("status"))))
    )


def robots_policy_matrix(fetch: DataFrame) -> DataFrame:
    """Site by crawler.  The crawlers are a literal of the row, so there is no join."""
    return robots_policies(fetch).select("target", F.inline("policies"))


def gating(policies: Column, engine: Column) -> Column:
    """(gating_ua, gradable, allowed) of an engine; a crawler without a policy is allowed."""
    ua = gating_ua(engine)
    policy = F.try_element_at(F.filter(policies, lambda p: p["ua"] == ua), F.lit(1))
    return F.struct(
        ua.alias("gating_ua"), ua.isNotNull().alias("gradable"),
        F.coalesce(policy["allowed"], F.lit(True)).alias("allowed"),
    )


def gating_policy(policies: DataFrame) -> DataFrame:
    """Policies with an ``engine`` column to the access of the crawler that gates it."""
    return policies.select("target", "engine", F.inline(F.array(gating(F.col("policies"), F.col("engine")))))
