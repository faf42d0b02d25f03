"""Rules on arrays of links, all inside the row: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LINKS
from .urls import (
    host_of, join_target, normalize_domain, normalize_target, path_of, prefix_match, registrable,
)



# two plain labels without a leading www: what normalizing gives back unchanged
NORMAL_DOMAIN = r"^(?!www\.)[a-z0-9-]+\.[a-z0-9-]+$"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def decode_ranks(json: Column) -> Column:
    """JSON array of whole numbers to ARRAY<INT>; anything else is an empty array.

    Items that are no numbers are left out.
    """
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    ranks = F.filter(F.transform(items, lambda v: F.try_variant_get(v, "$", "int")), lambda r: r.isNotNull())
    return F.coalesce(ranks, _empty("array<int>"))


def decode_links(json: Column) -> Column:
    """JSON array of link objects to typed links with a normalized domain.

    Items that are no objects, have no whole-number rank or no domain are left out; the domain falls
    back to the URL.
    """
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")

    def text(v: Column, key: str) -> Column:
        return F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))

    def link(v: Column) -> Column:
        return F.struct(
            F.try_variant_get(v, "$.rank", "int").alias("rank"),
            text(v, "url").alias("url"),
            normalize_domain(F.coalesce(text(v, "domain"), text(v, "url"))).alias("domain"),
        )

    objects = F.filter(items, lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull())
    typed = F.filter(F.transform(objects, link), lambda x: x["rank"].isNotNull() & (x["domain"] != ""))
    return F.coalesce(typed, _empty(LINKS))


def best_rank(ranks: Column) -> Column:
    """Smallest rank, NULL when there is none."""
    return F.array_min(ranks)


def domain_best_ranks(links: Column) -> Column:
    """One (domain, rank) per domain with its best rank, sorted by domain.

    Two passes so that the host is worked out once per link; a domain that is in normal form already, as
    ingest stores it, is taken as it is.  The sort puts the best rank of a domain first and the filter
    keeps it.
    """
    hosts = F.transform(
        links,
        lambda x: F.struct(
            F.when(F.rlike(x["domain"], F.lit(NORMAL_DOMAIN)), x["domain"])
            .otherwise(host_of(F.when(F.coalesce(x["domain"], F.lit("")) != "", x["domain"]).otherwise(x["url"])))
            .alias("host"),
            x["rank"].alias("rank"),
        ),
    )
    pairs = F.sort_array(
        F.filter(
            F.transform(
                hosts, lambda h: F.struct(registrable(h["host"]).alias("domain"), h["rank"].alias("rank"))
            ),
            lambda p: (p["domain"] != "") & p["rank"].isNotNull(),
        )
    )
    return best_of_sorted(pairs)


def best_of_sorted(pairs: Column) -> Column:
    """First element of every run of equal domains in a sorted array of (domain, rank)."""
    shifted = F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0)))
    previous = F.concat(F.array(F.lit(None).cast("string")), F.transform(shifted, lambda p: p["domain"]))
    marked = F.zip_with(
        pairs,
        previous,
        lambda p, before: F.struct(
            p["domain"].alias("domain"), p["rank"].alias("rank"), (~p["domain"].eqNullSafe(before)).alias("first")
        ),
    )
    kept = F.filter(marked, lambda m: m["first"] & m["domain"].isNotNull())
    return F.transform(kept, lambda m: F.struct(m["domain"].alias("domain"), m["rank"].alias("rank")))


def target_ranks(links: Column, target: Column, *, canonical: bool = False) -> Column:
    """Ascending ranks of the links that lie under the target, repeats kept.

    ``canonical`` says that the target already is in canonical form.
    """
    wanted = target if canonical else normalize_target(target)
    # rules only ever cut a domain shorter, so a link whose domain does not hold the target's is out at once
    wanted_domain = F.substring_index(wanted, "/", 1)
    near = F.filter(links, lambda x: F.contains(F.lower(x["domain"]), wanted_domain))
    parts = F.transform(
        near,
        lambda x: F.struct(
            host_of(x["url"]).alias("u"),
            host_of(x["domain"]).alias("d"),
            x["url"].alias("url"),
            x["domain"].alias("domain"),
            x["rank"].alias("rank"),
        ),
    )
    # a path counts only when the URL is on the stated domain
    located = F.transform(
        parts,
        lambda p: F.struct(
            registrable(p["d"]).alias("domain"),
            F.when(
                (F.coalesce(p["url"], F.lit("")) != "") & (registrable(p["u"]) == registrable(p["d"])),
                path_of(p["url"]),
            ).otherwise(path_of(p["domain"])).alias("path"),
            p["rank"].alias("rank"),
        ),
    )
    hits = F.filter(located, lambda p: prefix_match(join_target(p["domain"], p["path"]), wanted))
    return F.sort_array(F.transform(hits, lambda p: p["rank"]))


# How the engines wrap a result link, and the host of paid links.
GOOGLE_WRAPPER = r"^(?:https?://(?:www\.)?google\.[a-z.]+)?/url\?"
YANDEX_WRAPPER = r"^https?://(?:[a-z0-9-]+\.)*(?:yandex\.[a-z.]+|ya\.ru)/"
WRAPPED_PARAMETER = r"[?&](?:q|url)=([^&#]*)"
AD_HOST = r"^(?:https?:)?//yabs\.yandex\.[a-z.]+(?:[/?#]|$)"


def unwrap_redirects(url: Column) -> Column:
    """Target of a wrapped result link; the link itself when it is direct or cannot be unwrapped."""
    wrapped = F.rlike(url, F.lit(GOOGLE_WRAPPER)) | F.rlike(url, F.lit(YANDEX_WRAPPER))
    inner = F.try_url_decode(F.regexp_extract(url, WRAPPED_PARAMETER, 1))
    usable = F.rlike(inner, F.lit(r"^https?://[^/]"))
    return F.when(wrapped & F.coalesce(usable, F.lit(False)), inner).otherwise(url)


def is_ad_link(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(AD_HOST)), F.lit(False))


def drop_ads(links: Column) -> Column:
    """Links without paid ones, ranks renumbered."""
    return renumber(F.filter(links, lambda x: ~is_ad_link(x["url"])))


def renumber(links: Column) -> Column:
    """Ranks 1..n in array order."""
    return F.transform(
        links,
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("rank"), x["url"].alias("url"), x["domain"].alias("domain")
        ),
    )


def links_of_ranked(items: Column) -> Column:
    """Sorted (position, url) items to links with 1-based ranks and normalized domains."""
    return F.transform(
        items,
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("rank"), x["url"].alias("url"), normalize_domain(x["url"]).alias("domain")
        ),
    )
