"""Domain and target rules as native columns.

Every rule is one straight chain of built-ins in which a value is used once, so it costs the same in
generated code and inside a lambda, where Spark does not share common subexpressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, strip_ws

# The public suffixes of two labels under which a third label is the registrable one.
MULTI_PART_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk",
    "com.au", "net.au", "org.au", "gov.au", "edu.au", "id.au",
    "co.nz", "net.nz", "org.nz", "govt.nz",
    "com.br", "net.br", "org.br", "gov.br",
    "co.jp", "ne.jp", "or.jp", "go.jp", "ac.jp",
    "co.kr", "or.kr", "go.kr",
    "co.in", "net.in", "org.in", "gov.in",
    "com.cn", "net.cn", "org.cn", "gov.cn",
    "com.tr", "net.tr", "org.tr", "gov.tr", "edu.tr",
    "com.mx", "org.mx", "gob.mx",
    "co.za", "org.za", "gov.za",
    "com.sg", "com.hk", "com.tw", "com.ua", "co.il", "com.ar",
)

# the scheme ends at the first "://" anywhere; without one a leading "//" is dropped
_AFTER_SCHEME = rf"(?s)^[{WS_CLASS}]*(?:.*?://|//)?"
# the host follows the last "@" before the path, query or fragment
HOST_PATTERN = _AFTER_SCHEME + r"(?:[^/?#]*@)?([^/?#]*)"
PATH_PATTERN = _AFTER_SCHEME + r"[^/?#]*/([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port, outer dots and leading ``www.`` labels."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATTERN, 1)
    bare = F.lower(F.btrim(strip_ws(raw), F.lit(".")))
    return F.regexp_replace(F.substring_index(bare, ":", 1), r"^(?:www\.)+", "")


def registrable(host: Column) -> Column:
    """Last two labels of a host, or three under a two-label public suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*MULTI_PART_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def normalize_domain(url: Column) -> Column:
    """Registrable domain of a URL or host; '' when there is none."""
    return registrable(host_of(url))


def path_of(url: Column) -> Column:
    """Path segments joined by one '/', lower case, without empty segments; '' when there are none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), PATH_PATTERN, 1)
    return F.btrim(F.regexp_replace(F.lower(strip_ws(raw)), "/+", "/"), F.lit("/"))


def join_target(domain: Column, path: Column) -> Column:
    return F.when(domain == "", F.lit("")).when(path == "", domain).otherwise(
        F.concat(domain, F.lit("/"), path)
    )


def normalize_target(url: Column) -> Column:
    """Canonical brand target: registrable domain, then path segments."""
    return join_target(normalize_domain(url), path_of(url))


def split_target(target: Column) -> Column:
    """(domain, segments) of a canonical target."""
    parts = F.split(target, "/")
    return F.struct(
        F.element_at(parts, 1).alias("domain"),
        F.slice(parts, F.lit(2), F.size(parts)).alias("segments"),
    )


def prefix_match(canonical_url: Column, canonical_target: Column) -> Column:
    """Segment-wise prefix test of two canonical targets.

    Segments never hold a '/', so comparing whole strings up to a '/' is the segment comparison.
    """
    return (
        (canonical_target != "")
        & (canonical_url != "")
        & (
            (canonical_url == canonical_target)
            | F.startswith(canonical_url, F.concat(canonical_target, F.lit("/")))
        )
    )


def matches_target(url: Column, target: Column) -> Column:
    """The URL lies under the target (same domain, target path a prefix); '' on either side never does."""
    return prefix_match(normalize_target(url), normalize_target(target))


def effective_link(url: Column, domain: Column) -> Column:
    """The URL if it is on the stated domain, else the domain: a redirect wrapper has no usable path."""
    direct = (F.coalesce(url, F.lit("")) != "") & (normalize_domain(url) == normalize_domain(domain))
    return F.when(direct, url).otherwise(domain)


def target_prefixes(canonical_url: Column) -> Column:
    """Every target the URL lies under, shortest first: the keys of an equi-join against targets."""
    parts = F.split(canonical_url, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return F.when(canonical_url != "", prefixes).otherwise(F.array().cast("array<string>"))
