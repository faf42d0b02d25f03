"""What an AI crawler can read off a page, as native columns over the raw HTML.

Scripts, styles and comments are cut out first, in one pass in document order, because a page may hold
tags inside strings and comments.  Every later pattern runs on the rest.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import WS_CLASS, strip_ws

# Thresholds of the readability rules.
SPA_WORDS = 200
EMPTY_ROOT_WORDS = 100
CRITICAL_WORDS = 50
ROOT_TEXT_CHARS = 50
NOSCRIPT_CHARS = 20
FRAMEWORK_CHARS = 10_000
# Mount nodes of page apps, feed types, link texts, schema types that name an entity.
ROOT_IDS = ("root", "app", "__next", "__nuxt", "gatsby-focus-wrapper")
FEED_TYPES = ("application/rss+xml", "application/atom+xml")
ABOUT_TEXTS = ("about", "about us")
CONTACT_TEXTS = ("contact", "contact us")
JSONLD_TYPE = "application/ld+json"
# Framework and its traces (any of the alternatives, each a set that must all be there).
FRAMEWORK_TRACES = (
    ("Next", (("/__next/",), ("_next/static",), ("__next",))),
    ("Nuxt", (("__nuxt",), ("_nuxt/",))),
    ("React", (("react", 'id="root"'), ("react", "createroot"))),
    ("Angular", (("ng-version",), ("ng-app",))),
    ("Vue", (("data-v-",), ('id="app"',))),
    ("Gatsby", (("gatsby-",), ("/page-data/",))),
    ("Astro", (("_astro/",), ("astro-island",))),
)

_COMMENT = r"<!--.*?(?:-->|\z)"
_SCRIPT = r"<script\b[^>]*>.*?(?:</script[^>]*>|\z)"
_STYLE = r"<style\b[^>]*>.*?(?:</style[^>]*>|\z)"
_TAG = r"</?[a-zA-Z][^>]*>|<[!?][^>]*>"
UNREAD = rf"(?is){_COMMENT}|{_SCRIPT}|{_STYLE}"
MARKUP = (
    r"(?is)<noscript\b[^>]*>.*?(?:</noscript[^>]*>|\z)|<title\b[^>]*>.*?(?:</title[^>]*>|\z)|" + _TAG
    + r"|&(?:nbsp|ensp|emsp|thinsp|#160|#xa0);"
)
WORD = rf"[^{WS_CLASS}]+"
SCRIPT_PARTS = rf"(?is){_COMMENT}|(<script\b[^>]*>.*?)(?:</script[^>]*>|\z)"
HEADING = r"(?i)<h([1-6])(?:[\s/][^>]*)?>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
NOSCRIPT = r"(?is)<noscript\b[^>]*>(.*?)(?:</noscript|\z)"
ANCHOR_TAG = r"(?i)<a\s[^>]*>"
ANCHOR_TEXT = r"(?is)<a(?:\s[^>]*)?>(.*?)</a\s*>"
TIME_TAG = r"(?i)<time\s(?:[^>]*\s)?datetime[\s=>/]"
MAIN_TAG = r"(?i)<(?:main|article)[\s>/]"


_NAMED = json.dumps({name: char for name, char in html5.items() if name.endswith(";")})
_REFERENCE = r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def attr_pattern(name: str) -> str:
    return rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag's text; '' when it has none."""
    return F.regexp_replace(F.regexp_extract(tag, attr_pattern(name), 1), "^[\"']|[\"']$", "")


def unescape(text: Column) -> Column:
    """Named and numbered character references that end in a semicolon; others stay as they are."""
    # one literal once the plan is optimized
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def read(piece: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        number = F.when(F.rlike(name, F.lit("^#[xX]")), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(
            F.substring(name, 2, 8)
        ).cast("bigint")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        numbered = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
        char = F.when(F.startswith(name, F.lit("#")), numbered).otherwise(F.try_element_at(named, F.concat(name, F.lit(";"))))
        rest = F.substring(piece, F.length(name) + 3, F.length(piece))
        return F.when((name != "") & char.isNotNull(), F.concat(char, rest)).otherwise(piece)

    pieces = F.transform(F.split(text, "(?=&)"), read)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _plain(html: Column) -> Column:
    return F.regexp_replace(html, _TAG, "")


def heading_order_ok(levels: Column) -> Column:
    """No heading lies more than one level below the one before it."""
    steps = F.zip_with(levels, F.slice(levels, F.lit(2), F.size(levels)), lambda a, b: b - a)
    return F.coalesce(F.forall(steps, lambda s: F.coalesce(s <= 1, F.lit(True))), F.lit(True))


def framework(html: Column) -> Column:
    """First framework whose traces stand in the head of the page."""
    head = F.lower(F.substring(html, 1, FRAMEWORK_CHARS))

    def traced(alternatives: tuple) -> Column:
        found = F.lit(False)
        for parts in alternatives:
            every = F.lit(True)
            for part in parts:
                every = every & F.contains(head, F.lit(part))
            found = found | every
        return found

    return F.coalesce(*[F.when(traced(alternatives), F.lit(name)) for name, alternatives in FRAMEWORK_TRACES])


def _root_is_empty(clean: Column, root: str) -> Column:
    """The first div with this id holds less than 50 characters of text.

    What follows its opening tag is cut at every div tag; a running depth says where the div ends.  The
    text is only gathered until it is long enough.
    """
    opening = rf"(?is)<div\s(?:[^>]*\s)?id\s*=\s*[\"']?{root}[\"']?(?:[\s/][^>]*)?>(.*)\z"
    rest = F.regexp_extract(clean, opening, 1)
    pieces = F.split(rest, r"(?i)(?=</?div[\s>/])")
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("text"))

    def step(state: Column, piece: Column) -> Column:
        head = F.lower(F.substring(piece, 1, 5))
        depth = F.when(state["depth"] <= 0, F.lit(0)).when(head == "</div", state["depth"] - 1).when(
            F.startswith(head, F.lit("<div")), state["depth"] + 1
        ).otherwise(state["depth"])
        more = (depth > 0) & (F.length(state["text"]) < ROOT_TEXT_CHARS)
        text = F.when(more, F.ltrim(F.concat(state["text"], _plain(piece)), F.lit(" \t\n\r\x0b\x0c\xa0")))
        return F.struct(depth.alias("depth"), F.coalesce(text, state["text"]).alias("text"))

    inner = F.aggregate(pieces, start, step, lambda s: s["text"])
    there = F.contains(clean, F.lit(root)) & F.rlike(clean, F.lit(opening))
    return F.when(there, F.length(strip_ws(inner)) < ROOT_TEXT_CHARS).otherwise(False)


# --- JSON-LD --------------------------------------------------------------------------------------

_OBJECT = "map<string,variant>"


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _nesting(text: Column) -> Column:
    """How deep the lists and objects of a JSON text lie in each other: a running sum over its brackets."""
    # escapes go before strings, strings before the rest, so that only brackets of the structure are left
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*+"|[^\[\]{}"]++', "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(state: Column, bracket: Column) -> Column:
        at = state["at"] + F.when(bracket.isin("[", "{"), 1).when(bracket.isin("]", "}"), -1).otherwise(0)
        return F.struct(at.alias("at"), F.greatest(state["most"], at).alias("most"))

    return F.aggregate(F.split(bare, "(?<=.)"), start, step, lambda s: s["most"])


def _nodes(v: Column, text: Column) -> Column:
    """Objects of a JSON-LD value in document order: itself, then its list items or its @graph, at any depth.

    The values not yet looked into are replaced in place by their object and what lies below it, once for each level
    that ``text`` has.
    """
    none = F.lit(None).cast(_OBJECT)

    def closed(node: Column) -> Column:
        return F.struct(node.alias("node"), F.lit(None).cast("variant").alias("rest"))

    def opened(rest: Column) -> Column:
        return F.struct(none.alias("node"), rest.alias("rest"))

    def look(item: Column) -> Column:
        node = _as(item["rest"], _OBJECT)
        graph = F.try_element_at(node, F.lit("@graph"))
        below = F.coalesce(
            _as(item["rest"], "array<variant>"), _as(graph, "array<variant>"),
            F.when(graph.isNotNull(), F.array(graph)), F.array().cast("array<variant>"),
        )
        seen = F.concat(F.array(closed(node)), F.transform(below, opened))
        return F.when(item["rest"].isNull(), F.array(item)).otherwise(F.filter(seen, lambda i: i["node"].isNotNull() | i["rest"].isNotNull()))

    def level(items: Column, _: Column) -> Column:
        return F.when(F.exists(items, lambda i: i["rest"].isNotNull()), F.flatten(F.transform(items, look))).otherwise(items)

    # one round more than there are levels: what lies below the last one are plain values, which have no object
    levels = F.sequence(F.lit(0), _nesting(text))
    return F.transform(F.aggregate(levels, F.array(opened(v)), level), lambda i: i["node"])


def _types(node: Column) -> Column:
    value = F.try_element_at(node, F.lit("@type"))
    several = _as(value, "array<variant>")
    texts = F.filter(
        F.coalesce(several, F.array(value)), lambda t: F.coalesce(F.schema_of_variant(t) == "STRING", F.lit(False))
    )
    return F.transform(texts, lambda t: _as(t, "string"))


def _truthy(v: Column) -> Column:
    return F.coalesce(~F.to_json(v).isin("null", '""', "{}", "[]", "0", "0.0", "false"), F.lit(False))


def _count_same_as(v: Column) -> Column:
    return (
        F.when(F.schema_of_variant(v) == "STRING", 1)
        .when(_as(v, "array<variant>").isNotNull(), F.size(_as(v, "array<variant>")))
        .otherwise(0)
    )


def page_signals(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with a ``signals`` struct; a blank page has the signals of an empty one, NULL stays NULL.

    Written in steps: a step's columns are used by many later ones and are worked out once.
    """
    keep = [F.col(c) for c in pages.columns]
    read = F.when(strip_ws(F.substring(F.col(html), 1, 1000)) != "", F.col(html)).when(
        strip_ws(F.col(html)) != "", F.col(html)
    ).when(F.col(html).isNotNull(), F.lit(""))
    step1 = pages.select(*keep, read.alias("_html"))
    scripts = F.filter(
        F.regexp_extract_all("_html", F.lit(SCRIPT_PARTS), F.lit(1)),
        lambda s: F.lower(attr(F.regexp_extract(s, r"(?i)^<script\b[^>]*>", 0), "type")) == JSONLD_TYPE,
    )
    step2 = step1.select(
        *keep,
        "_html",
        F.regexp_replace("_html", UNREAD, " ").alias("_clean"),
        F.transform(scripts, lambda s: F.regexp_replace(s, r"(?i)^<script\b[^>]*>", "")).alias("_blocks"),
    )
    step3 = step2.select(
        *keep,
        "_html",
        "_clean",
        "_blocks",
        F.transform("_blocks", lambda b: F.try_parse_json(b)).alias("_json"),
        F.transform(
            F.regexp_extract_all("_clean", F.lit(HEADING), F.lit(1)), lambda h: h.cast("int")
        ).alias("_levels"),
        _tags(F.col("_clean"), "meta").alias("_meta"),
        _tags(F.col("_clean"), "link").alias("_link"),
        F.transform(
            F.regexp_extract_all("_clean", F.lit(ANCHOR_TAG), F.lit(0)), lambda t: F.lower(attr(t, "href"))
        ).alias("_hrefs"),
        F.transform(
            F.regexp_extract_all("_clean", F.lit(ANCHOR_TEXT), F.lit(1)),
            lambda t: F.lower(strip_ws(unescape(_plain(t)))),
        ).alias("_texts"),
        F.regexp_count(F.regexp_replace("_clean", MARKUP, " "), F.lit(WORD)).alias("_words"),
        F.array_compact(
            F.array(*[F.when(_root_is_empty(F.col("_clean"), r), F.lit(f"div#{r}")) for r in ROOT_IDS])
        ).alias("_roots"),
    )
    step4 = step3.withColumn(
        "_nodes",
        F.filter(
            F.flatten(F.transform(F.arrays_zip("_json", "_blocks"), lambda b: F.when(b["_json"].isNotNull(), _nodes(b["_json"], b["_blocks"])).otherwise(
                F.array().cast(f"array<{_OBJECT}>")))),
            lambda n: n.isNotNull(),
        ),
    )
    org = _first(F.filter("_nodes", lambda n: F.array_contains(_types(n), "Organization")))
    step5 = step4.withColumn("_org", org)

    def meta(name: str) -> Column:
        return F.filter("_meta", lambda m: F.lower(attr(m, "name")) == name)

    def rel(tag: Column, word: str) -> Column:
        return F.array_contains(F.split(F.lower(attr(tag, "rel")), r"\s+"), word)

    def anchor(word: str, texts: tuple) -> Column:
        by_href = F.exists("_hrefs", lambda h: F.contains(h, F.lit(word)))
        return by_href | F.exists("_texts", lambda t: t.isin(*texts))

    clean, words, levels = F.col("_clean"), F.col("_words"), F.col("_levels")
    headings = F.size(levels)
    described = F.filter(
        F.transform(meta("description"), lambda m: attr(m, "content")), lambda c: c != ""
    )
    canonical = F.filter(
        F.transform(F.filter("_link", lambda t: rel(t, "canonical")), lambda t: attr(t, "href")), lambda h: h != ""
    )
    html_tag = F.regexp_extract(clean, r"(?i)<html\b[^>]*>", 0)
    dated = F.exists(
        "_nodes", lambda n: F.map_contains_key(n, "datePublished") | F.map_contains_key(n, "dateModified")
    )
    signals = F.struct(
        words.alias("raw_word_count"),
        headings.alias("heading_count"),
        F.col("_roots").alias("empty_root_markers"),
        framework(F.col("_html")).alias("framework"),
        (
            F.length(strip_ws(_plain(F.regexp_extract(clean, NOSCRIPT, 1)))) > NOSCRIPT_CHARS
        ).alias("has_noscript"),
        (
            ((words < SPA_WORDS) & (headings == 0))
            | ((F.size("_roots") > 0) & (words < EMPTY_ROOT_WORDS))
            | (words < CRITICAL_WORDS)
        ).alias("js_dependent"),
        levels.alias("heading_levels"),
        F.size(F.filter(levels, lambda h: h == 1)).alias("h1_count"),
        F.rlike(clean, F.lit(MAIN_TAG)).alias("has_main_or_article"),
        heading_order_ok(levels).alias("heading_order_ok"),
        F.when(
            F.rlike(clean, F.lit(TITLE)), strip_ws(unescape(F.regexp_extract(clean, TITLE, 1)))
        ).alias("title"),
        unescape(_first(described)).alias("meta_description"),
        unescape(_first(canonical)).alias("canonical"),
        F.nullif(attr(html_tag, "lang"), F.lit("")).alias("lang"),
        F.exists(meta("robots"), lambda m: F.contains(F.lower(attr(m, "content")), F.lit("noindex"))).alias(
            "noindex"
        ),
        F.exists("_meta", lambda m: F.startswith(F.lower(attr(m, "property")), F.lit("og:"))).alias("og_present"),
        F.array_distinct(F.flatten(F.transform("_nodes", _types))).alias("jsonld_types"),
        F.size("_json").alias("jsonld_blocks"),
        F.size(F.filter("_json", lambda j: j.isNull())).alias("jsonld_invalid"),
        F.col("_org").isNotNull().alias("has_organization"),
        _truthy(F.try_element_at(F.col("_org"), F.lit("logo"))).alias("org_logo"),
        F.coalesce(_count_same_as(F.try_element_at(F.col("_org"), F.lit("sameAs"))), F.lit(0)).alias("org_sameas"),
        anchor("about", ABOUT_TEXTS).alias("has_about_link"),
        anchor("contact", CONTACT_TEXTS).alias("has_contact_link"),
        (dated | F.rlike(clean, F.lit(TIME_TAG))).alias("has_dates"),
        F.exists(
            "_link", lambda t: rel(t, "alternate") & F.lower(attr(t, "type")).isin(*FEED_TYPES)
        ).alias("has_feed"),
    )
    return step5.select(*keep, F.when(F.col("_html").isNotNull(), signals).alias("signals"))


def sitemap_wellformed(text: Column) -> Column:
    """The text is XML: it parses, and nothing but blanks and comments stands beside its one outermost element."""
    parsed = F.from_xml(text, "_corrupt_record STRING", {"mode": "PERMISSIVE"})
    one_root = (
        r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<![A-Z][^>]*>|\s)*+"
        r"<([^\s/>!?]+)(?:[^>]*/>|(?:\s[^>]*)?>.*</\1\s*>)\s*(?:<!--.*?-->\s*)*+$"
    )
    tags = F.regexp_extract_all(
        F.regexp_replace(text, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![A-Z][^>]*>", ""),
        F.lit(r"""<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0),
    )

    def step(state: Column, tag: Column) -> Column:
        change = F.when(F.startswith(tag, F.lit("</")), -1).when(F.endswith(tag, F.lit("/>")), 0).otherwise(1)
        depth = state["depth"] + change
        return F.struct(depth.alias("depth"), (state["roots"] + (depth == 0).cast("int")).alias("roots"))

    nothing = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("roots"))
    roots = F.aggregate(tags, nothing, step, lambda s: s["roots"])
    return F.coalesce(
        F.when(F.rlike(text, F.lit(one_root)), parsed["_corrupt_record"].isNull() & (roots == 1)), F.lit(False)
    )


def llms_has_h1(text: Column) -> Column:
    """Some line starts with '#'."""
    return F.coalesce(F.rlike(text, F.lit(rf"(?m)^[{WS_CLASS}]*#")), F.lit(False))
