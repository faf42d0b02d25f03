"""SQL statement of the derived tables, as common table expressions ahead of every checking query."""

from __future__ import annotations

from sightline.functions.urls import MULTI_PART_SUFFIXES
from sightline.schemas import COUNT_METRICS, SEVEN_METRICS

SUFFIXES = ", ".join(f"'{s}'" for s in MULTI_PART_SUFFIXES)
ENGINE_LIST = "['google','chatgpt_search','claude_search','gemini','yandex_neuro','perplexity','deepseek']"


def nd(x: str) -> str:
    """normalize_domain of an SQL expression."""
    host = (
        f"regexp_replace(split_part(lower(trim(regexp_extract(trim(coalesce({x}, '')), "
        r"'(?s)^(?:.*?://|//)?(?:[^/?#]*@)?([^/?#]*)', 1), ' .')), ':', 1), '^(www\.)+', '')"
    )
    return (
        f"list_transform([string_split({host}, '.')], lambda p: CASE WHEN array_to_string(p[-2:], '.') IN ({SUFFIXES}) "
        "THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END)[1]"
    )


def nt(x: str) -> str:
    """normalize_target of an SQL expression."""
    path = (
        f"trim(regexp_replace(lower(regexp_extract(trim(coalesce({x}, '')), "
        r"'(?s)^(?:.*?://|//)?[^/?#]*/([^?#]*)', 1)), '/+', '/', 'g'), '/')"
    )
    return f"CASE WHEN {nd(x)} = '' THEN '' WHEN {path} = '' THEN {nd(x)} ELSE {nd(x)} || '/' || {path} END"


def under(url: str, target: str) -> str:
    """Canonical URL lies under canonical target."""
    return f"({target} <> '' AND {url} <> '' AND ({url} = {target} OR starts_with({url}, {target} || '/')))"


def nq(x: str) -> str:
    """normalize_query of an SQL expression."""
    return (
        f"regexp_replace(lower(regexp_replace(trim(coalesce({x}, ''), e' \\t\\n\\r'), '\\s+', ' ', 'g')), "
        "'[\\s?!.,;:…]+$', '')"
    )


def toks(x: str) -> str:
    """Words of an SQL expression."""
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif({b}, 0))"


STATE_SQL = """
    count(*) AS n_queries,
    count(*) FILTER (overview_present) AS n_overviews,
    count(*) FILTER (overview_present AND len(s_ranks) > 0) AS n_in_sources,
    count(*) FILTER (overview_present AND len(c_ranks) > 0) AS n_cited,
    count(*) FILTER (overview_present AND brand_in_answer_text) AS n_brand_mentions,
    avg(list_min(s_ranks)) FILTER (overview_present) AS avg_source_position,
    avg(list_min(c_ranks)) FILTER (overview_present) AS avg_citation_position
"""

METRIC_SQL = {
    "overview_coverage": div("n_overviews", "n_queries"),
    "visibility_in_sources": div("n_in_sources", "n_overviews"),
    "visibility_in_citations": div("n_cited", "n_overviews"),
    "relative_citation": div("n_cited", "n_in_sources"),
}

_LINK_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)
_LINK_COLS = """
    'site' || (l_suppkey % 40) || '.com' AS domain,
    CASE WHEN l_partkey % 9 = 0 THEN 'https://www.google.com/url?q=https%3A%2F%2Fsite' || (l_suppkey % 40) || '.com'
         ELSE 'https://www.site' || (l_suppkey % 40) || '.com' || CASE WHEN l_partkey % 2 = 0 THEN '/p/' ELSE '/q/' END || l_partkey
    END AS url
"""

# aggregates that fold metric rows; the same text serves periods, groups and weeks
FOLD_SQL = f"""
    sum(n_queries)::BIGINT AS n_queries, sum(n_overviews)::BIGINT AS n_overviews,
    sum(n_in_sources)::BIGINT AS n_in_sources, sum(n_cited)::BIGINT AS n_cited,
    sum(n_brand_mentions)::BIGINT AS n_brand_mentions,
    round({div("sum(n_overviews)", "sum(n_queries)")}, 6) AS overview_coverage,
    round({div("sum(n_in_sources)", "sum(n_overviews)")}, 6) AS visibility_in_sources,
    round({div("sum(n_cited)", "sum(n_overviews)")}, 6) AS visibility_in_citations,
    round({div("sum(n_cited)", "sum(n_in_sources)")}, 6) AS relative_citation,
    round({div("sum(n_brand_mentions)", "sum(n_overviews) FILTER (n_brand_mentions IS NOT NULL)")}, 6) AS brand_mention_rate,
    round({div("sum(avg_source_position * n_in_sources)", "sum(n_in_sources)")}, 6) AS avg_source_position,
    round({div("sum(avg_citation_position * n_cited)", "sum(n_cited)")}, 6) AS avg_citation_position
"""


def shown(alias: str = "", suffix: str = "") -> str:
    """Metric columns of a row, rounded for comparison."""
    p = f"{alias}." if alias else ""
    counts = [f"{p}{c}::BIGINT AS {c}{suffix}" for c in COUNT_METRICS]
    return ", ".join([*counts, *[f"round({p}{m}, 6) AS {m}{suffix}" for m in SEVEN_METRICS]])


CTES = {
    "brands": """SELECT r_regionkey::BIGINT AS brand_id, r_name AS name,
        'site' || (7 * r_regionkey) || '.com' || CASE WHEN r_regionkey = 3 THEN '/p' ELSE '' END AS domain FROM region""",
    "answers_all": f"""SELECT o_orderkey AS id, (c_nationkey % 5)::BIGINT AS brand_id,
        {ENGINE_LIST}[o_orderkey % 7 + 1] AS engine, year(o_orderdate) AS yr, month(o_orderdate) AS mo,
        (((year(o_orderdate) * 12 + month(o_orderdate) - 1) * 7 + o_orderkey % 7) * 5 + c_nationkey % 5)::BIGINT AS run_id,
        'q' || (o_orderkey % 50) AS query,
        CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'branded' WHEN o_orderpriority[1] = '3' THEN 'comparative'
             ELSE 'general' END AS lens,
        o_orderdate AS captured_at, o_orderstatus <> 'P' AS overview_present,
        o_orderkey * 7 % 10 < 4 AS brand_in_answer_text,
        CASE WHEN o_orderkey % 5 <> 3 THEN ' phrase ' || (o_orderkey % 9) || ' ' END AS sentiment
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "answers": "SELECT * FROM answers_all WHERE run_id % 37 <> 0",
    "runs": """SELECT run_id, brand_id, engine, run_at,
        CASE WHEN run_at >= DATE '2001-07-01' THEN 'running' WHEN run_id % 23 = 0 THEN 'failed' ELSE 'done' END AS status,
        50::BIGINT AS n_queries, n_ok,
        CASE WHEN (yr + brand_id) % 2 = 0 THEN 'g' || yr || 'q' || ((mo - 1) // 3 + 1) END AS group_id
        FROM (SELECT run_id, brand_id, engine, yr, mo, count(*) AS n_ok,
              (make_date(yr, (mo - 1) // 3 * 3 + 1, 1) + ((mo - 1) % 3 * 2)::INT)::TIMESTAMP AS run_at
              FROM answers_all GROUP BY ALL)""",
    "links": f"""SELECT l_orderkey AS id, 'sources' AS channel, {_LINK_COLS},
            row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINK_ORDER}) AS rank FROM lineitem
        UNION ALL
        SELECT l_orderkey AS id, 'citations' AS channel, {_LINK_COLS},
            row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINK_ORDER}) AS rank FROM lineitem
        WHERE l_returnflag = 'R'""",
    "hits": r"""SELECT a.id, channel, list(rank ORDER BY rank) AS ranks FROM answers a JOIN brands b USING (brand_id)
        JOIN links l ON l.id = a.id AND l.domain = split_part(b.domain, '/', 1)
        AND (b.domain NOT LIKE '%/%' OR regexp_replace(l.url, '^https://www\.', '') LIKE b.domain || '/%')
        GROUP BY a.id, channel""",
    "sizes": """SELECT id, count(*) FILTER (channel = 'sources') AS n_sources,
        count(*) FILTER (channel = 'citations') AS n_citations FROM links GROUP BY id""",
    "cap_raw": """SELECT a.*, coalesce(s.ranks, []) AS s_ranks, coalesce(c.ranks, []) AS c_ranks,
        coalesce(n_sources, 0) AS n_sources, coalesce(n_citations, 0) AS n_citations FROM answers a
        LEFT JOIN (SELECT * FROM hits WHERE channel = 'sources') s ON s.id = a.id
        LEFT JOIN (SELECT * FROM hits WHERE channel = 'citations') c ON c.id = a.id
        LEFT JOIN sizes z ON z.id = a.id""",
    "cap": """SELECT * FROM cap_raw
        QUALIFY row_number() OVER (PARTITION BY run_id, query, lens ORDER BY id) = 1""",
    "scope": f"""SELECT run_id, CASE WHEN grouping(lens) = 1 THEN 'all' ELSE lens END AS lens, {STATE_SQL}
        FROM cap GROUP BY GROUPING SETS ((run_id, lens), (run_id))""",
    "metrics_new": f"""SELECT run_id, brand_id, engine, coalesce(lens, 'all') AS lens,
        coalesce(n_queries, 0) AS n_queries, coalesce(n_overviews, 0) AS n_overviews,
        coalesce(n_in_sources, 0) AS n_in_sources, coalesce(n_cited, 0) AS n_cited,
        coalesce(n_brand_mentions, 0) AS n_brand_mentions,
        {", ".join(f"{e} AS {m}" for m, e in METRIC_SQL.items())},
        {div("n_brand_mentions", "n_overviews")} AS brand_mention_rate,
        avg_source_position, avg_citation_position
        FROM (SELECT run_id, brand_id, engine FROM runs) LEFT JOIN (SELECT * FROM scope) USING (run_id)""",
    "metrics": """SELECT * REPLACE (
        CASE WHEN run_id // 420 <> 1995 THEN n_brand_mentions END AS n_brand_mentions,
        CASE WHEN run_id // 420 <> 1995 THEN brand_mention_rate END AS brand_mention_rate) FROM metrics_new""",
    "best": """SELECT run_id, lens, c.id, channel, l.domain, min(rank) AS rank FROM cap c JOIN links l ON l.id = c.id
        WHERE overview_present GROUP BY ALL""",
    "stats": f"""SELECT run_id, brand_id, engine, s.lens, s.domain,
        s.domain = split_part(b.domain, '/', 1) AS is_brand, appearances_sources, appearances_citations,
        sum_min_source_rank, sum_min_citation_rank,
        {div("sum_min_source_rank", "appearances_sources")} AS avg_source_position,
        {div("sum_min_citation_rank", "appearances_citations")} AS avg_citation_position
        FROM (SELECT run_id, CASE WHEN grouping(lens) = 1 THEN 'all' ELSE lens END AS lens, domain,
              count(*) FILTER (channel = 'sources') AS appearances_sources,
              count(*) FILTER (channel = 'citations') AS appearances_citations,
              coalesce(sum(rank) FILTER (channel = 'sources'), 0)::DOUBLE AS sum_min_source_rank,
              coalesce(sum(rank) FILTER (channel = 'citations'), 0)::DOUBLE AS sum_min_citation_rank
              FROM best GROUP BY GROUPING SETS ((run_id, lens, domain), (run_id, domain))) s
        JOIN runs r USING (run_id) JOIN brands b USING (brand_id)""",
    "sentiment": """SELECT DISTINCT run_id, lens,
        CASE WHEN run_id % 3 = 1 THEN 'summary ' || run_id || ' ' || lens END AS summary
        FROM answers WHERE run_id % 3 <> 0""",
    "questions": "SELECT DISTINCT brand_id, query, lens FROM answers WHERE query[2:]::INT % 7 <> 0",
    "done": "SELECT * FROM runs WHERE status = 'done'",
    "latest": """SELECT brand_id, engine, run_id, run_at, group_id FROM done
        QUALIFY row_number() OVER (PARTITION BY brand_id, engine ORDER BY run_at DESC, run_id DESC) = 1""",
    "ordered": """SELECT run_id, brand_id, engine, run_at,
        lag(run_id) OVER (PARTITION BY brand_id, engine ORDER BY run_at, run_id) AS prev_run_id FROM done""",
    "groups": """SELECT brand_id, engine, group_id, run_id, run_at,
        count(*) OVER (PARTITION BY brand_id, engine, group_id) AS n_repeats FROM done
        WHERE coalesce(group_id, '') <> ''""",
    "focus_group": """SELECT g.brand_id, g.engine, g.group_id, n_repeats, t.run_id AS focus_run_id, g.run_id
        FROM groups g JOIN latest t ON g.brand_id = t.brand_id AND g.engine = t.engine AND g.group_id = t.group_id
        WHERE n_repeats > 1""",
    "outcomes": """SELECT *, CASE WHEN NOT overview_present THEN 'no_answer' WHEN len(c_ranks) > 0 THEN 'cited'
        WHEN len(s_ranks) > 0 THEN 'sources_only' WHEN brand_in_answer_text THEN 'mention_only' ELSE 'absent' END AS outcome
        FROM cap""",
    "asked": """SELECT conv_id * 1000 + turn AS index, text AS query FROM conversations WHERE role = 'user'
        UNION ALL SELECT item_id + 1000000000, text FROM benchmark""",
    "cand0": """SELECT index, query || CASE WHEN index % 2 = 0 THEN ' ?' ELSE '' END
            || CASE WHEN index % 3 = 1 AND index % 5 <> 0 THEN ' Acme App' ELSE '' END AS query,
        CASE WHEN index % 29 = 0 THEN 'promo' ELSE ['general', 'branded', 'comparative'][index % 3 + 1] END AS lens,
        's' || (index % 4) AS segment, CASE WHEN index % 31 <> 0 THEN 'forum' ELSE '  ' END AS signal,
        CASE WHEN index % 37 <> 0 THEN 'https://f.example/t' END AS source_url FROM asked""",
    "cand": """SELECT * FROM cand0 UNION ALL
        SELECT index + 2000000000, lower('  ' || query || ' !'), lens, segment, signal, source_url FROM cand0
        WHERE index % 6 = 0""",
    "cand_bad": """SELECT index, query, CASE WHEN trim(query) = '' THEN 'query' WHEN lens = 'promo' THEN 'lens'
            WHEN trim(signal) = '' THEN 'signal' WHEN source_url IS NULL THEN 'source_url' END AS field,
        CASE WHEN trim(query) = '' THEN 'Value error, must be a non-empty string'
            WHEN lens = 'promo' THEN 'Input should be ''general'', ''branded'' or ''comparative'''
            WHEN trim(signal) = '' THEN 'Value error, must be a non-empty string'
            WHEN source_url IS NULL THEN 'Field required' END AS msg
        FROM cand WHERE field IS NOT NULL""",
    "cand_good": "SELECT * REPLACE (trim(query) AS query) FROM cand WHERE index NOT IN (SELECT index FROM cand_bad)",
    "cand_named": f"""SELECT *, list_has_all({toks(nq("query"))}, ['acme', 'app']) AS named FROM cand_good""",
    "cand_kept": f"""SELECT * FROM (SELECT * FROM cand_named WHERE NOT (lens = 'general' AND named)
        AND NOT (lens = 'branded' AND NOT named))
        QUALIFY row_number() OVER (PARTITION BY {nq("query")} ORDER BY index) = 1""",
    "audits": f"""SELECT page_id AS audit_id, 'site' || (page_id % 40) || '.com' AS domain,
        [{ENGINE_LIST[1:-1]}, NULL][page_id % 8 + 1] AS engine,
        TIMESTAMP '2026-01-01' + INTERVAL 1 HOUR * (page_id * 7 % 1000) AS checked_at,
        (page_id * 13 % 101)::BIGINT AS score FROM pages""",
    "audit_checks": """SELECT audit_id, domain, engine, checked_at, x.id AS id, x.category AS category, x.severity AS severity,
        ['pass', 'warn', 'fail', 'skip'][(audit_id // x.d) % 4 + 1] AS status
        FROM audits, (SELECT unnest([
            {'id': 'A1', 'category': 'A', 'severity': 'blocker', 'd': 1}, {'id': 'A3', 'category': 'A', 'severity': 'blocker', 'd': 4},
            {'id': 'B1', 'category': 'B', 'severity': 'recommended', 'd': 16}, {'id': 'B4', 'category': 'B', 'severity': 'nice_to_have', 'd': 2},
            {'id': 'C1', 'category': 'C', 'severity': 'recommended', 'd': 8}]) AS x)""",
    "latest_any": """SELECT * FROM audits
        QUALIFY row_number() OVER (PARTITION BY domain ORDER BY checked_at DESC, audit_id DESC) = 1""",
    "latest_own": """SELECT * FROM audits WHERE engine IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY domain, engine ORDER BY checked_at DESC, audit_id DESC) = 1""",
}


def with_ctes(select: str, extra: dict[str, str] | None = None) -> str:
    """A checking query after the common tables; those it does not name cost nothing."""
    tables = {**CTES, **(extra or {})}
    head = ",\n".join(f"{name} AS ({body})" for name, body in tables.items())
    return f"WITH {head}\n{select}"
