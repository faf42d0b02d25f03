"""Question sets and extraction scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import captures as C
from sightline.operators import questions as Q
from sightline.operators import scoring as S
from sightline.session import scratch_path
from sightline.sources import tables as T

from .derived import Derived
from .oracle import nq, toks, with_ctes
from .present import present

CASES: dict = {}


def case(key, fn, sql, extra=None):
    CASES[key] = (fn, None if sql is None else with_ctes(sql, extra))


_FIELDS = ["index", "query", "lens", "segment"]
case("validate_candidates", lambda d: present(Q.validate_candidates(d.candidates_raw)[0], *_FIELDS),
     "SELECT index, query, lens, segment FROM cand_good")
case("validate_candidates_errors", lambda d: present(Q.validate_candidates(d.candidates_raw)[1]),
     "SELECT index, query, field, msg FROM cand_bad")


def _brand():
    return F.lit("Acme App")


_GUARDED = """SELECT *, CASE WHEN lens = 'general' AND named THEN 'general lens must not name the brand'
    WHEN lens = 'branded' AND NOT named THEN 'branded lens must name the brand' END AS msg FROM cand_named"""
case("lens_brand_guard",
     lambda d: present(Q.lens_brand_guard(Q.validate_candidates(d.candidates_raw)[0], _brand())[1]),
     f"SELECT index, query, 'lens' AS field, msg FROM ({_GUARDED}) WHERE msg IS NOT NULL")
case("dedupe_questions", lambda d: present(Q.dedupe_questions(d.candidates), "index"),
     f"SELECT index FROM cand QUALIFY row_number() OVER (PARTITION BY {nq('query')} ORDER BY index) = 1")
case("build_question_set", lambda d: present(Q.build_question_set(d.candidates_raw, _brand())[0], *_FIELDS),
     "SELECT index, query, lens, segment FROM cand_kept")
_BY_LENS = ", ".join(f"count(*) FILTER (lens = '{x}') AS {x}" for x in ("general", "branded", "comparative"))
case("questions_by_lens", lambda d: present(Q.build_question_set(d.candidates_raw, _brand())[2]),
     f"""SELECT k.*, (SELECT count(*) FROM ({_GUARDED}) WHERE msg IS NULL) - written AS dropped_dups,
     (SELECT count(*) FROM cand_bad) + (SELECT count(*) FROM ({_GUARDED}) WHERE msg IS NOT NULL) AS errors
     FROM (SELECT count(*) AS written, {_BY_LENS} FROM cand_kept) k""")
case("grounded_only", lambda d: present(Q.grounded_only(d.candidates), "index"),
     "SELECT index FROM cand WHERE trim(signal) <> '' AND trim(coalesce(source_url, '')) <> ''")
case("near_duplicate_questions", lambda d: present(Q.near_duplicate_questions(d.candidates, 0.6), "index"),
     f"""SELECT index FROM words a WHERE NOT EXISTS (SELECT 1 FROM words b WHERE b.index < a.index AND len(a.w) > 0 AND len(b.w) > 0
     AND len(list_intersect(a.w, b.w)) >= 0.6 * len(list_distinct(list_concat(a.w, b.w))) - 1e-9)""",
     {"words": f"SELECT index, list_distinct({toks(nq('query'))}) AS w FROM cand"})
_QUOTA = {"general": 16, "branded": 10, "comparative": 10}
case("balance_questions", lambda d: present(Q.balance_questions(d.candidates, _QUOTA), "index", "lens", "position"),
     """SELECT index, lens, position FROM (SELECT index, lens, row_number() OVER (PARTITION BY lens ORDER BY sp, segment, index) AS position
        FROM (SELECT *, row_number() OVER (PARTITION BY lens, segment ORDER BY index) AS sp FROM cand))
     WHERE position <= CASE lens WHEN 'general' THEN 16 WHEN 'branded' THEN 10 WHEN 'comparative' THEN 10 ELSE 0 END""")


def _csv(d: Derived):
    """Questions with quotes, commas and line ends written as CSV and read back."""
    path = scratch_path(d.spark, "questions")
    q = d.candidates.select(F.concat("query", F.lit(' "a", b\n'), F.col("index").cast("string")).alias("query"), "lens")
    T.write_questions(q, path)
    return T.read_questions(d.spark, path)


_CSV_SQL = "SELECT query || ' \"a\", b' || chr(10) || index AS query, lens FROM cand"
case("write_questions", lambda d: present(_csv(d)), _CSV_SQL)
CASES["read_questions"] = CASES["write_questions"]

# --- scoring -------------------------------------------------------------------------------------------


def _scored(d: Derived):
    """(candidates, truth, corpus): every capture read a second time with faults by id."""
    i = F.col("id")
    truth = d.captures.withColumn("fixture_id", i)
    first = F.slice("sources", 1, 1)
    faulty = F.when(i % 5 == 0, F.slice("sources", 1, 0)).when(i % 5 == 1, F.reverse("sources")).when(
        i % 5 == 2, F.slice("sources", F.lit(2), F.size("sources"))).when(i % 5 == 3, F.concat("sources", first)).otherwise(F.col("sources"))
    cand = d.captures.withColumns({
        "candidate_id": i, "fixture_id": i, "sources": faulty,
        "overview_present": F.when(i % 7 == 0, ~F.col("overview_present")).otherwise(F.col("overview_present")),
        "sentiment": F.when(i % 11 == 0, F.lit(None)).otherwise(F.col("sentiment")),
        "target_source_ranks": F.when(i % 13 == 0, F.array().cast("array<int>")).otherwise(F.col("target_source_ranks")),
    })
    text = F.array_join(F.transform(F.slice("sources", 1, 3), lambda x: F.concat(F.lit("see "), x["url"], F.lit("/ now"))), "\n")
    corpus = d.captures.select(i.alias("fixture_id"), text.alias("text"))
    return cand, truth, corpus


_SCORING = {
    "there": """SELECT c.id, channel, rank, url, l.domain,
        CASE WHEN url LIKE 'https://www.google%' THEN 'google.com' ELSE l.domain END AS d FROM cap c JOIN links l ON l.id = c.id""",
    "reading": """SELECT id, channel, rank, url, domain, d, CASE WHEN channel = 'sources' AND id % 5 = 1 THEN -rank ELSE rank END AS place FROM there
        WHERE NOT (channel = 'sources' AND (id % 5 = 0 OR (id % 5 = 2 AND rank = 1)))
        UNION ALL SELECT id, channel, rank, url, domain, d, 1000 FROM there WHERE channel = 'sources' AND id % 5 = 3 AND rank = 1""",
    "multi": """SELECT id, channel, d, count(*) FILTER (side = 'r') AS n_read, count(*) FILTER (side = 't') AS n_true FROM (
        SELECT id, channel, d, 'r' AS side FROM reading UNION ALL SELECT id, channel, d, 't' FROM there) GROUP BY ALL""",
    "probes": """SELECT id, url, channel, place, rtrim(split_part(url, '?', 1), '/') AS probe FROM reading""",
    "corpus": "SELECT id, string_agg('see ' || url || '/ now', chr(10) ORDER BY rank) AS text FROM there WHERE channel = 'sources' AND rank <= 3 GROUP BY id",
    "fab": "SELECT p.id, p.channel, p.place, p.url FROM probes p JOIN corpus c USING (id) WHERE probe <> '' AND NOT contains(c.text, probe)",
    "lists": """SELECT c.id, coalesce(r.sources, []) AS rs, coalesce(r.citations, []) AS rc, coalesce(t.sources, []) AS ts, coalesce(t.citations, []) AS tc
        FROM cap c
        LEFT JOIN (SELECT id, list(d ORDER BY place) FILTER (channel = 'sources') AS sources, list(d ORDER BY place) FILTER (channel = 'citations') AS citations FROM reading GROUP BY id) r ON r.id = c.id
        LEFT JOIN (SELECT id, list(d ORDER BY rank) FILTER (channel = 'sources') AS sources, list(d ORDER BY rank) FILTER (channel = 'citations') AS citations FROM there GROUP BY id) t ON t.id = c.id""",
    "f1": """SELECT id, channel, common, n_read, n_true,
        CASE WHEN n_read > 0 THEN common / n_read WHEN n_true = 0 THEN 1.0 ELSE 0.0 END AS p,
        CASE WHEN n_true > 0 THEN common / n_true ELSE 1.0 END AS r FROM (
        SELECT c.id, ch.channel, coalesce(sum(least(n_read, n_true)), 0)::DOUBLE AS common, coalesce(sum(n_read), 0) AS n_read, coalesce(sum(n_true), 0) AS n_true
        FROM cap c CROSS JOIN (VALUES ('sources'), ('citations')) ch(channel) LEFT JOIN multi m ON m.id = c.id AND m.channel = ch.channel GROUP BY ALL)""",
    "bounds": """SELECT c.id,
        CASE WHEN len(rc) > 0 AND len(list_filter(cited, lambda x: NOT list_contains(sourced, x))) > 0 THEN FALSE
             WHEN len(c_ranks) > 0 AND len(t) = 0 THEN FALSE WHEN list_max(t) > len(rs) THEN FALSE WHEN list_max(c_ranks) > len(rc) THEN FALSE ELSE TRUE END AS valid, t
        FROM (SELECT c.*, CASE WHEN c.id % 13 = 0 THEN [] ELSE s_ranks END AS t FROM cap c) c JOIN lists USING (id)
        LEFT JOIN (SELECT id, coalesce(list(DISTINCT domain) FILTER (channel = 'sources'), []) AS sourced, coalesce(list(DISTINCT domain) FILTER (channel = 'citations'), []) AS cited FROM reading GROUP BY id) dd ON dd.id = c.id""",
}
case("score_multiset_join", lambda d: present(S.score_multiset_join(*_scored(d)[:2])),
     "SELECT id AS candidate_id, channel, d AS domain, n_read, n_true, least(n_read, n_true) AS n_common FROM multi", _SCORING)
case("fabricated_links", lambda d: present(S.fabricated_links(_scored(d)[0], _scored(d)[2])),
     "SELECT id AS candidate_id, row_number() OVER (PARTITION BY id ORDER BY CASE channel WHEN 'sources' THEN 0 ELSE 1 END, place) - 1 AS pos, url FROM fab", _SCORING)
_SCORE_COLS = ["candidate_id", "schema_valid", "overview_present_ok", "brand_in_answer_text_ok", "sentiment_nullness_ok",
               "target_source_ranks_ok", "target_citation_ranks_ok", "sources_precision", "sources_recall", "sources_f1",
               "citations_precision", "citations_recall", "citations_f1", "sources_exact_order", "citations_exact_order",
               "n_sources", "n_citations", "n_fabricated", "no_fabrication", "answer_text_present", "domain_field_accuracy"]


def _f1_sql(channel: str) -> str:
    return ", ".join([
        f"round_even(max(p) FILTER (channel = '{channel}'), 3) AS {channel}_precision",
        f"round_even(max(r) FILTER (channel = '{channel}'), 3) AS {channel}_recall",
        f"round_even(coalesce(max(p * r * 2 / nullif(p + r, 0)) FILTER (channel = '{channel}'), 0), 3) AS {channel}_f1"])


_SCORE_SQL = f"""SELECT c.id AS candidate_id, b.valid AS schema_valid, c.id % 7 <> 0 AS overview_present_ok, TRUE AS brand_in_answer_text_ok,
    c.id % 11 <> 0 OR sentiment IS NULL AS sentiment_nullness_ok, b.t = s_ranks AS target_source_ranks_ok, TRUE AS target_citation_ranks_ok,
    f.* EXCLUDE (id), rs = ts AS sources_exact_order, rc = tc AS citations_exact_order, len(rs)::BIGINT AS n_sources, len(rc)::BIGINT AS n_citations,
    coalesce(n_fab, 0) AS n_fabricated, coalesce(n_fab, 0) = 0 AS no_fabrication, c.id % 4 <> 0 AS answer_text_present,
    round_even(good / nullif(len(rs) + len(rc), 0), 3) AS domain_field_accuracy
    FROM cap c JOIN bounds b ON b.id = c.id JOIN lists l ON l.id = c.id
    JOIN (SELECT id, {_f1_sql('sources')}, {_f1_sql('citations')} FROM f1 GROUP BY id) f ON f.id = c.id
    LEFT JOIN (SELECT id, count(*) AS n_fab FROM fab GROUP BY id) x ON x.id = c.id
    LEFT JOIN (SELECT id, count(*) FILTER (d = domain)::DOUBLE AS good FROM reading GROUP BY id) g ON g.id = c.id"""
case("score_extraction", lambda d: present(S.score_extraction(*_scored(d)), *_SCORE_COLS), _SCORE_SQL, _SCORING)
case("score_gates", lambda d: present(S.score_gates(S.score_extraction(*_scored(d)))),
     f"""SELECT candidate_id, failed_gates, failed_gates = '' AS passed FROM (SELECT candidate_id, concat_ws(',',
     CASE WHEN NOT schema_valid THEN 'schema' END, CASE WHEN NOT overview_present_ok THEN 'gate' END, CASE WHEN NOT sentiment_nullness_ok THEN 'sent-null' END,
     CASE WHEN NOT target_source_ranks_ok THEN 'src-ranks' END, CASE WHEN NOT no_fabrication THEN 'no-fabrication' END) AS failed_gates FROM ({_SCORE_SQL}))""", _SCORING)
