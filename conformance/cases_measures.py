"""Metrics, leaderboards, rollups, run selection, outcomes and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import day_as_written, delta_direction
from sightline.operators import leaderboard as L
from sightline.operators import metrics as M
from sightline.operators import outcomes as O
from sightline.operators import rollups as R
from sightline.operators import runs as S
from sightline.plans import report, views
from sightline.schemas import COUNT_METRICS, METRIC_COLUMNS, SEVEN_METRICS

from .derived import Derived
from .oracle import FOLD_SQL, METRIC_SQL, div, nd, shown, ts, with_ctes
from .present import present

COLS = ["run_id", "brand_id", "engine", "lens"]
STATS = [
    "appearances_sources", "appearances_citations", "sum_min_source_rank", "sum_min_citation_rank",
    "avg_source_position", "avg_citation_position",
]
STATS_SQL = (
    "appearances_sources::BIGINT AS appearances_sources, appearances_citations::BIGINT AS appearances_citations, "
    "round(sum_min_source_rank, 6) AS sum_min_source_rank, round(sum_min_citation_rank, 6) AS sum_min_citation_rank, "
    "round(avg_source_position, 6) AS avg_source_position, round(avg_citation_position, 6) AS avg_citation_position"
)
BOARD_SQL = "domain, is_brand, " + STATS_SQL
BOARD_FOLD = f"""bool_or(is_brand) AS is_brand,
    sum(appearances_sources)::BIGINT AS appearances_sources, sum(appearances_citations)::BIGINT AS appearances_citations,
    sum(sum_min_source_rank) AS sum_min_source_rank, sum(sum_min_citation_rank) AS sum_min_citation_rank,
    {div("sum(sum_min_source_rank)", "sum(appearances_sources)")} AS avg_source_position,
    {div("sum(sum_min_citation_rank)", "sum(appearances_citations)")} AS avg_citation_position"""
BY_SOURCES = "appearances_sources DESC, appearances_citations DESC, domain"
BY_CITATIONS = "appearances_citations DESC, appearances_sources DESC, domain"
DONE_METRICS = "(SELECT m.* EXCLUDE (brand_id, engine), r.brand_id, r.engine, r.run_at, r.group_id FROM metrics m JOIN done r USING (run_id))"

CASES: dict = {}


def case(key, fn, sql, extra=None):
    CASES[key] = (fn, None if sql is None else with_ctes(sql, extra))


# --- run level -----------------------------------------------------------------------------------------

case("run_metrics", lambda d: present(M.run_metrics(d.captures, d.runs)),
     f"SELECT run_id, brand_id, engine, lens, {shown()} FROM metrics_new")

for _name in (*COUNT_METRICS, *SEVEN_METRICS):
    _kind = "BIGINT" if _name in COUNT_METRICS else None
    case(
        _name,
        lambda d, m=_name: present(M.run_metrics(d.captures, d.runs), "run_id", "lens", m),
        f"SELECT run_id, lens, {_name}::BIGINT AS {_name} FROM metrics_new" if _kind
        else f"SELECT run_id, lens, round({_name}, 6) AS {_name} FROM metrics_new",
    )

_STAGES = " UNION ALL ".join(
    f"""SELECT run_id, lens, {i}::BIGINT AS stage_no, '{s}' AS stage, {c}::BIGINT AS stage_count,
    round({c}::DOUBLE / greatest(n_overviews, 1), 6) AS width,
    n_cited <= n_in_sources AND n_in_sources <= n_overviews AND n_overviews <= n_queries AS narrowing FROM metrics"""
    for i, (s, c) in enumerate((("overview", "n_overviews"), ("sources", "n_in_sources"), ("cited", "n_cited")), 1)
)
case("funnel_stages", lambda d: present(M.funnel_stages(d.metrics)), _STAGES)
case("overview_gate", lambda d: present(M.overview_gate(d.captures), "run_id", "id"),
     "SELECT run_id, id FROM cap WHERE overview_present")

# --- leaderboard ---------------------------------------------------------------------------------------

case("domain_leaderboard", lambda d: present(d.stats),
     f"SELECT run_id, brand_id, engine, lens, {BOARD_SQL} FROM stats")
case("top_domains", lambda d: present(L.top_domains(d.stats), "run_id", "domain", "position"),
     f"""SELECT run_id, domain, row_number() OVER (PARTITION BY run_id ORDER BY {BY_SOURCES}) AS position
     FROM stats WHERE lens = 'all' QUALIFY position <= 10""")
case("leaderboard_top", lambda d: present(L.leaderboard_top(d.stats), "run_id", "lens", "domain", "position"),
     f"""SELECT run_id, lens, domain, row_number() OVER (PARTITION BY run_id, lens ORDER BY {BY_SOURCES}) AS position
     FROM stats QUALIFY position <= 15""")
case("leaderboard_top_cited_first",
     lambda d: present(L.leaderboard_top(d.stats, "citations", 7), "run_id", "lens", "domain", "position"),
     f"""SELECT run_id, lens, domain, row_number() OVER (PARTITION BY run_id, lens ORDER BY {BY_CITATIONS}) AS position
     FROM stats QUALIFY position <= 7""")
case("leaderboard_top_unlimited",
     lambda d: present(L.leaderboard_top(d.stats, "sources", 0), "run_id", "lens", "domain"),
     "SELECT run_id, lens, domain FROM stats")
case("top_cited_domains", lambda d: present(L.top_cited_domains(d.stats), "run_id", "lens", "domain", "position"),
     f"""SELECT run_id, lens, domain, row_number() OVER (PARTITION BY run_id, lens ORDER BY appearances_citations DESC,
         coalesce(avg_citation_position, 999), domain) AS position
     FROM (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY run_id, lens ORDER BY {BY_SOURCES}) <= 15)
     WHERE appearances_citations > 0 QUALIFY position <= 5""")
case("leaderboard_resort",
     lambda d: present(L.leaderboard_resort(d.stats, "avg_citation_position", True), *["run_id", "lens", "domain"], *STATS),
     f"SELECT run_id, lens, domain, {STATS_SQL} FROM stats")
_SHARES = f"""round({div("appearances_sources", "n_overviews")}, 6) AS share_sources,
    round({div("appearances_citations", "n_overviews")}, 6) AS share_citations"""
case("with_shares",
     lambda d: present(L.with_shares(d.stats, d.metrics), "run_id", "lens", "domain", "n_overviews", "share_sources", "share_citations"),
     f"SELECT s.run_id, s.lens, s.domain, n_overviews::BIGINT AS n_overviews, {_SHARES} FROM stats s JOIN metrics m ON m.run_id = s.run_id AND m.lens = s.lens")
CASES["leaderboard_shares"] = CASES["with_shares"]
_PERIOD_BOARD = f"SELECT r.brand_id, r.engine, s.lens, s.domain, {BOARD_FOLD} FROM stats s JOIN done r USING (run_id) GROUP BY ALL"
case("leaderboard_period", lambda d: present(L.leaderboard_period(d.stats, d.runs)),
     f"SELECT brand_id, engine, lens, domain, is_brand, {STATS_SQL} FROM ({_PERIOD_BOARD})")
case("stats_of_done_runs",
     lambda d: present(L.stats_of_done_runs(d.stats, d.runs), *COLS, "run_at", "domain", "is_brand", *STATS),
     f"SELECT s.run_id, r.brand_id, r.engine, s.lens, {ts('r.run_at')} AS run_at, {BOARD_SQL} FROM stats s JOIN done r USING (run_id)")

# --- run selection -------------------------------------------------------------------------------------

case("metrics_of_done_runs",
     lambda d: present(S.metrics_of_done_runs(d.metrics, d.runs), *COLS, "run_at", "group_id", *METRIC_COLUMNS),
     f"SELECT run_id, brand_id, engine, lens, {ts('run_at')} AS run_at, group_id, {shown()} FROM {DONE_METRICS}")
case("runs_with_brand", lambda d: present(S.runs_with_brand(d.runs, d.brands), "run_id", "engine", "status", "brand_name", "target"),
     "SELECT run_id, engine, status, name AS brand_name, domain AS target FROM runs JOIN brands USING (brand_id)")
case("runs_with_metrics", lambda d: present(S.runs_with_metrics(d.runs, d.metrics.where("run_id % 5 <> 0")), "run_id", "status"),
     "SELECT run_id, status FROM done WHERE run_id IN (SELECT run_id FROM metrics WHERE run_id % 5 <> 0)")
case("engines_without_metrics",
     lambda d: present(S.engines_without_metrics(
         d.runs.select("brand_id", "engine").distinct(), d.runs, d.metrics.where("engine NOT IN ('gemini', 'deepseek')"))),
     "SELECT DISTINCT brand_id, engine FROM runs WHERE engine IN ('gemini', 'deepseek')")
case("distinct_engines", lambda d: present(S.distinct_engines(d.runs)),
     "SELECT brand_id, engine, bool_or(status = 'done') AS any_done FROM runs GROUP BY ALL")
case("completed_only", lambda d: present(S.completed_only(d.runs), "run_id", "status"), "SELECT run_id, status FROM done")
case("n_runs_done", lambda d: present(S.n_runs_done(d.runs)),
     "SELECT brand_id, engine, count(*) AS n_runs FROM done GROUP BY ALL")
case("latest_completed_run", lambda d: present(S.latest_completed_run(d.runs)),
     f"SELECT brand_id, engine, run_id, {ts('run_at')} AS run_at, group_id FROM latest")
case("previous_completed_run", lambda d: present(S.previous_completed_run(d.runs)),
     f"SELECT run_id, brand_id, engine, {ts('run_at')} AS run_at, prev_run_id FROM ordered")
case("group_run_ids", lambda d: present(S.group_run_ids(d.runs)),
     f"SELECT brand_id, engine, group_id, run_id, {ts('run_at')} AS run_at, n_repeats FROM groups")
case("runs_newest_first", lambda d: present(S.runs_newest_first(d.runs), "run_id", "run_at", "status", "engine", "n_queries", "n_ok", "n_failed"),
     f"SELECT run_id, {ts('run_at')} AS run_at, status, engine, n_queries, n_ok, NULL::BIGINT AS n_failed FROM runs")
case("brands_by_name", lambda d: present(S.brands_by_name(d.brands), "brand_id", "name", "domain"),
     "SELECT brand_id, name, domain FROM brands")
_ASKED = """(SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 0 THEN lower(name) ELSE '  ' || name || ' ' END AS name,
    CASE WHEN c_custkey % 4 = 0 THEN 'https://www.other.org/' ELSE 'https://www.' || domain || '/' END AS domain, b.brand_id AS bid, domain AS own
    FROM customer JOIN brands b ON b.brand_id = c_custkey % 5)"""


def _requests(d: Derived):
    c = F.col("c_custkey")
    joined = d.given("customer").join(d.brands, c % 5 == F.col("brand_id"))
    return joined.select(
        c.alias("request_id"),
        F.when(c % 3 == 0, F.lower("name")).otherwise(F.concat(F.lit("  "), "name", F.lit(" "))).alias("name"),
        F.when(c % 4 == 0, "https://www.other.org/").otherwise(F.concat(F.lit("https://www."), "domain", F.lit("/"))).alias("domain"),
    )


case("resolve_brand", lambda d: present(S.resolve_brand(d.brands, _requests(d))),
     f"""SELECT request_id, CASE WHEN request_id % 4 <> 0 THEN bid END AS brand_id,
     CASE WHEN request_id % 4 = 0 THEN own END AS known_domains FROM {_ASKED}""")

# --- rollups -------------------------------------------------------------------------------------------

case("period_rollup", lambda d: present(R.period_rollup(d.metrics, d.runs)),
     f"SELECT brand_id, engine, lens, {FOLD_SQL} FROM {DONE_METRICS} GROUP BY ALL")
_GROUPED = "(SELECT m.* EXCLUDE (brand_id, engine), g.brand_id, g.engine, g.group_id, g.n_repeats FROM metrics m JOIN groups g USING (run_id) WHERE n_repeats > 1)"
case("group_rollup", lambda d: present(R.group_rollup(d.metrics, d.runs)),
     f"SELECT brand_id, engine, group_id, n_repeats, lens, {FOLD_SQL} FROM {_GROUPED} GROUP BY ALL")
SPREAD_SQL = ", ".join(f"round({f}({m}), 6) AS {m}_{f}" for m in SEVEN_METRICS for f in ("min", "max"))
case("group_spread", lambda d: present(R.group_spread(d.metrics, d.runs)),
     f"SELECT brand_id, engine, group_id, n_repeats, lens, {SPREAD_SQL} FROM {_GROUPED} GROUP BY ALL")
case("trend_points", lambda d: present(R.trend_points(d.metrics, d.runs)),
     f"SELECT brand_id, engine, lens, run_id, {ts('run_at')} AS run_at, {shown()} FROM {DONE_METRICS}")
WEEKLY_SQL = f"""SELECT brand_id, engine, lens, strftime(run_at, '%G-W%V') AS week,
    strftime(date_trunc('week', run_at), '%Y-%m-%d') AS monday, count(*) AS n_runs, {FOLD_SQL} FROM {DONE_METRICS} GROUP BY ALL"""
case("weekly_rollup", lambda d: present(R.weekly_rollup(d.metrics, d.runs)), WEEKLY_SQL)


def _dated_runs(d: Derived):
    """Runs whose time was given as text late in the evening, behind or before the session's zone, and read as an instant."""
    stamp = F.concat(F.date_format("run_at", "yyyy-MM-dd"), F.when(F.col("brand_id") % 2 == 0, "T23:00:00-05:00").otherwise("T01:00:00+09:00"))
    return d.runs.withColumn("stamp", stamp).withColumns({"run_at": F.to_timestamp("stamp"), "run_day": day_as_written(F.col("stamp"))})


case("weekly_rollup_own_offset", lambda d: present(R.weekly_rollup(d.metrics, _dated_runs(d))), WEEKLY_SQL)
_PREV = ", ".join(f"round(p.{m}, 6) AS {m}_prev" for m in SEVEN_METRICS)
_DELTA = ", ".join(f"round(m.{m} - p.{m}, 6) AS {m}_delta" for m in SEVEN_METRICS)
_PAIR = """FROM latest t JOIN ordered o ON o.run_id = t.run_id LEFT JOIN runs pr ON pr.run_id = o.prev_run_id
    JOIN metrics m ON m.run_id = t.run_id LEFT JOIN metrics p ON p.run_id = o.prev_run_id AND p.lens = m.lens"""
_PAIR_KEYS = f"t.brand_id, t.engine, t.run_id, {ts('t.run_at')} AS run_at, t.group_id, o.prev_run_id, {ts('pr.run_at')} AS prev_run_at, m.lens"
case("latest_vs_previous", lambda d: present(R.latest_vs_previous(d.metrics, d.runs)),
     f"SELECT {_PAIR_KEYS}, {shown('m')}, {_PREV} {_PAIR}")
case("metric_deltas", lambda d: present(R.metric_deltas(d.metrics, d.runs)),
     f"SELECT {_PAIR_KEYS}, {shown('m')}, {_PREV}, {_DELTA} {_PAIR}")
_ENGINES = "(SELECT brand_id, engine, count(*) FILTER (status = 'done') AS n_runs FROM runs GROUP BY ALL) e"
_MATRIX_TODAY = f"""SELECT e.brand_id, e.engine, e.n_runs, t.run_id, {ts('t.run_at')} AS run_at, {shown('m')} FROM {_ENGINES}
    LEFT JOIN latest t ON t.brand_id = e.brand_id AND t.engine = e.engine
    LEFT JOIN metrics m ON m.run_id = t.run_id AND m.lens = 'all'"""
_MATRIX_ALL = f"""SELECT e.brand_id, e.engine, e.n_runs, NULL::BIGINT AS run_id, NULL::VARCHAR AS run_at, {shown('m')} FROM {_ENGINES}
    LEFT JOIN (SELECT brand_id, engine, {FOLD_SQL} FROM {DONE_METRICS} WHERE lens = 'all' GROUP BY ALL) m
    ON m.brand_id = e.brand_id AND m.engine = e.engine"""
case("engine_matrix", lambda d: present(R.engine_matrix(d.metrics, d.runs)), _MATRIX_TODAY)
case("engine_matrix_period", lambda d: present(R.engine_matrix(d.metrics, d.runs, "all")), _MATRIX_ALL)
case("view_engine_matrix", lambda d: present(views.view_engine_matrix(d.metrics, d.runs, "all", "branded")),
     _MATRIX_ALL.replace("lens = 'all'", "lens = 'branded'"))
case("with_sentiment_summary",
     lambda d: present(R.with_sentiment_summary(d.metrics.select("run_id", "lens"), d.sentiment)),
     """SELECT m.run_id, m.lens, s.summary AS sentiment_summary FROM metrics m
     LEFT JOIN sentiment s ON s.run_id = m.run_id AND s.lens = m.lens""")

# --- outcomes ------------------------------------------------------------------------------------------

_KINDS = ("cited", "sources_only", "mention_only", "absent", "no_answer")
case("outcome_of", lambda d: present(O.with_outcome(d.captures), "id", "outcome"), "SELECT id, outcome FROM outcomes")
case("outcome_counts", lambda d: present(O.outcome_counts(d.captures)),
     "SELECT run_id, " + ", ".join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in _KINDS)
     + ', count(*) AS "all" FROM outcomes GROUP BY run_id')
case("results_by_outcome", lambda d: present(O.results_by_outcome(d.captures), "run_id", "id", "outcome", "outcome_rank"),
     f"SELECT run_id, id, outcome, (list_position({list(_KINDS)}, outcome) - 1)::BIGINT AS outcome_rank FROM outcomes")
case("gap_list", lambda d: present(O.gap_list(d.captures)),
     "SELECT run_id, id, trim(query) AS query, lens FROM outcomes WHERE outcome = 'absent'")
case("sentiment_samples", lambda d: present(O.sentiment_samples(d.captures, 2)),
     """SELECT run_id, lens, row_number() OVER (PARTITION BY run_id, lens ORDER BY captured_at DESC, id DESC) AS position,
     phrase, trim(query) AS query FROM (
        SELECT run_id, lens, captured_at, id, query, trim(sentiment) AS phrase FROM cap WHERE trim(sentiment) <> ''
        QUALIFY row_number() OVER (PARTITION BY run_id, lens, trim(sentiment) ORDER BY captured_at DESC, id DESC) = 1)
     QUALIFY position <= 2""")
_RESULT = "id, run_id, query, lens, overview_present, array_to_string(s_ranks, ',') AS target_source_ranks, array_to_string(c_ranks, ',') AS target_citation_ranks, brand_in_answer_text, sentiment"
_RESULT_COLS = ["id", "run_id", "query", "lens", "overview_present", "target_source_ranks", "target_citation_ranks", "brand_in_answer_text", "sentiment"]
case("results_in_order", lambda d: present(O.results_in_order(d.captures, "general"), *_RESULT_COLS),
     f"SELECT {_RESULT} FROM cap WHERE lens = 'general'")
case("view_results", lambda d: present(views.view_results(d.captures, d.runs), *_RESULT_COLS), f"SELECT {_RESULT} FROM cap")

# --- views ---------------------------------------------------------------------------------------------

_TODAY_COLS = ["brand_id", "engine", "run_id", "prev_run_id", "group_id", "n_repeats", "lens"]
_NULL_DELTAS = ", ".join(f"NULL::DOUBLE AS {m}_prev, NULL::DOUBLE AS {m}_delta" for m in SEVEN_METRICS)
_NULL_SPREAD = ", ".join(f"NULL::DOUBLE AS {m}_min, NULL::DOUBLE AS {m}_max" for m in SEVEN_METRICS)
_TODAY = f"""SELECT f.brand_id, f.engine, f.focus_run_id AS run_id, NULL::BIGINT AS prev_run_id, f.group_id, f.n_repeats, lens,
        {FOLD_SQL}, {_NULL_DELTAS}, {SPREAD_SQL}
    FROM metrics m JOIN focus_group f ON f.run_id = m.run_id
    GROUP BY f.brand_id, f.engine, f.focus_run_id, f.group_id, f.n_repeats, lens
    UNION ALL BY NAME
    SELECT t.brand_id, t.engine, t.run_id, o.prev_run_id, NULL::VARCHAR AS group_id, 1::BIGINT AS n_repeats, m.lens,
        {shown('m')}, {_PREV}, {_DELTA}, {_NULL_SPREAD} {_PAIR}
    WHERE (t.brand_id, t.engine) NOT IN (SELECT (brand_id, engine) FROM focus_group)"""
case("view_metrics_today", lambda d: present(views.view_metrics_today(d.metrics, d.runs, d.sentiment)),
     "SELECT t.*, s.summary AS sentiment_summary FROM today t LEFT JOIN sentiment s ON s.run_id = t.run_id AND s.lens = t.lens",
     {"today": _TODAY})
case("view_metrics_all", lambda d: present(views.view_metrics_all(d.metrics, d.runs, d.sentiment)),
     f"""SELECT p.*, n.n_runs, t.run_id, s.summary AS sentiment_summary
     FROM (SELECT brand_id, engine, lens, {FOLD_SQL} FROM {DONE_METRICS} GROUP BY ALL) p
     JOIN latest t ON t.brand_id = p.brand_id AND t.engine = p.engine
     JOIN (SELECT brand_id, engine, count(*) AS n_runs FROM done GROUP BY ALL) n ON n.brand_id = p.brand_id AND n.engine = p.engine
     LEFT JOIN sentiment s ON s.run_id = t.run_id AND s.lens = p.lens""")
case("view_timeseries", lambda d: present(views.view_timeseries(d.metrics, d.runs, "week")), WEEKLY_SQL)
_COMP = ["brand_id", "engine", "lens", "domain", "is_brand", "position", "share_sources", "share_citations",
         "appearances_sources", "appearances_citations", "avg_source_position", "avg_citation_position"]
_COMP_SQL = f"""brand_id, engine, lens, domain, is_brand,
    row_number() OVER (PARTITION BY brand_id, engine, lens ORDER BY {{order}}) AS position, {_SHARES},
    appearances_sources::BIGINT AS appearances_sources, appearances_citations::BIGINT AS appearances_citations,
    round(avg_source_position, 6) AS avg_source_position, round(avg_citation_position, 6) AS avg_citation_position"""
case("view_competitors", lambda d: present(views.view_competitors(d.stats, d.metrics, d.runs), *_COMP),
     f"""SELECT {_COMP_SQL.format(order=BY_SOURCES)} FROM (SELECT s.*, m.n_overviews FROM stats s JOIN latest t ON t.run_id = s.run_id
     JOIN metrics m ON m.run_id = s.run_id AND m.lens = s.lens) QUALIFY position <= 15""")
case("view_competitors_period", lambda d: present(views.view_competitors(d.stats, d.metrics, d.runs, "all", "citations", 10), *_COMP),
     f"""SELECT {_COMP_SQL.format(order=BY_CITATIONS)} FROM ({_PERIOD_BOARD}) JOIN
     (SELECT brand_id, engine, lens, sum(n_overviews) AS n_overviews FROM {DONE_METRICS} GROUP BY ALL) USING (brand_id, engine, lens)
     QUALIFY position <= 10""")
_PLACE = "CASE lens WHEN 'general' THEN 1 WHEN 'branded' THEN 2 WHEN 'comparative' THEN 3 ELSE 50 END::BIGINT AS place"
case("view_lens_breakdown", lambda d: present(views.view_lens_breakdown(d.metrics)),
     f"SELECT run_id, brand_id, engine, lens, {shown()}, {_PLACE} FROM metrics")
case("lens_order", lambda d: present(views.view_lens_breakdown(d.metrics), "run_id", "lens", "place"),
     f"SELECT run_id, lens, {_PLACE} FROM metrics")

_RATIO = {m: "TRUE" if not m.startswith("avg") else "FALSE" for m in SEVEN_METRICS}
_FLAT = {m: 0.005 if _RATIO[m] == "TRUE" else 0.05 for m in SEVEN_METRICS}
_DIRECTION = """CASE WHEN value IS NULL AND prev IS NULL THEN 'none' WHEN prev IS NULL THEN 'new' WHEN value IS NULL THEN 'no_data'
    WHEN abs(value - prev) < flat THEN 'flat' WHEN (value > prev) = is_ratio THEN 'improved' ELSE 'worse' END"""
_LONG = " UNION ALL ".join(
    f"""SELECT t.brand_id, t.engine, t.run_id, m.lens, '{m}' AS metric, {_RATIO[m]} AS is_ratio, m.{m} AS value, p.{m} AS prev,
    {_FLAT[m]} AS flat {_PAIR}""" for m in SEVEN_METRICS
)
case("delta_direction",
     lambda d: present(
         R.latest_vs_previous(d.metrics, d.runs).select(
             "run_id", "lens",
             *[delta_direction(F.col(m), F.col(f"{m}_prev"), F.lit(not m.startswith("avg")), F.lit(_FLAT[m])).alias(m) for m in SEVEN_METRICS])),
     "SELECT run_id, lens, " + ", ".join(f"max(direction) FILTER (metric = '{m}') AS {m}" for m in SEVEN_METRICS)
     + f" FROM (SELECT *, {_DIRECTION} AS direction FROM ({_LONG})) GROUP BY ALL")
_KPI = " UNION ALL ".join(
    f"""SELECT brand_id, engine, run_id, lens, '{m}' AS metric, {_RATIO[m]} AS is_ratio, n_repeats, {m} AS value, {m}_prev AS prev,
    {m}_delta AS delta, {m}_min AS low, {m}_max AS high, {_FLAT[m]} AS flat FROM today""" for m in SEVEN_METRICS
)
case("metric_polarity", lambda d: present(report.metrics_long(views.view_metrics_today(d.metrics, d.runs, d.sentiment))),
     f"""SELECT brand_id, engine, run_id, lens, metric, is_ratio, value, prev, delta, low, high,
     CASE WHEN n_repeats = 1 THEN {_DIRECTION} END AS direction FROM ({_KPI})""", {"today": _TODAY})


def _report(d: Derived):
    """Row counts and checksums of every report table: all of them are worked out."""
    tables = report.view_report_tables(d.runs, d.brands, d.metrics, d.sentiment, d.captures, d.stats, d.audits)
    tables.pop("audit")
    out = None
    for name, df in tables.items():
        key = "brand_id" if "brand_id" in df.columns else "run_id"
        part = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(key).cast("bigint").alias("key_sum"))
        out = part if out is None else out.unionByName(part)
    return present(out)


_FOCUS = "run_id IN (SELECT run_id FROM latest)"
_REPORT_PARTS = {
    "kpi": ("brand_id", f"(SELECT * FROM ({_KPI}) WHERE lens = 'all')"),
    "lenses": ("brand_id", f"(SELECT * FROM metrics WHERE {_FOCUS})"),
    "funnel": ("run_id", f"(SELECT * FROM ({_STAGES}) WHERE lens = 'all' AND {_FOCUS})"),
    "weekly": ("brand_id", f"(SELECT * FROM ({WEEKLY_SQL}) WHERE lens = 'all')"),
    "leaderboard": ("brand_id", f"""(SELECT * FROM stats WHERE lens = 'all' AND {_FOCUS}
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {BY_SOURCES}) <= 15)"""),
    "top_cited": ("brand_id", f"""(SELECT * FROM (SELECT * FROM stats WHERE lens = 'all' AND {_FOCUS}
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {BY_SOURCES}) <= 15) WHERE appearances_citations > 0
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY appearances_citations DESC, avg_citation_position, domain) <= 5)"""),
    "samples": ("run_id", f"""(SELECT * FROM (SELECT run_id, lens, trim(sentiment) AS phrase FROM cap WHERE trim(sentiment) <> '' AND {_FOCUS} GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY run_id, lens ORDER BY phrase) <= 4)"""),
    "outcomes": ("run_id", f"(SELECT DISTINCT run_id FROM outcomes WHERE {_FOCUS})"),
    "gaps": ("run_id", f"(SELECT * FROM outcomes WHERE outcome = 'absent' AND {_FOCUS})"),
}
case("view_report_tables", _report,
     " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, sum({k})::BIGINT AS key_sum FROM {t}" for n, (k, t) in _REPORT_PARTS.items()),
     {"today": _TODAY})

# the report over all done runs, one key a table, whole rows
_ALL_RUNS = f"""(SELECT p.*, t.run_id FROM (SELECT brand_id, engine, lens, {FOLD_SQL} FROM {DONE_METRICS} GROUP BY ALL) p
    JOIN latest t ON t.brand_id = p.brand_id AND t.engine = p.engine)"""
_NO_PAST = "NULL::DOUBLE AS prev, NULL::DOUBLE AS delta, NULL::DOUBLE AS low, NULL::DOUBLE AS high"
_REPORT_ALL = {
    "kpi": ((), " UNION ALL ".join(
        f"""SELECT brand_id, engine, run_id, lens, '{m}' AS metric, {_RATIO[m]} AS is_ratio, {m} AS value, {_NO_PAST},
        CASE WHEN {m} IS NULL THEN 'none' ELSE 'new' END AS direction FROM {_ALL_RUNS} WHERE lens = 'all'""" for m in SEVEN_METRICS)),
    "lenses": ((), f"SELECT *, {_PLACE} FROM {_ALL_RUNS}"),
    "funnel": ((), _STAGES.replace("FROM metrics", f"FROM {_ALL_RUNS} WHERE lens = 'all'")),
    "leaderboard": (_COMP, f"""SELECT {_COMP_SQL.format(order=BY_SOURCES)} FROM (SELECT * FROM ({_PERIOD_BOARD}) WHERE lens = 'all') JOIN
        (SELECT brand_id, engine, lens, sum(n_overviews) AS n_overviews FROM {DONE_METRICS} GROUP BY ALL) USING (brand_id, engine, lens)
        QUALIFY position <= 15"""),
}
for _table, (_columns, _sql) in _REPORT_ALL.items():
    case(
        f"view_report_{_table}_all",
        lambda d, t=_table, c=_columns: present(
            report.view_report_tables(d.runs, d.brands, d.metrics, d.sentiment, d.captures, d.stats, d.audits, "all")[t], *c),
        _sql,
    )
