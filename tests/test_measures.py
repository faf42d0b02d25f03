"""Hand-computed values of metrics, leaderboard and rollups, and invariants."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sightline.operators import leaderboard as L
from sightline.operators import metrics as M
from sightline.operators import outcomes as O
from sightline.operators import rollups as R
from sightline.operators import runs as S
from sightline.operators.captures import capture_links, match_links_to_targets
from sightline.plans.views import view_metrics_today
from sightline.sources.tables import open_runs
from sightline.schemas import BRANDS, LENS_SENTIMENT, METRICS, METRIC_COLUMNS, RESULTS, RUNS

T0 = dt.datetime(2026, 9, 1)


def run(run_id, at=T0, status="done", group=None, brand=1, engine="google"):
    return (run_id, brand, engine, at, status, 10, 0, 0, group)


def capture(i, run_id=1, lens="general", overview=True, src=(), cit=(), sources=(), citations=(), named=False, phrase=None):
    link = lambda r, d: (r, f"https://{d}/", d)
    return (
        i, run_id, f"q{i}", lens, T0 + dt.timedelta(minutes=i), None, None, overview,
        [link(r, d) for r, d in enumerate(sources, 1)], [link(r, d) for r, d in enumerate(citations, 1)],
        list(src), list(cit), named, phrase,
    )


def metric(run_id, lens="all", nq=10, nov=8, nis=4, nc=2, src=2.0, cit=1.0, mentions=6):
    div = lambda a, b: a / b if b and a is not None else None
    return (
        run_id, 1, "google", lens, nq, nov, nis, nc, mentions, div(nov, nq), div(nis, nov), div(nc, nov),
        div(nc, nis), div(mentions, nov), src, cit,
    )


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


@pytest.mark.parametrize(
    "captures, expected",
    [
        ([], dict(n_queries=0, n_overviews=0, overview_coverage=None, visibility_in_sources=None, avg_source_position=None)),
        ([capture(1, overview=False), capture(2, overview=False, src=[1], cit=[1])],
         dict(n_queries=2, n_overviews=0, overview_coverage=0.0, n_in_sources=0, visibility_in_sources=None, relative_citation=None)),
        ([capture(1, src=[1]), capture(2, overview=None, src=[2])],
         dict(n_overviews=1, n_in_sources=1, visibility_in_sources=1.0, avg_source_position=1.0)),
        ([capture(1), capture(2)], dict(visibility_in_sources=0.0, avg_source_position=None, relative_citation=None)),
        ([capture(1, src=[2]), capture(2, src=[3])], dict(avg_source_position=2.5, n_cited=0)),
        ([capture(1, src=[4, 2], cit=[3, 1]), capture(2, src=[5], cit=[6])], dict(avg_source_position=3.5, avg_citation_position=3.5)),
        ([capture(1, src=[3], cit=[2]), capture(2, src=[3], named=True)], dict(relative_citation=0.5, brand_mention_rate=0.5)),
    ],
)
def test_run_metrics_of_a_scope(spark, captures, expected):
    runs = spark.createDataFrame([run(1)], RUNS)
    got = rows_of(M.run_metrics(spark.createDataFrame(captures, RESULTS), runs), "lens")[("all",)]
    assert {k: got[k] for k in expected} == expected


def test_all_row_is_the_sum_of_the_lenses(spark):
    caps = [capture(i, lens=lens, src=[i], named=i % 2 == 0) for i, lens in enumerate(["general", "branded", "odd"] * 4, 1)]
    got = rows_of(M.run_metrics(spark.createDataFrame(caps, RESULTS), spark.createDataFrame([run(1), run(2)], RUNS)), "run_id", "lens")
    assert set(k for k in got if k[0] == 2) == {(2, "all")}
    for c in ("n_queries", "n_in_sources", "n_brand_mentions"):
        assert got[(1, "all")][c] == sum(v[c] for k, v in got.items() if k[0] == 1 and k[1] != "all")


def test_leaderboard(spark):
    caps = [
        capture(1, sources=["sleepfoundation.org", "acme.com", "casper.com"]),
        capture(2, sources=["wirecutter.com", "casper.com", "acme.com"]),
        capture(3, sources=["reddit.com", "casper.com"]),
        capture(4, overview=False, sources=["casper.com"]),
        capture(5, lens="branded", sources=["x.com", "casper.com", "y.com", "www.casper.com"], citations=["x.com"]),
    ]
    brands = spark.createDataFrame([(1, "Acme", "acme.com/path", T0)], BRANDS)
    runs = spark.createDataFrame([run(1)], RUNS)
    board = L.domain_leaderboard(spark.createDataFrame(caps, RESULTS), runs, brands)
    got = rows_of(L.leaderboard_top(board), "lens", "domain")
    casper, acme = got[("general", "casper.com")], got[("general", "acme.com")]
    assert (casper["appearances_sources"], casper["avg_source_position"], casper["position"]) == (3, pytest.approx(7 / 3), 1)
    assert (acme["appearances_sources"], acme["avg_source_position"], acme["position"], acme["is_brand"]) == (2, 2.5, 2, True)
    assert got[("branded", "casper.com")]["sum_min_source_rank"] == 2.0
    assert got[("all", "casper.com")]["appearances_sources"] == 4
    assert got[("all", "x.com")]["appearances_citations"] == 1
    assert L.leaderboard_top(board, k=0).count() == board.count()
    with pytest.raises(ValueError):
        L.leaderboard_top(board, "votes")


def _metric_tables(spark, metrics, runs):
    return spark.createDataFrame(metrics, METRICS), spark.createDataFrame(runs, RUNS)


def test_period_weights_positions_and_skips_running(spark):
    m, r = _metric_tables(
        spark,
        [metric(1, nis=1, src=2.0, nc=2, cit=1.0), metric(2, nis=3, src=4.0, nc=4, cit=3.0), metric(3, nis=9, src=9.0)],
        [run(1), run(2), run(3, status="running")],
    )
    got = R.period_rollup(m, r).collect()[0]
    assert got["avg_source_position"] == 3.5 and got["avg_citation_position"] == pytest.approx(14 / 6)


def test_legacy_rows_leave_both_sides_of_the_mention_rate(spark):
    m, r = _metric_tables(spark, [metric(1, nov=8, mentions=None), metric(2, nov=10, mentions=5)], [run(1), run(2)])
    got = R.period_rollup(m, r).collect()[0]
    assert (got["n_overviews"], got["n_brand_mentions"], got["brand_mention_rate"]) == (18, 5, 0.5)


GROUP = [metric(1), metric(2, nov=10, nis=6, nc=4, src=3.0, cit=2.0, mentions=8)]


def test_repeat_group(spark):
    m, r = _metric_tables(spark, GROUP, [run(1, group="g"), run(2, group="g"), run(3, group="solo")])
    got = R.group_rollup(m, r).collect()
    assert len(got) == 1
    g, s = got[0], R.group_spread(m, r).collect()[0]
    assert (g["n_repeats"], g["n_queries"], g["n_overviews"], g["overview_coverage"]) == (2, 20, 18, 0.9)
    assert g["avg_source_position"] == pytest.approx(2.6) and g["brand_mention_rate"] == pytest.approx(14 / 18)
    assert (s["overview_coverage_min"], s["overview_coverage_max"]) == (0.8, 1.0)
    assert (s["avg_source_position_min"], s["avg_source_position_max"]) == (2.0, 3.0)
    none = spark.createDataFrame([], LENS_SENTIMENT)
    grouped_runs = spark.createDataFrame([run(1, group="g"), run(2, group="g")], RUNS)
    today = view_metrics_today(m, grouped_runs, none).collect()[0]
    assert today["run_id"] == 2 and today["overview_coverage_delta"] is None and today["overview_coverage_min"] == 0.8


def test_week_folds_runs(spark):
    m, r = _metric_tables(spark, GROUP, [run(1), run(2, at=T0 + dt.timedelta(days=2))])
    got = R.weekly_rollup(m, r).collect()
    assert len(got) == 1 and (got[0]["n_runs"], got[0]["week"], got[0]["n_overviews"]) == (2, "2026-W36", 18)


def test_a_run_stays_in_the_week_of_its_own_offset(spark):
    asked = [(1, "google", f"2026-09-{d}", None) for d in ("06T23:00:00-05:00", "07T01:00:00+09:00", "07 12:00:00")] + [(1, "google", "soon", None)]
    runs = open_runs(spark.createDataFrame([run(1)], RUNS), spark.createDataFrame(asked, "brand_id LONG, engine STRING, run_at STRING, group_id STRING"))
    days = [r["run_day"] and r["run_day"].isoformat() for r in runs.orderBy("run_at", "status").where("status = 'running' AND run_at IS NOT NULL").collect()]
    assert sorted(days) == ["2026-09-06", "2026-09-07", "2026-09-07"]
    assert runs.where("run_day IS NULL").count() == 2
    done = runs.where("run_at IS NOT NULL").withColumn("status", F.lit("done"))
    m = done.select("run_id", "brand_id", "engine", F.lit("all").alias("lens"), *[F.lit(1).cast("bigint").alias(c) for c in METRIC_COLUMNS])
    weeks = {r["week"]: r["n_runs"] for r in R.weekly_rollup(m, done.where("run_day IS NOT NULL")).collect()}
    assert weeks == {"2026-W36": 1, "2026-W37": 2}


def test_period_of_one_run_is_that_run(spark):
    m, r = _metric_tables(spark, GROUP[:1], [run(1)])
    a, b = R.period_rollup(m, r).collect()[0], m.collect()[0]
    assert [a[c] for c in METRIC_COLUMNS] == [b[c] for c in METRIC_COLUMNS]


def test_previous_run_is_looked_back_not_the_lens(spark):
    runs = [run(1), run(2, at=T0 + dt.timedelta(days=1)), run(3, at=T0 + dt.timedelta(days=1), status="failed"), run(4, at=T0 + dt.timedelta(days=3))]
    m, r = _metric_tables(spark, [metric(1, "general"), metric(2), metric(4, "general"), metric(4, nov=9)], runs)
    got = rows_of(R.metric_deltas(m, r), "lens")
    assert got[("all",)]["prev_run_id"] == 2 and got[("all",)]["overview_coverage_delta"] == pytest.approx(0.1)
    assert got[("general",)]["overview_coverage_prev"] is None and got[("general",)]["overview_coverage_delta"] is None
    prev = rows_of(S.previous_completed_run(r), "run_id")
    assert [prev[(i,)]["prev_run_id"] for i in (1, 2, 4)] == [None, 1, 2]


def test_previous_run_inside_a_day_and_across_days(spark):
    rows = [run(i, at=T0 + dt.timedelta(hours=h)) for i, h in ((5, 0), (3, 0), (9, 1), (2, 30), (7, 200), (8, 200))]
    got = rows_of(S.previous_completed_run(spark.createDataFrame(rows, RUNS)), "run_id")
    assert {k[0]: v["prev_run_id"] for k, v in got.items()} == {3: None, 5: 3, 9: 5, 2: 9, 7: 2, 8: 7}


def test_engine_matrix_keeps_engines_without_done_runs(spark):
    m, r = _metric_tables(spark, [metric(1)], [run(1), run(2, engine="gemini", status="running")])
    got = rows_of(R.engine_matrix(m, r), "engine")
    assert got[("gemini",)]["n_runs"] == 0 and got[("gemini",)]["n_queries"] is None
    assert got[("google",)]["n_runs"] == 1


def test_samples_are_newest_and_different(spark):
    caps = [capture(i, phrase=p) for i, p in enumerate(["a", "b", " a ", "c", "d", "  ", "e", "b"])]
    got = O.sentiment_samples(spark.createDataFrame(caps, RESULTS)).orderBy("position").collect()
    assert [(r["phrase"], r["query"]) for r in got] == [("b", "q7"), ("e", "q6"), ("d", "q4"), ("c", "q3")]


def test_links_match_many_targets_by_prefix(spark):
    cap = list(capture(1))
    cap[8] = [(1, "https://github.com/u/r/x", "github.com"), (2, "https://github.com/u2", "github.com"), (3, "https://t.co/1", "github.com")]
    brands = [(1, "a", "github.com", T0), (2, "b", "github.com/u", T0), (3, "c", "https://GitHub.com/U/r", T0), (4, "d", "x.com", T0)]
    links = capture_links(spark.createDataFrame([tuple(cap)], RESULTS))
    got = rows_of(match_links_to_targets(links, spark.createDataFrame(brands, BRANDS)), "brand_id")
    assert {k[0]: v["ranks"] for k, v in got.items()} == {1: [1, 2, 3], 2: [1], 3: [1]}


def test_salted_join_equals_plain_join(spark):
    from sightline.operators.skew import salted_join

    big = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        a = salted_join(big, small, ["k"], ["id"], how).select("k", "id", "v")
        b = big.join(small, "k", how).select("k", "id", "v")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_of_weeks_equals_the_rollup_after_late_files(spark):
    from conformance.cases_streams import _to_latest
    from conformance.derived import Derived
    from sightline.operators.metrics import run_metrics
    from sightline.operators.rollups import weekly_rollup
    from sightline.streaming import stream_weekly_trend

    d = Derived(spark, "/root/testdata/sf0.001")
    keys = ["brand_id", "engine", "lens", "week", "monday"]
    got = _to_latest(d, d.captures, "weeks", F.col("id"), lambda s: stream_weekly_trend(s, d.runs), keys)
    want = weekly_rollup(run_metrics(d.captures, d.runs).where("n_queries > 0"), d.runs)
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
    rows = lambda df: sorted(map(str, df.select(*rounded).collect()))
    assert rows(got) == rows(want) and len(rows(want)) > 10
