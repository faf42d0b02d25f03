"""Array files of any size, tables in generations, one scan for both aggregates, pruned keys."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conformance.derived import Derived
from sightline.operators.leaderboard import domain_leaderboard
from sightline.operators.metrics import run_metrics
from sightline.plans.aggregate import aggregate_runs, scope_states
from sightline.schemas import DOMAIN_STATS, METRICS, RESULTS
from sightline.session import scratch_path
from sightline.sources import tables as T
from sightline.sources.arrays import read_array

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 4:
        return (rng.choice(["a,b", '"q",[x', "\\", '\\",{', "}],[", "é,中", '\n,"']), rng.randint(-5, 5), None, "x" * rng.randrange(30) + ",")[kind]
    if kind < 6:
        return {f"k{i}": _value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]


def _read(spark, path):
    rows = read_array(spark, str(path)).select(F.regexp_extract("file", "[^/]*$", 0).alias("f"), "index", F.to_json("raw").alias("r")).collect()
    found: dict = {}
    for r in rows:
        assert r["index"] not in found.setdefault(r["f"], {})
        found[r["f"]][r["index"]] = None if r["r"] is None else json.loads(r["r"])
    return found


def test_elements_over_many_splits(spark, tmp_path, small_splits):
    rng, want = random.Random(2), {}
    for n in range(12):
        items = [_value(rng) for _ in range(rng.choice((0, 1, 3, 60, 200)))]
        text = json.dumps(items, ensure_ascii=bool(n % 2), indent=rng.choice((None, 1)))
        (tmp_path / f"f{n}.json").write_text(rng.choice(("", "\n ", "﻿")) + text + rng.choice(("", "\n")))
        want[f"f{n}.json"] = dict(enumerate(items))
    assert _read(spark, tmp_path) == {f: x for f, x in want.items() if x}


def test_files_that_are_no_array_and_broken_elements_are_reported(spark, tmp_path):
    texts = {
        "object": '{"a": [1, 2], "b": "x,y"}', "word": "hello, you", "broken": '[{"a": 1}, {"b": nope}, {"c": 3}]', "open": '[{"a": 1}, {"b": "no end, {"c": 3}, 5]',
        "after": '[1, 2] x', "cut": '[{"a": 1}, {"b": [2, 3',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "nothing").write_text("")
    assert _read(spark, tmp_path) == {
        "object": {-1: {"a": [1, 2], "b": "x,y"}}, "word": {-1: None}, "broken": {0: {"a": 1}, 1: None, 2: {"c": 3}}, "open": {0: {"a": 1}, 1: None},
        "after": {0: 1, 1: None}, "cut": {0: {"a": 1}, 1: None},
    }


def test_an_element_beyond_the_largest_is_one_row(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text(json.dumps([1, ["x,y"] * 2000, {"b": 2}, "z" * 400]))
    rows = read_array(spark, str(tmp_path), largest=500).select("index", F.to_json("raw").alias("r")).orderBy("index").collect()
    assert [(r["index"], r["r"] and json.loads(r["r"])) for r in rows] == [(0, 1), (1, None), (2, {"b": 2}), (3, "z" * 400)]


def test_a_large_file_gives_all_its_captures(spark, tmp_path):
    body = json.dumps({"query": "what, \"is\" [best]?", "sources": [{"rank": i, "url": f"https://a{i}.example/p,q"} for i in range(9)]})
    n, at = 25_000, tmp_path / "large.json"
    with at.open("w") as f:
        f.write("[" + ",".join(f'{{"n": {i}, "of": {body}}}' for i in range(n)) + "]")
    got = read_array(spark, str(at)).select("index", F.try_variant_get("raw", "$.n", "int").alias("n"), F.try_variant_get("raw", "$.of.sources[8].rank", "int").alias("r"))
    assert got.where("index = n AND r = 8").count() == got.count() == n


METRIC = {"brand_id": 1, "engine": "google", "lens": "all", "n_queries": 1}


def _rows(spark, items, schema=METRICS):
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple({**METRIC, **x}.get(c) for c in names) for x in items], schema)


def test_newest_generation_counts_and_an_emptied_run_reads_empty(spark):
    path = scratch_path(spark, "generations")
    assert T.read_runs(spark, path, METRICS).count() == 0
    T.rebuild_metrics(_rows(spark, [{"run_id": r, "n_queries": 1} for r in (1, 1, 2, 3)]), path)
    T.rebuild_metrics(_rows(spark, [{"run_id": 1, "n_queries": 2}]), path, spark.createDataFrame([(1,), (2,)], "run_id LONG"))
    read = lambda p=path: Counter((r["run_id"], r["n_queries"]) for r in T.read_runs(spark, p, METRICS).collect())
    assert read() == {(1, 2): 1, (3, 1): 1}
    # rows that no state names, as a rebuild leaves that was cut short
    _rows(spark, [{"run_id": 3, "n_queries": 9}]).withColumn("batch", F.lit("lost")).write.mode("append").parquet(f"{path}/rows/generation=9")
    assert read() == {(1, 2): 1, (3, 1): 1}
    T.rebuild_metrics(_rows(spark, [{"run_id": 2, "n_queries": 3}]), path)
    to = scratch_path(spark, "compacted")
    T.compact_runs(spark, path, METRICS, to)
    assert read() == read(to) == {(1, 2): 1, (2, 3): 1, (3, 1): 1}
    T.rebuild_metrics(_rows(spark, []), to, spark.createDataFrame([(1,), (2,), (3,)], "run_id LONG"))
    assert read(to) == {}


def _scans(df, name):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(name in line for line in plan.splitlines() if "Relation" in line)


def test_aggregate_runs_scans_captures_once_and_equals_both_operators(spark):
    d = Derived(spark, SF)
    path = scratch_path(spark, "captures")
    d.captures.write.parquet(path)
    captures = spark.read.parquet(path)
    assert _scans(scope_states(captures), "overview_present") == 1
    out = scratch_path(spark, "both")
    metrics, board = aggregate_runs(captures, d.runs, d.brands, f"{out}/m", f"{out}/s")
    for got, stored, want in (
        (metrics, T.read_runs(spark, f"{out}/m", METRICS), run_metrics(captures, d.runs)),
        (board, T.read_runs(spark, f"{out}/s", DOMAIN_STATS), domain_leaderboard(captures, d.runs, d.brands)),
    ):
        names = want.columns
        expected = Counter(map(tuple, want.collect()))
        assert Counter(map(tuple, got.select(*names).collect())) == Counter(map(tuple, stored.select(*names).collect())) == expected


def test_keys_are_read_from_the_folders_of_the_batch_only(spark):
    path = scratch_path(spark, "results")
    captures = Derived(spark, SF).captures.withColumn("engine", F.lit("x"))
    T.write_captures(captures.select(*spark.createDataFrame([], RESULTS).columns), path)
    one = captures.select("run_id").distinct().limit(1)
    keys = T.stored_keys(spark, path, RESULTS, one)
    folder = one.select(T.run_bucket("run_id")).first()[0]
    plan = keys._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") :].split("]")[0]
    assert f"= {folder}" in filters or f"IN ({folder})" in filters
    want = captures.where(T.run_bucket("run_id") == folder).count()
    assert keys.count() == want > 0
