"""Validation, ingest, questions, scoring and tables on small literals."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import captures as C
from sightline.operators import questions as Q
from sightline.operators import scoring as S
from sightline.operators import validation as V
from sightline.schemas import LENS_SENTIMENT, RESULTS, RUNS
from sightline.session import scratch_path
from sightline.sources import tables as T
from sightline.sources.arrays import read_array
from sightline.streaming import ingest_batch, stream_captures

GOOD = {
    "query": "q", "lens": "general", "engine": "google", "captured_at": "2026-06-18T20:15:30Z",
    "overview_present": True, "brand_in_answer_text": False,
}
LINK = {"rank": 1, "url": "https://a.com/x", "domain": "a.com"}


def quarantine(spark, objects):
    rows = [(1, i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)]
    df = spark.createDataFrame(rows, "run_id LONG, index LONG, body STRING")
    valid, errors = V.quarantine(df.select("run_id", "index", F.try_parse_json("body").alias("raw")))
    return {r["index"]: r for r in valid.collect()}, {r["index"]: r for r in errors.collect()}


def test_lax_coercion(spark):
    objects = [
        {**GOOD, "overview_present": "yes", "sources": [{**LINK, "rank": "1"}, {**LINK, "rank": 2.0}, {**LINK, "rank": True}], "target_source_ranks": ["1", 3.0]},
        {**GOOD, "overview_present": "Off", "captured_at": 0},
        {**GOOD, "overview_present": 1.0, "captured_at": "2026-06-18T20:15:30+03:00", "sentiment": None},
        {**GOOD, "captured_at": 1_700_000_000_000},
        {**GOOD, "query": "", "captured_at": "2026-06-18", "unknown": 1},
    ]
    valid, errors = quarantine(spark, objects)
    assert errors == {}
    assert [x["rank"] for x in valid[0]["sources"]] == [1, 2, 1] and valid[0]["target_source_ranks"] == [1, 3]
    assert [valid[i]["overview_present"] for i in range(3)] == [True, False, True]
    utc = lambda t: t.replace(tzinfo=None)
    assert utc(valid[1]["captured_at"]) == dt.datetime(1970, 1, 1)
    assert utc(valid[2]["captured_at"]) == dt.datetime(2026, 6, 18, 17, 15, 30)
    assert valid[3]["captured_at"].year == 2023 and valid[4]["query"] == ""


@pytest.mark.parametrize(
    "fault, field, text",
    [
        ({"query": None}, "query", "valid string"), ({"query": 5}, "query", "valid string"),
        ({"lens": "General"}, "lens", "'general', 'branded' or 'comparative'"),
        ({"overview_present": "maybe"}, "overview_present", "boolean"), ({"overview_present": 2}, "overview_present", "boolean"),
        ({"captured_at": "soon"}, "captured_at", "datetime"),
        ({"sources": "notalist"}, "sources", "valid list"), ({"citations": None}, "citations", "valid list"),
        ({"sources": [LINK, 5]}, "sources.1", "valid dictionary"),
        ({"sources": [{**LINK, "rank": 1.5}]}, "sources.0.rank", "fractional"),
        ({"sources": [{**LINK, "rank": "abc"}]}, "sources.0.rank", "unable to parse"),
        ({"sources": [{**LINK, "rank": False}]}, "sources.0.rank", "greater than 0"),
        ({"sources": [{**LINK, "url": 123}]}, "sources.0.url", "valid string"),
        ({"sources": [{"rank": 1, "url": "u"}]}, "sources.0.domain", "Field required"),
        ({"target_source_ranks": [1, "oops", 3]}, "target_source_ranks.1", "unable to parse"),
        ({"citations": [LINK]}, "", "absent from sources: ['a.com']"),
        ({"sources": [LINK], "citations": [LINK], "target_citation_ranks": [1]}, "", "requires non-empty"),
        ({"sources": [LINK], "target_source_ranks": [7, 1]}, "", "[7] with only 1 entries"),
    ],
)
def test_first_error(spark, fault, field, text):
    _, errors = quarantine(spark, [{**GOOD, **fault}])
    assert errors[0]["field"] == field and text in errors[0]["msg"]


def test_bad_rows_do_not_stop_the_batch(spark):
    objects = [GOOD, {}, "[1]", "not json", {**GOOD, "query": "other"}, {"query": "only"}]
    valid, errors = quarantine(spark, objects)
    assert set(valid) == {0, 4} and set(errors) == {1, 2, 3, 5}
    assert errors[1]["field"] == "query" and errors[1]["msg"] == "Field required"
    assert errors[5]["query"] == "only" and errors[5]["field"] == "lens"
    assert errors[2]["field"] == "" and "QueryCapture" in errors[3]["msg"]


def test_ingest_is_idempotent_and_streams_alike(spark):
    bodies = [(1, i, json.dumps({**GOOD, "query": f"q{i % 4}"})) for i in range(6)] + [(2, 9, "{}")]
    df = spark.createDataFrame(bodies, "run_id LONG, index LONG, body STRING")
    raw = df.select("run_id", "index", F.try_parse_json("body").alias("raw"))
    out = scratch_path(spark, "t")
    for batch_no in (0, 1, 1):
        ingest_batch(raw, out, batch_no)
    kept = T.read_or_empty(spark, f"{out}/results", RESULTS)
    assert sorted(r["query"] for r in kept.collect()) == ["q0", "q1", "q2", "q3"]
    fates = spark.read.parquet(f"{out}/outcomes").groupBy("batch_no", "outcome").count().collect()
    assert {(r["batch_no"], r["outcome"]): r["count"] for r in fates} == {
        (0, "ok"): 4, (0, "skipped"): 2, (0, "error"): 1, (1, "skipped"): 6, (1, "error"): 1}
    root = scratch_path(spark, "s")
    df.write.parquet(f"{root}/in")
    stream_captures(spark, f"{root}/in", f"{root}/out", f"{root}/state").awaitTermination()
    streamed = T.read_or_empty(spark, f"{root}/out/results", RESULTS)
    assert sorted(r["query"] for r in streamed.collect()) == ["q0", "q1", "q2", "q3"]


def test_read_captures_gives_positions_and_flags_files_that_are_no_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([GOOD, {**GOOD, "lens": "x"}], indent=2))
    (tmp_path / "b.json").write_text(json.dumps(GOOD))
    raw = T.read_captures(spark, str(tmp_path))
    assert sorted(r["index"] for r in raw.select("index").collect()) == [-1, 0, 1]


def test_assemble_and_fold(spark):
    links = [(1, "sources", 3, "https://b.com"), (1, "sources", 1, "/url?q=https%3A%2F%2Fa.com%2F"), (1, "citations", 1, "https://c.com"),
             (1, "citations", 2, "https://c.com/2"), (1, "sources", 2, "https://yabs.yandex.ru/count/1")]
    df = spark.createDataFrame(links, "capture_id INT, channel STRING, position INT, url STRING")
    answers = spark.createDataFrame([(1,), (2,)], "capture_id INT")
    got = {r["capture_id"]: r for r in C.fold_citations_into_sources(C.assemble_captures(answers, C.drop_ad_links(df))).collect()}
    assert [(x["rank"], x["domain"]) for x in got[1]["sources"]] == [(1, "a.com"), (2, "b.com"), (3, "c.com")]
    assert [x["rank"] for x in got[1]["citations"]] == [1, 2] and got[2]["sources"] == []


def test_question_set(spark):
    base = {"lens": "general", "segment": "s", "signal": "g", "source_url": "u"}
    items = [
        {**base, "query": " best gpu? "}, {**base, "query": "Best  GPU"}, {**base, "query": "is Acme good"},
        {**base, "query": "acme price", "lens": "branded"}, {**base, "query": "price", "lens": "branded"},
        {**base, "query": "x", "signal": "  "}, {**base, "query": "acme vs b", "lens": "comparative"}, {**base, "query": "y", "lens": "promo"},
    ]
    raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "index LONG, body STRING").select(
        "index", F.try_parse_json("body").alias("raw"))
    kept, errors, counts = Q.build_question_set(raw, F.lit("Acme"))
    assert [r["query"] for r in kept.orderBy("index").collect()] == ["best gpu?", "acme price", "acme vs b"]
    assert [(r["index"], r["field"]) for r in errors.orderBy("index").collect()] == [(2, "lens"), (4, "lens"), (5, "signal"), (7, "lens")]
    assert counts.collect()[0].asDict() == {"written": 3, "general": 1, "branded": 1, "comparative": 1, "dropped_dups": 1, "errors": 4}


def test_near_duplicates_equal_brute_force_with_hot_words_split(spark):
    rng = random.Random(7)
    words = [f"w{'x' * (i % 5)}{i}" for i in range(12)]
    texts = [" ".join(rng.sample(words, rng.randint(1, 6))) for _ in range(120)] + ["hot topic number " + str(i % 9) for i in range(60)] + ["", "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "index LONG, query STRING")
    sets = [frozenset(t.split()) - {"!"} for t in texts]
    for threshold in (0.5, 0.8, 1.0):
        want = [i for i, a in enumerate(sets) if not any(a and b and len(a & b) >= threshold * len(a | b) - 1e-9 for b in sets[:i])]
        for hot in (5, 50_000):
            got = Q.near_duplicate_questions(df, threshold, hot)
            assert sorted(r["index"] for r in got.collect()) == want


def test_near_duplicates_stay_within_their_set(spark):
    rows = [(1, 0, "best red shoes"), (1, 1, "shoes red best"), (2, 1, "best red shoes"), (None, 3, "red best shoes"), (None, 4, "shoes red best"), (2, 5, "!")]
    df = spark.createDataFrame(rows, "set LONG, index LONG, query STRING")
    got = Q.near_duplicate_questions(df, keys=["set"])
    assert got.columns == df.columns
    assert sorted((r["set"] or 0, r["index"]) for r in got.collect()) == [(0, 3), (1, 0), (2, 1), (2, 5)]


def test_near_duplicates_of_every_kind_of_key_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "RARE_ROWS", 4)
    monkeypatch.setattr(Q, "PAIRED_WORDS", 9)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(1, 18))) for _ in range(250)]
    texts += [" ".join(rng.sample(t.split(), max(1, len(t.split()) - 1))) + rng.choice(["", " new"]) for t in rng.sample(texts, 60)]
    rows = [(i % 2, i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "set LONG, index LONG, query STRING")
    for threshold in (0.2, 0.6, 0.9):
        want = [
            (s, i) for s, i, t in rows
            if not any(r == s and j < i and len(set(t.split()) & set(u.split())) >= threshold * len(set(t.split()) | set(u.split())) - 1e-9 for r, j, u in rows)
        ]
        got = Q.near_duplicate_questions(df, threshold, 20, ["set"])
        assert sorted((r["set"], r["index"]) for r in got.collect()) == sorted(want)


def test_near_duplicates_of_a_frequent_long_word_are_not_all_paired(spark):
    # every question holds the two longest words; before, each met all earlier ones
    texts = [f"internationalization considerations a{i} b{i % 97} c{i % 89} d{i % 83} e{i % 79} f{i % 73}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[5] + " please", texts[5] + " now"])), "index LONG, query STRING")
    firsts = df.select(F.lit(0).alias("set"), "index", F.sort_array(F.split("query", " ")).alias("words"))
    pairs = Q._candidates(Q._ordered_words(firsts, Q.RARE_ROWS), 0.8, Q.HOT_TOKEN_ROWS).select("later", "earlier").distinct().collect()
    assert {(600, 5), (601, 5)} <= set(map(tuple, pairs)) and len(pairs) < 600
    assert sorted(r["index"] for r in Q.near_duplicate_questions(df).collect()) == list(range(600))


def test_balance_spreads_over_segments(spark):
    rows = [(i, "general", "s0" if i < 6 else f"s{i}") for i in range(9)] + [(100, "branded", "b")]
    df = spark.createDataFrame(rows, "index LONG, lens STRING, segment STRING")
    got = Q.balance_questions(df, {"general": 5, "branded": 2}).collect()
    assert sorted(r["index"] for r in got) == [0, 1, 6, 7, 8, 100]


def test_scoring(spark):
    link = lambda r, d: (r, f"https://{d}/p", d)
    base = (1, 1, "q", "general", dt.datetime(2026, 1, 1), "text", None, True)
    truth_links = [link(1, "a.com"), link(2, "a.com"), link(3, "b.com"), link(4, "c.com")]
    truth = spark.createDataFrame([(*base, truth_links, [], [1, 2], [], False, None)], RESULTS).withColumn("fixture_id", F.lit(1))
    cand_links = [link(1, "a.com"), link(2, "b.com"), (3, "https://z.org/new/?x", "Z.org")]
    cand = spark.createDataFrame([(*base, cand_links, [], [1, 2], [], False, "phrase")], RESULTS).withColumns(
        {"fixture_id": F.lit(1), "candidate_id": F.lit("m"), "engine": F.lit("google")})
    corpus = spark.createDataFrame([(1, "https://a.com/p https://b.com/p")], "fixture_id INT, text STRING")
    got = S.score_extraction(cand, truth, corpus).collect()[0]
    assert (got["sources_precision"], got["sources_recall"], got["sources_f1"]) == (0.667, 0.5, 0.571)
    assert (got["citations_precision"], got["citations_recall"], got["citations_f1"]) == (1.0, 1.0, 1.0)
    assert got["n_fabricated"] == 1 and got["domain_field_accuracy"] == 1.0 and not got["sources_exact_order"]
    gates = S.score_gates(S.score_extraction(cand, truth, corpus)).collect()[0]
    assert gates["failed_gates"] == ["sent-null", "no-fabrication"]
    joined = S.score_multiset_join(cand, truth).where("channel = 'sources'").agg(F.sum("n_common")).collect()[0][0]
    assert joined == 2


def test_upserts_and_patches(spark):
    at = dt.datetime(2026, 1, 1)
    current = spark.createDataFrame([(1, "all", "old", at), (1, "general", "keep", at)], LENS_SENTIMENT)
    news = spark.createDataFrame([(1, "all", None, at), (1, "promo", "x", at), (2, "branded", "new", at)], LENS_SENTIMENT)
    got = {(r["run_id"], r["lens"]): r["summary"] for r in T.upsert_lens_sentiment(current, news).collect()}
    assert got == {(1, "all"): None, (1, "general"): "keep", (2, "branded"): "new"}
    runs = spark.createDataFrame([(1, 1, "g", at, "running", 5, 2, None, None)], RUNS)
    patch = spark.createDataFrame([(1, None, 0, "done")], "run_id LONG, n_ok INT, n_failed INT, status STRING")
    row = T.update_run_counts(runs, patch).collect()[0]
    assert (row["n_queries"], row["n_ok"], row["n_failed"], row["status"]) == (5, 2, 0, "done")
    brands = spark.createDataFrame([(7, "Acme", "acme.com", at)], "brand_id LONG, name STRING, domain STRING, created_at TIMESTAMP")
    asked = spark.createDataFrame([(" ACME ", "https://www.acme.com/"), ("Acme", "acme.com/x"), ("acme", "acme.com/X/")], "name STRING, domain STRING")
    once = T.upsert_brands(brands, asked)
    assert once.count() == 2
    twice = T.upsert_brands(once, asked)
    assert sorted(r["brand_id"] for r in once.collect()) == sorted(r["brand_id"] for r in twice.collect())


def test_usual_form_gives_what_the_field_rules_give(spark):
    odd = [
        {}, {"sources": [None]}, {"sources": None}, {"sources": [{"rank": 1, "url": "u"}]}, {"sources": [{"rank": None, "url": "u", "domain": "a.com"}]},
        {"sources": [{"rank": "1.0", "url": "u", "domain": "a.com"}, {"rank": " 2", "url": "u", "domain": "b.com"}]},
        {"sources": [{"rank": 1, "url": "u", "domain": "a.com"}, {"rank": "x", "url": "u", "domain": "b.com"}]},
        {"sources": [{"rank": 1, "url": "u", "domain": "a.com", "title": "t"}]}, {"sources": [[1]]}, {"sources": []}, {"extra": 1},
        {"target_source_ranks": [1, None]}, {"target_source_ranks": ["1"]}, {"target_source_ranks": [0]}, {"target_citation_ranks": [1, 2]},
        {"overview_present": "YES"}, {"overview_present": 1}, {"overview_present": "maybe"}, {"overview_present": None}, {"brand_in_answer_text": "f"},
        {"query": None}, {"query": 5}, {"query": ""}, {"lens": "General"}, {"sentiment": None}, {"sentiment": 1}, {"answer_text_md": None},
        {"captured_at": "2026-01-02"}, {"captured_at": "2026-13-02T00:00:00Z"}, {"captured_at": "2026-01-02T03:04:05+02:00"}, {"captured_at": 1767225600},
        {"captured_at": "1767225600"}, {"captured_at": " 2026-01-02T03:04Z "}, {"citations": [{"rank": 1, "url": "u", "domain": "z.org"}]},
    ]
    objects = [json.dumps({**GOOD, **o}) for o in odd]
    objects += [json.dumps({k: v for k, v in GOOD.items() if k != gone}) for gone in GOOD] + ["[]", "3", "null", "{", "{}"]
    raw = spark.createDataFrame(list(enumerate(objects)), "index LONG, body STRING").select("index", F.try_parse_json("body").alias("raw"))
    refusal = F.struct(F.lit("").alias("field"), F.lit("Input should be a valid dictionary or instance of QueryCapture").alias("msg"))
    want = V.read_fields(raw, V.FIELDS, refusal).orderBy("index").collect()
    assert V.v_coerce(raw).orderBy("index").collect() == want
    plain = raw.select("index", V._usual(F.col("raw")).alias("u")).where("u IS NOT NULL").count()
    assert plain >= 20  # the usual form is met by most of these, also by those with a wrong value


def test_stored_quarantine_types_no_row_twice(spark, tmp_path):
    raw = spark.createDataFrame(
        [(1, i, json.dumps(o)) for i, o in enumerate([GOOD, {**GOOD, "lens": "x"}, {**GOOD, "query": "r"}])], "run_id LONG, index LONG, body STRING"
    ).select("run_id", "index", F.try_parse_json("body").alias("raw"))
    valid, errors = V.quarantine(raw, str(tmp_path / "checked"), ["query", "lens"])
    assert valid.columns == ["run_id", "index", "query", "lens"]
    assert "raw" not in valid._jdf.queryExecution().optimizedPlan().toString() and "checked" in errors.inputFiles()[0]
    assert sorted(map(tuple, valid.collect())) == [(1, 0, "q", "general"), (1, 2, "r", "general")]
    plain = V.quarantine(raw)
    assert plain[0].select(*valid.columns).exceptAll(valid).count() == 0 and plain[1].exceptAll(errors).count() == 0


def test_ingest_leaves_no_typed_rows_behind_and_stores_whole_captures(spark, tmp_path):
    objects = [{**GOOD, "sources": [LINK], "sentiment": " s "}, {**GOOD, "lens": "x"}, {**GOOD, "query": "r"}, GOOD]
    raw = spark.createDataFrame([(1, i, json.dumps(o)) for i, o in enumerate(objects)], "run_id LONG, index LONG, body STRING")
    raw = raw.select("run_id", "index", F.try_parse_json("body").alias("raw"))
    ingest_batch(raw, str(tmp_path), 0)
    ingest_batch(raw.limit(0), str(tmp_path), 1)
    kept = {r["query"]: r for r in T.read_or_empty(spark, f"{tmp_path}/results", RESULTS).collect()}
    assert set(kept) == {"q", "r"} and kept["q"]["sentiment"] == " s " and kept["q"]["sources"][0]["domain"] == "a.com"
    outcomes = spark.read.parquet(f"{tmp_path}/outcomes").where("batch_no = 0").select("index", "outcome").collect()
    assert sorted(map(tuple, outcomes)) == [(0, "ok"), (1, "error"), (2, "ok"), (3, "skipped")]
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith("_checked")]


def test_stored_captures_of_many_tasks_come_in_few_files(spark, tmp_path):
    rows = [(run, i, json.dumps({**GOOD, "query": f"q{run} {i}"})) for run in range(40) for i in range(10)]
    raw = spark.createDataFrame(rows, "run_id LONG, index LONG, body STRING").repartition(40)
    ingest_batch(raw.select("run_id", "index", F.try_parse_json("body").alias("raw")), str(tmp_path), 0)
    folders = [p for p in (tmp_path / "results").iterdir() if p.name.startswith("run_bucket=")]
    files = [f for p in folders for f in p.iterdir() if f.name.endswith(".parquet")]
    assert len(files) == len(folders) <= 40  # before, each task left a file in each folder it had rows of
    assert T.read_or_empty(spark, f"{tmp_path}/results", RESULTS).count() == 400
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith("_")]


def test_fields_read_at_once_equal_their_rules(spark):
    odd = {
        "query": [None, 3, "", ["x"]], "lens": [None, "promo", 1], "engine": [None, True], "captured_at": [None, "soon", 1_700_000_000, "2024-01-02"],
        "answer_text_md": [None, 4], "sentiment": [None, {}], "overview_present": [None, "maybe", 1, 0, 2, "YES", 1.0], "brand_in_answer_text": [None, "off", []],
        "sources": [None, "x", [None], [3], [{**LINK, "rank": "0"}], [LINK, {**LINK, "rank": "2.0"}], [{**LINK, "rank": 1.5}], [{"rank": 1, "url": None, "domain": "a.com"}], [{"rank": 1}]],
        "citations": [None, {}, [{**LINK, "domain": "z.org"}]], "target_source_ranks": [None, [0], ["1"], [None], [1, 2]], "target_citation_ranks": [None, [-1], 5],
    }
    objects = [GOOD, {}, [], {**GOOD, "lens": "x", "sources": [{**LINK, "rank": "-1"}], "extra": 1}]
    for field, values in odd.items():
        objects += [{**GOOD, field: v} for v in values] + [{k: v for k, v in GOOD.items() if k != field}]
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "index LONG, body STRING")
    raw = df.select("index", F.try_parse_json("body").alias("raw"))
    refusal = F.struct(F.lit("").alias("field"), F.lit("Input should be a valid dictionary or instance of QueryCapture").alias("msg"))
    ruled, read = V.read_fields(raw, V.FIELDS, refusal), V.v_coerce(raw)
    assert read.schema == ruled.schema and read.count() == len(objects)
    assert sorted(map(str, read.collect())) == sorted(map(str, ruled.collect()))
    # a row with one odd field takes one rule: the others stay as they were read
    forms = raw.select("index", V._usual(F.col("raw")).isNotNull().alias("usual")).where("usual").collect()
    assert objects.index({k: v for k, v in GOOD.items() if k != "query"}) in {r["index"] for r in forms}


ODD_ARRAYS = [
    "[1,2,3]", "[1],[2]", "[1]] , [[2]", "[1] x", "x [1]", "[1,2,", "[1,,2]", "[]", " [ ] ", "", ",", " ", '{"a":1}', '"s"', "﻿[1,2]",
    '[{"a":"x,]\\" ["},[1,[2]],"q"]\n', "[1,2]]", "[[1,2]", "[NaN,1]", "[1,2],", "[1 2]", "null", "[null, 1]", "[1,2] []", "[1,2]]]", "[1]\n[2]",
]


def test_small_array_files_are_read_whole_with_the_rows_that_cutting_gives(spark, tmp_path):
    for i, text in enumerate(ODD_ARRAYS):
        (tmp_path / f"f{i:02}.json").write_text(text, encoding="utf-8")

    def rows(**how):
        read = read_array(spark, str(tmp_path), **how)
        return sorted(map(tuple, read.select(F.element_at(F.split("file", "/"), -1), "index", F.coalesce(F.to_json("raw"), F.lit("none"))).collect()))

    whole, cut = rows(), rows(whole_file=-1)
    assert whole == cut and [r[1:] for r in whole if r[0] == "f00.json"] == [(0, "1"), (1, "2"), (2, "3")]
    good = read_array(spark, str(tmp_path)).where("index >= 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode(elements" in good  # no shuffle of what is read whole
