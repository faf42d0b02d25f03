"""Assembly, validation, ingest, resume and table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import captures as C
from sightline.operators import validation as V
from sightline.plans.aggregate import aggregate_runs
from sightline.plans.artifact import run_artifact, write_artifacts
from sightline.schemas import DOMAIN_STATS, METRIC_COLUMNS, METRICS, RESULTS, AUDITS
from sightline.session import discard, scratch_path
from sightline.sources import tables as T
from sightline.streaming.ingest import ingest_batch

from .derived import Derived
from .oracle import shown, ts, with_ctes
from .present import present

CASES: dict = {}


def case(key, fn, sql, extra=None):
    CASES[key] = (fn, None if sql is None else with_ctes(sql, extra))


# --- assembly ------------------------------------------------------------------------------------------

def _assembled(d: Derived):
    links = C.drop_ad_links(d.link_rows)
    return C.assemble_captures(d.answers.select(F.col("id").alias("capture_id"), "run_id"), links)


_LANDED = r"""SELECT a.id, channel, rank AS old_rank, 'https://www.' || domain || '/' || path AS url, domain,
    row_number() OVER (PARTITION BY a.id, channel ORDER BY rank) AS rank
    FROM (SELECT *, CASE channel WHEN 'sources' THEN 0 ELSE 2 END AS shift, regexp_extract(url, '/([pq])/', 1) AS path FROM links) l
    JOIN answers a ON a.id = l.id WHERE (l.rank + shift) % 5 <> 3"""

def _flat(df):
    return C.capture_links(df.withColumnRenamed("capture_id", "id"))


case("assemble_captures", lambda d: present(_flat(_assembled(d)), "capture_id", "channel", "rank", "url", "domain"),
     "SELECT id AS capture_id, channel, rank, url, domain FROM landed", {"landed": _LANDED})
case("fold_citations_into_sources",
     lambda d: present(_flat(C.fold_citations_into_sources(_assembled(d))).where("channel = 'sources'"), "capture_id", "rank", "domain"),
     """SELECT id AS capture_id, row_number() OVER (PARTITION BY id ORDER BY part, rank) AS rank, domain FROM (
        SELECT id, 0 AS part, rank, domain FROM landed WHERE channel = 'sources'
        UNION ALL SELECT id, 1, min(rank), domain FROM landed c WHERE channel = 'citations'
        AND NOT EXISTS (SELECT 1 FROM landed s WHERE s.id = c.id AND s.channel = 'sources' AND s.domain = c.domain) GROUP BY id, domain)""",
     {"landed": _LANDED})
case("uncited_sources", lambda d: present(C.uncited_sources(d.captures)),
     """SELECT id, run_id, '' AS cited_not_sourced, coalesce(x, '') AS sourced_not_cited FROM cap LEFT JOIN (
        SELECT id, string_agg(domain, ',' ORDER BY domain) AS x FROM (
            SELECT id, domain FROM links WHERE channel = 'sources' EXCEPT SELECT id, domain FROM links WHERE channel = 'citations')
        GROUP BY id) USING (id)""")
case("all_domains", lambda d: present(C.all_domains(d.captures)),
     "SELECT DISTINCT run_id, l.domain FROM cap c JOIN links l ON l.id = c.id")
case("dedupe_captures", lambda d: present(C.dedupe_captures(d.answers), "id", "run_id", "query", "lens"),
     "SELECT id, run_id, query, lens FROM cap")
case("match_links_to_targets",
     lambda d: present(C.match_links_to_targets(C.capture_links(d.captures), d.brands)),
     r"""SELECT c.id AS capture_id, channel, brand_id, string_agg(rank, ',' ORDER BY rank) AS ranks
     FROM (SELECT id FROM cap) c JOIN links l ON l.id = c.id JOIN brands b ON l.domain = split_part(b.domain, '/', 1)
     AND (b.domain NOT LIKE '%/%' OR regexp_replace(l.url, '^https://www\.', '') LIKE b.domain || '/%') GROUP BY ALL""")
case("live_n_ok", lambda d: present(C.live_n_ok(d.captures)), "SELECT run_id, count(*) AS n_ok FROM cap GROUP BY run_id")
case("missing_questions", lambda d: present(C.missing_questions(d.questions, d.captures, d.runs)),
     """SELECT run_id, r.brand_id, engine, q.query, q.lens FROM runs r JOIN questions q USING (brand_id) WHERE status = 'running'
     AND NOT EXISTS (SELECT 1 FROM cap c WHERE c.run_id = r.run_id AND c.query = q.query AND c.lens = q.lens)""")
case("resumable_runs", lambda d: present(C.resumable_runs(d.runs, d.captures, d.questions)),
     f"""SELECT run_id, brand_id, engine, {ts('run_at')} AS run_at FROM (SELECT * FROM runs WHERE status = 'running'
        QUALIFY row_number() OVER (PARTITION BY brand_id, engine ORDER BY run_at DESC, run_id DESC) = 1) r
     WHERE NOT EXISTS (SELECT 1 FROM cap c WHERE c.run_id = r.run_id AND NOT EXISTS (
        SELECT 1 FROM questions q WHERE q.brand_id = r.brand_id AND q.query = c.query AND q.lens = c.lens))""")


def _second_read(d: Derived):
    i = F.col("id")
    changed = F.when(i % 5 == 0, F.array().cast(d.captures.schema["sources"].dataType)).when(
        i % 5 == 1, F.reverse("sources")).when(i % 5 == 2, F.slice("sources", F.lit(2), F.size("sources"))).otherwise(F.col("sources"))
    return d.captures.withColumn("sources", changed)


case("capture_agreement", lambda d: present(C.capture_agreement(d.captures, _second_read(d))),
     """SELECT run_id, query, lens, n AS n_a, n_b, CASE WHEN a = b THEN 'agree' WHEN n = 0 OR n_b = 0 THEN 'empty_read'
        WHEN list_sort(a) = list_sort(b) THEN 'reordered' ELSE 'drift' END AS verdict FROM (
        SELECT *, len(b) AS n_b FROM (SELECT run_id, query, lens, coalesce(ds, []) AS a, len(coalesce(ds, [])) AS n,
            CASE cap.id % 5 WHEN 0 THEN [] WHEN 1 THEN list_reverse(coalesce(ds, [])) WHEN 2 THEN coalesce(ds, [])[2:] ELSE coalesce(ds, []) END AS b
        FROM cap LEFT JOIN (SELECT id, list(domain ORDER BY rank) AS ds FROM links WHERE channel = 'sources' GROUP BY id) USING (id)))""")

# --- validation ----------------------------------------------------------------------------------------

_LENS_MSG = "Input should be ''general'', ''branded'' or ''comparative''"
_BOOL_MSG = "Input should be a valid boolean, unable to interpret input"
_SUB_MSG = ("Value error, citations must be a subset of sources (the model can only cite what it retrieved); "
            "cited domain(s) absent from sources: [''z.org'']")
_BAD = f"""SELECT *, CASE WHEN id % 41 = 0 THEN 'query' WHEN id % 43 = 0 THEN 'lens' WHEN id % 47 = 0 THEN 'captured_at'
        WHEN id % 53 = 0 AND id % 4 <> 1 THEN 'overview_present' WHEN id % 59 = 0 AND n_sources > 0 THEN 'sources.0.rank'
        WHEN id % 61 = 0 THEN '' WHEN len(c_ranks) > 0 AND len(t) = 0 THEN '' WHEN list_max(t) > n_sources THEN '' END AS field,
    CASE WHEN id % 41 = 0 THEN 'Field required' WHEN id % 43 = 0 THEN '{_LENS_MSG}' WHEN id % 47 = 0 THEN 'Input should be a valid datetime'
        WHEN id % 53 = 0 AND id % 4 <> 1 THEN '{_BOOL_MSG}' WHEN id % 59 = 0 AND n_sources > 0 THEN 'Input should be greater than 0'
        WHEN id % 61 = 0 THEN '{_SUB_MSG}'
        WHEN list_max(t) > n_sources THEN 'Value error, target_source_ranks points past the end of the array it indexes: [99] with only '
            || n_sources || ' entries' END AS msg
    FROM (SELECT *, CASE WHEN id % 67 = 0 THEN [99] ELSE s_ranks END AS t FROM cap_raw)"""
_BADX = {"bad": _BAD}
_REFUSED = "SELECT run_id, id AS index, CASE WHEN id % 41 <> 0 THEN query END AS query, field, msg FROM bad WHERE field IS NOT NULL"
case("quarantine", lambda d: present(V.quarantine(d.raw_objects)[1]), _REFUSED, _BADX)
case("v_coerce",
     lambda d: present(
         V.quarantine(d.raw_objects)[0].select(
             "run_id", "index", "query", "lens", "engine", "captured_at", "overview_present", "brand_in_answer_text", "sentiment",
             F.transform("sources", lambda x: x["rank"]).alias("source_ranks"), "target_source_ranks", "target_citation_ranks")),
     f"""SELECT run_id, id AS index, query, lens, engine, {ts('captured_at')} AS captured_at, overview_present, brand_in_answer_text, sentiment,
     array_to_string(range(1, n_sources + 1), ',') AS source_ranks, array_to_string(t, ',') AS target_source_ranks,
     array_to_string(c_ranks, ',') AS target_citation_ranks FROM bad WHERE field IS NULL""", _BADX)


def _tampered(d: Derived):
    """Typed captures with one fault per rule, by id."""
    i = F.col("id")
    return d.captures.withColumns({
        "query": F.when(i % 41 != 0, F.col("query")),
        "lens": F.when(i % 43 == 0, "General").otherwise(F.col("lens")),
        "sources": F.when(i % 59 == 0, F.transform("sources", lambda x: F.struct((x["rank"] - 1).alias("rank"), x["url"].alias("url"), x["domain"].alias("domain"))))
        .when(i % 53 == 0, F.transform("sources", lambda x: F.struct(x["rank"].alias("rank"), F.lit(None).cast("string").alias("url"), x["domain"].alias("domain"))))
        .otherwise(F.col("sources")),
        "citations": F.when(i % 61 == 0, F.array(F.struct(F.lit(1).alias("rank"), F.lit("u").alias("url"), F.lit("www.z.org").alias("domain")))).otherwise(F.col("citations")),
        "target_source_ranks": F.when(i % 67 == 0, F.array(F.lit(99), F.lit(98))).when(i % 71 == 0, F.array().cast("array<int>")).otherwise(F.col("target_source_ranks")),
        "target_citation_ranks": F.when(i % 71 == 0, F.array(F.lit(1))).otherwise(F.col("target_citation_ranks")),
    })


_IMPLIES = "Value error, target_citation_ranks non-empty requires non-empty target_source_ranks (a cited target is also a source)"
_RULES = {
    "v_required": ("id % 41 = 0", "'query'"),
    "v_lens": ("id % 43 = 0", f"'{_LENS_MSG}'"),
    "v_rank_positive": ("id % 59 = 0 AND n_sources > 0", "'Input should be greater than 0'"),
    "v_link_shape": ("id % 53 = 0 AND id % 59 <> 0 AND n_sources > 0", "'Field required'"),
    "v_citations_subset": ("id % 61 = 0", f"'{_SUB_MSG}'"),
    "v_target_implication": ("(id % 71 = 0 AND id % 67 <> 0) OR (id % 71 <> 0 AND id % 67 <> 0 AND len(c_ranks) > 0 AND len(s_ranks) = 0)", f"'{_IMPLIES}'"),
    "v_rank_bounds": (
        "id % 67 = 0 OR (id % 71 = 0 AND n_citations = 0 AND id % 61 <> 0) OR (id % 61 = 0 AND list_max(c_ranks) > 1)",
        "CASE WHEN id % 67 = 0 THEN 'Value error, target_source_ranks points past the end of the array it indexes: [98, 99] with only ' || n_sources || ' entries' "
        "WHEN id % 71 = 0 THEN 'Value error, target_citation_ranks points past the end of the array it indexes: [1] with only ' || n_citations || ' entries' "
        "ELSE 'Value error, target_citation_ranks points past the end of the array it indexes: [' || array_to_string(list_filter(c_ranks, lambda r: r > 1), ', ') || '] with only 1 entries' END"),
}
for _rule, (_where, _msg) in _RULES.items():
    case(_rule, lambda d, r=_rule: present(V.rule_violations(_tampered(d), r)), f"SELECT id, run_id, {_msg} AS msg FROM cap WHERE {_where}")

case("dq_capture_rules", lambda d: present(V.dq_capture_rules(d.captures)),
     """SELECT run_id, count(*) AS n_rows, count(*) FILTER (NOT overview_present AND n_sources > 0) AS no_overview_has_links,
     count(*) FILTER (NOT overview_present AND id % 4 <> 0) AS no_overview_has_text,
     count(*) FILTER (NOT overview_present AND brand_in_answer_text) AS no_overview_has_mention,
     count(*) FILTER (sentiment IS NOT NULL AND NOT here) AS sentiment_without_presence,
     count(*) FILTER (sentiment IS NULL AND here) AS presence_without_sentiment,
     0::BIGINT AS rank_is_not_position, count(*) FILTER (wrapped) AS domain_is_not_of_url
     FROM (SELECT *, len(s_ranks) > 0 OR len(c_ranks) > 0 OR brand_in_answer_text AS here,
        id IN (SELECT id FROM links WHERE url LIKE 'https://www.google%') AS wrapped FROM cap) GROUP BY run_id""")


# --- stored tables -------------------------------------------------------------------------------------

def _batch(d: Derived):
    return d.captures_raw.withColumn("index", F.col("id"))


def _stored(d: Derived):
    return d.captures_raw.where(F.col("id") % 3 == 0)


_NEW = """SELECT run_id, id AS index FROM cap_raw c WHERE NOT EXISTS (
    SELECT 1 FROM cap_raw s WHERE s.id % 3 = 0 AND s.run_id = c.run_id AND s.query = c.query AND s.lens = c.lens)
    QUALIFY row_number() OVER (PARTITION BY run_id, query, lens ORDER BY id) = 1"""


def _append(d: Derived):
    inserted, skipped = T.append_captures(_batch(d), _stored(d))
    return present(
        inserted.select("run_id", "index", F.lit("ok").alias("outcome")).unionByName(
            skipped.withColumn("outcome", F.lit("skipped"))))


case("append_captures", _append,
     f"SELECT run_id, id AS index, CASE WHEN (run_id, id) IN (SELECT (run_id, index) FROM ({_NEW})) THEN 'ok' ELSE 'skipped' END AS outcome FROM cap_raw")


def _report(d: Derived):
    good, errors = V.quarantine(d.raw_objects, scratch_path(d.spark, "checked"), ["query", "lens"])
    inserted, skipped = T.append_captures(good, _stored(d))
    stored = _stored(d).select("run_id").unionByName(inserted.select("run_id"))
    return present(V.ingest_report(inserted, skipped, errors, stored))


case("ingest_report", _report,
     """SELECT run_id, sum(ok)::BIGINT AS ok, sum(skipped)::BIGINT AS skipped, sum(errors)::BIGINT AS errors, sum(n_ok)::BIGINT AS n_ok FROM (
        SELECT run_id, n::INT AS ok, 1 - n::INT AS skipped, 0 AS errors, n::INT AS n_ok FROM (SELECT run_id,
            NOT EXISTS (SELECT 1 FROM cap_raw s WHERE s.id % 3 = 0 AND s.run_id = b.run_id AND s.query = b.query AND s.lens = b.lens)
            AND row_number() OVER (PARTITION BY run_id, query, lens ORDER BY id) = 1 AS n FROM bad b WHERE field IS NULL)
        UNION ALL SELECT run_id, 0, 0, 1, 0 FROM bad WHERE field IS NOT NULL
        UNION ALL SELECT run_id, 0, 0, 0, 1 FROM cap_raw WHERE id % 3 = 0) GROUP BY run_id""", _BADX)


def _ingest_twice(d: Derived):
    """A batch stored, part of it sent again, then all of it: every capture is kept once."""
    out, captures = scratch_path(d.spark, "ingest"), scratch_path(d.spark, "captures")
    # three batches are made of the same captures
    d.captures_raw.write.parquet(captures)
    d.captures_raw = d.spark.read.schema(d.captures_raw.schema).parquet(captures)
    # places are counted anew in every chunk of a run
    rows = d.raw_objects.withColumn("file", F.floor(F.col("index") / 10)).withColumn("whole", F.col("index"))
    rows = rows.withColumn("index", F.col("index") % 10)
    half = rows.where(F.col("whole") % 2 == 0)
    for batch_no, batch in enumerate((half, half, rows)):
        ingest_batch(batch.drop("whole"), out, batch_no)
    discard(d.spark, captures)
    kept = T.read_or_empty(d.spark, f"{out}/results", RESULTS)
    # an id that two captures shared would leave fewer rows
    by_id = kept.groupBy("id").agg(*[F.min(c).alias(c) for c in ("run_id", "query", "lens")], F.count(F.lit(1)).alias("n"))
    return present(by_id, "run_id", "query", "lens", "n")


case("ingest_batch", _ingest_twice,
     "SELECT DISTINCT run_id, query, lens, 1::BIGINT AS n FROM bad WHERE field IS NULL", _BADX)


def _tally(raw):
    valid, errors = V.quarantine(raw, scratch_path(raw.sparkSession, "checked"), [])
    both = valid.select(F.lit("ok").alias("what")).unionByName(errors.select(F.lit("error").alias("what")))
    return present(both.groupBy("what").agg(F.count(F.lit(1)).alias("n")))


ARRAY_ROWS = 2000


def _read_arrays(d: Derived):
    """Captures landed as JSON array files of so many rows each, and read back."""
    path = scratch_path(d.spark, "arrays")
    rows = d.capture_bodies.select("id", "body", F.expr(f"id DIV {ARRAY_ROWS}").alias("file"))
    first = rows.groupBy("file").agg(F.min("id").alias("first"))
    lines = rows.join(first, "file").select("file", "id", F.concat(F.when(F.col("id") == F.col("first"), "[").otherwise(","), "body").alias("value"))
    ends = first.select("file", F.lit(2**62).alias("id"), F.lit("]").alias("value"))
    # by a hash, as the planner may leave out a shuffle by the file itself and put the ends into files of their own
    (lines.unionByName(ends).repartition(F.xxhash64("file")).sortWithinPartitions("file", "id").select("file", "value")
     .write.partitionBy("file").text(path))
    read = T.read_captures(d.spark, path)
    text = lambda k: F.try_variant_get("raw", f"$.{k}", "string").alias(k)
    return present(read.select(F.regexp_extract("file", r"/file=(\d+)/", 1).alias("file"), "index", *map(text, ("query", "lens", "engine", "captured_at"))))


def _read_lines(d: Derived):
    """Captures landed one per line and read back."""
    path = scratch_path(d.spark, "lines")
    d.capture_bodies.select("body").write.text(path)
    return _tally(T.read_capture_lines(d.spark, path))


_TALLY = "SELECT CASE WHEN field IS NULL THEN 'ok' ELSE 'error' END AS what, count(*) AS n FROM bad GROUP BY ALL"
case("read_captures", _read_arrays,
     f"""SELECT (id // {ARRAY_ROWS})::VARCHAR AS file, row_number() OVER (PARTITION BY id // {ARRAY_ROWS} ORDER BY id) - 1 AS index,
     CASE WHEN id % 41 <> 0 THEN query END AS query, CASE WHEN id % 43 = 0 THEN 'promo' ELSE lens END AS lens, engine,
     CASE WHEN id % 47 = 0 THEN 'soon' ELSE strftime(captured_at, '%Y-%m-%dT%H:%M:%SZ') END AS captured_at FROM cap_raw""")
case("read_capture_lines", _read_lines, _TALLY, _BADX)


def _rebuild(d: Derived, kind: str):
    """Store all runs, then replace a third of them by changed rows; every ninth run loses its rows."""
    path = scratch_path(d.spark, kind)
    if kind == "metrics":
        rows, write, schema = d.metrics, T.rebuild_metrics, METRICS
        changed = rows.withColumn("n_queries", F.col("n_queries") + 1)
    else:
        rows, write, schema = d.stats, T.rebuild_domain_stats, DOMAIN_STATS
        changed = rows.withColumn("appearances_sources", F.col("appearances_sources") + 1)
    write(rows, path)
    again = d.runs.where(F.col("run_id") % 3 == 0)
    write(changed.where((F.col("run_id") % 3 == 0) & (F.col("run_id") % 9 != 0)), path, again)
    return T.read_runs(d.spark, path, schema)


case("rebuild_metrics", lambda d: present(_rebuild(d, "metrics"), "run_id", "lens", "n_queries", "overview_coverage"),
     "SELECT run_id, lens, n_queries::BIGINT + (run_id % 3 = 0)::BIGINT AS n_queries, round(overview_coverage, 6) AS overview_coverage FROM metrics WHERE run_id % 9 <> 0")
case("rebuild_domain_stats", lambda d: present(_rebuild(d, "stats"), "run_id", "lens", "domain", "appearances_sources"),
     "SELECT run_id, lens, domain, appearances_sources::BIGINT + (run_id % 3 = 0)::BIGINT AS appearances_sources FROM stats WHERE run_id % 9 <> 0")


def _aggregated(d: Derived):
    """All runs aggregated, then those of one day of seven anew with changed captures; both stored tables as they read."""
    root = scratch_path(d.spark, "aggregate")
    paths = f"{root}/metrics", f"{root}/stats"
    aggregate_runs(d.captures.where("id % 2 = 0"), d.runs, d.brands, *paths)
    aggregate_runs(d.captures, d.runs.where("run_id % 3 <> 0"), d.brands, *paths)
    aggregate_runs(d.captures, d.runs.where("run_id % 3 = 0"), d.brands, *paths)
    metrics, stats = T.read_runs(d.spark, paths[0], METRICS), T.read_runs(d.spark, paths[1], DOMAIN_STATS)
    none = F.lit(None)
    return present(metrics.select(
        "run_id", "brand_id", "engine", "lens", none.cast("string").alias("domain"), none.cast("boolean").alias("is_brand"),
        "n_queries", "n_overviews", "n_in_sources", "n_cited", "avg_source_position", "avg_citation_position",
    ).unionByName(stats.select(
        "run_id", "brand_id", "engine", "lens", "domain", "is_brand", F.col("appearances_sources").alias("n_queries"),
        F.col("appearances_citations").alias("n_overviews"), F.col("sum_min_source_rank").cast("bigint").alias("n_in_sources"),
        F.col("sum_min_citation_rank").cast("bigint").alias("n_cited"), "avg_source_position", "avg_citation_position")))


case("aggregate_run", _aggregated,
     """SELECT run_id, brand_id, engine, lens, NULL::VARCHAR AS domain, NULL::BOOLEAN AS is_brand, n_queries::BIGINT AS n_queries, n_overviews::BIGINT AS n_overviews,
     n_in_sources::BIGINT AS n_in_sources, n_cited::BIGINT AS n_cited, round(avg_source_position, 6) AS avg_source_position,
     round(avg_citation_position, 6) AS avg_citation_position FROM metrics_new
     UNION ALL SELECT run_id, brand_id, engine, lens, domain, is_brand, appearances_sources::BIGINT, appearances_citations::BIGINT, sum_min_source_rank::BIGINT,
     sum_min_citation_rank::BIGINT, round(avg_source_position, 6), round(avg_citation_position, 6) FROM stats""")


def _audit_store(d: Derived):
    path = scratch_path(d.spark, "audits")
    T.append_audits(d.audits.where("audit_id % 2 = 0"), path)
    T.append_audits(d.audits.where("audit_id % 2 = 1"), path)
    return present(T.read_or_empty(d.spark, path, AUDITS), "audit_id", "domain", "engine", "checked_at", "score")


case("append_audits", _audit_store, f"SELECT audit_id, domain, engine, {ts('checked_at')} AS checked_at, score FROM audits")


def _old_table(d: Derived):
    """Metric rows of an old table without mention columns, and a table that is not there."""
    path = scratch_path(d.spark, "old")
    d.metrics.drop("n_brand_mentions", "brand_mention_rate").write.parquet(path)
    return T.read_or_empty(d.spark, path, METRICS).unionByName(T.read_or_empty(d.spark, path + "-none", METRICS))


case("read_or_empty", lambda d: present(_old_table(d), "run_id", "lens", "n_queries", "n_brand_mentions", "brand_mention_rate"),
     "SELECT run_id, lens, n_queries::BIGINT AS n_queries, NULL::BIGINT AS n_brand_mentions, NULL::DOUBLE AS brand_mention_rate FROM metrics")


def _sentiment_updates(d: Derived):
    scopes = d.sentiment.where("run_id % 2 = 0")
    return scopes.select(
        "run_id", F.when(F.col("run_id") % 10 == 0, "promo").otherwise(F.col("lens")).alias("lens"),
        F.when(F.col("run_id") % 4 != 0, F.lit("new")).alias("summary"), F.lit("2002-02-02").cast("timestamp").alias("computed_at"))


case("upsert_lens_sentiment",
     lambda d: present(T.upsert_lens_sentiment(d.sentiment, _sentiment_updates(d)), "run_id", "lens", "summary"),
     """SELECT run_id, lens, CASE WHEN run_id % 2 = 0 AND run_id % 10 <> 0 THEN CASE WHEN run_id % 4 <> 0 THEN 'new' END ELSE summary END AS summary FROM sentiment""")


def _wanted_brands(d: Derived):
    c = F.col("c_custkey")
    return d.given("customer").select(
        F.when(c % 2 == 0, F.lower("c_name")).otherwise(F.concat(F.lit(" "), "c_name")).alias("name"),
        F.concat(F.lit("https://www.cust"), (c % 97).cast("string"), F.lit(".com/")).alias("domain"),
        F.lit("2021-01-01").cast("timestamp").alias("requested_at"),
    ).unionByName(d.brands.select(F.lower("name").alias("name"), "domain", F.lit("2021-01-01").cast("timestamp").alias("requested_at")))


case("upsert_brands",
     lambda d: present(T.upsert_brands(d.brands, _wanted_brands(d)).groupBy("domain").agg(
         F.count(F.lit(1)).alias("n"), F.countDistinct("brand_id").alias("ids"))),
     """SELECT domain, count(*) AS n, count(*) AS ids FROM (SELECT DISTINCT 'cust' || (c_custkey % 97) || '.com' AS domain, lower(c_name) FROM customer
     UNION ALL SELECT domain, name FROM brands) GROUP BY domain""")


def _new_runs(d: Derived):
    asked = d.runs.where("run_id % 4 = 0").select(
        "brand_id", "engine", F.lit("2003-01-01").cast("timestamp").alias("run_at"),
        F.when(F.col("run_id") % 8 == 0, F.col("run_id").cast("string")).otherwise(F.concat(F.lit("x"), "run_id")).alias("group_id"))
    return T.open_runs(d.runs, asked)


case("open_runs",
     lambda d: present(_new_runs(d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("ids"))),
     """SELECT status, count(*) AS n, count(*) AS ids FROM (SELECT status FROM runs UNION ALL SELECT 'running' FROM runs WHERE run_id % 4 = 0) GROUP BY status""")
case("update_run_counts",
     lambda d: present(T.update_run_counts(d.runs, d.runs.where("run_id % 3 = 0").select(
         "run_id", F.lit(None).cast("int").alias("n_queries"), F.lit(0).alias("n_failed"),
         F.when(F.col("status") == "running", "done").alias("status"))), "run_id", "n_queries", "n_ok", "n_failed", "status"),
     """SELECT run_id, n_queries, n_ok, CASE WHEN run_id % 3 = 0 THEN 0::BIGINT END AS n_failed,
     CASE WHEN run_id % 3 = 0 AND status = 'running' THEN 'done' ELSE status END AS status FROM runs""")


# --- artifacts -----------------------------------------------------------------------------------------

def _artifacts(d: Derived, part_rows: int):
    return run_artifact(d.runs, d.brands, d.metrics, d.sentiment, d.captures, d.stats, d.audits, part_rows)


case("run_artifact",
     lambda d: present(_artifacts(d, 10_000).select(
         "run_id", "part", "n_parts", F.col("artifact.run.status").alias("status"), F.col("artifact.brand.target").alias("target"),
         F.array_join(F.map_keys("artifact.metrics"), ",").alias("lenses"),
         F.array_join(F.transform(F.map_values("artifact.metrics"), lambda m: m["n_queries"]), ",").alias("counts"),
         F.array_join(F.transform("artifact.results", lambda r: r["query"]), ",").alias("queries"),
         F.size("artifact.domain_stats").alias("n_stats"), F.col("artifact.audit.score").alias("audit_score"))),
     """SELECT r.run_id, 0::BIGINT AS part, 1::BIGINT AS n_parts, r.status, b.domain AS target, m.lenses, m.counts, coalesce(c.queries, '') AS queries,
     coalesce(s.n, 0) AS n_stats, a.score AS audit_score FROM runs r JOIN brands b USING (brand_id)
     JOIN (SELECT run_id, string_agg(lens, ',' ORDER BY place) AS lenses, string_agg(n_queries, ',' ORDER BY place) AS counts FROM
        (SELECT *, list_position(['all', 'general', 'branded', 'comparative'], lens) AS place FROM metrics) GROUP BY run_id) m USING (run_id)
     LEFT JOIN (SELECT run_id, string_agg(query, ',' ORDER BY id) AS queries FROM cap GROUP BY run_id) c USING (run_id)
     LEFT JOIN (SELECT run_id, count(*) AS n FROM stats GROUP BY run_id) s USING (run_id)
     LEFT JOIN latest_own a ON a.domain = split_part(b.domain, '/', 1) AND a.engine = r.engine""")


def _artifact_parts(d: Derived):
    """Documents cut into parts of three rows, written and read back: nothing is lost."""
    path = scratch_path(d.spark, "artifacts")
    write_artifacts(_artifacts(d, 3), path)
    docs = d.spark.read.schema("run_id LONG, part INT, n_parts INT, artifact STRING").json(path)
    doc = F.try_parse_json("artifact")
    counted = docs.select(
        "run_id", F.size(F.try_variant_get(doc, "$.results", "array<variant>")).alias("n_results"),
        F.size(F.try_variant_get(doc, "$.domain_stats", "array<variant>")).alias("n_stats"))
    return present(counted.groupBy("run_id").agg(F.sum("n_results").alias("n_results"), F.sum("n_stats").alias("n_stats")))


case("run_artifact_parts", _artifact_parts,
     """SELECT run_id, coalesce(c.n, 0) AS n_results, coalesce(s.n, 0) AS n_stats FROM runs
     LEFT JOIN (SELECT run_id, count(*) AS n FROM cap GROUP BY run_id) c USING (run_id)
     LEFT JOIN (SELECT run_id, count(*) AS n FROM stats GROUP BY run_id) s USING (run_id)""")
