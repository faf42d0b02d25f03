"""Capture validation: typed fields out of raw JSON, quarantine of bad rows, data-quality rules.

Raw objects are VARIANT, so ``1``, ``"1"`` and ``true`` stay different until the rule for the field has
looked at them, and every rule is a native column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_domain, strip_ws
from ..schemas import LENSES, LINKS

REQUIRED = "Field required"
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Work a value out once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _get(v: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


def _looked_at(v: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of (v, k) with k the type of the variant, NULL where there is none."""
    return let(F.struct(v.alias("v"), F.schema_of_variant(v).alias("k")), use)


def _verdict(value: Column, error: Column) -> Column:
    return F.struct(value.alias("value"), error.cast("string").alias("error"))


def _is_number(k: Column) -> Column:
    return F.rlike(k, F.lit("^(DECIMAL|DOUBLE|FLOAT)"))


# --- lax coercion of one value: (value, error) -----------------------------------------------------

def coerce_text(v: Column, optional: bool = False) -> Column:
    absent = F.lit(None) if optional else F.lit(REQUIRED)

    def rule(s: Column) -> Column:
        fine = (s["k"] == "STRING") | (s["k"] == "VOID") if optional else s["k"] == "STRING"
        error = F.when(s["k"].isNull(), absent).when(~fine, F.lit("Input should be a valid string"))
        return _verdict(F.when(s["k"] == "STRING", _get(s["v"], "string")), error)

    return _looked_at(v, rule)


def coerce_lens(v: Column) -> Column:
    def rule(s: Column) -> Column:
        text = F.when(s["k"] == "STRING", _get(s["v"], "string"))
        known = F.coalesce(text.isin(*LENSES), F.lit(False))
        error = F.when(s["k"].isNull(), REQUIRED).when(
            ~known, "Input should be 'general', 'branded' or 'comparative'"
        )
        return _verdict(F.when(known, text), error)

    return _looked_at(v, rule)


def coerce_bool(v: Column) -> Column:
    def rule(s: Column) -> Column:
        word, number = F.lower(_get(s["v"], "string")), _get(s["v"], "double")
        value = (
            F.when(s["k"] == "BOOLEAN", _get(s["v"], "boolean"))
            .when(s["k"] == "STRING", F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False))
            .when((s["k"] == "BIGINT") | _is_number(s["k"]), F.when(number == 1, True).when(number == 0, False))
        )
        read = F.rlike(s["k"], F.lit("^(STRING|BIGINT|DECIMAL|DOUBLE)"))
        return let(
            F.struct(value.alias("value"), s["k"].alias("k"), read.alias("read")),
            lambda r: _verdict(
                r["value"],
                F.when(r["k"].isNull(), REQUIRED)
                .when(r["value"].isNotNull(), F.lit(None))
                .when(r["read"], "Input should be a valid boolean, unable to interpret input")
                .otherwise("Input should be a valid boolean"),
            ),
        )

    return _looked_at(v, rule)


def coerce_rank(v: Column) -> Column:
    """A whole number above 0; "1", 1.0 and true count as 1."""
    def rule(s: Column) -> Column:
        text, number = strip_ws(_get(s["v"], "string")), _get(s["v"], "double")
        value = (
            F.when(s["k"] == "BIGINT", _get(s["v"], "bigint"))
            .when(s["k"] == "BOOLEAN", _get(s["v"], "boolean").cast("bigint"))
            .when(s["k"] == "STRING", F.when(
                F.rlike(text, F.lit(r"^[+-]?\d+(\.0*)?$")), F.substring_index(text, ".", 1).try_cast("bigint")
            ))
            .when(_is_number(s["k"]), F.when(number == F.floor(number), number.cast("bigint")))
        )
        return let(
            F.struct(value.alias("value"), s["k"].alias("k")),
            lambda r: _verdict(
                r["value"].cast("int"),
                F.when(r["k"].isNull(), REQUIRED)
                .when(r["value"] <= 0, "Input should be greater than 0")
                .when(r["value"].isNotNull(), F.lit(None))
                .when(_is_number(r["k"]), "Input should be a valid integer, got a number with a fractional part")
                .when(r["k"] == "STRING", "Input should be a valid integer, unable to parse string as an integer")
                .otherwise("Input should be a valid integer"),
            ),
        )

    return _looked_at(v, rule)


def coerce_time(v: Column) -> Column:
    """ISO text or epoch seconds (milliseconds beyond 2e10), as number or as text."""
    def rule(s: Column) -> Column:
        return let(
            F.struct(s["k"].alias("k"), strip_ws(_get(s["v"], "string")).alias("text")),
            lambda r: let(_time_value(r["k"], r["text"]), lambda value: _verdict(
                value,
                F.when(r["k"].isNull(), REQUIRED).when(value.isNull(), "Input should be a valid datetime"),
            )),
        )

    return _looked_at(v, rule)


def _time_value(k: Column, text: Column) -> Column:
    number = F.when(
        (k == "BIGINT") | _is_number(k) | F.rlike(text, F.lit(r"^-?\d+(\.\d+)?$")), text.try_cast("double")
    )
    micros = let(number, lambda n: F.when(F.abs(n) > 2e10, n * 1000).otherwise(n * 1_000_000))
    iso = F.when(
        (k == "STRING") & F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}|$)")),
        F.try_to_timestamp(text),
    )
    return F.coalesce(F.timestamp_micros(micros.cast("bigint")), iso)


def coerce_list(v: Column, item: Callable[[Column], Column]) -> Column:
    """A list with every item coerced; a missing list is empty.  ``item`` gives (value, loc, error)."""
    def judged(s: Column) -> Column:
        placed = F.transform(
            s["checked"],
            lambda x, i: F.struct(
                F.concat_ws(".", i.cast("string"), x["loc"]).alias("loc"), x["error"].alias("error")
            ),
        )
        bad = F.try_element_at(F.filter(placed, lambda x: x["error"].isNotNull()), F.lit(1))
        return let(bad, lambda b: F.struct(
            F.coalesce(F.transform(s["checked"], lambda x: x["value"]), F.array()).alias("value"),
            b["loc"].alias("loc"),
            F.when(s["wrong"], "Input should be a valid list").otherwise(b["error"]).alias("error"),
        ))

    return _looked_at(v, lambda s: let(
        F.struct(
            F.transform(_get(s["v"], "array<variant>"), item).alias("checked"),
            (s["k"].isNotNull() & ~F.startswith(s["k"], F.lit("ARRAY"))).alias("wrong"),
        ),
        judged,
    ))


def coerce_link(v: Column) -> Column:
    def parts(s: Column) -> Column:
        return F.struct(
            F.startswith(s["k"], F.lit("OBJECT")).alias("is_object"),
            coerce_rank(_get(s["v"], "variant", "$.rank")).alias("rank"),
            coerce_text(_get(s["v"], "variant", "$.url")).alias("url"),
            coerce_text(_get(s["v"], "variant", "$.domain")).alias("domain"),
        )

    names = ("rank", "url", "domain")

    def whole(p: Column) -> Column:
        loc = F.coalesce(*[F.when(p[n]["error"].isNotNull(), F.lit(n)) for n in names])
        return F.struct(
            F.struct(*[p[n]["value"].alias(n) for n in names]).alias("value"),
            F.when(p["is_object"], loc).alias("loc"),
            F.when(~p["is_object"], "Input should be a valid dictionary or instance of Link")
            .otherwise(F.coalesce(*[p[n]["error"] for n in names]))
            .alias("error"),
        )

    return _looked_at(v, lambda s: let(parts(s), whole))


def _rank_item(v: Column) -> Column:
    return let(coerce_rank(v), lambda r: F.struct(
        r["value"].alias("value"), _null("string").alias("loc"), r["error"].alias("error")
    ))


# fields in the order in which their errors are reported
FIELDS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "query": (coerce_text, "string"),
    "lens": (coerce_lens, "string"),
    "engine": (coerce_text, "string"),
    "captured_at": (coerce_time, "timestamp"),
    "answer_text_md": (lambda v: coerce_text(v, True), "string"),
    "screenshot_path": (lambda v: coerce_text(v, True), "string"),
    "overview_present": (coerce_bool, "boolean"),
    "sources": (lambda v: coerce_list(v, coerce_link), LINKS),
    "citations": (lambda v: coerce_list(v, coerce_link), LINKS),
    "target_source_ranks": (lambda v: coerce_list(v, _rank_item), "array<int>"),
    "target_citation_ranks": (lambda v: coerce_list(v, _rank_item), "array<int>"),
    "brand_in_answer_text": (coerce_bool, "boolean"),
    "sentiment": (lambda v: coerce_text(v, True), "string"),
}
_LISTS = ("sources", "citations", "target_source_ranks", "target_citation_ranks")

# --- the usual form of a capture, read at once -------------------------------------------------------------

_LINK_TEXTS = "array<struct<rank: string, url: string, domain: string>>"
# how the fields of the usual form are read out of a VARIANT; a row with anything else in it takes the rules above
_USUAL = {
    "query": "string", "lens": "string", "engine": "string", "captured_at": "string", "answer_text_md": "string",
    "screenshot_path": "string", "overview_present": "string", "sources": _LINK_TEXTS, "citations": _LINK_TEXTS,
    "target_source_ranks": "array<bigint>", "target_citation_ranks": "array<bigint>", "brand_in_answer_text": "string",
    "sentiment": "string",
}
_USUAL_KINDS = {
    "string": "STRING", _LINK_TEXTS: r"ARRAY<(VOID|OBJECT<domain: STRING, rank: (STRING|BIGINT), url: STRING>)>",
    "array<bigint>": "ARRAY<(VOID|BIGINT)>",
}


def _usual_form() -> str:
    """Pattern of ``schema_of_variant`` of the usual form; its fields come sorted by name."""
    must = ("query", "lens", "engine", "captured_at")
    parts = []
    for name, kind in sorted(_USUAL.items()):
        # where one of these is absent its own rule says so
        if name in must:
            parts.append(f"({name}: (STRING|VOID)(, |>$))?")
        elif name in ("overview_present", "brand_in_answer_text"):
            parts.append(f"({name}: (STRING|BOOLEAN|VOID)(, |>$))?")
        else:
            null = "|VOID" if kind == "string" else ""
            parts.append(f"({name}: ({_USUAL_KINDS[kind]}{null})(, |>$))?")
    return "^OBJECT<" + "".join(parts) + "$"


def _usual(v: Column) -> Column:
    """Texts and lists of an object in the usual form, NULL for any other."""
    wanted = "struct<" + ", ".join(f"{name}: {kind}" for name, kind in _USUAL.items()) + ">"
    return F.when(F.rlike(F.schema_of_variant(v), F.lit(_usual_form())), _get(v, wanted))


def _usual_values(t: Column) -> Column:
    """The values m, of each field whether it is fine, and of all; a value that is not fine is left to its rule, which says what is wrong."""
    def word(w: Column) -> Column:
        low = F.lower(w)
        usual = F.when(w == "true", True).when(w == "false", False)
        return usual.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)

    def links(arr: Column) -> Column:
        def link(x: Column) -> Column:
            rank = F.substring_index(x["rank"], ".", 1).cast("int")
            fine = x["url"].isNotNull() & x["domain"].isNotNull() & F.rlike(x["rank"], F.lit(r"^[1-9][0-9]{0,8}(\.0*)?$"))
            return F.when(fine, F.struct(rank.alias("rank"), x["url"].alias("url"), x["domain"].alias("domain")))

        return F.coalesce(F.transform(arr, link), F.array().cast(LINKS))

    def ranks(arr: Column) -> Column:
        return F.coalesce(arr, F.array().cast("array<bigint>"))

    time = t["captured_at"]
    iso = F.when(F.rlike(time, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}:\d{2})?$")), F.try_to_timestamp(time))
    made = {
        "lens": F.when(t["lens"].isin(*LENSES), t["lens"]), "captured_at": iso,
        "overview_present": word(t["overview_present"]), "brand_in_answer_text": word(t["brand_in_answer_text"]),
        "sources": links(t["sources"]), "citations": links(t["citations"]),
        "target_source_ranks": ranks(t["target_source_ranks"]), "target_citation_ranks": ranks(t["target_citation_ranks"]),
    }

    def judged(m: Column) -> Column:
        ok = {c: m[c].isNotNull() for c in ("query", "lens", "engine", "captured_at", "overview_present", "brand_in_answer_text")}
        ok |= {c: F.forall(m[c], lambda x: x.isNotNull()) for c in ("sources", "citations")}
        ok |= {
            c: F.forall(m[c], lambda r: F.coalesce((r > 0) & (r < 2**31), F.lit(False)))
            for c in ("target_source_ranks", "target_citation_ranks")
        }
        return F.struct(m.alias("m"), F.struct(*[ok.get(f, F.lit(True)).alias(f) for f in FIELDS]).alias("ok"))

    def summed(j: Column) -> Column:
        return F.struct(j["m"].alias("m"), j["ok"].alias("ok"), reduce(and_, [j["ok"][f] for f in FIELDS]).alias("fine"))

    return let(let(F.struct(*[made.get(f, t[f]).alias(f) for f in FIELDS]), judged), summed)


def read_fields(
    raw: DataFrame, fields: dict[str, tuple[Callable[[Column], Column], str]], refusal: Column,
    usual: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The fields of ``raw`` VARIANT objects, coerced, with ``field_error`` = first (field, msg) or NULL.

    ``refusal`` is the (field, msg) of a row that is no object.  The fields come out of one generator, so
    they are worked out once and no later filter or column repeats their rules.  ``usual`` gives (m, ok, fine) with the
    values m of an object in its usual form, NULL for any other; fields that are not ok go through their rules.
    """
    keys = [c for c in raw.columns if c != "raw"]

    def outcome(p: Column) -> Column:
        problems = [
            F.when(
                p[f]["error"].isNotNull(),
                F.struct(
                    (F.concat_ws(".", F.lit(f), p[f]["loc"]) if f in _LISTS else F.lit(f)).alias("field"),
                    p[f]["error"].alias("msg"),
                ),
            )
            for f in fields
        ]
        return F.struct(
            p["echoed"].alias("echoed_query"),
            *[p[f]["value"].cast(kind).alias(f) for f, (_, kind) in fields.items()],
            F.when(~p["is_object"], refusal).otherwise(F.coalesce(*problems)).alias("field_error"),
        )

    def coerced(v: Column, u: Column | None = None) -> Column:
        is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))

        def judged(f: str) -> Column:
            rule, kind = fields[f]
            ruled = rule(_get(v, "variant", f"$.{f}"))
            if u is None:
                return ruled
            loc = [_null("string").alias("loc")] if f in _LISTS else []
            known = F.struct(u["m"][f].cast(kind).alias("value"), *loc, _null("string").alias("error"))
            return F.when(F.coalesce(u["ok"][f], F.lit(False)), known).otherwise(ruled)

        return F.struct(
            is_object.alias("is_object"), _get(v, "string", "$.query").alias("echoed"), *[judged(f).alias(f) for f in fields]
        )

    def ruled(v: Column) -> Column:
        return let(coerced(v), outcome)

    def at_once(u: Column) -> Column:
        m = u["u"]["m"]
        values = F.struct(
            m["query"].alias("echoed_query"),
            *[m[f].cast(kind).alias(f) for f, (_, kind) in fields.items()],
            F.lit(None).cast("struct<field: string, msg: string>").alias("field_error"),
        )
        return F.when(F.coalesce(u["u"]["fine"], F.lit(False)), values).otherwise(let(coerced(u["v"], u["u"]), outcome))

    if usual is None:
        rows = F.transform(F.array("raw"), ruled)
    else:
        read = F.transform(F.array("raw"), lambda v: F.struct(v.alias("v"), usual(v).alias("u")))
        rows = F.transform(read, at_once)
    return raw.select(*keys, F.inline(rows))


def v_coerce(raw: DataFrame) -> DataFrame:
    """Typed capture columns out of ``raw`` VARIANT, with ``field_error`` = first (field, msg) or NULL."""
    refusal = F.struct(
        F.lit("").alias("field"),
        F.lit("Input should be a valid dictionary or instance of QueryCapture").alias("msg"),
    )
    def usual(v: Column) -> Column:
        return let(_usual(v), lambda t: F.when(t.isNotNull(), _usual_values(t)))

    return read_fields(raw, FIELDS, refusal, usual)


# --- rules on typed captures: error text or NULL ---------------------------------------------------

def v_required() -> Column:
    missing = [
        F.when(F.col(c).isNull(), F.lit(c))
        for c in ("query", "lens", "engine", "captured_at", "overview_present", "brand_in_answer_text")
    ]
    return F.coalesce(*missing)


def v_lens() -> Column:
    return F.when(
        ~F.coalesce(F.col("lens").isin(*LENSES), F.lit(False)),
        "Input should be 'general', 'branded' or 'comparative'",
    )


def _all(arr: str, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.forall(F.col(arr), test), F.lit(True))


def v_rank_positive() -> Column:
    def positive(r: Column) -> Column:
        return F.coalesce(r > 0, F.lit(False))

    good = _all("target_source_ranks", positive) & _all("target_citation_ranks", positive)
    for arr in ("sources", "citations"):
        good = good & _all(arr, lambda x: positive(x["rank"]))
    return F.when(~good, "Input should be greater than 0")


def v_link_shape() -> Column:
    def whole(x: Column) -> Column:
        return x["rank"].isNotNull() & x["url"].isNotNull() & x["domain"].isNotNull()

    return F.when(~(_all("sources", whole) & _all("citations", whole)), REQUIRED)


def _domains(arr: str) -> Column:
    return F.transform(F.col(arr), lambda x: normalize_domain(x["domain"]))


def _quoted(items: Column, quote: str) -> Column:
    mark = F.lit(quote)
    texts = F.transform(items, lambda x: F.concat(mark, x.cast("string"), mark))
    return F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))


def v_citations_subset() -> Column:
    """Cited domains that are no sources, sorted."""
    extra = F.sort_array(F.array_except(_domains("citations"), _domains("sources")))
    # domains that are the same as written need not be normalized to be compared
    strange = F.size(F.array_except(F.col("citations.domain"), F.col("sources.domain"))) > 0
    return F.when(
        strange & (F.size(extra) > 0),
        F.concat(
            F.lit(
                "Value error, citations must be a subset of sources (the model can only cite what it "
                "retrieved); cited domain(s) absent from sources: "
            ),
            _quoted(extra, "'"),
        ),
    )


def v_target_implication() -> Column:
    return F.when(
        (F.size("target_citation_ranks") > 0) & (F.size("target_source_ranks") == 0),
        "Value error, target_citation_ranks non-empty requires non-empty target_source_ranks "
        "(a cited target is also a source)",
    )


def _bounds(ranks: str, links: str) -> Column:
    over = F.sort_array(F.filter(F.col(ranks), lambda r: r > F.size(links)))
    return F.when(
        F.size(over) > 0,
        F.concat(
            F.lit(f"Value error, {ranks} points past the end of the array it indexes: "),
            _quoted(over, ""),
            F.lit(" with only "),
            F.size(links).cast("string"),
            F.lit(" entries"),
        ),
    )


def v_rank_bounds() -> Column:
    return F.coalesce(
        _bounds("target_source_ranks", "sources"), _bounds("target_citation_ranks", "citations")
    )


ROW_RULES = {
    "v_required": v_required,
    "v_lens": v_lens,
    "v_rank_positive": v_rank_positive,
    "v_link_shape": v_link_shape,
    "v_citations_subset": v_citations_subset,
    "v_target_implication": v_target_implication,
    "v_rank_bounds": v_rank_bounds,
}


def rule_violations(captures: DataFrame, rule: str) -> DataFrame:
    """Rows that break one rule, with its message."""
    return (
        captures.select("id", "run_id", ROW_RULES[rule]().alias("msg")).where(F.col("msg").isNotNull())
    )


def checked_captures(raw: DataFrame) -> DataFrame:
    """Coerced captures with ``error`` = first (field, msg); whole-row rules run only on good fields."""
    typed = v_coerce(raw)
    whole_row = F.coalesce(v_citations_subset(), v_target_implication(), v_rank_bounds())
    return typed.withColumn(
        "error",
        F.coalesce(
            F.col("field_error"),
            F.when(whole_row.isNotNull(), F.struct(F.lit("").alias("field"), whole_row.alias("msg"))),
        ),
    ).drop("field_error")


def quarantine(raw: DataFrame, path: str | None = None, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid captures, errors(index, query, field, msg)); a bad row never stops the batch.

    Whoever reads more than one of the two, or one more than once, names a free ``path``: the typed rows are stored there
    first, with those capture ``columns`` only that are read later, and no row is typed twice.
    """
    keys = [c for c in raw.columns if c != "raw"]
    checked = checked_captures(raw)
    if columns is not None:
        checked = checked.select(*keys, "echoed_query", *columns, "error")
    if path is not None:
        kind = checked.schema
        checked.write.parquet(path)
        checked = raw.sparkSession.read.schema(kind).parquet(path)
    valid = checked.where(F.col("error").isNull()).drop("error", "echoed_query")
    errors = checked.where(F.col("error").isNotNull()).select(
        *keys, F.col("echoed_query").alias("query"), "error.field", "error.msg"
    )
    return valid, errors


def ingest_report(inserted: DataFrame, skipped: DataFrame, errors: DataFrame, stored: DataFrame) -> DataFrame:
    """Per run: how many rows were stored, skipped and refused, and the live number of stored captures."""
    def tally(df: DataFrame, what: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(what))

    counts = tally(inserted, "ok").unionByName(tally(skipped, "skipped")).unionByName(tally(errors, "error"))
    counts = counts.unionByName(tally(stored, "stored"))

    def of(what: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))

    return counts.groupBy("run_id").agg(
        of("ok").alias("ok"), of("skipped").alias("skipped"), of("error").alias("errors"),
        of("stored").alias("n_ok"),
    )


def ingest_outcomes(inserted: DataFrame, skipped: DataFrame, errors: DataFrame) -> DataFrame:
    """What became of every row: (run_id, [file,] index, outcome, query, field, msg); the last three for errors."""
    place = [c for c in ("run_id", "file", "index") if c in errors.columns]

    def rows(df: DataFrame, outcome: str) -> DataFrame:
        notes = [
            (F.col(c) if outcome == "error" else _null("string")).alias(c) for c in ("query", "field", "msg")
        ]
        return df.select(*place, F.lit(outcome).alias("outcome"), *notes)

    return rows(inserted, "ok").unionByName(rows(skipped, "skipped")).unionByName(rows(errors, "error"))


def dq_capture_rules(captures: DataFrame) -> DataFrame:
    """Violations per run of the documented rules that ingest does not enforce."""
    def positions(arr: str) -> Column:
        return _all_indexed(arr, lambda x, i: x["rank"] == i + 1)

    def clean_domains(arr: str) -> Column:
        return _all(arr, lambda x: x["domain"] == normalize_domain(x["url"]))

    silent = ~F.coalesce(F.col("overview_present"), F.lit(False))
    appears = (
        (F.size("target_source_ranks") > 0)
        | (F.size("target_citation_ranks") > 0)
        | F.coalesce(F.col("brand_in_answer_text"), F.lit(False))
    )
    rules = {
        "no_overview_has_links": silent & ((F.size("sources") > 0) | (F.size("citations") > 0)),
        "no_overview_has_text": silent & F.col("answer_text_md").isNotNull(),
        "no_overview_has_mention": silent & F.coalesce(F.col("brand_in_answer_text"), F.lit(False)),
        "sentiment_without_presence": F.col("sentiment").isNotNull() & ~appears,
        "presence_without_sentiment": F.col("sentiment").isNull() & appears,
        "rank_is_not_position": ~(positions("sources") & positions("citations")),
        "domain_is_not_of_url": ~(clean_domains("sources") & clean_domains("citations")),
    }
    return captures.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(test).alias(name) for name, test in rules.items()]
    )


def _all_indexed(arr: str, test: Callable[[Column, Column], Column]) -> Column:
    marks = F.transform(F.col(arr), lambda x, i: F.coalesce(test(x, i), F.lit(False)))
    return F.coalesce(F.forall(marks, lambda m: m), F.lit(True))
