"""From checks to blockers, verdict, score and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import is_fresh, normalize_domain, ratio
from ..skew import latest_per_key

# Weight of a severity, credit of a status, and the two display orders of statuses.
WEIGHT = {"blocker": 3, "recommended": 2, "nice_to_have": 1}
CREDIT = {"pass": 1.0, "warn": 0.5, "fail": 0.0}
STATUSES = ("pass", "warn", "fail", "skip")
REPORT_ORDER = ("fail", "warn", "skip", "pass")
GATE_ORDER = ("fail", "warn", "pass", "skip")


def _has(check: Column, *statuses: str) -> Column:
    return check["status"].isin(*statuses)


def blockers_of(checks: Column) -> Column:
    failed = F.filter(checks, lambda x: (x["severity"] == "blocker") & _has(x, "fail"))
    return F.transform(failed, lambda x: x["id"])


def audit_verdict(audits: DataFrame) -> DataFrame:
    """blocked if any blocker fails, ready_with_warnings if anything fails or warns, else ready."""
    blockers = blockers_of(F.col("checks"))
    verdict = (
        F.when(F.size("blockers") > 0, "blocked")
        .when(F.exists("checks", lambda x: _has(x, "fail", "warn")), "ready_with_warnings")
        .otherwise("ready")
    )
    return (
        audits.withColumn("blockers", blockers)
        .withColumn("verdict", verdict)
        .withColumn("blocked", F.col("verdict") == "blocked")
    )


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, b: a + b)


def audit_score(audits: DataFrame) -> DataFrame:
    """Weighted credit over the graded checks, 0..100, half to even; 100 when nothing is graded."""
    def weight(x: Column) -> Column:
        return F.coalesce(*[F.when(x["severity"] == s, F.lit(float(w))) for s, w in WEIGHT.items()])

    def credit(x: Column) -> Column:
        return F.coalesce(*[F.when(x["status"] == s, F.lit(v)) for s, v in CREDIT.items()])

    graded = F.filter("checks", lambda x: ~_has(x, "skip"))
    total = _total(F.transform(graded, weight))
    earned = _total(F.transform(graded, lambda x: weight(x) * credit(x)))
    score = F.coalesce(F.bround(ratio(earned * 100, total), 0), F.lit(100.0)).cast("int")
    return audits.withColumn("score", score)


def audit_status_counts(audits: DataFrame) -> DataFrame:
    def number(status: str) -> Column:
        return F.size(F.filter("checks", lambda x: _has(x, status)))

    return audits.withColumns({f"n_{s}": number(s) for s in STATUSES})


def with_verdict(audits: DataFrame) -> DataFrame:
    return audit_status_counts(audit_score(audit_verdict(audits)))


def status_rank(status: Column, order: tuple[str, ...] = REPORT_ORDER) -> Column:
    return F.coalesce(*[F.when(status == s, F.lit(i)) for i, s in enumerate(order)], F.lit(99))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(i)) for i, s in enumerate(WEIGHT)], F.lit(99))


def audit_check_order(checks: Column, by_severity: bool = False) -> Column:
    """Checks in display order: fail, warn, skip, pass, then id; or fail, warn, pass, skip, then severity, id."""
    order = GATE_ORDER if by_severity else REPORT_ORDER

    def keyed(x: Column) -> Column:
        rank = status_rank(x["status"], order)
        second = severity_rank(x["severity"]) if by_severity else F.lit(0)
        return F.struct(rank.alias("rank"), second.alias("second"), x["id"].alias("id"), x.alias("check"))

    return F.transform(F.sort_array(F.transform(checks, keyed)), lambda k: k["check"])


def audit_by_category(audits: DataFrame) -> DataFrame:
    """One row per check with its place inside its category."""
    ordered = audits.withColumn("checks", audit_check_order(F.col("checks")))
    rows = ordered.select(
        "target", "engine", F.posexplode("checks").alias("pos", "check"), "checks"
    )
    ahead = F.filter(
        F.slice(F.col("checks"), F.lit(1), F.col("pos")), lambda x: x["category"] == F.col("check.category")
    )
    return rows.select(
        "target", "engine", "check.category", (F.size(ahead) + 1).alias("position"), "check.id", "check.severity",
        "check.status", "check.detail", "check.remediation",
    )


def latest_audit(audits: DataFrame, strict_engine: bool = True) -> DataFrame:
    """Newest audit per domain and engine; or per domain of any engine.

    One engine's verdict never stands in for another's.
    """
    keys = ["domain", "engine"] if strict_engine else ["domain"]
    rows = audits.where(F.col("engine").isNotNull()) if strict_engine else audits
    keep = [c for c in audits.columns if c not in keys]
    return latest_per_key(rows, keys, ["checked_at", "audit_id"], keep)


def brand_audit_join(brands: DataFrame, audits: DataFrame, strict_engine: bool = True) -> DataFrame:
    """Brands with the newest audit of their registrable domain."""
    named = brands.select("brand_id", normalize_domain(F.col("domain")).alias("domain")).where(
        F.col("domain") != ""
    )
    return named.join(latest_audit(audits, strict_engine), "domain", "left")


def audit_refresh_list(
    sites: DataFrame, audits: DataFrame, now: Column | None = None, max_age_s: int = 86_400
) -> DataFrame:
    """(domain, engine) pairs to audit: never audited for that engine, or too long ago.

    Without an engine the newest audit of any engine counts.
    """
    moment = F.current_timestamp() if now is None else now
    wanted = sites.select("domain", "engine").distinct()
    own = latest_audit(audits).select("domain", "engine", "checked_at")
    of_any = latest_audit(audits, strict_engine=False).select("domain", "checked_at")
    seen = wanted.where(F.col("engine").isNotNull()).join(own, ["domain", "engine"], "left").unionByName(
        wanted.where(F.col("engine").isNull()).join(of_any, "domain", "left")
    )
    return seen.where(~is_fresh(F.col("checked_at"), moment, max_age_s))
