"""Decisions on issues, and the gate that they open or close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.operators.match import last_decision


def expand_groups(groups: DataFrame) -> DataFrame:
    """One decision for each question of a group decision."""
    return groups.select("issue_code", F.explode("indexes").alias("index"), "action", "decided_at")


def resolved(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """`issues` (unit, code, index, severity) with action and resolved.

    An error is resolved by skipping its question alone, and never without one; a warning by
    skipping or confirming, a possible duplicate also by sending both.
    """
    last = last_decision(decisions, ["code", "index"], "decided_at").select("code", "index", "action")
    joined = issues.join(last, ["code", "index"], "left")
    skip = F.col("action") == "skip_question"
    confirm = F.col("action") == "confirm"
    both = (F.col("code") == "possible_duplicate_question") & (F.col("action") == "send_both")
    ok = F.when(F.col("severity") == "error", skip & F.col("index").isNotNull()).otherwise(skip | confirm | both)
    return joined.withColumn("resolved", F.coalesce(ok, F.lit(False)))


def upload_gate(issues: DataFrame, decisions: DataFrame, unit: str, stale: bool = False) -> DataFrame:
    """(unit, status, reason, n_skipped) of every unit that has issues; skipped_rows() has the rows themselves.

    Issues are folded by unit and index first, then by unit, so that a unit with most of the issues is combined on its way.
    """
    found = resolved(issues, decisions)
    if stale:
        found = found.withColumn("resolved", F.lit(False))
    open_ = lambda severity: F.bool_or((F.col("severity") == severity) & ~F.col("resolved"))
    skips = F.bool_or(F.col("resolved") & (F.col("action") == "skip_question") & F.col("index").isNotNull())
    each = found.groupBy(unit, "index").agg(open_("error").alias("e"), open_("warning").alias("w"), skips.alias("s"))
    folded = each.groupBy(unit).agg(F.bool_or("e").alias("e"), F.bool_or("w").alias("w"), F.count_if("s").alias("n_skipped"))
    if stale:
        status, reason = F.lit("review_required"), F.lit("review_decisions_stale")
    else:
        status = F.when(F.col("e"), "blocked").when(F.col("w"), "review_required").otherwise("allowed")
        reason = F.when(F.col("e"), "hard_errors_unresolved").when(F.col("w"), "warnings_unresolved").otherwise("validation_resolved")
    return folded.select(unit, status.alias("status"), reason.alias("reason"), "n_skipped")


def skipped_rows(issues: DataFrame, decisions: DataFrame, unit: str) -> DataFrame:
    """(unit, index) of every question that a decision skips, once."""
    found = resolved(issues, decisions)
    return found.where((F.col("action") == "skip_question") & F.col("resolved") & F.col("index").isNotNull()).select(unit, "index").distinct()


def warning_buckets(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Kinds of warnings that come more than once."""
    return issues.where("severity = 'warning'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
