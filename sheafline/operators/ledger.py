"""Folding run and job events, time estimates and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pacing presets as (message, question, pause low, pause high, pause every) in seconds.
SPEEDS = {
    "normal": (4.5, 30.0, 60.0, 120.0, 10),
    "fast": (2.25, 7.5, 20.0, 35.0, 10),
    "slow": (8.0, 75.0, 180.0, 300.0, 8),
    "auto": (2.25, 7.5, 20.0, 35.0, 10),
}
COOLDOWN_EVERY, COOLDOWN_LOW, COOLDOWN_HIGH = 40, 300.0, 420.0
TERMINAL = ("completed", "cancelled", "cancelled_replaced")


def _by_speed(speed: Column, value) -> Column:
    out = F.lit(None).cast("double")
    for name, preset in SPEEDS.items():
        out = F.when(speed == name, F.lit(float(value(preset)))).otherwise(out)
    return out


def multiples(step: Column, after: Column, upto: Column) -> Column:
    """How many multiples of step lie in (after, upto]."""
    return F.greatest(F.floor(upto / step) - F.floor(after / step), F.lit(0))


def eta_seconds(total: Column, uploaded: Column, skipped: Column, speed: Column, bot: Column, status: Column, cooldowns_done: Column) -> Column:
    """Whole seconds that a run still takes."""
    left = total - F.least(total, uploaded + skipped)
    each = _by_speed(speed, lambda p: p[0]) + _by_speed(speed, lambda p: p[1]) + bot
    pauses = multiples(_by_speed(speed, lambda p: p[4]), uploaded, total) * _by_speed(speed, lambda p: (p[2] + p[3]) / 2)
    due = F.greatest(multiples(F.lit(COOLDOWN_EVERY), F.greatest(uploaded - 1, F.lit(0)), total - 1) - cooldowns_done, F.lit(0))
    cooling = F.when(speed == "auto", due * (COOLDOWN_LOW + COOLDOWN_HIGH) / 2).otherwise(0.0)
    seconds = F.when(left > 0, left * each + pauses + cooling).otherwise(0.0)
    return F.when(status.isin(*TERMINAL), 0).otherwise(F.greatest(F.floor(seconds), F.lit(0))).cast("long")


def cooldown_due(uploaded: Column, completed: Column) -> Column:
    """The threshold that has been reached and not cooled down for, else null."""
    at = (F.floor(uploaded / COOLDOWN_EVERY) * COOLDOWN_EVERY).cast("int")
    return F.when((at > 0) & ~F.array_contains(completed, at), at)


def continue_plan(start: Column, next_index: Column, count: Column, target: Column) -> Column:
    """What continuing from a question means for the run."""
    return (
        F.when((target < start) | (target > count + 1), "error")
        .when(target == next_index, "resume")
        .when(target < next_index, "rollback")
        .otherwise("skip")
    )


def error_class(message: Column, kind: Column | None = None) -> Column:
    """struct(status, code: fixed values) of an error by its kind (the name of its class), then by what its message says."""
    low, kind = F.lower(message), F.lower(F.coalesce(kind if kind is not None else F.lit(""), F.lit("")))
    has = lambda s: F.contains(low, F.lit(s))
    code = (
        F.when(F.contains(kind, F.lit("timeout")), "telegram_timeout")
        .when(F.contains(kind, F.lit("unexpectedstate")), "unexpected_bot_state")
        .when(has("too many incoming messages"), "telegram_too_many_incoming_messages")
        .when(has("too many requests"), "telegram_too_many_requests")
        .when(has("floodwait") | F.contains(kind, F.lit("floodwait")), "telegram_flood_wait")
        .when(has("retry") & has("exhaust"), "telegram_retry_exhausted")
        .otherwise("upload_failed")
    )
    status = F.when(code.isin("unexpected_bot_state", "upload_failed"), "failed").otherwise("paused")
    return F.struct(status.alias("status"), code.alias("code"))


def probe_class(message: Column, kind: Column) -> Column:
    """struct(status, code, limit: whether the other side set a limit) of what ended a probe: as error_class(), but a retry limit is no
    case of its own, an interruption by the user pauses without being a limit, and all else fails the probe.
    """
    told, low = error_class(message, kind), F.lower(F.coalesce(kind, F.lit("")))
    by_user = F.contains(low, F.lit("interrupt")) | F.contains(low, F.lit("cancelled"))
    known = ~told["code"].isin("upload_failed", "telegram_retry_exhausted")
    code = F.when(by_user, "paused_by_user").when(known, told["code"]).otherwise("speed_probe_failed")
    status = F.when(by_user, "paused").when(known, told["status"]).otherwise("failed")
    return F.struct(status.alias("status"), code.alias("code"), (~by_user & known & (told["status"] == "paused")).alias("limit"))


def snapshot(events: DataFrame, run: str, order: str) -> DataFrame:
    """State of each run: counts of its net events, the pointer, the last values set."""
    net = events.groupBy(run, "index").agg(F.max_by("kind", order).alias("kind"), F.max(order).alias("at"))
    return net.groupBy(run).agg(
        F.count_if(F.col("kind") == "uploaded").alias("uploaded"),
        F.count_if(F.col("kind") == "skipped").alias("skipped"),
        F.count_if(F.col("kind") == "undone").alias("undone"),
        (F.max(F.when(F.col("kind").isin("uploaded", "skipped"), F.col("index"))) + 1).alias("next_index"),
        F.max_by("kind", "at").alias("last_kind"),
    )


def fold_jobs(events: DataFrame, job: str, order: str, fields: list[str]) -> DataFrame:
    """The last value of each field that is not null, by job."""
    latest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return events.groupBy(job).agg(F.count(F.lit(1)).alias("events"), F.max(order).alias("last"), *latest)
