"""Queries that run as streams: job states, resumptions, net runs, tails. Users of the events table stand for jobs and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheafline.plans.items import table
from sheafline.scratch import scratch, written
from sheafline.streaming import stateful, tail
from sheafline.streaming import upload as uploads

STEPS = 3


def _step(spark, sf_dir, steps):
    """The step (0 to steps - 1) of an event by its id, which follows time."""
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return F.floor(F.col("seq") * steps / F.lit(last + 1))


# ------------------------------------------------------------------ states of jobs
JOB_COLUMNS = """user_id AS job, event_id AS seq,
  CASE WHEN event_id % 97 = 0 THEN 'complete' WHEN event_id % 89 = 0 THEN 'fail' WHEN event_id % 53 = 0 THEN 'cancel' ELSE 'emit' END AS kind,
  CASE WHEN event_type = 'view' THEN props END AS stage, CASE WHEN event_type = 'click' THEN CAST(floor(value * 3) AS INT) - 20 END AS progress,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS INT) - 10 END AS eta, CASE WHEN event_type = 'signup' THEN concat('group ', CAST(event_id % 7 AS {text})) END AS grp,
  concat('event ', CAST(event_id AS {text})) AS message, CASE WHEN event_type = 'error' THEN props END AS warning, CASE WHEN event_id % 11 = 0 THEN props END AS result"""


def job_state_stream(spark, sf_dir):
    """Every job folded in a stream that is stopped and started again twice; the last row of each job."""
    e = table(spark, sf_dir, "events").selectExpr(*_split(JOB_COLUMNS.format(text="STRING")))
    out = stateful.restarted(spark, e, _step(spark, sf_dir, STEPS), STEPS, stateful.job_states, scratch(spark, "jobs"))
    fields = [c.split()[0] for c in stateful.JOB_STATE.split(", ")]
    last = out.groupBy("job").agg(F.max_by(F.struct(*fields), "seq").alias("e"))
    return last.select("job", "e.*")


def _split(columns: str) -> list[str]:
    """The columns of a list, cut at commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


JOBS = f"""
WITH e AS (SELECT {JOB_COLUMNS.format(text="VARCHAR")} FROM events),
t AS (SELECT *, coalesce(max(kind IN ('complete', 'fail')) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM e),
l AS (SELECT * FROM t WHERE NOT (kind = 'cancel' AND over))
SELECT t.job, max(t.seq) AS seq,
  coalesce(any_value(f.status), CASE WHEN bool_or(t.kind = 'emit') THEN 'running' ELSE 'queued' END) AS status,
  arg_max(stage, t.seq) FILTER (t.kind = 'emit' AND stage IS NOT NULL) AS stage,
  coalesce(arg_max(CASE WHEN t.kind = 'emit' THEN greatest(0, least(100, progress)) ELSE 100 END, t.seq) FILTER (t.kind IN ('complete', 'fail') OR t.kind = 'emit' AND progress IS NOT NULL), 0) AS progress,
  arg_max(greatest(0, eta), t.seq) FILTER (t.kind = 'emit' AND eta IS NOT NULL) AS eta, arg_max(grp, t.seq) FILTER (t.kind = 'emit' AND grp IS NOT NULL) AS grp,
  any_value(s.step) AS step, arg_max(result, t.seq) FILTER (t.kind IN ('emit', 'complete') AND result IS NOT NULL) AS result, arg_max(message, t.seq) FILTER (t.kind = 'fail') AS error,
  bool_or(t.kind = 'cancel') AS cancel, coalesce(any_value(s.n), 0) AS n_logs, count(*) FILTER (t.kind = 'emit' AND warning IS NOT NULL) AS n_warnings
FROM t LEFT JOIN (SELECT job, CASE arg_max(kind, seq) WHEN 'complete' THEN 'completed' ELSE 'failed' END AS status FROM e WHERE kind IN ('complete', 'fail') GROUP BY job) f USING (job)
LEFT JOIN (SELECT job, count(*) AS n, arg_max(CASE kind WHEN 'complete' THEN 'job completed' WHEN 'cancel' THEN 'cancel requested' ELSE message END, seq) AS step FROM l GROUP BY job) s USING (job)
GROUP BY t.job
"""


# ------------------------------------------------------------------ resumptions
def resume_firings(spark, sf_dir):
    """When each run is resumed: errors ask for it after their delay, any other event of the run calls it off."""
    at = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS at"
    e = table(spark, sf_dir, "events").selectExpr("user_id AS run", "event_id AS seq", at, "event_type IN ('error', 'view', 'click') AS needs", "CAST(floor(value * 900) AS INT) AS delay")
    return stateful.restarted(spark, e, _step(spark, sf_dir, STEPS), STEPS, stateful.resume_firings, scratch(spark, "firings")).select("run", "due", "attempt")


FIRINGS = """
WITH RECURSIVE e AS (
  SELECT user_id AS run, epoch_us(ts) // 1000 AS ms, event_type IN ('error', 'view', 'click') AS needs, CAST(floor(value * 900) AS BIGINT) AS delay,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
r AS (
  SELECT DISTINCT run, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS due, CAST(-1 AS BIGINT) AS fired, 0 AS attempt FROM e
  UNION ALL
  SELECT e.run, e.k, CASE WHEN NOT e.needs THEN -1 WHEN r.due >= 0 AND r.due > e.ms THEN r.due ELSE e.ms + 1000 * greatest(30, e.delay) END,
    CASE WHEN r.due >= 0 AND r.due <= e.ms THEN r.due ELSE -1 END, r.attempt + CASE WHEN r.due >= 0 AND r.due <= e.ms THEN 1 ELSE 0 END
  FROM r JOIN e ON e.run = r.run AND e.k = r.k + 1),
z AS (SELECT run, arg_max(due, k) AS due, arg_max(attempt, k) AS attempt FROM r GROUP BY run)
SELECT run, fired AS due, attempt FROM r WHERE fired >= 0
UNION ALL SELECT run, due, attempt + 1 FROM z WHERE due >= 0 AND due <= (SELECT max(ms) FROM e)
"""


# ------------------------------------------------------------------ net states of runs
BATCHES = 4


def net_run_states(spark, sf_dir):
    """After each micro-batch, the net state of every run that it touches: undone events are taken back."""
    kind = F.when(F.col("event_type") == "error", "undone").when(F.col("event_type") == "signup", "skipped").otherwise("uploaded")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_id") % 40).alias("index_"), kind.alias("kind"))
    step = _step(spark, sf_dir, BATCHES)
    out = stateful.restarted(spark, e, step, BATCHES, stateful.net_runs, scratch(spark, "net"))
    return out.select(F.col("batch").cast("long").alias("batch"), "run", "uploaded", "skipped", "undone", "next_index", "last_kind")


NET = f"""
WITH e AS (
  SELECT user_id AS run, event_id AS seq, event_id % 40 AS i, CASE event_type WHEN 'error' THEN 'undone' WHEN 'signup' THEN 'skipped' ELSE 'uploaded' END AS kind,
    floor(event_id * {BATCHES} / ((SELECT max(event_id) FROM events) + 1.0)) AS b FROM events),
n AS (SELECT t.b AS batch, run, i, arg_max(kind, seq) AS kind, max(seq) AS seq FROM e JOIN (SELECT DISTINCT b FROM e) t ON e.b <= t.b GROUP BY ALL)
SELECT CAST(batch AS BIGINT) AS batch, run, count(*) FILTER (kind = 'uploaded') AS uploaded, count(*) FILTER (kind = 'skipped') AS skipped, count(*) FILTER (kind = 'undone') AS undone,
  max(i) FILTER (kind <> 'undone') + 1 AS next_index, arg_max(kind, seq) AS last_kind
FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.run = n.run AND e.b = n.batch) GROUP BY batch, run
"""


# ------------------------------------------------------------------ tails
def tailed_jobs(spark, sf_dir):
    """Events followed from an offset until every job has ended and the source is drained: how many of each job came through."""
    path = scratch(spark, "tail")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"))
    last = e.groupBy("job").agg(F.max("seq").alias("end"))
    e.join(last, "job").select("job", "seq", (F.col("seq") == F.col("end")).alias("ends")).repartition(STEPS, "seq").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("job long, seq long, ends boolean").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    tail.tail(tail.after(stream, "seq", 100), F.col("ends"), last.where("end >= 100").count(), stateful.into_folders(f"{path}/out"), f"{path}/offsets")
    return spark.read.schema("job long, seq long, ends boolean").parquet(f"{path}/out").groupBy("job").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("last"), F.bool_or("ends").alias("ended"))


TAILED = "SELECT user_id AS job, count(*) AS events, max(event_id) AS \"last\", true AS ended FROM events WHERE event_id >= 100 GROUP BY 1"

QUERIES = {f.__name__: f for f in (job_state_stream, resume_firings, net_run_states, tailed_jobs)}
ORACLES = {"job_state_stream": JOBS, "resume_firings": FIRINGS, "net_run_states": NET, "tailed_jobs": TAILED}


# ------------------------------------------------------------------ paced uploads
def paced_uploads(spark, sf_dir):
    """Orders uploaded by customer: an upload that breaks in a task, one whose driver is lost, then two that end; each row once, with its planned start."""
    path = scratch(spark, "uploads")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey")
    rows = o.withColumn("index", F.row_number().over(Window.partitionBy("run").orderBy("o_orderkey")).cast("long"))
    speed = F.get(F.array(*[F.lit(x) for x in ("normal", "fast", "slow", "auto")]), F.pmod("run", F.lit(4)).cast("int"))
    rows = written(uploads.planned(rows, "run", "index", speed), "planned")
    for crash in ("task", "driver", "", ""):
        try:
            uploads.upload(rows, path, "run", "index", **({"crash": crash} if crash else {}))
        except Exception:  # what was planned to break
            if not crash:
                raise
    return uploads.ledger(spark, path, "run", "index").select("run", "index", "o_orderkey", "seconds", "starts_at", "times")


PACED = """
WITH o AS (SELECT o_custkey AS run, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
s AS (
  SELECT *, [4.5, 2.25, 8.0, 2.25][run % 4 + 1] + [30.0, 7.5, 75.0, 7.5][run % 4 + 1] + 2.0
    + CASE WHEN i % [10, 10, 8, 10][run % 4 + 1] = 0 THEN [90.0, 27.5, 240.0, 27.5][run % 4 + 1] ELSE 0.0 END AS seconds FROM o)
SELECT run, i AS "index", o_orderkey, CAST(seconds AS DOUBLE) AS seconds, CAST(sum(seconds) OVER (PARTITION BY run ORDER BY i) - seconds AS DOUBLE) AS starts_at, 2 AS times FROM s
"""
QUERIES["paced_uploads"] = paced_uploads
ORACLES["paced_uploads"] = PACED
