"""Queries on ordered items (conversations), runs (events by user) and decisions (labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators import gate, ledger, merge, ordered, selection
from sheafline.plans.items import table


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


UNIT, ORDER = ["conv_id"], ["turn"]


def context_carry_forward(spark, sf_dir):
    """System turns set the context, assistant turns that follow a long answer reset it."""
    c = conversations(spark, sf_dir)
    sets, resets = F.col("role") == "system", (F.col("role") == "assistant") & (F.length("text") > 1500)
    out = ordered.carry_forward(c, UNIT, ORDER, F.md5("text"), sets, resets, "context")
    return out.select("conv_id", "turn", "role", "context")


def context_change_items(spark, sf_dir):
    c = ordered.carry_forward(conversations(spark, sf_dir), UNIT, ORDER, F.md5("text"), F.col("role") == "system", F.length("text") > 2500, "context")
    asked = c.where("role = 'user'")
    asked = ordered.changed(asked, UNIT, ORDER, F.col("context"))
    kinds = F.when(F.col("changed"), F.when(F.col("context").isNull(), F.array(F.lit("reset_context"), F.lit("question"))).otherwise(F.array(F.lit("context"), F.lit("question")))).otherwise(F.array(F.lit("question")))
    return asked.select("conv_id", "turn", F.posexplode(kinds).alias("part", "item_type"))


def prelude_once(spark, sf_dir):
    c = conversations(spark, sf_dir)
    key = F.when(F.col("role") != "assistant", F.col("role"))
    return c.select("conv_id", "turn", ordered.prelude(c, UNIT, ORDER, key, "once").alias("sends"))


def item_numbering(spark, sf_dir):
    out = ordered.numbered(conversations(spark, sf_dir), UNIT, ORDER, F.col("role") == "user", "q", "q-")
    return out.select("conv_id", "turn", F.col("q_index").cast("long").alias("q_index"), "q_id")


def event_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    e = ordered.islands(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") != "error", F.col("event_type")))
    return e.groupBy("user_id").agg(F.countDistinct("island").alias("runs"), F.count(F.lit(1)).alias("events"))


def blank_runs(spark, sf_dir):
    out = ordered.blanks_before(conversations(spark, sf_dir), UNIT, ORDER, F.length("text") < 400)
    return out.select("conv_id", "turn", F.col("blank_before").cast("long").alias("blank_before"))


def split_three_parts(spark, sf_dir):
    d = ordered.thirds(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 200)
    return d.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def balanced_pack(spark, sf_dir):
    sized = conversations(spark, sf_dir).select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return ordered.pack(sized, "conv_id", "turn", "size", 3).select("conv_id", "turn", "part")


def chunk_ownership(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") + 1).alias("pos"))
    n = d.agg(F.max("pos").alias("total"))
    seen = d.crossJoin(F.broadcast(n)).select("doc_id", "pos", ordered.chunk_owner(F.col("pos")).alias("owner"), F.explode(ordered.chunks_seeing(F.col("pos"), F.col("total"))).alias("chunk"))
    return seen.groupBy("chunk").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("owner") == F.col("chunk")).alias("owned"))


def nearest_anchor(spark, sf_dir):
    out = ordered.nearest(conversations(spark, sf_dir), UNIT, "turn", F.col("role") == "assistant", 8, 5, "anchor")
    return out.select("conv_id", "turn", "anchor")


def conditional_propagation(spark, sf_dir):
    """A turn inherits the context if it shares a long word of it, or refers to it."""
    c = ordered.carry_forward(conversations(spark, sf_dir), UNIT, ORDER, F.lower("text"), F.col("role") == "system", F.lit(False), "context")
    low = F.lower("text")
    inherits = F.col("context").isNotNull() & (F.contains(low, F.lit("this")) | F.exists(T.title_tokens(F.col("context")), lambda t: F.contains(low, t)))
    return c.where("role = 'user'").select("conv_id", "turn", inherits.alias("inherits"))


def disambiguate_duplicates(spark, sf_dir):
    """Names of parts of one brand are made different; every ninth part is named like the second of some name."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat("p_name", F.lit(" (контекст 2)"))).when(F.col("p_partkey") % 50 == 7, F.concat("p_name", F.lit(" (контекст 2) (контекст 1)"))).otherwise(F.col("p_name"))
    named = p.select(F.substring("p_brand", 1, 7).alias("brand"), "p_partkey", name.alias("name"))
    return selection.made_different(named, "brand", "p_partkey", "name").select("p_partkey", "title")


# ------------------------------------------------------------------ selection in order
def limited_rows(spark, sf_dir):
    """Documents from an id on, up to a limit; a limit of 0 gives one row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return selection.limited(d, "doc_id", 37, 250).withColumn("kind", F.lit("some")).unionByName(selection.limited(d, "doc_id", 100, 0).withColumn("kind", F.lit("none")))


def list_failures(spark, sf_dir):
    """Turns as lists of one role and length class: the first text that came before, else lists that are too long."""
    c = conversations(spark, sf_dir).select(F.concat_ws(" ", "role", (F.length("text") % 97).cast("string")).alias("list"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.substring_index("text", " ", 2).alias("text"))
    return selection.list_failures(c, "list", "pos", "text")


def merged_in_order(spark, sf_dir):
    """Documents with labels put over them, numbered by id, up to the first that is toxic and of low quality."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("unlabelled").alias("state"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat_ws(" ", "quality", "toxic").alias("state"))
    return selection.until_first(selection.merged_in_order(d, new, "doc_id"), "doc_id", (F.col("state") == "0 1") & (F.col("doc_id") > 100))


# ------------------------------------------------------------------ decisions
def _issues(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("index"), "n_chars")
    code = F.when(F.col("n_chars") > 4000, "text_too_long").when(F.col("n_chars") < 300, "short_context").when(F.pmod("index", F.lit(7)) == 0, "possible_duplicate_question")
    severity = F.when(F.col("n_chars") > 4000, "error").otherwise("warning")
    return d.select("source", code.alias("code"), "index", severity.alias("severity")).where("code IS NOT NULL")


def _decisions(spark, sf_dir) -> DataFrame:
    codes = F.explode(F.array(*[F.lit(c) for c in ("text_too_long", "short_context", "possible_duplicate_question")]))
    action = F.when(F.col("toxic") == 1, "skip_question").otherwise("confirm")
    return table(spark, sf_dir, "labels").select(codes.alias("code"), F.col("doc_id").alias("index"), action.alias("action"), F.lit(0).alias("decided_at"))


def decision_join(spark, sf_dir):
    return gate.resolved(_issues(spark, sf_dir), _decisions(spark, sf_dir)).select("source", "code", "index", "severity", "action", "resolved")


def upload_gate(spark, sf_dir):
    out = gate.upload_gate(_issues(spark, sf_dir), _decisions(spark, sf_dir), "source")
    return out


def skipped_rows(spark, sf_dir):
    return gate.skipped_rows(_issues(spark, sf_dir), _decisions(spark, sf_dir), "source")


def stale_gate(spark, sf_dir):
    return gate.upload_gate(_issues(spark, sf_dir), _decisions(spark, sf_dir), "source", stale=True)


def warning_buckets(spark, sf_dir):
    return gate.warning_buckets(_issues(spark, sf_dir), ["source", "code"])


ISSUES_SQL = """
WITH issues AS (SELECT * FROM (
  SELECT source, doc_id AS idx, CASE WHEN n_chars > 4000 THEN 'text_too_long' WHEN n_chars < 300 THEN 'short_context'
    WHEN doc_id % 7 = 0 THEN 'possible_duplicate_question' END AS code, CASE WHEN n_chars > 4000 THEN 'error' ELSE 'warning' END AS severity
  FROM documents) WHERE code IS NOT NULL),
r AS (
  SELECT i.*, CASE WHEN toxic = 1 THEN 'skip_question' WHEN toxic IS NOT NULL THEN 'confirm' END AS action FROM issues i LEFT JOIN labels ON doc_id = idx),
o AS (SELECT *, coalesce(CASE WHEN severity = 'error' THEN action = 'skip_question' ELSE action IN ('skip_question', 'confirm') END, false) AS resolved FROM r)
"""


# ------------------------------------------------------------------ merging and resuming
def upsert_newest_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    first = e.where("event_type <> 'click'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    second = e.where("event_type = 'click'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return merge.upsert(first, second, "user_id")


def resume_todo(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    review = labels.where("quality = 0").withColumn("reason", F.when(F.col("toxic") == 1, "gpt_request_failed").otherwise("bad_json"))
    done = merge.done_ids(labels.where("quality = 1"), review, "doc_id", "reason")
    return merge.todo(table(spark, sf_dir, "documents").select("doc_id", "source"), done, "doc_id", start=100)


def normalize_with_retries(spark, sf_dir):
    """With a stand-in for the model: some rows need a second attempt, some never succeed."""

    def attempt(row, error):
        if row["id"] % 11 == 0:
            return False, "bad_json"
        return (row["id"] % 3 != 0 or error is not None), "missing_required_field"

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return merge.normalise_with_retries(rows, attempt)


# ------------------------------------------------------------------ runs
def _runs(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "uploaded").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "error", "undone")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("index"))
    return e.where("kind IS NOT NULL")


RUNS_SQL = """
WITH runs AS (SELECT * FROM (
  SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'uploaded' WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'undone' END AS kind,
    CAST(json_extract(props, '$.k') AS INTEGER) AS idx FROM events) WHERE kind IS NOT NULL),
net AS (SELECT user_id, idx, arg_max(kind, event_id) AS kind, max(event_id) AS last FROM runs GROUP BY 1, 2),
state AS (SELECT user_id, count(*) FILTER (kind = 'uploaded') AS uploaded, count(*) FILTER (kind = 'skipped') AS skipped,
  count(*) FILTER (kind = 'undone') AS undone, max(CASE WHEN kind <> 'undone' THEN idx END) + 1 AS next_index, arg_max(kind, last) AS last_kind
  FROM net GROUP BY 1)
"""


def run_snapshot(spark, sf_dir):
    return ledger.snapshot(_runs(spark, sf_dir), "user_id", "event_id")


def job_event_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "error", F.col("value")).alias("error"), F.when(F.col("event_type") == "view", F.col("props")).alias("stage")
    )
    return ledger.fold_jobs(e, "user_id", "event_id", ["error", "stage"])


def eta_seconds(spark, sf_dir):
    s = ledger.snapshot(_runs(spark, sf_dir), "user_id", "event_id")
    speed = F.get(F.array(*[F.lit(x) for x in ("normal", "fast", "slow", "auto")]), F.pmod("user_id", F.lit(4)).cast("int"))
    total = F.lit(120)
    eta = ledger.eta_seconds(total, F.col("uploaded"), F.col("skipped"), speed, F.lit(2.0), F.lit("running"), F.lit(0))
    return s.select("user_id", eta.alias("eta"))


def cooldown_due(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", ledger.cooldown_due(F.col("n"), F.array(F.lit(80), F.lit(120))).alias("due"))


def continue_plan(spark, sf_dir):
    s = ledger.snapshot(_runs(spark, sf_dir), "user_id", "event_id")
    plan = ledger.continue_plan(F.lit(5), F.col("next_index"), F.lit(100), F.pmod("user_id", F.lit(110)).cast("int"))
    return s.select("user_id", plan.alias("plan"))


def probe_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("event_type") == "purchase").alias("confirmed"),
        F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("first_limit"), F.round(F.max("value"), 2).alias("slowest"),
    )


def error_classes(spark, sf_dir):
    texts = ["no answer", "Too many requests, retry", "wait for 30 s", "retry limit exhausted", "a timeout it is not"]
    kinds = ["TimeoutError", "", "FloodWaitError", "", "ValueError"]
    kind = F.get(F.array(*[F.lit(t) for t in kinds]), F.pmod("event_id", F.lit(5)).cast("int"))
    message = F.get(F.array(*[F.lit(t) for t in texts]), F.pmod("event_id", F.lit(5)).cast("int"))
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(ledger.error_class(message, kind).alias("c"))
    return e.groupBy(F.col("c.status").alias("status"), F.col("c.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def probe_classes(spark, sf_dir):
    """What ended a probe, by the type of an event and what its value makes of its message."""
    tens = F.floor("value").cast("long") % 10
    said = F.when(tens < 2, "TOO many incoming messages").when(tens < 4, "too many requests").when(tens == 4, "a FloodWait of a minute").when(tens == 5, "retry budget exhausted").otherwise("odd reply")
    kind = F.when(F.col("event_type") == "signup", "KeyboardInterrupt").when(F.col("event_type") == "view", "TimeoutError").when(F.col("event_type") == "click", "UnexpectedStateError").otherwise("ValueError")
    c = table(spark, sf_dir, "events").select(ledger.probe_class(F.concat_ws(" ", "props", said), kind).alias("c"))
    return c.groupBy("c.status", "c.code", "c.limit").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    probe_classes, context_carry_forward, context_change_items, prelude_once, item_numbering, event_islands, blank_runs, split_three_parts,
    balanced_pack, chunk_ownership, nearest_anchor, conditional_propagation, disambiguate_duplicates, decision_join, upload_gate,
    skipped_rows, stale_gate, limited_rows, list_failures, merged_in_order,
    warning_buckets, upsert_newest_wins, resume_todo, normalize_with_retries, run_snapshot, job_event_fold, eta_seconds,
    cooldown_due, continue_plan, probe_fold, error_classes,
)}

_CARRIED = "last_value({v} ignore nulls) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"

ORACLES = {
    "context_carry_forward": "SELECT conv_id, turn, role, nullif(" + _CARRIED.format(v="CASE WHEN role = 'system' THEN md5(text) WHEN role = 'assistant' AND length(text) > 1500 THEN '' END") + ", '') AS context FROM conversations",
    "context_change_items": "WITH c AS (SELECT *, nullif(" + _CARRIED.format(v="CASE WHEN role = 'system' THEN md5(text) WHEN length(text) > 2500 THEN '' END") + """, '') AS context FROM conversations),
u AS (SELECT *, lag(context) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM context AS changed FROM c WHERE role = 'user'),
p AS (SELECT conv_id, turn, CASE WHEN changed THEN [CASE WHEN context IS NULL THEN 'reset_context' ELSE 'context' END, 'question'] ELSE ['question'] END AS kinds FROM u)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS part, kinds[i] AS item_type FROM (SELECT *, unnest(generate_series(1, len(kinds))) AS i FROM p)""",
    "prelude_once": """SELECT conv_id, turn, k IS NOT NULL AND lag(k) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM k AS sends
FROM (SELECT *, CASE WHEN role <> 'assistant' THEN role END AS k FROM conversations)""",
    "item_numbering": """SELECT conv_id, turn, CAST(n AS BIGINT) AS q_index, CASE WHEN role = 'user' THEN 'q-' || lpad(CAST(CAST(n AS BIGINT) AS VARCHAR), 4, '0') END AS q_id
FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations)""",
    "event_islands": """SELECT user_id, CAST(sum(s) AS BIGINT) AS runs, count(*) AS events FROM (
  SELECT user_id, CASE WHEN k IS NULL OR lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM k THEN 1 ELSE 0 END AS s
  FROM (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS k FROM events)) GROUP BY 1""",
    "blank_runs": """SELECT conv_id, turn, turn_no - 1 - coalesce(max(CASE WHEN NOT b THEN turn_no END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blank_before
FROM (SELECT *, length(text) < 400 AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations)""",
    "split_three_parts": """SELECT source, part, count(*) AS n, min(doc_id) AS first_id FROM (
  SELECT source, doc_id, CAST(least(floor((rn - 1) / least(200, ceil(n / 3))), 2) AS INTEGER) AS part FROM (
    SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)) GROUP BY 1, 2""",
    "balanced_pack": """WITH RECURSIVE s AS (
  SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
    sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text) AS placed,
    sum(length(text)) OVER (PARTITION BY conv_id) / 3.0 AS target FROM conversations),
p AS (SELECT conv_id, turn, rn, CASE WHEN placed >= target THEN 1 ELSE 0 END AS part FROM s WHERE rn = 1
  UNION ALL SELECT s.conv_id, s.turn, s.rn, CASE WHEN p.part < 2 AND s.placed >= s.target * (p.part + 1) THEN p.part + 1 ELSE p.part END
  FROM p JOIN s ON s.conv_id = p.conv_id AND s.rn = p.rn + 1)
SELECT conv_id, turn, CAST(part AS INTEGER) AS part FROM p""",
    "chunk_ownership": """WITH d AS (SELECT doc_id + 1 AS pos, max(doc_id + 1) OVER () AS total FROM documents),
e AS (SELECT pos, (pos - 1) // 240 AS owner, unnest(generate_series((pos - 1) // 240, greatest((pos - 1) // 240, (least(pos + 100, total) - 1) // 240))) AS chunk FROM d)
SELECT CAST(chunk AS INTEGER) AS chunk, count(*) AS seen, count(*) FILTER (owner = chunk) AS owned FROM e GROUP BY 1""",
    "nearest_anchor": """SELECT c.conv_id, c.turn, coalesce(min(a.turn) FILTER (a.turn BETWEEN c.turn AND c.turn + 8), max(a.turn) FILTER (a.turn BETWEEN c.turn - 5 AND c.turn - 1)) AS anchor
FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.role = 'assistant' GROUP BY 1, 2""",
    "conditional_propagation": "SELECT conv_id, turn, context IS NOT NULL AND (contains(lower(text), 'this') OR len(list_filter(regexp_extract_all(context, '[" + T.LETTER + "]+'), lambda t: length(t) >= 5 AND contains(lower(text), t))) > 0) AS inherits FROM (SELECT *, " + _CARRIED.format(v="CASE WHEN role = 'system' THEN lower(text) END") + " AS context FROM conversations) WHERE role = 'user'",
    "disambiguate_duplicates": """WITH RECURSIVE p AS (
  SELECT substr(p_brand, 1, 7) AS brand, p_partkey AS pos, CASE WHEN p_partkey % 9 = 0 THEN p_name || ' (контекст 2)' WHEN p_partkey % 50 = 7 THEN p_name || ' (контекст 2) (контекст 1)' ELSE p_name END AS name FROM part),
d AS (SELECT *, lower(trim(name)) AS key, row_number() OVER (PARTITION BY brand, lower(trim(name)) ORDER BY pos) AS n FROM p),
g AS (
  SELECT brand, pos, name || ' (контекст ' || n || ')' AS title FROM d WHERE n > 1
  UNION SELECT d.brand, d.pos, d.name || ' (контекст 1)' FROM g JOIN d ON d.brand = g.brand AND d.key = lower(trim(g.title)) AND d.n = 1 AND d.pos > g.pos)
SELECT d.pos AS p_partkey, coalesce(g.title, d.name) AS title FROM d LEFT JOIN g ON g.brand = d.brand AND g.pos = d.pos""",
    "skipped_rows": ISSUES_SQL + "SELECT DISTINCT source, idx AS \"index\" FROM o WHERE resolved AND action = 'skip_question'",
    "stale_gate": ISSUES_SQL + "SELECT DISTINCT source, 'review_required' AS status, 'review_decisions_stale' AS reason, 0 AS n_skipped FROM o",
    "limited_rows": """SELECT doc_id, source, 'some' AS kind FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id >= 37) WHERE n <= 250
UNION ALL SELECT doc_id, source, 'none' FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE doc_id >= 100)""",
    "list_failures": """WITH c AS (
  SELECT role || ' ' || (length(text) % 97) AS list, conv_id * 1000 + turn AS pos, lower(trim(array_to_string(string_split(text, ' ')[1:2], ' '))) AS key FROM conversations),
r AS (SELECT *, min(pos) OVER (PARTITION BY list, key) AS first FROM c),
f AS (SELECT list, min(pos) AS duplicate, arg_min(first, pos) AS original FROM r WHERE pos > first GROUP BY 1)
SELECT list, count(*) AS rows, any_value(duplicate) AS duplicate, any_value(original) AS original,
  CASE WHEN any_value(duplicate) IS NOT NULL THEN 'duplicate_question' WHEN count(*) > 200 THEN 'too_many_questions' END AS code FROM c LEFT JOIN f USING (list) GROUP BY 1""",
    "merged_in_order": """WITH m AS (SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE quality || ' ' || toxic END AS state FROM documents d FULL JOIN labels l USING (doc_id)),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place FROM m)
SELECT * FROM n WHERE doc_id <= coalesce((SELECT min(doc_id) FROM n WHERE state = '0 1' AND doc_id > 100), (SELECT max(doc_id) FROM n))""",
    "decision_join": ISSUES_SQL + 'SELECT source, code, idx AS "index", severity, action, resolved FROM o',
    "upload_gate": ISSUES_SQL + """SELECT source, CASE WHEN e THEN 'blocked' WHEN w THEN 'review_required' ELSE 'allowed' END AS status,
  CASE WHEN e THEN 'hard_errors_unresolved' WHEN w THEN 'warnings_unresolved' ELSE 'validation_resolved' END AS reason, n_skipped FROM (
  SELECT source, bool_or(severity = 'error' AND NOT resolved) AS e, bool_or(severity = 'warning' AND NOT resolved) AS w,
    count(DISTINCT CASE WHEN resolved AND action = 'skip_question' THEN idx END) AS n_skipped FROM o GROUP BY 1)""",
    "warning_buckets": ISSUES_SQL + "SELECT source, code, count(*) AS n FROM o WHERE severity = 'warning' GROUP BY 1, 2 HAVING count(*) > 1",
    "upsert_newest_wins": """SELECT user_id, coalesce(arg_max(value, event_id) FILTER (event_type = 'click'), arg_max(value, event_id) FILTER (event_type <> 'click')) AS value
FROM events GROUP BY 1""",
    "resume_todo": "SELECT doc_id, source FROM documents WHERE doc_id >= 100 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic <> 1)",
    "normalize_with_retries": """SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'review' ELSE 'clean' END AS outcome, CASE WHEN doc_id % 11 = 0 THEN 'bad_json' END AS reason,
  CAST(CASE WHEN doc_id % 11 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS tries FROM documents""",
    "run_snapshot": RUNS_SQL + "SELECT * FROM state",
    "job_event_fold": """SELECT user_id, count(*) AS events, max(event_id) AS last, arg_max(value, event_id) FILTER (event_type = 'error') AS error,
  arg_max(props, event_id) FILTER (event_type = 'view') AS stage FROM events GROUP BY 1""",
    "eta_seconds": RUNS_SQL + """, p AS (SELECT *, [4.5, 2.25, 8.0, 2.25][user_id % 4 + 1] + [30.0, 7.5, 75.0, 7.5][user_id % 4 + 1] + 2.0 AS each,
  [10, 10, 8, 10][user_id % 4 + 1] AS every, [90.0, 27.5, 240.0, 27.5][user_id % 4 + 1] AS pause FROM state)
SELECT user_id, CAST(floor(CASE WHEN 120 > least(120, uploaded + skipped) THEN (120 - least(120, uploaded + skipped)) * each
  + greatest(120 // every - uploaded // every, 0) * pause
  + CASE WHEN user_id % 4 = 3 THEN greatest(119 // 40 - greatest(uploaded - 1, 0) // 40, 0) * 360.0 ELSE 0.0 END ELSE 0.0 END) AS BIGINT) AS eta FROM p""",
    "cooldown_due": """SELECT user_id, CASE WHEN n // 40 * 40 > 0 AND n // 40 * 40 NOT IN (80, 120) THEN CAST(n // 40 * 40 AS INTEGER) END AS due
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""",
    "continue_plan": RUNS_SQL + """SELECT user_id, CASE WHEN user_id % 110 < 5 OR user_id % 110 > 101 THEN 'error' WHEN user_id % 110 = next_index THEN 'resume'
  WHEN user_id % 110 < next_index THEN 'rollback' ELSE 'skip' END AS plan FROM state""",
    "probe_fold": """SELECT user_id, count(*) AS attempted, count(*) FILTER (event_type = 'purchase') AS confirmed,
  min(event_id) FILTER (event_type = 'error') AS first_limit, round(max(value), 2) AS slowest FROM events GROUP BY 1""",
    "probe_classes": """WITH e AS (SELECT event_type AS k, CAST(floor(value) AS BIGINT) % 10 AS t FROM events),
c AS (SELECT CASE k WHEN 'signup' THEN 'paused_by_user' WHEN 'view' THEN 'telegram_timeout' WHEN 'click' THEN 'unexpected_bot_state' ELSE
  CASE WHEN t < 2 THEN 'telegram_too_many_incoming_messages' WHEN t < 4 THEN 'telegram_too_many_requests' WHEN t = 4 THEN 'telegram_flood_wait' ELSE 'speed_probe_failed' END END AS code FROM e)
SELECT CASE WHEN code IN ('unexpected_bot_state', 'speed_probe_failed') THEN 'failed' ELSE 'paused' END AS status, code, starts_with(code, 'telegram_') AS "limit", count(*) AS n FROM c GROUP BY ALL""",
    "error_classes": """SELECT ['paused', 'paused', 'paused', 'paused', 'failed'][event_id % 5 + 1] AS status,
  ['telegram_timeout', 'telegram_too_many_requests', 'telegram_flood_wait', 'telegram_retry_exhausted', 'upload_failed'][event_id % 5 + 1] AS code, count(*) AS n
FROM events WHERE event_type = 'error' GROUP BY 1, 2""",
}
