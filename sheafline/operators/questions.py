"""Building questions: types, distractors, markup by block ids, exports and imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.functions import values as V
from sheafline.operators.ordered import carry_forward

LONG_QUESTION = 250
READY_OPTIONS = 3
#: Defaults of the settings of a quiz.
DEFAULT_SETTINGS = {"time_limit": "30 sec", "shuffle_options": "true", "context_send_mode": "per-question"}
CONTEXT_MODES = ("per-question", "once")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


# ------------------------------------------------------------------ types and distractors
def question_type(question: Column, answer: Column, options: Column, media: Column, answers: Column) -> Column:
    """The type of a parsed question; what needs a review comes first."""
    plain = (
        F.when(F.size(media) > 0, "media_context_quiz").when(F.size(options) > 0, "multiple_choice")
        .when(F.length(question) > LONG_QUESTION, "long_question").when(F.length(answer) > T.OPTION_MAX, "short_answer_with_explanation")
        .otherwise("simple_quiz")
    )
    return (
        F.when(F.size(answers) == 0, "needs_answer_review").when(F.length(answer) > T.OPTION_MAX, "needs_option_length_review")
        .when(F.size(answers) > 1, "multiple_answer").otherwise(plain)
    )


def number_distractors(answer: Column) -> Column:
    """Neighbours of a century in Roman numerals ("XIX веке") or of a year of three or four digits; else empty."""
    clean = T.collapse(answer)
    numeral = F.upper(F.regexp_extract(clean, r"(?i)^([IVXLCDM]+)\s+веке$", 1))
    known = F.array(*[V.roman(F.lit(n)) for n in range(1, 22)])
    at = F.array_position(known, numeral).cast("int")
    centuries = F.slice(F.filter(F.array(at - 1, at + 1, at + 2, at - 2), lambda n: n.between(1, 21)), F.lit(1), F.lit(3))
    years = V.year_distractors(F.when(clean.rlike(r"^\d{3,4}$"), clean.cast("int")))
    return F.when(at > 0, F.transform(centuries, lambda n: F.concat(V.roman(n), F.lit(" веке")))).when(
        clean.rlike(r"^\d{3,4}$"), F.transform(years, lambda y: y.cast("string"))
    ).otherwise(_none("string"))


def keyword_distractors(combined: Column, answer: Column, rules: Sequence[tuple[Sequence[str], Sequence[str]]], fallbacks: Sequence[tuple[Sequence[str], Sequence[str]]] = ()) -> Column:
    """Up to three distractors of the first rule all of whose keywords occur; else of the first fallback with any.

    `rules` and `fallbacks` are small tables of (keywords, options) that the caller gives, in order.
    Options that are empty, too long, equal to the answer or to an earlier one are left out.
    """
    low, right = F.lower(combined), T.simple_key(answer)

    def usable(options: Sequence[str]) -> Column:
        kept = F.filter(F.array(*[F.lit(o) for o in options]), lambda o: (T.collapse(o) != "") & (F.length(o) <= T.OPTION_MAX) & (T.simple_key(o) != right))
        keys = F.transform(kept, T.simple_key)
        return F.slice(F.filter(kept, lambda o, i: F.array_position(keys, T.simple_key(o)) == i + 1), F.lit(1), F.lit(3))

    out = _none("string")
    for words, options in reversed(list(fallbacks)):
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        out = F.when(hit, usable(options)).otherwise(out)
    for words, options in reversed(list(rules)):
        hit = F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        out = F.when(hit, usable(options)).otherwise(out)
    return out


def with_distractors(df: DataFrame, distractors: Column, question_kind: str = "type") -> DataFrame:
    """Questions (options, correct_answer, type) without options get the answer and three distractors, or a review type."""
    todo = (F.size("options") == 0) & (F.coalesce(F.col("correct_answer"), F.lit("")) != "")
    long = F.length("correct_answer") > T.OPTION_MAX
    few = F.size(distractors) < 3
    source = F.when(long, "needs_option_length_review").when(few, "needs_contextual_distractors").otherwise("heuristic_same_document")
    built = F.concat(F.array("correct_answer"), F.slice(distractors, F.lit(1), F.lit(3)))
    review = F.when(long, "needs_option_length_review").when(few, "needs_distractor_review")
    return df.withColumns(
        {
            "options": F.when(todo & ~long & ~few, built).otherwise(F.col("options")),
            "correct": F.when(todo & ~long & ~few, F.lit(1)).when(todo, None).otherwise(F.col("correct")),
            "distractors_source": F.when(todo, source),
            question_kind: F.when(todo, F.coalesce(review, F.col(question_kind))).otherwise(F.col(question_kind)),
        }
    )


# ------------------------------------------------------------------ questions from block ids
def _tagged(role: int, ids: Column, right: Column | None = None) -> Column:
    """Ids with their role and place, and whether they are among those in `right`."""
    texts = lambda c: F.coalesce(c.cast("array<string>"), _none("string"))
    good = lambda x: F.lit(False) if right is None else F.coalesce(F.array_contains(texts(right), x), F.lit(False))
    return F.transform(texts(ids), lambda x, i: F.struct(F.lit(role).alias("role"), i.alias("pos"), good(x).alias("right"), x.alias("id")))


def build_from_markup(markup: DataFrame, blocks: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Questions from markup (question_id, question_ids, option_ids, correct_ids, context_ids) and blocks (document, block_id, order, text).

    `order` is unique over all documents. Where a question shares a block with its context, the last block with text between the context
    and the first option is taken instead. A context of its own comes before that of a region
    (region, block_ids, applies_to), of which the last one wins. Flags tell missing ids, the
    replacement, limits that are broken and missing answers. An empty context repeats nothing: one
    equal to the question is dropped.

    All ids of a question are exploded once with what they are, meet the blocks once and are gathered once;
    a block carries the block with text before it, so that the replacement needs no join of its own. Only what a
    question uses travels: a right option goes once, marked; ids go back where no block has them, places and blocks before
    where a question shares a block with its context, texts of blocks where they are shown.
    """
    if regions is None:
        asked = markup.withColumn("__region", F.array().cast("array<long>"))
    else:
        of = regions.select(F.explode("applies_to").alias("question_id"), "region", "block_ids")
        asked = markup.join(of.groupBy("question_id").agg(F.max_by("block_ids", "region").alias("__region")), "question_id", "left")
    listed = lambda c: F.coalesce(F.col(c).cast("array<string>"), _none("string"))
    every = F.concat(
        _tagged(0, F.col("question_ids")), _tagged(1, F.col("option_ids"), F.col("correct_ids")), _tagged(2, F.col("context_ids")), _tagged(3, F.col("__region")),
        _tagged(4, F.array_except(listed("correct_ids"), listed("option_ids"))),
    )
    overlap = F.coalesce(F.arrays_overlap("question_ids", "context_ids"), F.lit(False))
    refs = asked.select("question_id", overlap.alias("__overlap"), F.explode_outer(every).alias("r")).select("question_id", "__overlap", "r.*")
    key = F.coalesce(refs["id"], F.concat(F.lit("no id of "), refs["question_id"].cast("string")))  # no key is common to all questions
    w = Window.partitionBy("document").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("text") != "", F.struct("order", "text")), ignorenulls=True).over(w)
    known = blocks.select(F.col("block_id").cast("string").alias("__key"), "order", "text", before.alias("before"), F.lit(True).alias("known"))
    used = F.struct(
        "role", "pos", "right", F.when(F.col("known").isNull(), F.col("id")).alias("id"), "known", F.when(F.col("role") != 4, F.col("text")).alias("text"),
        F.when(F.col("__overlap"), F.col("order")).alias("order"), F.when(F.col("__overlap") & (F.col("role") == 1), F.col("before")).alias("before"),
    )
    m = refs.join(known, key == known["__key"], "left").select("question_id", "__overlap", used.alias("r"))
    m = m.groupBy("question_id", "__overlap").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    found = lambda role: F.filter("rows", lambda r: (r["role"] == role) & r["known"])
    texts = lambda role: F.transform(found(role), lambda r: r["text"])
    lost = lambda role: F.transform(F.filter("rows", lambda r: (r["role"] == role) & r["known"].isNull() & r["id"].isNotNull()), lambda r: r["id"])
    since = F.array_max(F.transform(found(2), lambda r: r["order"]))
    first = F.array_min(F.transform(found(1), lambda r: F.struct(r["order"].alias("order"), r["before"].alias("before"))))
    m = m.withColumns({"__since": since, "__first": first})
    told = F.col("__overlap") & (F.col("__first.order") > F.col("__since") + 1) & (F.col("__first.before.order") > F.col("__since"))
    m = m.withColumn("inferred", F.coalesce(told, F.lit(False)))
    m = m.withColumns(
        {
            "q": F.when(F.col("inferred"), F.array("__first.before.text")).otherwise(texts(0)), "options": texts(1), "c": texts(2), "r": texts(3),
            "answers": F.transform(F.filter(found(1), lambda r: r["right"]), lambda r: r["pos"] + 1),
            "missing": F.array_distinct(F.concat(F.when(F.col("inferred"), F.array().cast("array<string>")).otherwise(lost(0)), lost(1), lost(2), lost(3), lost(4))),
        }
    )
    some = lambda c: F.coalesce(F.col(c), _none("string"))
    question = F.trim(F.array_join(some("q"), "\n"))
    own = F.trim(F.array_join(some("c"), "\n"))
    context = F.when(own != "", own).otherwise(F.trim(F.array_join(some("r"), "\n")))
    options = F.transform(some("options"), lambda x: F.regexp_replace(x, r"^\s*[A-DА-Га-гa-d][).]\s*", ""))
    m = m.select("question_id", question.alias("question"), options.alias("options"), "answers", context.alias("context"), "missing", "inferred")
    long = F.filter(F.transform("options", lambda o, i: F.when(F.length(o) > T.OPTION_MAX, F.concat(F.lit("option_too_long:"), (i + 1).cast("string")))), lambda x: x.isNotNull())
    flags = F.concat(
        F.array_compact(
            F.array(
                F.when(F.size("missing") > 0, F.concat(F.lit("missing_source_blocks: "), F.array_join("missing", ", "))),
                F.when(F.col("inferred"), F.lit("context_overlap_autofix")),
                F.when(F.length("question") > T.QUESTION_MAX, F.lit("question_too_long")),
                F.when(F.size("options") < READY_OPTIONS, F.lit("too_few_options")),
            )
        ),
        long,
        F.array_compact(F.array(F.when(F.size("answers") == 0, F.lit("answer_missing")))),
    )
    return m.select(
        "question_id", "question", "options", "answers", F.when(F.size("answers") == 0, F.array(F.lit(1))).otherwise(F.col("answers")).alias("correct"),
        F.when(F.col("context") == F.col("question"), "").otherwise(F.col("context")).alias("context"), flags.alias("flags"),
    )


# ------------------------------------------------------------------ clean items, uploads, imports
def clean_and_audit(items: DataFrame, unit: str, order: str) -> DataFrame:
    """Items (type, text) numbered: item_index for all, question_index for questions, a preview and the section they stand in."""
    upto = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy(unit).orderBy(order))
    out = items.withColumn("item_index", n).withColumn("question_index", F.when(F.col("type") == "question", F.sum((F.col("type") == "question").cast("int")).over(upto)))
    out = carry_forward(out, [unit], [order], F.col("text"), F.col("type") == "title", F.lit(False), "section")
    return out.withColumn("preview", F.when(F.col("type") == "context", F.substring("text", 1, 160)))


def upload_rows(items: DataFrame, unit: str, order: str, title_resets: bool = True) -> DataFrame:
    """Question items with the context that holds; without `title_resets` a title leaves it, and media of a question come first."""
    resets = F.col("type").isin("title", "reset_context") if title_resets else F.col("type") == "reset_context"
    state = F.struct(F.col("text").alias("context"), F.col("media").alias("context_media"))
    out = carry_forward(items, [unit], [order], state, F.col("type") == "context", resets, "__state")
    media = F.col("__state.context_media")
    if not title_resets:
        media = F.when(F.size("media") > 0, F.col("media")).otherwise(media)
    upto = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("index", F.sum((F.col("type") == "question").cast("int")).over(upto)).where("type = 'question'")
    return out.select(*[c for c in items.columns if c not in ("media", "type")], "index", F.col("__state.context").alias("context"), F.coalesce(media, _none("string")).alias("media")).drop("__state")


def correct_value(answers: Column, mode: Column) -> Column:
    """The one-based answers as an upload has them: one number unless the mode is multiple."""
    every = F.array_join(F.transform(answers, lambda a: a.cast("string")), ",")
    return F.when(mode == "multiple", F.concat(F.lit("["), every, F.lit("]"))).otherwise(F.get(answers, 0).cast("string"))


def selected(rows: DataFrame, start: int, indexes: Sequence[int] | None = None) -> DataFrame:
    """Rows from `start` on, of the chosen indexes where some are."""
    out = rows.where(F.col("index") >= start)
    return out if indexes is None else out.where(F.col("index").isin(*indexes))


def skipped_indexes(start: Column, count: Column, reviewed: Column) -> Column:
    """1 to start - 1 (of count + 1 at most) and what a review skips, sorted, each once."""
    last = F.least(start, count + 1) - 1
    prefix = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(_none("int"))
    return F.array_sort(F.array_union(prefix, reviewed))


def group_title(title: Column, label: Column, groups: Column) -> Column:
    """Title of an exported group; the label is added unless it is the only one or the title has it."""
    name = F.when(F.trim(title) == "", "Новый квиз").otherwise(F.trim(title))
    mark = F.trim(label)
    return F.when((mark == "") | (groups == 1), name).when(F.contains(name, mark), mark).otherwise(F.concat(name, F.lit(" · "), mark))


def insert_missing(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """`rows` and those of `more` whose key is not there, null keys compared too."""
    there = rows.select(F.col(key).alias("__key")).distinct()
    return rows.unionByName(more.join(there, more[key].eqNullSafe(F.col("__key")), "left_anti"))


def overridden(rows: DataFrame, key: str, drop: Sequence[int], low: int, high: int, column: str, value: Column) -> DataFrame:
    """Without the dropped keys, and with `column` replaced where the key lies in a range."""
    kept = rows.where(~F.col(key).isin(*drop))
    return kept.withColumn(column, F.when(F.col(key).between(low, high), value).otherwise(F.col(column)))


def inherit_media(rows: DataFrame, unit: str, order: str, low: int, high: int) -> DataFrame:
    """Within a range of `order`, rows without media take the last media seen in their unit."""
    upto = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.size("media") > 0, F.col("media")), ignorenulls=True).over(upto)
    take = F.col(order).between(low, high) & (F.size("media") == 0)
    return rows.withColumn("media", F.when(take, F.coalesce(seen, F.col("media"))).otherwise(F.col("media")))


def clean_cuts(lines: DataFrame, unit: str, order: str, kind: Column, items: Column, target: int) -> DataFrame:
    """(unit, cut, n_items): the place where a unit is cut so that `target` items lie before it.

    Places are lines of kind 'start' whose last non-empty line is an option ('opt'). The first with
    exactly `target` items before it is taken, else the last one with fewer, else the first.
    """
    w = Window.partitionBy(unit).orderBy(order)
    rows = lines.withColumn("__kind", kind).withColumn("__before", F.coalesce(F.sum(items.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where("__kind <> 'empty'").withColumn("__last", F.lag("__kind").over(w))
    places = rows.where("__kind = 'start' AND __last = 'opt'")
    rank = F.when(F.col("__before") == target, 0).when(F.col("__before") < target, 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), F.when(rank == 1, -F.col(order)).otherwise(F.col(order)).alias("o"), F.col(order).alias("cut"), F.col("__before").alias("n")))
    return places.groupBy(unit).agg(best.alias("b")).select(unit, F.col("b.cut").alias("cut"), F.col("b.n").cast("long").alias("n_items"))


# ------------------------------------------------------------------ checks on values
def settings_issues(settings: Column) -> Column:
    """Codes for a map of settings: unknown keys (warning), a bad context mode or a shuffle flag that is no boolean (errors)."""
    unknown = F.array_sort(F.array_except(F.map_keys(settings), F.array(*[F.lit(k) for k in DEFAULT_SETTINGS])))
    value = lambda k: F.coalesce(F.try_element_at(settings, F.lit(k)), F.lit(DEFAULT_SETTINGS[k]))
    return F.concat(
        F.transform(unknown, lambda k: F.concat(F.lit("settings_unknown_key:"), k)),
        F.array_compact(
            F.array(
                F.when(~value("context_send_mode").isin(*CONTEXT_MODES), F.lit("settings_context_send_mode_invalid")),
                F.when(~value("shuffle_options").isin("true", "false"), F.lit("settings_shuffle_options_invalid")),
            )
        ),
    )


def long_options(rows: DataFrame, keys: Sequence[str], options: str) -> DataFrame:
    """(keys, option_index, n_chars) of every option over the limit, white space collapsed."""
    at = rows.select(*keys, F.posexplode(options).alias("__i", "__text"))
    n = F.length(T.collapse(F.col("__text")))
    return at.select(*keys, (F.col("__i") + 1).alias("option_index"), n.alias("n_chars")).where(n > T.OPTION_MAX)


def editor_issues(question: Column, options: Column, correct: Column, explanation: Column) -> Column:
    """Array of struct(code, severity, option) as an editor shows them; a repeat is told from its second place on."""
    keys = F.transform(options, lambda x: F.lower(F.trim(x)))
    one = lambda when, code, severity: F.when(when, F.array(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(None).cast("int").alias("option"))))
    each = lambda test, code, severity: F.transform(
        F.filter(F.transform(keys, lambda k, i: F.when(test(k, i), i + 1)), lambda i: i.isNotNull()),
        lambda i: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), i.alias("option")),
    )
    parts = [
        one(F.trim(question) == "", "empty_question", "critical"),
        one(F.length(question) > T.QUESTION_MAX, "question_limit", "critical"),
        one(F.size(options) < READY_OPTIONS, "few_options", "critical"),
        one(~F.coalesce(correct.between(1, F.size(options)), F.lit(False)), "missing_correct", "critical"),
        each(lambda k, i: k == "", "empty_option", "critical"),
        each(lambda k, i: F.length(k) > T.OPTION_MAX, "option_limit", "critical"),
        each(lambda k, i: (k != "") & (F.array_position(keys, k) < i + 1), "duplicate_option", "warning"),
        one(F.length(explanation) > T.EXPLANATION_MAX, "explanation_limit", "warning"),
    ]
    return F.flatten(F.array_compact(F.array(*parts)))


def missing_media(rows: DataFrame, keys: Sequence[str], media: str, files: DataFrame) -> DataFrame:
    """(keys, ref) of media that no file of the listing (path) has."""
    refs = rows.select(*keys, F.explode(media).alias("ref")).distinct()
    return refs.join(files.select(F.col("path").alias("ref")).distinct(), "ref", "left_anti").select(*keys, "ref")


def shape_of(text: Column) -> Column:
    """What a JSON text of questions is: clean, ui_group, block_markup, questions, list or invalid."""
    v = F.try_parse_json(text)
    has = lambda path, kind="string": F.try_variant_get(v, path, kind).isNotNull()
    any_ = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    zero_based = F.try_variant_get(v, "$.questions[0].correct", "int") < F.size(F.try_variant_get(v, "$.questions[0].options", "array<variant>"))
    ids = any_("$.questions[0].question_block_ids") | any_("$.questions[0].option_block_ids")
    return (
        F.when(v.isNull(), "invalid").when(F.substring(F.trim(text), 1, 1) == "[", "list").when(any_("$.items"), "clean")
        .when(~has("$.quiz_title") & has("$.name") & F.coalesce(zero_based, F.lit(False)), "ui_group")
        .when(~any_("$.questions[0].question") & ids, "block_markup").when(any_("$.questions"), "questions").otherwise("invalid")
    )


def quiz_markdown(title: Column, questions: Column) -> Column:
    """A review text of an array of struct(question, options, answer): numbered, the right option marked."""
    def one(q: Column, i: Column) -> Column:
        options = F.transform(q["options"], lambda o, j: F.concat((j + 1).cast("string"), F.lit(". "), o, F.when(j + 1 == q["answer"], " ✅").otherwise("")))
        return F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), F.trim(q["question"]), F.lit("\n\n"), F.array_join(options, "\n"))

    head = F.concat(F.lit("# "), title, F.lit("\n\nВсего вопросов: **"), F.size(questions).cast("string"), F.lit("**\n\n---\n\n"))
    return F.concat(head, F.array_join(F.transform(questions, one), "\n\n---\n\n"))


# ------------------------------------------------------------------ runs and accounts
#: Error codes after which a run may go on by itself, and those of a stop by hand.
RESUMABLE = ("telegram_timeout", "telegram_too_many_incoming_messages", "telegram_too_many_requests", "telegram_flood_wait", "telegram_retry_exhausted")
BY_HAND = ("paused_by_user", "stopped_by_user")
MAX_ENABLED = 2


def needs_auto_resume(enabled: Column, status: Column, code: Column) -> Column:
    code = F.coalesce(code, F.lit(""))
    return enabled & status.isin("paused", "failed") & ~code.isin(*BY_HAND) & ((status == "paused") | code.isin(*RESUMABLE))


def protected(uploaded: Column, skips: Column, cooldowns: Column, next_index: Column, start: Column, status: Column) -> Column:
    """Whether a run has progress that must not be lost."""
    return (uploaded > 0) | (skips > 0) | (cooldowns > 0) | (next_index > start) | status.isin("running", "cooldown", "paused", "completed")


def same_source(stored: Column, content: Column) -> Column:
    """Whether a run may resume: the stored sha256 is that of the content."""
    return stored == F.sha2(content, 256)


def undo_order(uploads: DataFrame, run: str, index: str, upto: int) -> DataFrame:
    """Uploads from index `upto` on, with their place when undone from the last one back."""
    back = Window.partitionBy(run).orderBy(F.desc(index))
    return uploads.where(F.col(index) >= upto).withColumn("undo_place", F.row_number().over(back))


def public_accounts(accounts: DataFrame, active: Column) -> DataFrame:
    """Accounts (id, name, phone, session, enabled, authorized) as shown: status, masked phone, file name of the session."""
    status = F.when(~F.col("enabled"), "disabled").when(F.col("authorized"), "enabled_authorized").otherwise("enabled")
    return accounts.select(
        "id", F.coalesce(F.nullif("name", F.lit("")), F.col("id").cast("string")).alias("display_name"), status.alias("status"),
        F.regexp_extract("session", r"([^/]*)$", 1).alias("session_file"), T.masked(F.col("phone")).alias("phone_masked"), (F.col("id") == active).alias("is_active"),
    )


def over_enabled(accounts: DataFrame, store: str, most: int = MAX_ENABLED) -> DataFrame:
    """(store, n_enabled) of stores with more enabled accounts than may be."""
    return accounts.where("enabled").groupBy(store).agg(F.count(F.lit(1)).alias("n_enabled")).where(F.col("n_enabled") > most)
