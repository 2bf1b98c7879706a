"""Human review: samples, queues, decision logs, overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings
from ..functions import words as w
from .match import cover_state, dual_cover_state, protection
from .scale import lookup_join, top_rows, with_dense_rank
from .search import holds_pattern

NO_SAMPLE = "no sample"


def sample_rows(
    rows: DataFrame, size: int = settings.REVIEW_SAMPLE, seed: str = "0", id_col: str = "id"
) -> DataFrame:
    """Uniform sample without replacement, all rows if there are fewer.

    Rows are ordered by a digest of id and seed, so it can be repeated.
    """
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit("#" + seed)))
    return rows.withColumn("_key", key).orderBy("_key", id_col).limit(size).drop("_key")


def unify_columns(rows: DataFrame) -> DataFrame:
    """``judgment`` becomes ``is_score`` and ``thought`` becomes ``reason``."""
    for old, new in (("judgment", "is_score"), ("thought", "reason")):
        if old in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    return rows


def with_row_id(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``id`` = ``row_<i>`` along the order, for input without an id column."""
    if "id" in rows.columns:
        return rows
    numbered = with_dense_rank(rows, order, "_no")
    return numbered.withColumn("id", F.concat(F.lit("row_"), (F.col("_no") - 1).cast("string"))).drop("_no")


def last_decisions(log: DataFrame) -> DataFrame:
    """<id, decision>: the latest explicit decision per id."""
    # seq and the flag share one number, wide enough for every seq, which keeps the maximum a hash aggregate
    packed = F.col("seq").cast("decimal(20,0)") * 2 + F.col("decision").cast("int")
    return (
        log.where(F.col("decision").isNotNull())
        .groupBy("id")
        .agg(F.max(packed).alias("_last"))
        .select("id", (F.col("_last") % 2 == 1).alias("decision"))
    )


def with_override(judged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds <final, overridden>: a human decision replaces the verdict."""
    sides = decisions.select("id", "decision")
    return (
        lookup_join(judged, sides, ["id"], "left")
        .withColumn("final", F.coalesce("decision", "is_score"))
        .withColumn("overridden", F.col("decision").isNotNull())
        .drop("decision")
    )


def verified(judged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Final table <id, label, is_score, llm_reason, verified_by_human>."""
    rows = with_override(unify_columns(judged), decisions)
    reason = F.coalesce("reason", F.lit("")) if "reason" in rows.columns else F.lit("")
    return rows.select(
        "id",
        "label",
        F.coalesce("final", F.lit(False)).alias("is_score"),
        reason.alias("llm_reason"),
        F.col("overridden").alias("verified_by_human"),
    )


def verdict_summary(judged: DataFrame) -> DataFrame:
    """<is_score, cnt, overrides>, unknown as NULL; counts ``overridden`` if it is there."""
    flag = F.col("overridden") if "overridden" in judged.columns else F.lit(False)
    return judged.groupBy("is_score").agg(F.count("*").alias("cnt"), F.count_if(flag).alias("overrides"))


# -- decision logs -------------------------------------------------------------
# Actions: TOGGLE_NG, TOGGLE_OK (clicks), NG, OK, RESET (bulk).  States: none 0, NG 1, OK 2.
# An action is a function of the states, and so is any run of actions.  A function is
# written as one number with three digits to the base 3: what it makes of state 0, 1, 2.

SEGMENT = 1 << 16  # values of seq folded together


def _function(of_none: int, of_drop: int, of_keep: int) -> int:
    return of_none + 3 * of_drop + 9 * of_keep


IDENTITY = _function(0, 1, 2)
ACTIONS = {
    "NG": _function(1, 1, 1),
    "OK": _function(2, 2, 2),
    "RESET": _function(0, 0, 0),
    "TOGGLE_NG": _function(1, 0, 1),
    "TOGGLE_OK": _function(2, 2, 0),
}


def _applied(function: Column, state: Column) -> Column:
    """Digit of a function at a state."""
    return F.pmod(F.call_function("div", function, F.when(state == 0, 1).when(state == 1, 3).otherwise(9)).cast("int"), F.lit(3))


def _then(first: Column, second: Column) -> Column:
    """One function after another."""
    digits = [_applied(second, _applied(first, F.lit(state))) for state in range(3)]
    return digits[0] + 3 * digits[1] + 9 * digits[2]


def _composed(steps: Column) -> Column:
    """All functions of an array of structs <at, f>, in order."""
    ordered = F.array_sort(steps)
    return F.aggregate(ordered, F.lit(IDENTITY), lambda done, step: _then(done, step["f"]))


def decision_functions(log: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """What stretches of a log <word, seq, action> do: <word, at, f>, one row per word and stretch.

    A stretch holds ``segment`` values of ``seq``, so a word with most of the
    log in it is folded in as many pieces, none of which is large.  The log is
    read once.  Functions can be kept, and united with those of later entries.
    Unknown and null actions change nothing; entries without ``seq`` come first.
    """
    code = F
    for action, number in ACTIONS.items():
        code = code.when(F.col("action") == action, F.lit(number))
    seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    steps = log.select("word", seq.alias("at"), code.otherwise(F.lit(IDENTITY)).alias("f"))
    # Of runs of equal bulk actions or of clicks nothing can be left out beforehand, but a segment is bounded.
    pieces = steps.groupBy("word", F.floor(F.col("at") / segment).alias("_segment"))
    listed = pieces.agg(F.min("at").alias("at"), F.collect_list(F.struct("at", "f")).alias("_steps"))
    return listed.select("word", "at", _composed(F.col("_steps")).alias("f"))


def fold_functions(functions: DataFrame) -> DataFrame:
    """<word, at, f> of all stretches of a word together, in the order of their beginnings."""
    listed = functions.groupBy("word").agg(F.min("at").alias("at"), F.collect_list(F.struct("at", "f")).alias("_steps"))
    return listed.select("word", "at", _composed(F.col("_steps")).alias("f"))


def states_of(functions: DataFrame) -> DataFrame:
    """<word, state> after functions that start from no state: NG, OK or NULL."""
    end = _applied(F.col("f"), F.lit(0))
    return functions.select("word", F.when(end == 1, "NG").when(end == 2, "OK").alias("state"))


def fold_decisions(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """State of every word after a log <word, seq, action>: <word, state>.

    Clicks flip a word in their own list and move it out of the other; bulk
    actions set the state.  ``before`` holds the functions of an earlier part
    of the log (:func:`decision_functions`), which is not read again then.
    """
    functions = decision_functions(log)
    if before is not None:
        functions = before.select("word", "at", "f").unionByName(functions)
    return states_of(fold_functions(functions))


def fold_toggles(log: DataFrame) -> DataFrame:
    """Words chosen after clicks on a single list: an odd number of clicks."""
    counts = log.groupBy("word").agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") % 2 == 1).select("word")


def lists_of(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop and keep lists of folded decisions; they never share a word."""
    return (
        states.where(F.col("state") == "NG").select("word"),
        states.where(F.col("state") == "OK").select("word"),
    )


def select_all(selection: DataFrame, visible: DataFrame) -> DataFrame:
    return selection.select("word").unionByName(visible.select("word")).distinct()


def clear_all(selection: DataFrame, visible: DataFrame) -> DataFrame:
    return selection.select("word").distinct().join(visible.select("word").distinct(), "word", "left_anti")


# -- review queues -------------------------------------------------------------


def with_samples(words: DataFrame, samples: DataFrame, on: Sequence[str] = ("n", "word")) -> DataFrame:
    """Adds ``examples``: the sample titles as one text, or a note."""
    text = F.when(
        F.size("samples") > 0,
        F.array_join(F.transform("samples", lambda t: F.concat(F.lit("・"), t)), "\n"),
    )
    return (
        words.join(samples, list(on), "left")
        .withColumn("examples", F.coalesce(text, F.lit(NO_SAMPLE)))
        .drop("samples")
    )


def subject_queue(
    ranked: DataFrame,
    selected: DataFrame,
    protected: Sequence[str],
    limit: int = settings.QUEUE_LIMIT,
    uris_only: bool = False,
) -> DataFrame:
    """Subjects to review: <rank, word, cnt, checked, protected, key, label, link>."""
    rows = ranked.where(w.is_uri("word")) if uris_only else ranked
    shown = top_rows(rows, [F.desc("cnt"), F.asc("word")], limit)
    marks = selected.select("word").distinct().withColumn("_in", F.lit(True))
    guard = protection("word", protected)
    return shown.join(marks, "word", "left").select(
        "rank",
        "word",
        "cnt",
        F.coalesce("_in", F.lit(False)).alias("checked"),
        guard["protected"].alias("protected"),
        guard["key"].alias("key"),
        w.short_uri_label("word").alias("label"),
        w.lookup_link("word").alias("link"),
    )


def word_queue(
    ranked: DataFrame,
    selected: DataFrame,
    samples: DataFrame | None = None,
    how: str = "suffix",
    limit: int = settings.TOP_SUFFIXES,
) -> DataFrame:
    """First ``limit`` ranked words <n, rank, word, cnt> per size against one list."""
    rows = cover_state(ranked.where(F.col("rank") <= limit), selected, how)
    rows = rows.withColumn("link", w.lookup_link("word"))
    return rows if samples is None else with_samples(rows, samples)


def dual_queue(
    ranked: DataFrame,
    drop: DataFrame,
    keep: DataFrame,
    samples: DataFrame | None = None,
    pattern: str | None = None,
    limit: int = settings.TOP_GRAMS,
) -> DataFrame:
    """Ranked words <n, rank, word, cnt> against drop and keep list.

    With a search pattern all matching words are shown, else the first ``limit``.
    """
    shown = ranked.where(F.col("rank") <= limit) if pattern is None else ranked.where(holds_pattern("word", pattern))
    rows = dual_cover_state(shown, drop, keep).withColumn("link", w.lookup_link("word"))
    return rows if samples is None else with_samples(rows, samples)
