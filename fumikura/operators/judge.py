"""Batch judging of undecided rows by a caller's scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import settings
from ..functions import replies, titles
from .scale import bound_batches, pinned


def judge_input(records: DataFrame, rec: str = "rec") -> DataFrame:
    """<id, label, prompt> of parsed records; rows without an id are left out."""
    rows = pinned(
        records.select(rec),
        id=titles.record_id(rec),
        label=titles.title(rec, default=settings.NO_TITLE),
        _text=titles.description(rec),
    ).where(F.col("id") != "")
    text = replies.prompt(F.col("label"), F.col("label"), F.col("_text"))
    return rows.select("id", "label", text.alias("prompt"))


Reply = str | Exception
Scorer = Callable[[Sequence[str]], Sequence[Reply]]


def one_by_one(score: Callable[[str], str]) -> Scorer:
    """Batch scorer from one that takes a single prompt; an error spoils its own row only."""

    def batch(prompts: Sequence[str]) -> list[Reply]:
        out: list[Reply] = []
        for prompt in prompts:
            try:
                out.append(score(prompt))
            except Exception as problem:  # any scorer error becomes a row
                out.append(problem)
        return out

    return batch


def ask(rows: DataFrame, scorer: Scorer, prompt: str = "prompt", setup: Callable[[], object] | None = None, batch_rows: int = 256) -> DataFrame:
    """Adds <reply, error>: the scorer's text, or the error it gave.

    The scorer runs inside the tasks on batches of at most ``batch_rows``
    prompts and gives a reply or an error for each; ``setup`` runs once per
    task before it, say to open a connection.  A batch that fails as a whole
    is asked again row by row, so one bad prompt spoils its own row only.

    A task holds one Arrow batch as it came, which is bounded in bytes, and the
    texts of ``batch_rows`` prompts.
    """
    kept = [c for c in rows.columns if c != prompt]
    kind = StructType([*rows.select(*kept).schema.fields, *[StructField(name, StringType()) for name in ("reply", "error")]])
    bound_batches(rows.sparkSession)

    def answers(prompts: list[str]) -> list[Reply]:
        try:
            found = list(scorer(prompts))
            if len(found) != len(prompts):
                raise ValueError(f"{len(found)} replies to {len(prompts)} prompts")
            return found
        except Exception as problem:
            if len(prompts) == 1:
                return [problem]
            return [answers([one])[0] for one in prompts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup is not None:
            setup()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                piece = batch.slice(at, batch_rows)
                found = answers(piece.column(prompt).to_pylist())
                reply = [None if isinstance(x, Exception) else x for x in found]
                error = [str(x) if isinstance(x, Exception) else None for x in found]
                columns = [*[piece.column(c) for c in kept], pa.array(reply, pa.string()), pa.array(error, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "reply", "error"])

    return rows.mapInArrow(run, kind)


def judgments(replied: DataFrame) -> DataFrame:
    """<id, label, judgment, reason> from <id, label, reply, error>."""
    parsed = pinned(replied, _parsed=replies.parsed_reply("reply"))
    failure = F.coalesce(
        F.concat(F.lit(replies.CALL_ERROR), F.col("error")),
        replies.reply_failure("reply", F.col("_parsed")),
    )
    return parsed.withColumn("_failure", failure).select(
        "id",
        "label",
        F.when(F.col("_failure").isNull(), replies.reply_verdict(F.col("_parsed"))).alias("judgment"),
        F.coalesce("_failure", replies.reply_reason(F.col("_parsed"))).alias("reason"),
    )


def judge(records: DataFrame, scorer: Scorer, setup: Callable[[], object] | None = None, batch_rows: int = 256) -> DataFrame:
    """Prompt, ask, parse; as many tasks as the records have partitions."""
    return judgments(ask(judge_input(records), scorer, setup=setup, batch_rows=batch_rows))


def keyword_scorer(yes: list[str], no: list[str]) -> Scorer:
    """Deterministic stand-in for a model: looks for words in the prompt."""

    def score(prompt: str) -> str:
        import json

        for words, verdict in ((no, False), (yes, True)):
            for word in words:
                if word in prompt:
                    return json.dumps({"is_score": verdict, "reason": f"holds {word}"}, ensure_ascii=False)
        return json.dumps({"is_score": None, "reason": "no known word"})

    return one_by_one(score)


def first_lines(lines: DataFrame, limit: int = settings.JUDGE_LIMIT, order: tuple[str, ...] = ("file", "block", "seq")) -> DataFrame:
    """The first raw lines of the input, bad ones counted."""
    return lines.orderBy(*order).limit(limit)
