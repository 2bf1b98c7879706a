"""Corpus and lists to a verified, labelled table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .. import settings
from ..functions import titles
from ..operators import judge as judging, match, mine, review
from ..operators.scale import pinned, with_dense_rank
from ..session import checkpointed, stored
from ..sources import rankings, records as lines
from . import mining


@dataclass(frozen=True)
class Curation:
    split: DataFrame
    judged: DataFrame
    sample: DataFrame
    final: DataFrame


def clean(records: DataFrame, noise: Sequence[str]) -> DataFrame:
    """Records <id, raw, rec> whose title holds no noise word, columns unchanged."""
    titled = pinned(records, _title=titles.title("rec"))
    tagged = match.with_first_hit(titled, noise, "_title", "_hit")
    return tagged.where(F.col("_hit").isNull()).select(*records.columns)


def curate(
    records: DataFrame,
    noise: Sequence[str],
    drop: Sequence[str] | DataFrame,
    keep: Sequence[str] | DataFrame,
    scorer: judging.Scorer,
    decisions: DataFrame,
    sample_size: int = settings.REVIEW_SAMPLE,
    wanted: Column | None = None,
) -> Curation:
    """Class filter, clean, split, judge the undecided, sample them, apply human decisions.

    Lists that are frames <ord, word> are joined.  ``records`` is <id, raw, rec>, ``decisions`` is <id, decision>; ``wanted``
    is a test of the class.  Split and judgments are written to the shared
    folder, so every record is split and judged once whatever is read of the
    result, and the sample agrees with the final table.
    """
    if wanted is not None:
        records = records.where(wanted)
    titled = pinned(clean(records, noise), title=titles.title("rec"))
    split = match.split_three_ways(titled, drop, keep)
    split = stored(split.select("id", "raw", "title", "verdict", "word", "reason", "is_score"))
    gray = pinned(split.where(F.col("verdict") == "gray").select("raw"), rec=F.try_parse_json("raw"))
    judged = stored(judging.judge(gray, scorer))
    sample = review.sample_rows(judged, sample_size)
    return Curation(split, judged, sample, review.verified(judged, decisions))


@dataclass(frozen=True)
class MinedCuration:
    ranking: DataFrame
    drop: DataFrame
    curation: Curation


def mined_drop_list(
    records: DataFrame,
    wanted: Column | None = None,
    sizes: Sequence[int] = settings.SUFFIX_SIZES,
    k: int = settings.TOP_SUFFIXES,
    run: str = settings.COMPOUND_RUN,
    end: str = settings.COMPOUND_END,
    heuristic: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Suffix ranking <n, rank, word, cnt> of the records <ord, rec> of a class, and the drop list <ord, word> it gives.

    Titles are mined for compounds, their endings ranked, the ranking packed,
    and its words tried by the noise heuristic (``heuristic`` holds options of
    :func:`mining.drop_list_from_ranking`).  The list is in word order; it has
    at most ``k`` words per size and those added by hand.
    """
    mined = records if wanted is None else records.where(wanted)
    named = pinned(mined, title=titles.title_of_list("rec")).select("ord", "title")
    ranking = stored(mine.suffix_ranking(mine.compound_counts(named, run, end), sizes, k))
    words = mining.drop_list_from_ranking(mine.packed_ranking(ranking, sizes, k), **(heuristic or {}))
    return ranking, checkpointed(with_dense_rank(words, [F.asc("word")], "ord"))


def mine_and_curate(
    records: DataFrame,
    noise: Sequence[str],
    keep: Sequence[str] | DataFrame,
    scorer: judging.Scorer,
    decisions: DataFrame,
    sample_size: int = settings.REVIEW_SAMPLE,
    wanted: Column | None = None,
    **options,
) -> MinedCuration:
    """:func:`curate` with the drop list mined from the very records <ord, id, raw, rec>.

    ``wanted`` tells the class whose titles are mined; all records are split.
    ``options`` are those of :func:`mined_drop_list`.
    """
    ranking, drop = mined_drop_list(records, wanted, **options)
    rows = records.select("id", "raw", "rec")
    return MinedCuration(ranking, drop, curate(rows, noise, drop, keep, scorer, decisions, sample_size))


def final_filter(
    records: DataFrame,
    keep: Sequence[str] | DataFrame,
    drop: Sequence[str] | DataFrame,
    kept_path: str,
    dropped_path: str,
    mode: str = "error",
) -> dict[str, int]:
    """Keep-first filter of records <raw, rec> with both outputs; counts <kept, rescued, dropped>.

    Kept lines are written as they came.  Dropped records become a CSV for
    spreadsheets: ``exclusion_reason`` and the two title keys first, then all
    other keys of dropped records; a key of the record by that name gives way.
    The lists, of any length, are searched once; the counters come from the
    pass that stores the verdicts.
    """
    verdicts = keep_by_subject(records.select("raw", "rec"), keep, drop).select("raw", "verdict", "reason", "rescued")
    seen = Observation()
    counters = {
        "kept": F.count_if(F.col("verdict") == "keep"),
        "rescued": F.count_if("rescued"),
        "dropped": F.count_if(F.col("verdict") == "drop"),
    }
    judged = stored(verdicts.observe(seen, *[value.alias(name) for name, value in counters.items()]))
    lines.write_lines(judged.where(F.col("verdict") == "keep"), kept_path, mode=mode)
    dropped = judged.where(F.col("verdict") == "drop").select("raw", F.col("reason").alias("exclusion_reason"))
    keys = [key for key in lines.field_names(dropped) if key != "exclusion_reason"]
    table = lines.as_columns(lines.parse_records(dropped), keys, kept=["exclusion_reason"])
    first = ("exclusion_reason", settings.LABEL_KEY, settings.NAME_KEY)
    rankings.write_csv(table, dropped_path, first, quote_all=True, bom=True, mode=mode)
    return seen.get


def keep_by_subject(
    records: DataFrame, keep: Sequence[str] | DataFrame, drop: Sequence[str] | DataFrame, rec: str = "rec"
) -> DataFrame:
    """Keep-first filter over title and subjects together: adds <text, verdict, reason, rescued>.

    Both lists are searched in the searchable text (title and subject
    values); a keep word wins over any drop word.
    """
    texts = pinned(records, text=titles.search_text(rec, titles.title_of_list(rec)))
    return match.with_keep_first(texts, keep, drop, "text")
