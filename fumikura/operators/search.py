"""Searches over rankings and judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.words import _col, is_uri
from ..session import stored


def holds_text(word: Column | str, query: str) -> Column:
    """Literal search, case ignored."""
    return F.contains(F.lower(_col(word)), F.lower(F.lit(query)))


def holds_pattern(word: Column | str, pattern: str) -> Column:
    """Regular expression search, case kept."""
    return F.coalesce(_col(word).rlike(pattern), F.lit(False))


def any_holds_pattern(columns: list[Column | str], pattern: str) -> Column:
    """Regular expression search over several columns, case ignored."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(_col(c).cast("string").rlike("(?iu)" + pattern), F.lit(False))
    return out


def with_uri_flag(words: DataFrame, word: str = "word") -> DataFrame:
    return words.withColumn("is_uri", is_uri(word))


def by_verdict(rows: DataFrame, wanted: bool | str | None, verdict: str = "is_score") -> DataFrame:
    """Rows whose three-valued verdict is true, false, unknown (None), or ``"all"``."""
    if wanted == "all":
        return rows
    if wanted is None:
        return rows.where(F.col(verdict).isNull())
    return rows.where(F.col(verdict).eqNullSafe(F.lit(wanted)))


def head_of(rows: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, Column]:
    """First ``limit`` rows of an order, and whether more rows exist.

    One row more than asked for tells; the input is evaluated once.
    """
    head = stored(rows.orderBy(*order).limit(limit + 1))
    more = head.select((F.count("*") > limit).alias("truncated")).scalar()
    return head.orderBy(*order).limit(limit), more
