"""Ranking tables in CSV: word rankings, packed suffix rankings, writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import settings
from ..functions import words as w


def read_table(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV with a header, all columns text; a byte order mark is skipped.

    ``multiline`` reads values with line breaks in them, one task per file.
    """
    # Quotes are doubled in these files, not escaped by a backslash.
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(path)


def word_column(table: DataFrame) -> DataFrame:
    """Header blanks trimmed; ``Keyword``, else the second column, is ``Word``."""
    table = table.toDF(*[c.strip() for c in table.columns])
    if "Keyword" in table.columns:
        return table.withColumnRenamed("Keyword", "Word")
    if "Word" not in table.columns and len(table.columns) >= 2:
        return table.withColumnRenamed(table.columns[1], "Word")
    return table


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Ranking CSV with a ``Word`` column; ``Rank`` and ``Count`` as numbers."""
    table = word_column(read_table(spark, path))
    for number in ("Rank", "Count"):
        if number in table.columns:
            table = table.withColumn(number, F.col(number).try_cast("bigint"))
    return table


def _cells(table: DataFrame, chosen: dict[int, str]) -> DataFrame:
    pairs = [
        F.struct(F.lit(n).alias("n"), F.col(f"`{c}`").cast("string").alias("cell")) for n, c in chosen.items()
    ]
    return table.select(F.inline(F.array(*pairs)))


def unpack_ranking(
    table: DataFrame, sizes: Sequence[int] = settings.SUFFIX_SIZES, stem: str = "Last"
) -> DataFrame:
    """Packed wide ranking to long <n, word, cnt>; the first column per size counts."""
    chosen = {}
    for n in sizes:
        match = next((c for c in table.columns if f"{stem}{n}" in c), None)
        if match is not None:
            chosen[n] = match
    if not chosen:
        return table.sparkSession.createDataFrame([], "n int, word string, cnt bigint")
    cells = _cells(table, chosen)
    return cells.select(
        "n", w.packed_word("cell").alias("word"), w.packed_count("cell").alias("cnt")
    ).where(F.col("word").isNotNull())


def read_packed_ranking(spark: SparkSession, path: str) -> DataFrame:
    return unpack_ranking(read_table(spark, path))


def candidate_words(table: DataFrame, stem: str = "Last") -> DataFrame:
    """Distinct words of all packed columns, cut at the first bracket: <word>."""
    chosen = dict(enumerate(c for c in table.columns if stem in c))
    cells = _cells(table, chosen)
    return cells.select(w.candidate_word("cell").alias("word")).where(F.col("word").isNotNull()).distinct()


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return candidate_words(read_table(spark, path))


def write_csv(
    rows: DataFrame,
    path: str,
    first: Sequence[str] = (),
    quote_all: bool = False,
    bom: bool = False,
    mode: str = "error",
) -> None:
    """CSV with a header; named columns that exist come first.

    ``bom`` puts the UTF-8 mark in front of the header, for spreadsheets.
    With ``quote_all`` the mark must stand before the first quote, which the
    CSV writer does not do: the lines are then written as text, every value
    quoted and quotes doubled, each file with the mark and a header of its own.
    """
    head = [c for c in first if c in rows.columns]
    order = head + [c for c in rows.columns if c not in head]
    out = rows.select(*[F.col(f"`{c}`") for c in order])
    if bom and quote_all:
        _write_quoted(out, path, mode)
        return
    if bom:
        out = out.withColumnRenamed(order[0], "﻿" + order[0])
    (
        out.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", quote_all)
        .option("emptyValue", "")
        .csv(path)
    )


def _write_quoted(rows: DataFrame, path: str, mode: str) -> None:
    """All values quoted, NULL as "", the byte order mark first in each file."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *[quoted(F.col(f"`{c}`").cast("string")) for c in rows.columns])
    header = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
    # One header line per task, in front of its rows.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = rows.select(F.explode(F.when(first, F.array(F.lit(header), line)).otherwise(F.array(line))).alias("value"))
    lines.write.mode(mode).text(path)
