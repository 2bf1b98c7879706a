"""Word lists in text files: ordered and set form, sorted writers, code export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.variants import json_string
from ..functions.words import strip
from ..operators.scale import with_dense_rank
from ..session import stored
from .records import LINE_ORDER, read_lines

LIST_ROWS = 100_000  # words on one page of code


def _missing(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def clean_words(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Trimmed words, blank lines dropped; other columns stay."""
    return lines.withColumn("word", strip(raw)).where(F.col("word") != "").drop(raw)


def read_word_lines(spark: SparkSession, path: str) -> DataFrame:
    """<word, file, block, seq> in file order; a missing file gives no rows."""
    if _missing(spark, path):
        return spark.createDataFrame([], "word string, file string, block bigint, seq bigint")
    lines = read_lines(spark, path)
    return clean_words(lines).select("word", *LINE_ORDER)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Ordered list <ord, word>."""
    words = read_word_lines(spark, path)
    ranked = with_dense_rank(words, [F.col(c) for c in LINE_ORDER], "ord")
    return ranked.select((F.col("ord") - 1).alias("ord"), "word")


def read_word_set(spark: SparkSession, path: str) -> DataFrame:
    return read_word_lines(spark, path).select("word").distinct()


def as_literals(words: DataFrame) -> list[str]:
    """Words of <ord, word> in order, for use inside expressions.

    They all come to the driver; a list that should not stays a DataFrame
    (``match.first_hit_join``).
    """
    return [r.word for r in words.orderBy("ord").toLocalIterator()]


def sorted_words(words: DataFrame) -> DataFrame:
    return words.select("word").distinct().orderBy("word")


def write_word_list(words: DataFrame, path: str, mode: str = "error", one_file: bool = True) -> int:
    """Sorted unique words, one per line; returns their number.

    ``one_file=False`` writes one file per sorted range, whose names follow
    the order; that is for lists too long to go through one task.
    """
    unique = stored(words.select("word").distinct())
    out = unique.orderBy("word")
    if one_file:
        out = out.coalesce(1)
    out.write.mode(mode).text(path)
    return unique.count()


def list_as_code(words: DataFrame, name: str, page_size: int = LIST_ROWS) -> DataFrame:
    """``NAME = ["a", "b"]`` with sorted unique words, one per line: <page, code>.

    One row per ``page_size`` words, so one row for a list of usual length;
    later pages extend the list (``NAME += [...]``), so the pages in order are the whole code.
    """
    ranked = with_dense_rank(words.select("word").distinct(), [F.asc("word")], "_no")
    page = F.call_function("div", F.col("_no") - 1, F.lit(page_size))
    words = F.transform(F.array_sort(F.collect_list("word")), json_string)
    sign = F.when(page == 0, F.lit(" = [")).otherwise(F.lit(" += ["))
    body = F.concat(F.lit(name), F.first(sign), F.array_join(words, ",\n    "), F.lit("]"))
    return ranked.groupBy(page.alias("page")).agg(body.alias("code"))
