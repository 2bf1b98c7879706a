"""JSON Lines: tolerant scan, counters, row-preserving and JSON writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ..functions.variants import field, is_json, is_json_object
from ..operators.scale import lookup_join, pinned
from ..session import stored
from . import membership

LINE_ORDER = ("file", "block", "seq")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with their place in the input: <raw, file, block, seq>.

    ``file, block, seq`` sorts lines as they stand in the files.
    """
    return spark.read.text(path).select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def parse_records(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``rec``; lines that are blank, broken or no JSON object are dropped.

    Where an object repeats a key, the last one counts; Spark refuses such
    objects unless the session is told otherwise, so it is told here.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return pinned(lines, rec=F.when(is_json_object(raw), F.try_parse_json(raw))).where(F.col("rec").isNotNull())


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of JSON Lines files: <raw, file, block, seq, rec>."""
    return parse_records(read_lines(spark, path))


def scan_counts(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """One row <lines, parsed, objects>."""
    return lines.agg(
        F.count("*").alias("lines"),
        F.count_if(is_json(raw)).alias("parsed"),
        F.count_if(is_json_object(raw)).alias("objects"),
    )


def written_counts(rows: DataFrame, write: Callable[[DataFrame], None], **counters: Column) -> dict[str, int]:
    """Counters over rows, taken in the pass that writes them; ``write`` makes one output of what it is given."""
    seen = Observation()
    write(rows.observe(seen, *[value.alias(name) for name, value in counters.items()]))
    return seen.get


def write_objects(lines: DataFrame, path: str, raw: str = "raw", mode: str = "error") -> dict[str, int]:
    """Writes the lines that are JSON objects, byte by byte; counts <lines, parsed, objects> on the way."""
    flags = pinned(lines, _parsed=is_json(raw), _object=is_json_object(raw))
    return written_counts(
        flags,
        lambda rows: write_lines(rows.where("_object"), path, raw, mode),
        lines=F.count(F.lit(1)),
        parsed=F.count_if("_parsed"),
        objects=F.count_if("_object"),
    )


def numbered(lines: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Adds the line number, from 0, to the lines of :func:`read_lines`.

    Lines are written once to pin their places; then the sizes of the file
    blocks, one row each, give the offset of every block.  Nothing is sorted.
    """
    rows = stored(lines)
    blocks = rows.groupBy("file", "block").agg(F.min("seq").alias("_first"), F.count("*").alias("_size"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "file", "block", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    placed = lookup_join(rows, offsets, ["file", "block"], "inner")
    number = F.col("_offset") + F.col("seq") - F.col("_first")
    return placed.withColumn(ord_col, number).drop("_first", "_offset")


def field_keys(records: DataFrame, raw: str = "raw") -> DataFrame:
    """All top-level keys, sorted: <key>."""
    return records.select(F.explode(F.json_object_keys(raw)).alias("key")).distinct().orderBy("key")


def field_names(records: DataFrame, raw: str = "raw") -> list[str]:
    """All top-level keys as column names for the driver; see :func:`field_keys`."""
    return [r.key for r in field_keys(records, raw).toLocalIterator()]


def as_columns(records: DataFrame, keys: Sequence[str], rec: str = "rec", kept: Sequence[str] = ()) -> DataFrame:
    """One text column per key, lists and objects as JSON text; for CSV output."""
    return records.select(*kept, *[field(rec, key, "string").alias(key) for key in keys])


def write_lines(rows: DataFrame, path: str, raw: str | Column = "raw", mode: str = "error") -> None:
    """The text column as it is, one row per line."""
    rows.select(F.col(raw) if isinstance(raw, str) else raw).write.mode(mode).text(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Rows as JSON objects; NULL is written as null, other scripts stay readable."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_by_verdict(
    rows: DataFrame, path: str, line: str = "raw", verdict: str = "verdict", mode: str = "error"
) -> None:
    """All outputs of a split in one pass, one folder per verdict."""
    rows.select(line, verdict).write.mode(mode).partitionBy(verdict).text(path)


def write_split(
    split: DataFrame, path: str, line: str = "raw", verdicts: Sequence[str] = ("ng", "ok", "gray"), flag: str = "is_score", mode: str = "error"
) -> dict[str, tuple[int, int]]:
    """:func:`write_by_verdict` that also counts, in the same pass: verdict to (rows, rows with the flag), and ``all``."""
    counters = {}
    for name in (*verdicts, "all"):
        mine = F.lit(True) if name == "all" else F.col("verdict") == name
        counters[f"rows_{name}"] = F.count_if(mine)
        counters[f"flag_{name}"] = F.count_if(mine & F.coalesce(F.col(flag), F.lit(False)))
    found = written_counts(split, lambda rows: write_by_verdict(rows, path, line, "verdict", mode), **counters)
    return {name: (found[f"rows_{name}"], found[f"flag_{name}"]) for name in (*verdicts, "all")}


def pending(rows: DataFrame, done: DataFrame, key: str = "uri") -> DataFrame:
    """Rows whose key is not in the output yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def unwritten(rows: DataFrame, path: str, key: str = "uri") -> DataFrame:
    """The rows, stored, whose key the JSON Lines output at ``path`` does not hold yet.

    A filter of the keys is kept in the hidden folder ``_keys`` of the output
    (:mod:`fumikura.sources.membership`).  Rows whose key it rules out are
    new; only for the others is the output itself read, its key column alone.
    """
    spark = rows.sparkSession
    rows = stored(rows)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return rows
    known = membership.read_filter(spark, path)
    if known is None:  # written without a filter
        known = membership.write_filter(written_keys(spark, path, key), path, key)
    maybe = stored(membership.possible(rows.select(key).distinct(), known, key))
    if maybe.isEmpty():
        return rows
    repeated = maybe.join(written_keys(spark, path, key), key, "left_semi")
    return lookup_join(rows, repeated, [key], "left_anti")


def append_new(rows: DataFrame, keys: DataFrame, path: str, key: str = "uri") -> None:
    """Append rows that :func:`unwritten` let through; ``keys`` holds their keys.

    The filter is written first: where a run ends in between it holds keys
    that are not in the output, which cost an exact check and nothing else.
    """
    membership.write_filter(keys.select(key), path, key)
    write_jsonl(rows, path, mode="append")


def append_pending(rows: DataFrame, path: str, key: str = "uri") -> None:
    """Append the rows an earlier run has not written (JSON Lines output).

    Nothing is appended twice, whatever the order of the input and wherever
    an earlier run ended; see :func:`unwritten` and :func:`append_new`.
    """
    rows = unwritten(rows, path, key)
    append_new(rows, rows, path, key)


def written_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys of a JSON Lines output, each once."""
    return spark.read.schema(f"`{key}` string").json(path).distinct()
