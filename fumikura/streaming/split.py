"""Drop/keep split of JSON Lines that keep arriving in a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions import titles
from ..operators import match
from ..operators.scale import pinned
from ..sources.records import parse_records


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).withColumnRenamed("value", "raw")


def stream_split(lines: DataFrame, drop: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """<raw, verdict, reason> per line; no state, any trigger."""
    titled = pinned(parse_records(lines), title=titles.title("rec"))
    verdict = match.three_way_verdict(match.first_hit("title", drop), match.first_hit("title", keep))
    return titled.withColumn("_v", verdict).select("raw", "_v.verdict", "_v.reason")


def write_split(split: DataFrame, path: str, checkpoint: str, **trigger):
    """Start the query: one parquet folder per verdict."""
    return (
        split.writeStream.format("parquet")
        .partitionBy("verdict")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
