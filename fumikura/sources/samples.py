"""Example titles per word, as nested or flat JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def nested_samples(texts: DataFrame, text: str = "value") -> DataFrame:
    """``{"2": {word: [title]}}`` to <n, word, samples>."""
    sizes = texts.select(
        F.explode(F.from_json(text, "map<string, map<string, array<string>>>")).alias("n", "_words")
    )
    return sizes.select(F.col("n").try_cast("int").alias("n"), F.explode("_words").alias("word", "samples"))


def flat_samples(texts: DataFrame, text: str = "value") -> DataFrame:
    """``{word: [title]}`` to <word, samples>."""
    return texts.select(F.explode(F.from_json(text, "map<string, array<string>>")).alias("word", "samples"))


def read_samples(spark: SparkSession, path: str, flat: bool = False) -> DataFrame:
    """One JSON document per file; its size is set by the length of the top lists."""
    texts = spark.read.text(path, wholetext=True)
    return flat_samples(texts) if flat else nested_samples(texts)


def samples_document(examples: DataFrame) -> DataFrame:
    """<n, word, samples> of a top list as one nested JSON text: <value>.

    Pass top-list words only: the document holds sizes x top-N words.
    """
    entries = F.array_sort(F.collect_list(F.struct("word", "samples")))
    sizes = examples.groupBy(F.col("n").cast("string").alias("n")).agg(entries.alias("entries"))
    listed = F.array_sort(F.collect_list(F.struct("n", "entries")))
    by_size = F.transform(listed, lambda x: F.struct(x["n"], F.map_from_entries(x["entries"])))
    return sizes.agg(F.to_json(F.map_from_entries(by_size)).alias("value"))


def write_samples(examples: DataFrame, path: str, mode: str = "error") -> None:
    samples_document(examples).write.mode(mode).text(path)
