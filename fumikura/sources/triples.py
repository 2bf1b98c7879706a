"""Triples from saved SPARQL result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scale import with_dense_rank

_TERM = "struct<value: string>"
_RESULT = f"results struct<bindings: array<struct<s: {_TERM}, p: {_TERM}, o: {_TERM}>>>"


def binding_rows(results: DataFrame) -> DataFrame:
    """Rows of parsed result documents: <s, p, o> and the place in the document."""
    rows = results.select("*", F.posexplode("results.bindings").alias("pos", "_b")).drop("results")
    return rows.select(
        *[c for c in rows.columns if c != "_b"],
        F.col("_b.s.value").alias("s"),
        F.col("_b.p.value").alias("p"),
        F.col("_b.o.value").alias("o"),
    )


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """One result document per file: <file, pos, s, p, o>."""
    docs = spark.read.schema(_RESULT).option("multiLine", True).json(path)
    return binding_rows(docs.withColumn("file", F.col("_metadata.file_path")))


def read_binding_lines(spark: SparkSession, path: str) -> DataFrame:
    """One result document per line (many saved pages in few files)."""
    docs = spark.read.schema(_RESULT).json(path)
    return binding_rows(docs.withColumn("file", F.col("_metadata.file_path")))


def numbered_triples(rows: DataFrame) -> DataFrame:
    """<s, p, o, ord> with ``ord`` along files and positions."""
    return with_dense_rank(rows, [F.col("file"), F.col("pos"), F.col("s"), F.col("p"), F.col("o")], "ord").select(
        "s", "p", "o", "ord"
    )
