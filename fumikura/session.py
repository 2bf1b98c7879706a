"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_OWNER: ContextVar[str | None] = ContextVar("fumikura_stages", default=None)


def build_session(cores: int | str = "*", memory: str = "20g", shuffle_partitions: int | None = None):
    """Local session for tests and the benchmark; a cluster brings its own."""
    if shuffle_partitions is None:
        shuffle_partitions = int(cores) if str(cores).isdigit() else (os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fumikura")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a session without that setting gets a folder of this machine, which
    is right for local mode and nothing else.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="fumikura-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder, or below that of the stages now open."""
    folder = _OWNER.get() or f"{shared_dir(spark).rstrip('/')}/fumikura"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def stages(spark: SparkSession) -> Iterator[str]:
    """Owns the tables written inside and removes them at the end.

    Frames made inside read these tables, so write what is to stay (to a path
    taken outside) before the block ends.
    """
    folder = scratch_path(spark, "stages")
    before = _OWNER.set(folder)
    try:
        yield folder
    finally:
        _OWNER.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a short frame to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str | None = None, by: str | None = None) -> DataFrame:
    """Write a frame that grows with the corpus to a table in the shared folder.

    Columnar files keep what is read again small: columns are pruned and
    filters pushed, and the planner knows the size.  ``compression`` is one of
    Parquet's, by default that of the session; ``zstd`` suits long texts.
    ``by`` names a column of few values; one value is then read without the
    rows of the others.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path, compression=compression, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """A table in the shared folder that grows by appending and stays dealt out by its keys.

    Joins and groupings on the keys read it without a shuffle.  The catalog
    knows it only until :meth:`forget`; its files stay.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int, keys: list[str]):
        self.spark, self.buckets, self.keys = spark, buckets, keys
        self.path = scratch_path(spark, name)
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.schema = None

    def append(self, df: DataFrame, partition: str | None = None) -> int:
        """Number of rows written; ``partition`` names a column that tells appended rows from earlier ones."""
        counted = Observation()
        observed = df.observe(counted, F.count(F.lit(1)).alias("rows"))
        writer = observed.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, *self.keys)
        (writer.partitionBy(partition) if partition else writer).saveAsTable(self.name)
        self.schema = df.schema
        return counted.get["rows"]

    def rows(self) -> DataFrame:
        """All rows, dealt out by the keys."""
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """All rows, read from the files; stays valid when the catalog has forgotten the table."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
