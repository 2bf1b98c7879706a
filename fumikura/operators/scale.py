"""Top-k, dense ranks and joins that stay even when one key is hot."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stored

# Spark limits rows per group before the shuffle up to this many (its own default).
_PRESHUFFLE_LIMIT = 1000
_SALTS = 32
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
TASK_ROWS = 500_000  # rows that one task gathers into arrays
#: Bytes of one Arrow batch handed to a Python task, where the session allows more.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Keeps Arrow batches small, so that long texts do not fill a worker's memory.

    This is a setting of the session, read when a query runs; a smaller one stays.
    """
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", spark.conf.get(_BATCH).strip().lower()).groups()
    now = int(number) << 10 * " kmgtp".index(unit or " ")
    if not 0 < now <= most:
        spark.conf.set(_BATCH, str(most))


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of an input that comes in too few partitions.

    Meant for the frame of a file scan, such as one unsplittable file.  Inputs
    with at least one partition per core stay as they are, unshuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Deals ``rows`` rows out by their keys, before arrays are gathered by these.

    The number of partitions grows with the rows, so a task holds about
    TASK_ROWS of them whatever the input is; and the task that reads them does
    not gather arrays of its own first, which saves nothing where groups are small.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // TASK_ROWS)), *keys)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that must be computed once per row.

    Later filters on them would be moved below a plain projection and compute
    them again for every mention; they do not move below a generator.
    """
    made = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select("*", F.inline(made))


def _weight(df: DataFrame) -> Column:
    """Rough bytes of a row: texts by length, nested values as their JSON text."""
    parts = []
    for column in df.schema.fields:
        kind, value = column.dataType.typeName(), F.col(f"`{column.name}`")
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(value), F.lit(0)))
        elif kind in ("array", "map", "struct", "variant"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)))
    return sum(parts, F.lit(16 * len(df.columns))).cast("bigint")


def is_small(df: DataFrame, rows: int | None = None, size: int = BROADCAST_BYTES) -> bool:
    """Whether a frame has at most ``rows`` rows and about ``size`` bytes.

    Rows are counted first, over all partitions; bytes only if they are few.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    return df.count() <= rows and (df.agg(F.sum(_weight(df))).first()[0] or 0) <= size


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    derived: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Equi join with one right row per key, safe against hot keys on the left.

    A right side measured as small, in rows and bytes, is broadcast.  Any
    other is joined as it is, each row once; adaptive execution measures the
    shuffled partitions and splits those that a hot key makes large.  A
    derived right side is written first, so that counting it and joining it do
    not compute it twice; pass ``derived=False`` for a stored table.
    """
    if derived:
        right = stored(right)
    return left.join(F.broadcast(right) if is_small(right, rows) else right, list(on), how)


def _salt(df: DataFrame) -> Column:
    """Salt of a row, the same when a lost task runs again.

    The partition number takes part, so that equal rows are spread as well.
    """
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("variant", "map")]
    mixed = F.xxhash64(*[F.col(c) for c in plain], F.spark_partition_id())
    return F.pmod(mixed, F.lit(_SALTS)).cast("int")


def top_rows(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of a total order with their rank.

    The limit runs per partition first, so the ranking sees ``k`` rows.
    """
    kept = df.orderBy(*order).limit(k)
    return kept.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of every group with their rank.

    Up to Spark's threshold the per-group limit runs before the shuffle.  A
    larger ``k`` goes through salted groups first, so no task sorts a whole
    hot group.
    """
    if k > _PRESHUFFLE_LIMIT:
        salted = df.withColumn("_salt", _salt(df))
        first = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))
        df = salted.withColumn("_first", first).where(F.col("_first") <= k).drop("_first", "_salt")
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank, number).where(F.col(rank) <= k).withColumn(
        rank, F.col(rank).cast("bigint")
    )


def with_dense_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Number all rows 1..N along a total order without one task seeing them all.

    The rows are range-sorted and written once with their partition and place
    in it; the partition sizes, one row each, give the offsets.  The number of
    the partition a row comes from breaks ties, which spreads equal rows.
    """
    place = F.monotonically_increasing_id()
    sourced = df.withColumn("_source", F.spark_partition_id())
    rows = stored(sourced.orderBy(*order, "_source").drop("_source").withColumn("_place", place))
    part = F.shiftright(F.col("_place"), 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition of `rows`
        .withColumn(rank, F.col("_offset") + inside + 1)
        .drop("_part", "_place", "_offset")
    )
