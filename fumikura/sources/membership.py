"""A Bloom filter of keys, kept as a table beside the output it speaks of.

The filter has blocks of 512 bits, one row per block that has a bit.  A key
belongs to one block and sets BITS bits there.  New keys append rows; rows of
one block are united when they are read.  Whatever the filter rules out was
never written; what it does not needs an exact check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.scale import lookup_join

#: Bits set per key, and the number of blocks: 8 bits a key for some 67 million keys; more keys only mean more exact checks.
BITS = 6
BLOCKS = 1 << 20
_WORDS = [f"w{i}" for i in range(8)]


def _place(key: Column) -> tuple[Column, list[Column]]:
    """Block of a key, and its bits as eight words."""
    text = key.cast("string")
    mixed = F.xxhash64(text, F.lit(1))
    # Nine bits of one hash for every bit to set.
    spots = [F.shiftrightunsigned(mixed, 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(BITS)]
    words = []
    for number in range(len(_WORDS)):
        word = F.lit(0).cast("bigint")
        for spot in spots:
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot, F.lit(64)))
            word = word.bitwiseOR(F.when(F.call_function("div", spot, F.lit(64)) == number, bit).otherwise(F.lit(0)))
        words.append(word)
    return F.pmod(F.xxhash64(text, F.lit(2)), F.lit(BLOCKS)), words


def _with_bits(keys: DataFrame, key: str) -> DataFrame:
    block, words = _place(F.col(key))
    return keys.select(key, block.alias("block"), *[word.alias(name) for word, name in zip(words, _WORDS)])


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/_keys"


def write_filter(keys: DataFrame, path: str, key: str) -> DataFrame:
    """Adds keys to the filter of the output at ``path``; gives the whole filter.  Null keys are left out."""
    bits = _with_bits(keys.where(F.col(key).isNotNull()), key)
    bits.groupBy("block").agg(*[F.bit_or(word).alias(word) for word in _WORDS]).write.mode("append").parquet(_folder(path))
    return read_filter(keys.sparkSession, path)


def read_filter(spark: SparkSession, path: str) -> DataFrame | None:
    """<block, w0..w7> of the filter beside an output, one row per block; None if there is no whole one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_folder(path)}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    rows = spark.read.schema(", ".join(["block bigint", *[f"{word} bigint" for word in _WORDS]])).parquet(_folder(path))
    return rows.groupBy("block").agg(*[F.bit_or(word).alias(word) for word in _WORDS])


def possible(keys: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The keys <key> that a filter does not rule out; each key meets one row of the filter."""
    blocks = known.select("block", *[F.col(word).alias(f"_{word}") for word in _WORDS])
    met = lookup_join(_with_bits(keys, key), blocks, ["block"], "inner")
    held = F.lit(True)
    for word in _WORDS:
        held = held & (F.col(word).bitwiseAND(F.col(f"_{word}")) == F.col(word))
    return met.where(held).select(key)
