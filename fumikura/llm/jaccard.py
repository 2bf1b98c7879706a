"""Similarity join on the sets of a document's word n-grams.

Every set is put in one global order, rare n-grams first.  Two sets that are
similar enough must share an n-gram among the first few of both (prefix
filter), must be of similar size (length filter) and must have enough left
after the shared one (positional filter).  Two bounds on the rest follow
(suffix filter), neither of which loses a link.  Every n-gram flips one bit of
its set's sketch, so the bits in which two sketches differ are at most the
n-grams that only one of the sets has.  And the sets, cut by hash into 64
parts, share at most the lesser count of each part.  What is left is verified
once per pair, on whole sets.

Equal sets are one class and take part once.  Components are found in two
steps, so that a group of many near copies is not compared pair by pair: each
bucket of an n-gram is first compared with a few leaders of like size, and then only
pairs that are still in different components.  Every pair of classes that the
filters let through is verified or already connected, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scale import lookup_join
from ..session import stored
from .bytewords import SPACES, document_words, shingles, small_batches
from .components import components
from .rows import TEXT_BATCH, bound_batches, lean, packed, row_key, schema, unpacked

#: N-grams counted together by a task.
BLOCK = 2_000_000
#: Bytes of the table of frequencies at most; it has four for every n-gram that is kept.
SLOTS = 1 << 24
_PARTS = 64
#: Words of 64 bits in the parity sketch of a set.
SKETCH = 4
_SKETCH = [f"s{i}" for i in range(SKETCH)]


def _count_blocks(size: int):
    """Per block of about BLOCK n-grams, those that occur in several documents.

    A frequent n-gram is frequent in some block.  What is missed or undercounted
    only moves in the order; any order gives the same links.
    """

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(held)
        held.clear()
        values.sort()
        # Runs of equal values, by where they begin and end among the values that are like the one before them.
        like = np.concatenate([[False], values[1:] == values[:-1], [False]])
        first, last = np.flatnonzero(like[1:] > like[:-1]), np.flatnonzero(like[1:] < like[:-1])
        return pa.RecordBatch.from_pydict({"h": values[first].view(np.int64), "n": last - first + 1})

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in small_batches(batches):
            for _, words in document_words(batch.column(0), SPACES):
                own = shingles(words, size)
                held.append(own)
                total += len(own)
                if total >= BLOCK:
                    yield counted(held)
                    held, total = [], 0
        if total:
            yield counted(held)

    return run


def frequencies(docs: DataFrame, size: int, most: int = SLOTS) -> np.ndarray:
    """How frequent n-grams are, roughly: a byte for every remainder of a hash by the table's length.

    0 stands for n-grams that are not known to be repeated, other values grow
    with the logarithm of the count.  The table grows with the number of
    repeated n-grams up to ``most`` bytes; beyond it the least frequent are left out.  Where hashes
    meet, the larger count stands.  All this only moves n-grams in the order, and any order gives the same links.
    """
    bound_batches(docs.sparkSession, TEXT_BATCH)
    counted = docs.select("text").mapInArrow(_count_blocks(size), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(255), F.floor(8 * F.log2("n"))).cast("int")
    rated = stored(counted.select("h", level.alias("level")))
    # One row per level: from which on do all fit?
    sizes = {r.level: r["count"] for r in rated.groupBy("level").count().collect()}
    kept, least = 0, 256
    for number in sorted(sizes, reverse=True):
        if kept + sizes[number] > most // 4:
            break
        kept, least = kept + sizes[number], number
    slots = 1 << max(10, (4 * kept - 1).bit_length()) if kept else 1 << 10
    slots = min(slots, 1 << (most.bit_length() - 1))
    table = np.zeros(slots, np.uint8)
    found = rated.where(F.col("level") >= least).groupBy(F.col("h").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")).agg(F.max("level").cast("short").alias("level"))
    for batch in found.toArrow().to_batches():  # at most a quarter of ``most`` rows
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table


def _ceil_share(n, top: int, bottom: int):
    return -(-n * top // bottom)


def _rare_first(own: np.ndarray, table: np.ndarray, keep: int) -> np.ndarray:
    """The first ``keep`` n-grams of a set, which is in order of hashes, by (frequency, hash)."""
    level = table[(own & np.uint64(len(table) - 1)).astype(np.int64)]
    return own[np.argsort(level, kind="stable")[:keep]]


def sketch_of(own: np.ndarray) -> np.ndarray:
    """Parity, per bit, of the n-grams whose hash falls on it."""
    spot = (own >> np.uint64(20)) % np.uint64(64 * SKETCH)
    odd = np.bincount(spot.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def class_of(own: np.ndarray) -> int:
    """64-bit digest of a set; among a thousand million sets two agree by chance once in 37 runs."""
    return int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """<doc_id, _text, n, class, probe, indexed, parts, s0..> of every row.

    ``probe`` is the prefix a set looks partners up with, its first
    ``indexed`` n-grams are those it is found by; ``parts`` counts the set by
    hash, ``s0..`` are its sketch.  Class, prefix and parts are null for an empty set.
    """
    held = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size))  # at most SLOTS bytes

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in small_batches(batches):
            rows = len(batch)
            count, indexed = np.zeros(rows, np.int64), np.zeros(rows, np.int32)
            name, probe, parts = [None] * rows, [None] * rows, [None] * rows
            sketch = np.zeros((SKETCH, rows), np.int64)
            for i, words in document_words(batch.column("text"), SPACES):
                own = shingles(words, size)
                n = len(own)
                if not n:
                    continue
                count[i], name[i] = n, class_of(own)
                first = n - _ceil_share(n, percent, 100) + 1
                indexed[i] = n - _ceil_share(n, 2 * percent, 100 + percent) + 1
                probe[i] = _rare_first(own, table, first).view(np.int64)
                sketch[:, i] = sketch_of(own)
                parts[i] = np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=_PARTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("_text"), pa.array(count), pa.array(name, pa.int64()),
                    pa.array(probe, pa.list_(pa.int64())), pa.array(indexed), pa.array(parts, pa.list_(pa.int32())), *map(pa.array, sketch),
                ],
                names=["doc_id", "_text", "n", "class", "probe", "indexed", "parts", *_SKETCH],
            )

    read = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    sketches = ", ".join(f"{c} bigint" for c in _SKETCH)
    return read.mapInArrow(run, schema(read, ("doc_id", "_text"), f"n bigint, class bigint, probe array<bigint>, indexed int, parts array<int>, {sketches}"))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """<class, set> of the wanted classes; texts are found again by their hash ``_text``."""
    keyed = docs.select(F.xxhash64("text").alias("_text"), "text")
    texts = lookup_join(keyed, wanted.select("_text").distinct(), ["_text"], "left_semi")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            name, sets, last = [], [], set()
            for _, words in document_words(batch.column(0), SPACES):
                own = shingles(words, size)
                if len(own) and (key := class_of(own)) not in last:
                    last.add(key)
                    name.append(key)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["class", "set"])

    made = texts.select("text").mapInArrow(run, "class bigint, set array<bigint>")
    return made.groupBy("class").agg(F.first("set").alias("set"))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length, positional and sketch filter of a row of set x and one of set y that share an n-gram.

    The larger set must probe with it and the smaller be found by it.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c(x, "n") + c(y, "n")
    need = total * percent
    # At least so many n-grams are in one of the sets only.
    apart = reduce(lambda a, b: a + b, [F.bit_count(c(x, s).bitwiseXOR(c(y, s))) for s in _SKETCH])
    left = 1 + F.least(c(x, "n") - c(x, "pos") - 1, c(y, "n") - c(y, "pos") - 1)
    x_is_larger = (c(x, "n") > c(y, "n")) | ((c(x, "n") == c(y, "n")) & (c(x, "class") > c(y, "class")))
    return (
        (F.least(c(x, "n"), c(y, "n")) * 100 >= F.greatest(c(x, "n"), c(y, "n")) * percent)
        & (left * (100 + percent) >= need)
        & ((total - apart) * (100 + percent) >= 2 * need)
        & F.when(x_is_larger, c(y, "pos") < c(y, "indexed")).otherwise(c(x, "pos") < c(x, "indexed"))
    )


def _pairs(joined: DataFrame) -> DataFrame:
    a, b = F.col("x.class"), F.col("y.class")
    return joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs <a, b> of classes whose sets are similar enough; each is tested once."""
    side = lambda name: classes.select(F.col("class").alias(name), F.col("n").alias(f"_n{name}"), F.col("parts").alias(f"_p{name}"), F.col("_text").alias(f"_t{name}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.aggregate(F.zip_with("_pa", "_pb", lambda p, q: F.least(p, q).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)
    total = F.col("_na") + F.col("_nb")
    likely = stored(known.where(shared * (100 + percent) >= total * percent).select("a", "b", "_na", "_nb", "_ta", "_tb"))
    wanted = likely.select(F.explode(F.array("_ta", "_tb")).alias("_text"))
    sets = stored(_sets(docs, wanted, size))
    both = likely.join(sets.select(F.col("class").alias("a"), F.col("set").alias("_sa")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("set").alias("_sb")), "b"
    )
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(common * 100 >= (total - common) * percent).select("a", "b")


def _candidates(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of classes that share an n-gram of their prefixes and pass the filters.

    ``rows`` is <tok, class, n, pos, indexed, comp>.  Unless ``every``, pairs
    within a component are left out: in a bucket, each row outside its largest
    component meets all rows.
    """
    if every:
        one = rows
    else:
        mixed = rows.groupBy("tok", "comp").agg(F.count("*").alias("_c")).groupBy("tok").agg(F.max(F.struct("_c", "comp")).alias("_m"), F.count("*").alias("_k"))
        mixed = mixed.where(F.col("_k") > 1).select("tok", F.col("_m.comp").alias("_major"))
        rows = stored(rows.join(mixed, "tok"))
        one = rows.where(F.col("comp") != F.col("_major"))
    apart = F.col("x.class") != F.col("y.class") if every else F.col("x.comp") != F.col("y.comp")
    return _pairs(one.alias("x").join(rows.alias("y"), (F.col("x.tok") == F.col("y.tok")) & apart & _may_link("x", "y", percent)))


def similarity_join(docs: DataFrame, size: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(members, links) of documents by the sets of their ``size``-word n-grams.

    ``members`` is <doc_id, _text, n_shingles, class, root, component_id>, one
    row per input row, with ``_text`` a hash of the text and ``root`` a class
    that names the component (null if no other row is in it); ``links`` is <a, b> of classes and connects every component.

    Words are runs without ASCII white space, ASCII letters in lower case; a
    text of fewer words than ``size`` has its whole sequence as one n-gram.
    Two sets link when 100 * intersection >= ``percent`` * union.

    * Null or empty text, or text without a word: empty set, class null, linked
      with nothing, component_id is its own doc_id.
    * Rows of equal sets are one class, thus connected, whatever their ids.
    * component_id is the least doc_id of the component, nulls left out; null if there are only nulls.
    * Repeated rows give repeated results; other columns are not read.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    rows = stored(signatures(docs, size, percent).withColumn("_key", row_key()))
    full = rows.where(F.col("n") > 0)
    classes = stored(
        full.groupBy("class").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("_key").alias("_key"), F.first("n").alias("n"), F.first("_text").alias("_text"),
            F.first("indexed").alias("indexed"), F.first("parts").alias("parts"), *[F.first(c).alias(c) for c in _SKETCH],
        )
    )
    # Prefixes of all rows but copies: those are few enough to be told by their keys, so prefixes are not shuffled here.
    held_back = classes.where(F.col("copies") > 1).select("class", F.col("_key").alias("_kept"))
    copies = lookup_join(full.select("class", "_key"), held_back, ["class"], "inner").where(F.col("_key") != F.col("_kept")).select("_key")
    single = lookup_join(full.select("_key", "class", "probe", "indexed"), copies, ["_key"], "left_anti")
    postings = single.select("class", F.posexplode("probe").alias("pos", "tok"), "indexed")
    # Of most n-grams there is one; a pair needs two sets, and one that is found by it.
    shared = postings.groupBy("tok").agg(F.count("*").alias("_c"), F.count_if(F.col("pos") < F.col("indexed")).alias("_i"))
    shared = shared.where((F.col("_c") > 1) & (F.col("_i") > 0)).select("tok")
    met = postings.select("tok", "class", "pos").join(shared, "tok", "left_semi")
    buckets = stored(met.join(classes.select("class", "n", "indexed", *_SKETCH), "class"))

    # First step: in each bucket, everyone against the leaders of its own range of sizes and the next ones.
    # The fewer rare n-grams stand before the shared one, the less a copy was changed: such a one leads.
    step = -math.log(percent / 100) if percent < 100 else 1.0
    banded = buckets.withColumn("_band", F.floor(F.log("n") / step))
    leaders = banded.groupBy("tok", "_band").agg(F.min(F.struct("pos", "class", "n", "indexed", *_SKETCH)).alias("_l"))
    leaders = leaders.select("tok", F.explode(F.array(*[F.col("_band") + i for i in (-1, 0, 1)])).alias("_band"), "_l.*")
    paired = banded.alias("x").join(
        leaders.alias("y"),
        (F.col("x.tok") == F.col("y.tok")) & (F.col("x._band") == F.col("y._band")) & (F.col("x.class") != F.col("y.class")) & _may_link("x", "y", percent),
    )
    tried = stored(_pairs(paired))
    first = stored(verified(tried, classes, docs, size, percent))
    roots = stored(components(first))

    # Second step: what is left between different components.
    placed = buckets.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("comp", F.coalesce("root", "class"))
    rest = stored(_candidates(placed.select("tok", "class", "n", "pos", "indexed", "comp", *_SKETCH), percent, every=False))
    second = stored(verified(rest.join(tried, ["a", "b"], "left_anti"), classes, docs, size, percent))
    links = first.unionByName(second)
    if second.isEmpty():
        final = roots
    else:
        final = stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)))

    # Least doc_id of every component of several classes, and of every class with copies.
    grouped = classes.select("class", "first_id", "copies").join(final.withColumnRenamed("node", "class"), "class", "left")
    several = grouped.where(F.col("root").isNotNull() | (F.col("copies") > 1)).withColumn("root", F.coalesce("root", "class"))
    least = several.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = several.select("class", "root").join(least, "root").select("class", "root", "component_id")
    found = lookup_join(rows.select("doc_id", "_text", F.col("n").alias("n_shingles"), "class"), named, ["class"], "left")
    alone = F.col("root").isNull()
    members = found.select("doc_id", "_text", "n_shingles", "class", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return members, links


def every_link(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """<a, b> of all pairs of classes that link, also within components.

    The number of rows is that of the links, so it grows with the square of a
    group of near copies; :func:`similarity_join` gives the groups without.
    """
    rows = stored(signatures(docs, size, percent))
    classes = stored(rows.where(F.col("n") > 0).dropDuplicates(["class"]))
    postings = stored(classes.select("class", "n", "indexed", F.lit(0).alias("comp"), *_SKETCH, F.posexplode("probe").alias("pos", "tok")))
    return verified(_candidates(postings, percent, every=True), classes, docs, size, percent)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies; all columns and their order kept.

    The row with the least doc_id stays (rows without an id come last), then
    that with the least text hash; of wholly repeated (doc_id, text) rows one
    stays.  Rows of empty sets all stay.
    """
    members, _ = similarity_join(docs, size, percent)
    key = ["_id", "_text"]
    rows = stored(members.where(F.col("root").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "_text", "root", "doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", "_id")
    winners = rows.groupBy("root").agg(F.min(order).alias("_w")).select("root", F.col("_w._id").alias("_id"), F.col("_w._text").alias("_text"))
    losers = rows.select("root", *key).join(winners, ["root", *key], "left_anti").select(*key).distinct()
    repeated = stored(rows.groupBy(*key).agg(F.count("*").alias("_c")).where(F.col("_c") > 1).select(*key))
    keyed = packed(docs, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64("text").alias("_text"))
    kept = lookup_join(keyed, losers, key, "left_anti")
    if not repeated.isEmpty():
        once = lookup_join(kept, repeated, key, "left_semi", derived=False).dropDuplicates(key)
        kept = lookup_join(kept, repeated, key, "left_anti", derived=False).unionByName(once)
    return unpacked(kept, docs.columns)
