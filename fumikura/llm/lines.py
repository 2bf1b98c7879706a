"""Substring dedup by hashing lines, their sentences, or paragraphs, or all three at once.

Every text is cut into units; a unit's digest is that of its words in lower
case with single blanks between.  Equal digests are grouped over all
documents, the first occurrence by rank stays, and all others are removed.
Removed units keep their place in the original text.

A passage copied into the middle of a line is no line of its own; its inner
sentences still are units when lines are cut at the ends of sentences.  A line
of short sentences only is a unit as a whole; ``nested`` hashes sentences,
lines and paragraphs and removes what any of them repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.scale import lookup_join
from ..session import stored
from .bytewords import small_batches
from .rows import bound_batches, counted_chars, packed, row_key, schema, unpacked

#: What parts the units of a text.
UNITS = {"line": r"\n", "sentence": r"\n|(?<=[.!?])[ \t\r\f\v]+", "paragraph": r"\n[ \t\r\f\v]*\n\s*"}
#: Kinds of units hashed at once, finest first; the breaks of each are among those of the one before.
LEVELS = {"nested": ("sentence", "line", "paragraph")}
#: Shorter units are part of ordinary prose and stay, unless a longer unit round them goes.
LEAST_WORDS = 6


def _cut(text: str, parting: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    for gap in parting.finditer(text):
        yield at, gap.start()
        at = gap.end()
    yield at, len(text)


def units(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, rank: str = "doc_id") -> DataFrame:
    """<doc_id, _text, rank, level, unit, start, end, words, digest>, one row per unit with words, and one with unit -1 per row.

    ``start`` and ``end`` are code points of the text, from the unit's first
    word to its last; digest is null for units below ``least_words``.  Units of
    level 0 are numbered; one of a higher level has the number of the first
    unit in it, and is there only with a digest and other words than any
    finer unit.
    """
    patterns = [UNITS[u] for u in LEVELS.get(unit, (unit,))]
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partings = [re.compile(p) for p in patterns]
        for batch in small_batches(batches):
            texts = batch.column("text")
            row, level, number, start, end, count, digest = [], [], [], [], [], [], []
            for i in range(len(batch)):
                text = texts[i].as_py() or ""
                row.append(i), level.append(0), number.append(-1), start.append(0), end.append(len(text)), count.append(0), digest.append(None)
                begins: dict[int, int] = {}  # number of the unit that begins at a place
                met: set[tuple[int, int]] = set()
                for up, parting in enumerate(partings):
                    for k, (a, b) in enumerate(_cut(text, parting)):
                        piece = text[a:b]
                        first = a + len(piece) - len(piece.lstrip())
                        last = first + len(piece.strip())
                        if first == last or (first, last) in met:
                            continue
                        words = piece.lower().split()
                        if up and len(words) < least_words:
                            continue
                        if len(partings) > 1:
                            met.add((first, last))
                        if not up:
                            begins[first] = k
                        row.append(i), level.append(up), number.append(begins[first]), start.append(first), end.append(last), count.append(len(words))
                        digest.append(blake2b(" ".join(words).encode(), digest_size=16).digest() if len(words) >= least_words else None)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at), batch.column("_text").take(at), batch.column("_rank").take(at),
                    pa.array(level, pa.int32()), pa.array(number, pa.int32()),
                    pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(count, pa.int32()), pa.array(digest, pa.binary()),
                ],
                names=["doc_id", "_text", "rank", "level", "unit", "start", "end", "words", "digest"],
            )

    read = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.col(rank).alias("_rank"), "text")
    ranked = read.withColumnRenamed("_rank", "rank")
    return read.mapInArrow(run, schema(ranked, ("doc_id", "_text", "rank"), "level int, unit int, start int, end int, words int, digest binary"))


def find_repeats(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, rank: str = "doc_id") -> DataFrame:
    """Per row <doc_id, _text, n_units, n_removed, removed_words, removed>.

    ``removed`` lists <unit, start, end, doc_id of the occurrence that stays>
    in order.  The first occurrence is that with the least (rank, doc_id, text
    hash, start); a null rank comes after all others.

    * Null or empty text: no unit.  Units of fewer than ``least_words`` words stay.
    * ``nested``: ``n_units`` counts sentences; ``removed`` lists repeated sentences, lines and paragraphs
      that are in no longer one, <unit> being the number of their first sentence. Short sentences in them go too.
    * Rows that share doc_id and text are one document: its units stay or go in all of them alike.
    * A unit repeated within one document goes but for its first place.
    * Other columns are not read.
    """
    rows = stored(units(docs, unit, least_words, rank))
    order = F.struct(F.col("rank").isNull().alias("none"), "rank", "doc_id", "_text", "start")
    long = rows.where(F.col("digest").isNotNull())
    # Most units occur once.  Half their digest tells which may occur twice; counts are taken per task
    # first, so a line in a third of all documents is one row per task.
    half = F.xxhash64("digest")
    often = long.groupBy(half.alias("_half")).agg(F.count("*").alias("_c")).where(F.col("_c") > 1).select("_half")
    long = stored(long.withColumn("_half", half).join(often, "_half", "left_semi"))
    firsts = long.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("_last"))
    firsts = firsts.where(F.col("first") != F.col("_last")).select("digest", "first")
    hit = lookup_join(long, firsts, ["digest"], "inner").where(order != F.col("first"))
    gone = hit.select("doc_id", "_text", "unit", "start", "end", "words", F.col("first.doc_id").alias("kept_in")).distinct()
    if unit in LEVELS:  # units lie in each other or apart, so one is inside another if an earlier one ends no sooner
        before = Window.partitionBy("doc_id", "_text").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
        gone = gone.withColumn("_reach", F.max("end").over(before)).where(F.coalesce(F.col("end") > F.col("_reach"), F.lit(True))).drop("_reach")
    every = rows.groupBy("doc_id", "_text").agg(F.count(F.when(F.col("unit") == -1, 1)).alias("_rows"), F.count(F.when((F.col("unit") >= 0) & (F.col("level") == 0), 1)).alias("_units"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    every = every.select("doc_id", "_text", "_rows", "_units", F.lit(None).cast(f"struct<unit:int,start:int,end:int,kept_in:{kind}>").alias("_gone"), F.lit(0).alias("_words"))
    zero = F.lit(0).cast("bigint")
    out = gone.select("doc_id", "_text", zero.alias("_rows"), zero.alias("_units"), F.struct("unit", "start", "end", "kept_in").alias("_gone"), F.col("words").alias("_words"))
    totals = every.unionByName(out).groupBy("doc_id", "_text").agg(
        F.max("_rows").alias("_rows"),
        F.max("_units").alias("_units"),
        F.count("_gone").alias("n_removed"),
        F.sum("_words").cast("bigint").alias("removed_words"),
        F.array_sort(F.collect_list("_gone")).alias("removed"),
    )
    per_row = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows")))
    return totals.select("doc_id", "_text", (F.col("_units") / F.col("_rows")).cast("bigint").alias("n_units"), "n_removed", "removed_words", "removed", per_row.alias("_copy")).drop("_copy")


def dedup(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, rank: str = "doc_id") -> DataFrame:
    """Documents without repeated units; all columns and their order kept, then <removed_units>.

    A removed unit goes with the break after it (the last one with the break
    before it); ``n_chars`` follows the text.  Rows without a repeat stay as
    they are, with an empty list.
    """
    found = find_repeats(docs, unit, least_words, rank).where("n_removed > 0").select("doc_id", "_text", "removed").dropDuplicates(["doc_id", "_text"])
    keyed = packed(docs, "doc_id", F.xxhash64("text").alias("_text")).withColumn("_key", row_key())
    joined = lookup_join(keyed, found.select(row_key().alias("_key"), "removed"), ["_key"], "left").select("_row", "text", "removed")
    pattern = UNITS[LEVELS.get(unit, (unit,))[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parting = re.compile(pattern)
        for batch in batches:
            texts, gone = batch.column("text"), batch.column("removed").to_pylist()
            new = [_without(texts[i].as_py(), [(s["start"], s["end"]) for s in spans], parting) if spans else texts[i].as_py() for i, spans in enumerate(gone)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(new, pa.string()), pa.array([g or [] for g in gone], batch.schema.field("removed").type)], names=["_row", "text", "removed"]
            )

    clean = joined.mapInArrow(run, joined.schema).withColumnRenamed("removed", "_removed")
    out = unpacked(clean, docs.columns, "_removed", **counted_chars(docs, F.size("_removed") > 0))
    return out.withColumnRenamed("_removed", "removed_units")


def _without(text: str, out: list[tuple[int, int]], parting: re.Pattern) -> str:
    """Text without the units that begin inside given spans, which are in order and apart."""
    parts, tail, at = [], "", 0
    places = list(_cut(text, parting))
    for k, (a, b) in enumerate(places):
        first = b - len(text[a:b].lstrip())
        while at < len(out) and out[at][1] <= first:
            at += 1
        if at == len(out) or first < out[at][0]:
            parts.append(tail + text[a:b])
            tail = text[b:places[k + 1][0]] if k + 1 < len(places) else ""
    return "".join(parts)
