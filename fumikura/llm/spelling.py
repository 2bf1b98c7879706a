"""Spelling variants by a dictionary of trie node pairs.

The words of a corpus are put in two tries, one forward and one of the
reversed words, and the nodes of both are numbered.  A place in a word is then
a pair of integers, the node of what stands before and the node of what
follows.  Two words differ by one replaced code point when they have the same
pair round a skipped one, and by an inserted one when the pair at a place of
the shorter is the pair round a skipped code point of the longer.  So a join
of integer pairs finds every neighbour and nothing else.

A trie is numbered without any task holding it.  Cut words part the sorted
words in ranges; a node that lies on the way to a cut word can reach over
ranges and is numbered with the cuts, any other lies in one range and gets a
number of that range when the words pass in order.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .bytewords import small_batches
from .rows import bound_batches

LEAST = 7
TIMES = 2
RATIO = 10
#: One of so many runs of a document loses a code point.
DROP = 31
#: Distinct words a task counts before it hands them on.
HELD = 300_000
#: Words looked at per range when the cut words are chosen; they change the balance, not the numbers' meaning.
SAMPLE = 20
_RANGE = 40
# What a place of a word is: whole there, or a skipped code point, the first of its run or not.
WHOLE, SKIP, FIRST = 0, 1, 2


def word_counts(docs: DataFrame, least: int = LEAST, times: int = TIMES, drop: int | None = DROP) -> DataFrame:
    """<word, n> of the words of all texts with at least ``least`` code points and ``times`` occurrences.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, only A-Z in lower
    case.  With ``drop``, a run loses the code point at h % length where
    ``drop`` divides h, the crc32 of ``<doc_id>:<run>``.  Null text has no
    words; a null id is spelled as nothing.  Repeated rows count each.
    """
    bound_batches(docs.sparkSession)
    runs = re.compile("[a-zÀ-ÿ]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in small_batches(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = crc32(f"{'' if key is None else key}:".encode())
                # bytes.lower() leaves all but A-Z as they are.
                for word, n in Counter(runs((text.as_py() or "").encode().lower().decode())).items():
                    if len(word) < least:
                        continue
                    if drop and not (h := crc32(word.encode(), start)) % drop:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    total[word] += n
            if len(total) >= HELD:
                yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
                total.clear()
        if total:
            yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def cut_words(words: DataFrame, column: str, ranges: int) -> list[str]:
    """At most ``ranges`` words in code-point order, evenly spread; from about SAMPLE * ``ranges`` words chosen by hash."""
    step = max(1, words.count() // (SAMPLE * ranges))
    some = sorted(r[0] for r in words.where(F.pmod(F.xxhash64(column), F.lit(step)) == 0).select(column).collect())
    return some[len(some) // (2 * ranges)::max(1, -(-len(some) // ranges))]


class Numbering:
    """Numbers of trie nodes for words that pass range by range, in order within a range."""

    def __init__(self, cuts: list[str]):
        self.cuts = cuts
        # The trie of the cut words: (node, letter) to node; the root is 0.
        self.common: dict[tuple[int, str], int] = {}
        for word in cuts:
            node = 0
            for letter in word:
                node = self.common.setdefault((node, letter), len(self.common) + 1)
        self.range = self.next = -1
        self.word, self.path = "", [0]

    def range_of(self, word: str) -> int:
        return bisect_right(self.cuts, word)

    def nodes(self, word: str, number: int) -> list[int]:
        """Nodes of all beginnings of a word of range ``number``, from the root to the whole word."""
        if number != self.range:
            self.range, self.next, self.word, self.path = number, (number + 1) << _RANGE, "", [0]
        path, node = [0], 0
        for letter in word:
            node = self.common.get((node, letter))
            if node is None:
                break
            path.append(node)
        # Beyond the common nodes: those of the word before as far as both agree, then new ones.
        at = len(path) - 1
        old = self.word
        if len(path) <= min(len(old), len(word)) and old[:at] == word[:at]:
            most = min(len(old), len(word))
            while at < most and old[at] == word[at]:
                at += 1
            path += self.path[len(path):at + 1]
        fresh = len(word) + 1 - len(path)
        path += range(self.next, self.next + fresh)
        self.next += fresh
        self.word, self.path = word, path
        return path


def _in_ranges(words: DataFrame, column: str, cuts: list[str], ranges: int) -> DataFrame:
    """The rows with their range ``_range``, sorted by it and the word; a range is within one partition."""
    columns = words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = [bisect_right(cuts, w) for w in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*columns, "_range"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(run, f"{kind}, _range bigint").repartition(ranges, "_range").sortWithinPartitions("_range", column)


def _forward(batches: Iterator[pa.RecordBatch], cuts: list[str]) -> Iterator[pa.RecordBatch]:
    """<id, word, n, path> of the sorted words; ids follow the order of the words."""
    trie, place, last = Numbering(cuts), 0, None
    for batch in small_batches(batches):
        ids, paths = [], []
        for word, number in zip(batch.column("word").to_pylist(), batch.column("_range").to_pylist()):
            if number != last:
                place, last = 0, number
            ids.append((number << _RANGE) + place)
            place += 1
            paths.append(trie.nodes(word, number))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("word"), batch.column("n"), pa.array(paths, pa.list_(pa.int64()))], names=["id", "word", "n", "path"])


def _places(batches: Iterator[pa.RecordBatch], cuts: list[str]) -> Iterator[pa.RecordBatch]:
    """<before, after, id, n, kind> of every place of every word, in the order of the reversed words."""
    trie = Numbering(cuts)
    for batch in small_batches(batches, 256):
        before, after, kinds, sizes = [], [], [], []
        for turned, number, path in zip(batch.column("turned").to_pylist(), batch.column("_range").to_pylist(), batch.column("path")):
            path, back = path.values.to_numpy(), trie.nodes(turned, number)[::-1]
            word = turned[::-1]
            before += [path, path[:-1]]
            after += [back, back[1:]]
            kinds += [WHOLE] * len(path)
            kinds += [FIRST if not i or word[i - 1] != word[i] else SKIP for i in range(len(word))]
            sizes.append(2 * len(path) - 1)
        many = lambda name: pa.array(np.repeat(batch.column(name).to_numpy(), sizes))
        both = [pa.array(np.concatenate([np.asarray(x, np.int64) for x in xs])) if xs else pa.array([], pa.int64()) for xs in (before, after)]
        yield pa.RecordBatch.from_arrays([*both, many("id"), many("n"), pa.array(kinds, pa.int8())], names=["before", "after", "id", "n", "kind"])


def numbered(words: DataFrame) -> DataFrame:
    """<id, word, n, path>: words <word, n> with the nodes of their beginnings; ids follow code-point order."""
    ranges = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut_words(words, "word", ranges)
    sorted_ = _in_ranges(words, "word", cuts, ranges)
    return sorted_.mapInArrow(lambda batches: _forward(batches, cuts), "id bigint, word string, n bigint, path array<bigint>")


def places(known: DataFrame) -> DataFrame:
    """<before, after, id, n, kind> of numbered words: node pairs at every place and round every code point."""
    turned = known.select("id", "n", "path", F.reverse("word").alias("turned"))
    ranges = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut_words(turned, "turned", ranges)
    return _in_ranges(turned, "turned", cuts, ranges).mapInArrow(lambda batches: _places(batches, cuts), "before bigint, after bigint, id bigint, n bigint, kind byte")


def near_pairs(known: DataFrame) -> DataFrame:
    """<id, n, near, near_n>: every two numbered words that differ by one code point, once in each direction.

    A node pair round a skipped code point stands for one word per letter of
    the alphabet at most, so no key of the join is hot.
    """
    rows = places(known)
    x, y = rows.alias("x"), rows.alias("y")
    replaced = (F.col("x.kind") != WHOLE) & (F.col("y.kind") != WHOLE) & (F.col("x.id") != F.col("y.id"))
    longer = ((F.col("x.kind") == WHOLE) & (F.col("y.kind") == FIRST)) | ((F.col("x.kind") == FIRST) & (F.col("y.kind") == WHOLE))
    met = x.join(y, (F.col("x.before") == F.col("y.before")) & (F.col("x.after") == F.col("y.after")) & (replaced | longer))
    return met.select(F.col("x.id").alias("id"), F.col("x.n").alias("n"), F.col("y.id").alias("near"), F.col("y.n").alias("near_n"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """<word, form, root, n, n_near, form_n> of words <word, n>, each word once.

    Two words are near if one inserted, deleted or replaced code point makes
    one of the other.  ``form`` is the near word of largest n, of equal ones
    the first in code-point order, if its n is at least ``ratio`` times that
    of the word, else null; ``root`` follows forms to the last and is the word
    itself if it has none.

    Words may be of any length.  No word gives no row.  Each step to a form
    multiplies n by ``ratio``, so the number of rounds is known beforehand.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    known = stored(numbered(words))
    best = near_pairs(known.select("id", "word", "n", "path")).groupBy("id").agg(
        F.count("*").alias("n_near"), F.first("n").alias("_n"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("id"))).alias("_best")
    )
    has_form = -F.col("_best.n") >= ratio * F.col("_n")
    near = stored(best.select("id", "n_near", F.when(has_form, F.col("_best.id")).alias("to"), F.when(has_form, -F.col("_best.n")).alias("form_n")))

    ends = near.where(F.col("to").isNotNull()).select("id", F.col("to").alias("end"))
    most = near.agg(F.max("form_n")).first()[0] or 1
    steps = int(math.log(most) / math.log(ratio)) + 1
    for _ in range(steps.bit_length()):  # every round doubles how far a word is followed
        ends = stored(ends)
        after = ends.select(F.col("id").alias("end"), F.col("end").alias("_on"))
        ends = ends.join(after, "end", "left").select("id", F.coalesce("_on", "end").alias("end"))

    name = known.select("id", "word", "n")
    found = name.join(near, "id", "left").join(ends, "id", "left")
    found = found.join(name.select(F.col("id").alias("to"), F.col("word").alias("form")), "to", "left")
    found = found.join(name.select(F.col("id").alias("end"), F.col("word").alias("_last")), "end", "left")
    return found.select("word", "form", F.coalesce("_last", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


def spelling_groups(docs: DataFrame, least: int = LEAST, times: int = TIMES, ratio: int = RATIO, drop: int | None = DROP) -> DataFrame:
    """:func:`variants` of the :func:`word_counts` of all texts."""
    return variants(stored(word_counts(docs, least, times, drop)), ratio)
