"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every run of words of the normalised test items.  Words
of a document are streamed through it; at every word it knows the longest
run, ending there, that some item contains.  A place where that length
reaches ``window`` ends a window; items shorter than the window count whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..operators.scale import lookup_join
from ..session import stored
from .bytewords import small_batches
from .rows import TEXT_BATCH, asked, bound_batches, counted_chars, lean, packed, schema, store, unpacked

WINDOW = 10
#: Item words held by one automaton, which takes about a kilobyte a word; more items go through several, one after another.
BLOCK_WORDS = 200_000

# ASCII letters in lower case, digits and bytes from 0x80 on make words; the rest parts them.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


#: The same words as a pattern over code points.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        ends: list[set[int]] = [set()]
        whole: list[set[int]] = [set()]
        for number, (_, words) in enumerate(items):
            last = 0
            for word in words:
                last = self._extend(last, word, ends, whole)
                ends[last].add(number)
            if words and len(words) < window:
                whole[last].add(number)
        # Items of a state hold for all states its links lead to: longest first.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        # Where a match of at least ``window`` words ends: the items that hold its last ``window`` words.
        self.windows: list[tuple[int, ...]] = [()] * len(self.next)
        # Whole short items that end a match: (length, items), by following the links.
        self.short: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= window:
                self.windows[state] = tuple(sorted(ends[state])) if self.length[up] < window else self.windows[up]
            own = ((self.length[state], tuple(sorted(whole[state]))),) if whole[state] else ()
            self.short[state] = self.short[up] + own

    def _extend(self, last: int, word: bytes, ends: list[set[int]], whole: list[set[int]]) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._copy(last, word, known, ends, whole)
        new = self._state(self.length[last] + 1, {}, 0, ends, whole)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            exact = self.length[known] == self.length[at] + 1
            self.link[new] = known if exact else self._copy(at, word, known, ends, whole)
        return new

    def _copy(self, at: int, word: bytes, known: int, ends: list[set[int]], whole: list[set[int]]) -> int:
        """Split the shorter runs of a state off into a state of their own."""
        copy = self._state(self.length[at] + 1, dict(self.next[known]), self.link[known], ends, whole)
        self.link[known] = copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, next_: dict[bytes, int], link: int, ends: list[set[int]], whole: list[set[int]]) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        ends.append(set())
        whole.append(set())
        return len(self.next) - 1

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Word spans covered by windows (merged, end exclusive), their items, longest run."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        follow, link, lengths, short, window = self.next, self.link, self.length, self.short, self.window
        root = follow[0]
        state = length = longest = 0
        for place, word in enumerate(words):
            if state:
                to = follow[state].get(word)
                while to is None and state:
                    state = link[state]
                    length = lengths[state]
                    to = follow[state].get(word)
                if to is None:
                    length = 0
                    continue
                state = to
                length += 1
            else:
                state = root.get(word, 0)
                if not state:
                    continue
                length = 1
            if length > longest:
                longest = length
            begin = place + 1
            if length >= window:
                begin = place + 1 - window
                items.update(self.windows[state])
            if short[state]:
                for size, names in short[state]:
                    if size <= length:
                        begin = min(begin, place + 1 - size)
                        items.update(names)
            if begin <= place:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, place + 1))
        return spans, items, longest


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Distinct items as word lists, in blocks of about BLOCK_WORDS words.

    Spark counts the words and deals the items out by their hash; one block
    at a time comes to the driver.  An item is never cut.
    """
    size = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("name"), "text").distinct()
    items = stored(items.withColumn("size", size).where("size > 0"))
    total = items.agg(F.sum("size")).first()[0] or 0
    count = max(1, -(-total // BLOCK_WORDS))
    for number in range(count):
        block = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == number)
        yield [(row.name, words_of(row.text)) for row in block.select("name", "text").collect()]


def find_overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with <n_words, n_hit, n_items, items, spans, longest> of every row.

    * ``items`` are the item ids as sorted strings, ``spans`` the word spans
      covered by windows, merged, end exclusive; ``longest`` is the longest run shared with an item.
    * Null or empty text, or text without a word: zero words, no hit.  Items
      with null text or no word take no part; repeated item ids count once.
      Words of an item with null id are hit, but it is not among ``items``.
    * An empty test set hits nothing.
    * One output row per input row; other columns are not read.
    """
    read, measured = _matched(docs.select(*dict.fromkeys([*keep, "text"])), benchmark, window)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = measured(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pa.array([r[0] for r in found], pa.int64()),
                    pa.array([sum(b - a for a, b in r[1]) for r in found], pa.int64()),
                    pa.array([len(r[2]) for r in found], pa.int64()),
                    pa.array([sorted(r[2]) for r in found], pa.list_(pa.string())),
                    pa.array([[x for s in r[1] for x in s] for r in found], pa.list_(pa.int64())),
                    pa.array([r[3] for r in found], pa.int64()),
                ],
                names=[*keep, "n_words", "n_hit", "n_items", "items", "spans", "longest"],
            )

    return read.mapInArrow(run, schema(docs, keep, "n_words bigint, n_hit bigint, n_items bigint, items array<string>, spans array<bigint>, longest bigint"))


def _matched(rows: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[list]]]:
    """Rows <.., text>, and what tells the words, spans, item names and longest run of each row of a batch.

    A test set of one block is broadcast and matched where the rows are read.
    A larger one takes one pass over the texts per block, with the broadcast
    of that block alone; what a pass finds is written under the digest of the
    text, united over the blocks, and joined to the rows.
    """
    bound_batches(rows.sparkSession, TEXT_BATCH)
    blocks = _blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        held = _broadcast(rows, window, first)
        return rows, lambda batch: _found(batch.column("text"), _built(*held.value))
    parts = [_found_in_block(rows, window, block) for block in chain((first, second), blocks)]
    every = reduce(DataFrame.unionByName, parts).groupBy("_key")  # copies of a text have equal rows
    united = every.agg(F.collect_set(F.struct("items", "spans")).alias("_parts"), F.max("longest").alias("_longest"))
    keyed = rows.withColumn("_key", F.unhex(F.sha2("text", 256)))
    return lookup_join(keyed, united, ["_key"], "left").drop("_key"), _united


def _broadcast(rows: DataFrame, window: int, block: list[tuple[str | None, list[bytes]]]) -> Broadcast:
    """A block under a name that tells blocks apart in reused workers."""
    return rows.sparkSession.sparkContext.broadcast((uuid4().hex, window, block))


def _found_in_block(rows: DataFrame, window: int, block: list[tuple[str | None, list[bytes]]]) -> DataFrame:
    """<_key, items, spans, longest> of the texts that share a word with a block, stored."""
    held = _broadcast(rows, window, block)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column("text")
            found = [(i, r) for i, r in enumerate(_found(texts, _built(*held.value))) if r[3]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sha256(texts[i].as_py().encode()).digest() for i, _ in found], pa.binary()),
                    pa.array([sorted(r[2]) for _, r in found], pa.list_(pa.string())),
                    pa.array([[x for s in r[1] for x in s] for _, r in found], pa.list_(pa.int64())),
                    pa.array([r[3] for _, r in found], pa.int64()),
                ],
                names=["_key", "items", "spans", "longest"],
            )

    done = stored(rows.select("text").mapInArrow(run, "_key binary, items array<string>, spans array<bigint>, longest bigint"))
    held.destroy()
    return done


def _united(batch: pa.RecordBatch) -> list[list]:
    """Words, spans, item names and longest run of every row, from what the blocks found."""
    out = []
    for text, parts, longest in zip(batch.column("text"), batch.column("_parts").to_pylist(), batch.column("_longest").to_pylist()):
        flat = [part["spans"] for part in parts or ()]
        spans = [span for run in flat for span in zip(run[::2], run[1::2])]
        out.append([len(words_of(text.as_py() or "")), _merged(spans), {name for part in parts or () for name in part["items"]}, longest or 0])
    return out


def _found(texts: pa.Array, automaton: Automaton) -> list[list]:
    """Words, spans, item names and longest run of every text."""
    out = []
    for text in texts:
        words = words_of(text.as_py() or "")
        spans, items, longest = automaton.matches(words)
        out.append([len(words), spans, {automaton.names[k] for k in items} - {None}, longest])
    return out


_BUILT: dict[str, Automaton] = store()


def _built(name: str, window: int, block: list[tuple[str | None, list[bytes]]]) -> Automaton:
    """Automaton of a block, made once per worker; a worker holds one at a time."""
    built = asked(_BUILT)
    if name not in built:
        built.clear()
        built[name] = Automaton(block, window)
    return built[name]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def cut_spans(text: str, spans: list[int]) -> str:
    """Text without the words of the spans (flat list of begins and ends).

    A cut runs from the first byte of its first word to the last byte of its
    last; what is left around it stays as it was.
    """
    raw = text.encode()
    code = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(code.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    kept, at = [], 0
    for begin, end in zip(spans[::2], spans[1::2]):
        kept.append(raw[at:starts[begin]])
        at = int(ends[end - 1])
    kept.append(raw[at:])
    return b"".join(kept).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """Documents without benchmark passages, all columns and their order kept.

    Spans of ``window`` words or more shared with an item are cut from the
    text and ``n_chars`` follows; a document of which more than ``coverage``
    of the words were hit is dropped.  Documents without a hit, null and empty
    texts among them, stay as they are; repeated rows are treated alike, each
    on its own.  Items count as in :func:`find_overlap`.
    """
    rows, measured = _matched(packed(docs), benchmark, window)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column("text")
            found = measured(batch)
            stay = pa.array([sum(b - a for a, b in r[1]) <= coverage * r[0] for r in found], pa.bool_())
            cut = [cut_spans(texts[i].as_py(), [x for s in r[1] for x in s]) if r[1] else texts[i].as_py() for i, r in enumerate(found)]
            whole = pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(cut, pa.string()), pa.array([bool(r[1]) for r in found], pa.bool_())], names=["_row", "text", "cut"])
            yield whole.filter(stay)

    clean = rows.mapInArrow(run, schema(rows, ("_row", "text"), "cut boolean"))
    return unpacked(clean, docs.columns, **counted_chars(docs, F.col("cut")))
