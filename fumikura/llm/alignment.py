"""Alignment of the tokens of two tokenizers by interval coalescing.

Both token sequences cut the same bytes.  All tokens of both are sorted by
where they start, and a running maximum of where they end is kept; a group
ends where a start reaches that maximum.  Tokens of one group whose bytes
overlap are linked.

How often an id pair is linked in the whole corpus is counted with Spark.
Tasks gather documents in blocks of a bounded number of links, number the id
pairs of a block, and give every document as counts of these numbers, so that
a pair is shuffled once per block and not once per link.  The corpus counts go
back to the blocks the same way.

Texts are cut at spaces before which both tokenizers end a token whatever
stands around.  What a worker found for a part it remembers, so that words
that texts repeat are encoded and aligned once; all parts of a text, joined,
are the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..session import stored
from .bpe import _byte_letters
from .bytewords import small_batches
from .rows import bound_batches

#: Links after which a block of documents ends; a longer document is a block of its own.
LINKS = 4_000_000
#: Code points encoded together; a longer text is cut where both tokenizers cut it anyway.
PIECE = 1 << 17
#: Id pairs in one row of a block's list.
_CHUNK = 1 << 16
#: Parts, and code points of them, that a worker remembers; then it begins anew.
REMEMBERED, REMEMBERED_SIZE = 300_000, 1 << 24
#: Code points of the new parts that are encoded in one text.
_TOGETHER = 1 << 11
# A single space between two visible ASCII characters always begins a new token of both.
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
# A part that may stand next to others in one text.
_PLAIN = re.compile(r"[!-~](?:.*[!-~])?", re.DOTALL)


class Tokens:
    """Token bytes of a vocabulary, in one blob with offsets, and ids as decimal digits."""

    def __init__(self, words: Sequence[bytes]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(words), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.blob[np.arange(int(size.sum())) + np.repeat(self.offset[ids] - before, size)]


class Pair:
    """Tokenizer A, a byte-level file of the tokenizers library, and B, a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letter = _byte_letters()
        n = self.a.get_vocab_size()
        own = [self.a.id_to_token(i) or "" for i in range(n)]
        self.of_a = Tokens([bytes(letter[c] for c in w) if all(c in letter for c in w) else w.encode() for w in own])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.of_b = Tokens([bytes([int(w[3:5], 16)]) if self.b.is_byte(i) else w.replace("▁", " ").encode() for i, w in enumerate(pieces)])
        # A text may be cut before a space only if A splits there before it merges and no piece of B goes on over one.
        kind = json.loads(self.a.to_str())
        splits = kind["normalizer"] is None and (kind["pre_tokenizer"] or {}).get("type") == "ByteLevel" and kind["pre_tokenizer"].get("use_regex", True)
        self.may_cut = splits and all(t["special"] for t in kind["added_tokens"]) and not any("▁" in w.lstrip("▁") for w in pieces)
        self.parts = _Parts()
        self.n_b = len(pieces)
        self.bits = (n * len(pieces)).bit_length()
        width = len(str(max(n, len(pieces))))
        self.n_digits = np.array([len(str(i)) for i in range(max(n, len(pieces)))])
        self.digits = np.frombuffer("".join(str(i).ljust(width + 1) for i in range(len(self.n_digits))).encode(), np.uint8).reshape(-1, width + 1)

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces between which both tokenizers begin anew; the space between is left out."""
        at = 0
        while self.may_cut and len(text) - at > PIECE:
            cut = _CUT.search(text, at + PIECE - 1)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.end()
        yield text[at:]

    def encoded(self, texts: list[str]) -> tuple[list, list]:
        fast = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return [e.ids for e in fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)


def coalesced(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0, of all A and all B intervals."""
    starts, ends = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    which = np.repeat(np.array([0, 1], np.int8), [len(start_a), len(start_b)])
    order = np.lexsort((which, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[:len(start_a)], group[len(start_a):]


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(per A interval how many B it overlaps, A index per link, B index per link); each side is in order and without gaps."""
    first = np.searchsorted(end_b, start_a, "right")
    count = np.searchsorted(start_b, end_a, "left") - first
    a = np.repeat(np.arange(len(start_a)), count)
    b = np.arange(len(a)) + np.repeat(first - (np.cumsum(count) - count), count)
    return count, a, b


def align_pieces(pair: Pair, texts: list[str], parts: list[list[str]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Per piece <n_a, n_b, n_groups>, -1 where the bytes differ, and number of links; all link keys ``a * n_b + b``; per piece its groups, spelled.

    With the ``parts`` whose texts, joined by spaces, the pieces are, the same per part.
    """
    n = len(texts) if parts is None else sum(map(len, parts))
    ids_a, ids_b = pair.encoded(texts)
    data = [(" " + t).encode() for t in texts]
    size, n_a, n_b = (np.array([len(x) for x in xs], np.int64) for xs in (data, ids_a, ids_b))
    flat_a, flat_b = (np.fromiter(chain.from_iterable(xs), np.int64, sum(map(len, xs))) for xs in (ids_a, ids_b))

    def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    same = (summed(pair.of_a.size[flat_a], n_a) == size) & (summed(pair.of_b.size[flat_b], n_b) == size)
    for _ in range(2):  # lengths first, then bytes
        if not same.all():
            flat_a, flat_b = flat_a[np.repeat(same, n_a)], flat_b[np.repeat(same, n_b)]
        kept = np.flatnonzero(same)
        n_a, n_b, size = n_a * same, n_b * same, size * same
        if not len(kept) or _ == 1:
            break
        whole = np.frombuffer(b"".join([data[i] for i in kept]), np.uint8)
        wrong = np.flatnonzero((pair.of_a.bytes_of(flat_a) != whole) | (pair.of_b.bytes_of(flat_b) != whole))
        if not len(wrong):
            break
        same[np.searchsorted(np.cumsum(size), wrong, "right")] = False
    if not len(kept):
        return np.full((3, n), -1, np.int64), np.zeros(n, np.int64), np.zeros(0, np.int64), [b""] * n

    end_a, end_b = np.cumsum(pair.of_a.size[flat_a]), np.cumsum(pair.of_b.size[flat_b])
    start_a, start_b = end_a - pair.of_a.size[flat_a], end_b - pair.of_b.size[flat_b]
    group_a, group_b = coalesced(start_a, end_a, start_b, end_b)
    count, a, b = overlaps(start_a, end_a, start_b, end_b)
    keys = flat_a[a] * pair.n_b + flat_b[b]

    # Spelled: A ids, then B ids of each group, with what stands behind each id.
    rank = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(rank, kind="stable")
    ids, rank = np.concatenate([flat_a, flat_b])[order], rank[order]
    mark = np.full(len(ids), ord(";"), np.uint8)
    step = np.diff(rank)
    mark[:-1][step == 0] = ord(",")
    mark[:-1][(step == 1) & (rank[:-1] % 2 == 0)] = ord("|")
    signs, length = pair.digits[ids], pair.n_digits[ids]
    signs[np.arange(len(ids)), length] = mark
    spelled = signs[np.arange(signs.shape[1]) <= length[:, None]].tobytes()
    spelled_end = np.cumsum(length + 1)

    if parts is not None:  # a space and the part, whose bytes the tokens give
        size = np.array([(len(p) if p.isascii() else len(p.encode())) + 1 if good else 0 for some, good in zip(parts, same.tolist()) for p in some], np.int64)
        n_a, n_b = (np.diff(np.searchsorted(end, np.cumsum(size), "right"), prepend=0) for end in (end_a, end_b))
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    link_end = np.concatenate([[0], np.cumsum(count)])[ends_a]
    text_end = np.concatenate([[0], spelled_end])[ends_a + ends_b]
    group_end = np.concatenate([[-1], group_a])[ends_a]
    sums = np.array([n_a, n_b, np.diff(group_end, prepend=-1)])
    sums[:, size == 0] = -1
    begin = np.concatenate([[0], text_end[:-1]])
    return sums, np.diff(link_end, prepend=0), keys, [spelled[x:max(x, y - 1)] for x, y in zip(begin.tolist(), text_end.tolist())]


class _Parts(dict):
    """Number of every part a worker remembers, and what was found for it."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.size = self.n_links = 0
        self.spelled: list[bytes] = []
        # n_a, n_b, n_groups, -1 where the bytes differ; number of links, and where their keys begin.
        self.found = np.zeros((5, 1 << 12), np.int64)
        self.links = np.zeros(1 << 16, np.int64)

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        self.new.append(part)
        return number

    def align(self, pair: Pair) -> None:
        """Encodes the new parts, plain ones many in a text; where its bytes differ, each by itself."""
        base, new, self.new = len(self.spelled), self.new, []
        self.spelled += [b""] * len(new)
        if len(self) > self.found.shape[1]:
            self.found = np.hstack([self.found, np.zeros((5, max(len(new), self.found.shape[1])), np.int64)])
        joined, alone, width = [], [], _TOGETHER
        for i, part in enumerate(new):
            if pair.may_cut and len(part) < _TOGETHER and _PLAIN.fullmatch(part):
                if width >= _TOGETHER:
                    joined.append([])
                    width = 0
                joined[-1].append(i)
                width += len(part) + 1
            else:
                alone.append(i)
        if joined:
            texts = [[new[i] for i in some] for some in joined]
            differ = self._take(base, list(chain.from_iterable(joined)), *align_pieces(pair, [" ".join(some) for some in texts], texts))
            alone += differ
        if alone:
            self._take(base, alone, *align_pieces(pair, [new[i] for i in alone]))
        self.size += sum(map(len, new))

    def _take(self, base: int, which: list[int], sums: np.ndarray, counts: np.ndarray, keys: np.ndarray, spelled: list[bytes]) -> list[int]:
        """Keeps what was found; gives those of the parts whose bytes differ."""
        at = base + np.array(which, np.int64)
        self.found[:3, at], self.found[3, at], self.found[4, at] = sums, counts, self.n_links + np.cumsum(counts) - counts
        if self.n_links + len(keys) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros(max(len(keys), len(self.links)), np.int64)])
        self.links[self.n_links:self.n_links + len(keys)] = keys
        self.n_links += len(keys)
        for i, text in zip(at.tolist(), spelled):
            self.spelled[i] = text
        return [which[i] for i in np.flatnonzero(sums[0] < 0)]

    def full(self) -> bool:
        return len(self) >= REMEMBERED or self.size >= REMEMBERED_SIZE


class _Block:
    """Documents whose id pairs are numbered together."""

    def __init__(self, pair: Pair, groups: bool):
        self.pair, self.groups = pair, groups
        self.rows: list[list] = []  # n_a, n_b, n_groups, n_links, digest, whether it counts, spelled parts
        self.waiting: list[tuple[int, str]] = []
        self.size = self.links = self.raw = 0
        self.keys: list[np.ndarray] = []
        self.done = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, text: str | None) -> None:
        self.rows.append([0, 0, 0, 0, sha256(), bool(text), []])
        for piece in self.pair.pieces(text) if text else ():
            self.waiting.append((len(self.rows) - 1, piece))
            self.size += len(piece)
            if self.size >= PIECE:
                self.encode()

    def encode(self) -> None:
        if not self.waiting:
            return
        if self.pair.parts.full():
            self.pair.parts = _Parts()
        parts = self.pair.parts
        split = _CUT.split if self.pair.may_cut else lambda text: [text]
        numbers = [np.fromiter(map(parts.__getitem__, split(text)), np.int64) for _, text in self.waiting]
        if parts.new:
            parts.align(self.pair)
        for (slot, _), here in zip(self.waiting, numbers):
            row = self.rows[slot]
            found = parts.found[:, here]
            if found[0].min() < 0:
                row[5] = False
                continue
            n_a, n_b, n_groups = found[:3].sum(1).tolist()
            count = found[3]
            ends = np.cumsum(count)
            keys = parts.links[np.arange(ends[-1]) + np.repeat(found[4] - ends + count, count)]
            spelled = b";".join([parts.spelled[i] for i in here.tolist()])
            if row[2]:
                spelled = b";" + spelled
            row[0], row[1], row[2], row[3] = row[0] + n_a, row[1] + n_b, row[2] + n_groups, row[3] + len(keys)
            row[4].update(spelled)
            if self.groups:
                row[6].append(spelled)
            self.keys.append(keys + (slot << self.pair.bits))
            self.links += len(keys)
            self.raw += len(keys)
            if self.raw >= 2 * LINKS:
                self.count()
        self.waiting, self.size = [], 0

    def count(self) -> None:
        """Sum up what was gathered, as <document, pair> and times."""
        if not self.keys:
            return
        keys = np.sort(np.concatenate(self.keys))
        self.keys, self.raw = [], 0
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, times = keys[first], np.diff(first, append=len(keys))
        if len(self.done[0]):
            both, more = np.concatenate([self.done[0], keys]), np.concatenate([self.done[1], times])
            order = np.argsort(both, kind="stable")
            both, more = both[order], more[order]
            first = np.flatnonzero(np.diff(both, prepend=-1))
            keys, times = both[first], np.add.reduceat(more, first)
        self.done = keys, times

    def table(self, rows: pa.Array, block: int) -> Iterator[pa.RecordBatch]:
        self.encode()
        self.count()
        keys, times = self.done
        slots, pairs = keys >> self.pair.bits, keys & ((1 << self.pair.bits) - 1)
        counts = np.array([row[5] for row in self.rows], bool)
        if len(keys) and not counts.all():  # a document counts whole or not at all
            use = counts[slots]
            slots, pairs, times = slots[use], pairs[use], times[use]
        known, number = np.unique(pairs, return_inverse=True)
        totals = np.bincount(number, times, len(known)).astype(np.int64)
        bounds = np.searchsorted(slots, np.arange(len(self.rows) + 1)).astype(np.int32)
        column = lambda i: pa.array([row[i] if row[5] else 0 for row in self.rows], pa.int64())
        lists = lambda v: pa.ListArray.from_arrays(pa.array(bounds), pa.array(v.astype(np.int32)))
        n = len(self.rows)
        names = ["_row", "_block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "_number", "_times", "_base", "_pairs", "_totals"]
        none = lambda kind, m: pa.nulls(m, kind)
        longs = pa.list_(pa.int64())
        digest = pa.array([row[4].hexdigest() if row[5] else "" for row in self.rows], pa.string())
        spelled = pa.array([b"".join(row[6]).decode() if row[5] else "" for row in self.rows], pa.string()) if self.groups else none(pa.string(), n)
        here = pa.array(np.full(n, block))
        whole = pa.RecordBatch.from_arrays(
            [rows, here, column(0), column(1), column(2), column(3), digest, spelled, lists(number), lists(times), none(pa.int32(), n), none(longs, n), none(longs, n)], names=names
        )
        yield from small_batches([whole])
        for at in range(0, len(known), _CHUNK):
            some = [pa.array([v[at:at + _CHUNK]], longs) for v in (known, totals)]
            nothing = [none(whole.schema.field(c).type, 1) for c in names[2:10]]
            yield pa.RecordBatch.from_arrays([none(rows.type, 1), pa.array([block]), *nothing, pa.array([at], pa.int32()), *some], names=names)


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    """Both tokenizers, read once per worker."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def _blocks(docs: DataFrame, path_a: str, path_b: str, keep: Sequence[str], groups: bool) -> DataFrame:
    """One row per document, in blocks, and besides the id pairs of every block with their totals."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        # Task and place: the same again when a lost task runs anew.
        number = TaskContext.get().partitionId() << 32
        block, held = _Block(pair, groups), []
        for batch in small_batches(batches):
            first = 0
            for i, text in enumerate(batch.column("text")):
                block.add(text.as_py())
                if block.links >= LINKS:
                    held.append(batch.column("_row").slice(first, i + 1 - first))
                    yield from block.table(pa.concat_arrays(held), number)
                    block, held, first, number = _Block(pair, groups), [], i + 1, number + 1
            held.append(batch.column("_row").slice(first))
        if block.rows:
            yield from block.table(pa.concat_arrays(held), number)

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), "text")
    more = "_block bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, _number array<int>, _times array<int>, _base int, _pairs array<bigint>, _totals array<bigint>"
    return own.mapInArrow(run, StructType([StructField("_row", own.schema["_row"].dataType), *StructType.fromDDL(more).fields]))


def _listed(blocks: DataFrame) -> DataFrame:
    """<_in, _at, _pair, _n>: the id pairs of every block."""
    both = blocks.where(F.col("_base").isNotNull()).select("_block", "_base", F.posexplode(F.arrays_zip("_pairs", "_totals")).alias("_i", "_p"))
    return both.select(F.col("_block").alias("_in"), (F.col("_base") + F.col("_i")).alias("_at"), F.col("_p._pairs").alias("_pair"), F.col("_p._totals").alias("_n"))


def _scored(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Sums of one block's documents over the corpus counts of its pairs."""
    docs, known = docs.combine_chunks(), known.combine_chunks()
    n = len(known)
    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = known.column("_at").to_numpy()
    total[at], best[at] = known.column("_total").to_numpy(), known.column("_best").to_numpy(zero_copy_only=False)
    sizes = docs.column("_number").combine_chunks().value_lengths().to_numpy()
    number = docs.column("_number").combine_chunks().flatten().to_numpy()
    times = docs.column("_times").combine_chunks().flatten().to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    sums = []
    for value in (best, total):
        running = np.concatenate([[0], np.cumsum(times * value[number])])
        sums.append(pa.array(running[ends] - running[ends - sizes]))
    out = ["_row", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*[docs.column(c) for c in out], *sums, docs.column("groups_sha256"), docs.column("groups")], [*out, "n_best", "count_sum", "groups_sha256", "groups"])


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """<a_id, b_id, n>: how many links of the whole corpus hold the two ids; the same rows as in :func:`align` count."""
    counted = _listed(_blocks(docs, path_a, path_b, (), False)).groupBy("_pair").agg(F.sum("_n").alias("n"))
    n_b = _pair(path_a, path_b).n_b
    return counted.select(F.expr(f"_pair div {n_b}").alias("a_id"), F.pmod("_pair", F.lit(n_b)).alias("b_id"), "n")


def align(docs: DataFrame, path_a: str, path_b: str, keep: Sequence[str] = ("doc_id",), groups: bool = False) -> DataFrame:
    """``keep`` columns with <n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256> and, if asked for, <groups>.

    A encodes a space and the text, B the text, to which it adds that space
    itself; neither adds special tokens, and their strings in a text are plain
    text.  ``groups`` spells the ids as ``a1,a2|b1;a3|b2,b3`` and
    ``groups_sha256`` is its digest.  ``n_best`` counts the links whose id pair
    is linked as often in the corpus as any pair with the same B id, and
    ``count_sum`` sums the corpus counts of the links.

    * Null or empty text, or one whose tokens do not give its bytes back: no tokens, zeros, ``groups_sha256`` empty.
    * Repeated rows each count and each have a row; no document: no row, no pair.
    * Texts are taken whole; other columns than ``keep`` and ``text`` are not read, and their names may clash.
    * Both paths must be readable on every executor.
    """
    spark = docs.sparkSession
    n_b = _pair(path_a, path_b).n_b
    blocks = stored(_blocks(docs, path_a, path_b, keep, groups))
    listed = _listed(blocks)
    counts = stored(listed.groupBy("_pair").agg(F.sum("_n").alias("_total")))
    # One row per B id, so at most as many as the vocabulary has.
    top = counts.groupBy(F.pmod("_pair", F.lit(n_b)).alias("_b")).agg(F.max("_total").alias("_most"))
    rated = counts.withColumn("_b", F.pmod("_pair", F.lit(n_b))).join(F.broadcast(top), "_b").select("_pair", "_total", (F.col("_total") == F.col("_most")).alias("_best"))
    known = listed.select("_in", "_at", "_pair").join(rated, "_pair").select("_in", "_at", "_total", "_best")
    rows = blocks.where(F.col("_base").isNull()).select("_row", "_block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "_number", "_times")
    bound_batches(spark)
    kind = StructType([rows.schema["_row"], *StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string").fields])
    summed = rows.groupBy("_block").cogroup(known.groupBy("_in")).applyInArrow(_scored, kind)
    more = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else [])]
    return summed.select(*[F.col("_row").getField(c).alias(c) for c in keep], *more)
