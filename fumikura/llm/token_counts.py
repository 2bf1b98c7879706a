"""Token counts that follow edits.

The pre-tokens of a document (see ``bpe``) are gathered in leaves of LEAF
pre-tokens; a leaf knows its characters and its tokens, and a balanced tree over
the leaves holds the sums.  The leaves of every document are kept in a table
beside its text, so that an edit made later finds them.  Pre-tokens never share a token, and cutting a text
into pre-tokens never looks back.  It looks at most LOOK characters beyond the
end of a pre-token: white space before a word leaves its last character to the
word, and a quote mark is alone when the two letters after it are no ending
such as 're.  So after an edit the cut starts at the leaf of the character LOOK
before it and may stop where it meets the start of an old leaf again:
everything beyond is as it was.  Only that region is encoded anew; the sums
above its leaves are updated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import stored
from .bpe import Codec, codec
from .bytewords import small_batches
from .rows import bound_batches, lean, schema

#: Pre-tokens per leaf.
LEAF = 32
#: Children of a node when it is made; twice as many split it.
FAN = 16
#: Characters beyond the end of a pre-token that can decide where it ends.
LOOK = 2


class _Node:
    """Up to 2 * FAN children: nodes, or leaves as <characters, tokens>."""

    __slots__ = ("kids", "low", "leaves", "chars", "tokens")

    def __init__(self, kids: list, low: bool):
        self.kids, self.low = kids, low
        if low:
            self.leaves = len(kids)
            self.chars, self.tokens = sum(c for c, _ in kids), sum(t for _, t in kids)
        else:
            self.leaves, self.chars, self.tokens = sum(k.leaves for k in kids), sum(k.chars for k in kids), sum(k.tokens for k in kids)


def _packed(kids: list, low: bool) -> list[_Node]:
    """Nodes of about FAN children each; one node as long as they fit."""
    if len(kids) <= 2 * FAN:
        return [_Node(kids, low)] if kids else []
    return [_Node(kids[at:at + FAN], low) for at in range(0, len(kids), FAN)]


class Tree:
    """Sums of characters and tokens over the leaves of one text, in a balanced tree.

    A run of leaves is replaced by any number of others: nodes on its way are
    made anew and split where they grow too wide, all others stay.
    """

    def __init__(self, chars: Sequence[int], tokens: Sequence[int]):
        self.root = self._grown(_packed(list(zip(chars, tokens)) or [(0, 0)], True))

    @staticmethod
    def _grown(nodes: list[_Node]) -> _Node:
        while len(nodes) > 1:
            nodes = _packed(nodes, False)
        return nodes[0] if nodes else _Node([(0, 0)], True)

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def size(self) -> int:
        return self.root.chars

    @property
    def leaves(self) -> int:
        return self.root.leaves

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character; the last leaf beyond the end."""
        node, leaf, start = self.root, 0, 0
        if place >= node.chars:
            while not node.low:
                node = node.kids[-1]
            return self.root.leaves - 1, self.root.chars - node.kids[-1][0]
        while not node.low:
            for kid in node.kids:
                if place < start + kid.chars:
                    break
                start, leaf = start + kid.chars, leaf + kid.leaves
            node = kid
        for chars, _ in node.kids:
            if place < start + chars:
                break
            start, leaf = start + chars, leaf + 1
        return leaf, start

    def put(self, first: int, last: int, parts: list[tuple[int, int]]) -> None:
        """Replace leaves first..last by others."""
        self.root = self._grown(self._put(self.root, first, last + 1, parts))

    def _put(self, node: _Node, first: int, stop: int, parts: list[tuple[int, int]]) -> list[_Node]:
        if node.low:
            return _packed(node.kids[:first] + parts + node.kids[stop:], True)
        kids: list[_Node] = []
        at = 0
        for kid in node.kids:
            if at + kid.leaves <= first or at >= stop:
                kids.append(kid)
            else:
                kids += self._put(kid, max(0, first - at), min(kid.leaves, stop - at), parts)
                parts = []  # the first node that is touched takes them all
            at += kid.leaves
        return _packed(kids, False)

    def as_leaves(self) -> tuple[list[int], list[int]]:
        chars: list[int] = []
        tokens: list[int] = []

        def walk(node: _Node) -> None:
            for kid in node.kids:
                if node.low:
                    chars.append(kid[0])
                    tokens.append(kid[1])
                else:
                    walk(kid)

        walk(self.root)
        return chars, tokens


def _sums(values: list[int], leaf: int) -> list[int]:
    return np.add.reduceat(np.array(values, np.int64), np.arange(0, len(values), leaf)).tolist() if values else []


def _gathered(chars: list[int], tokens: list[int], leaf: int = LEAF) -> list[tuple[int, int]]:
    return list(zip(_sums(chars, leaf), _sums(tokens, leaf)))


def leaves_of(own: Codec, text: str) -> tuple[list[int], list[int]]:
    """Characters and tokens of the leaves of a text."""
    if own.has_special(text):
        words = [text[a:b] for a, b in own.spans(text)]
        return _sums([len(w) for w in words], LEAF), _sums([own.n_tokens(w) for w in words], LEAF)
    words = own.split(text)
    return _sums(list(map(len, words)), LEAF), _sums(list(map(own.counts.__getitem__, words)), LEAF)


def build(own: Codec, text: str) -> Tree:
    return Tree(*leaves_of(own, text))


def applied(text: str, edits: Sequence[tuple[int, int, str]]) -> str:
    """Text after edits <start, end, new>, which are in order and do not overlap."""
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def update(own: Codec, tree: Tree, old: str, edits: Sequence[tuple[int, int, str]]) -> tuple[Tree, str, int]:
    """(tree, text, characters encoded anew) after edits of the old text."""
    new = applied(old, edits)
    # Nothing is found by position once two places of special tokens could join, so those go as a whole.
    if own.has_special(old) or own.has_special(new):
        return build(own, new), new, len(new)
    redone = at = 0
    shifted = 0  # by how much the tree's places are already new
    while at < len(edits):
        start = edits[at][0]
        # An edit can join or part what stands before it.
        first, begin = tree.find(max(0, start + shifted - LOOK))
        chars: list[int] = []
        tokens: list[int] = []
        place = begin
        inside = shifted
        end = None
        last = first
        for match in own.find(new, begin):
            word = match.group()
            chars.append(len(word))
            tokens.append(own.counts[word])
            place += len(word)
            # Edits that begin up to here belong to the region.
            while at < len(edits) and edits[at][0] + inside <= place:
                inside += len(edits[at][2]) - (edits[at][1] - edits[at][0])
                end = edits[at][1]
                at += 1
            if end is None or place < end + inside:
                continue
            # Back to the places the tree has: does a leaf begin here?
            there = place - inside + shifted
            if there >= tree.size:
                break
            leaf, leaf_start = tree.find(there)
            if leaf_start == there and leaf > first:
                last = leaf - 1
                break
        else:
            # The text ended first: what is left of the edits stands at its end.
            while at < len(edits):
                inside += len(edits[at][2]) - (edits[at][1] - edits[at][0])
                at += 1
        if place - inside + shifted >= tree.size or place >= len(new):
            last = tree.leaves - 1
        redone += place - begin
        tree.put(first, last, _gathered(chars, tokens))
        shifted = inside
    return tree, new, redone


def build_trees(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with <text, n_tokens, leaf_chars, leaf_tokens>, one row per input row.

    Write it as a table: :func:`apply_edits` goes on from there.  Null text
    counts as empty: no leaf, no token.  Texts are taken whole; repeated rows
    each have a tree, no row gives no tree; other columns are not read.
    """
    bound_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in small_batches(batches):
            total, chars, tokens = [], [], []
            for text in batch.column("text"):
                a, b = leaves_of(own, text.as_py() or "")
                total.append(sum(b)), chars.append(a), tokens.append(b)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], batch.column("text"), pa.array(total, pa.int64()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))],
                names=[*keep, "text", "n_tokens", "leaf_chars", "leaf_tokens"],
            )
        own.forget()

    return docs.select(*keep, "text").mapInArrow(run, schema(docs, keep, "text string, n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>"))


def _edited(trees: DataFrame, path: str, keep: Sequence[str], edits: str | None, rules: Sequence[tuple[str, str]], whole: bool) -> DataFrame:
    """Counts after edits that a column holds, or that rules make of the text; with ``whole`` also the new texts and trees."""
    bound_batches(trees.sparkSession)
    sums = ["n_tokens", "n_before", "n_edits", "n_redone"]
    kept = ["text", "leaf_chars", "leaf_tokens"] if whole else []

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        compiled = [(re.compile(p), new) for p, new in rules]
        for batch in small_batches(batches):
            counts: list[tuple[int, ...]] = []
            more: list[tuple] = []
            leaf_chars, leaf_tokens = batch.column("leaf_chars"), batch.column("leaf_tokens")
            for i, (text, before) in enumerate(zip(batch.column("text"), batch.column("n_tokens").to_pylist())):
                text = text.as_py()
                if edits:
                    changes = [(e["start"], e["end"], e["new"] or "") for e in batch.column(edits)[i].as_py() or []]
                else:
                    changes = pattern_edits(text or "", compiled)
                total = before
                redone = 0
                tree = None
                if changes:
                    tree, text, redone = update(own, Tree(leaf_chars[i].as_py(), leaf_tokens[i].as_py()), text or "", changes)
                    total = tree.total
                counts.append((total, before, len(changes), redone))
                if whole:
                    more.append((text, *(tree.as_leaves() if tree else (leaf_chars[i].as_py(), leaf_tokens[i].as_py()))))
            arrays = [pa.array([r[j] for r in counts], pa.int64()) for j in range(len(sums))]
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            arrays += [pa.array([r[j] for r in more], kind) for j, kind in enumerate(kinds[:len(kept)])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *arrays], names=[*keep, *sums, *kept])
        own.forget()

    read = trees.select(*keep, "text", "n_tokens", "leaf_chars", "leaf_tokens", *([edits] if edits else []))
    fields = "n_tokens bigint, n_before bigint, n_edits bigint, n_redone bigint"
    return read.mapInArrow(run, schema(trees, keep, fields + (", text string, leaf_chars array<int>, leaf_tokens array<int>" if whole else "")))


def apply_edits(trees: DataFrame, edits: str, path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with <text, n_tokens, leaf_chars, leaf_tokens, n_before, n_edits, n_redone>.

    ``trees`` comes from :func:`build_trees`, or from here, with a column
    ``edits`` of structs <start, end, new> in code points of its text, in order
    and without overlap.  ``n_redone`` counts all characters encoded anew: the
    regions round the edits, or the whole text if it holds a special token
    before or after.  Null or no edits leave the row as it was; edits of a null
    text see an empty one.  No row gives no row.
    """
    done = _edited(trees, path, keep, edits, (), True)
    return done.select(*keep, "text", "n_tokens", "leaf_chars", "leaf_tokens", "n_before", "n_edits", "n_redone")


#: Edits of a usual cleaning pass: mail addresses, long numbers, runs of marks.
CLEANING = (
    (r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+", "[mail]"),
    (r"\+?[0-9][0-9 ()-]{6,}[0-9]", "[number]"),
    (r"[%&*$#]{3}", ""),
    (r"!!", "!"),
)


def pattern_edits(text: str, rules: Sequence[tuple[re.Pattern, str]]) -> list[tuple[int, int, str]]:
    """Edits <start, end, new> that replace matches; where matches overlap, the earlier rule has its way."""
    taken: list[tuple[int, int, str]] = []
    for pattern, new in rules:
        found = [(m.start(), m.end(), new) for m in pattern.finditer(text)]
        if taken and found:
            merged, at = [], 0
            for edit in found:
                while at < len(taken) and taken[at][1] <= edit[0]:
                    at += 1
                if at == len(taken) or taken[at][0] >= edit[1]:
                    merged.append(edit)
            found = merged
        if found:
            taken = sorted(taken + found)
    return taken


def with_edits(trees: DataFrame, rules: Sequence[tuple[str, str]] = CLEANING) -> DataFrame:
    """Adds <edits>, the replacements that a list of (pattern, new text) makes; none for a null text."""
    columns = trees.columns
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
    bound_batches(trees.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(re.compile(p), new) for p, new in rules]
        for batch in small_batches(batches):
            edits = [[{"start": a, "end": b, "new": new} for a, b, new in pattern_edits(t.as_py() or "", compiled)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind)], names=[*columns, "edits"])

    return trees.mapInArrow(run, schema(trees, columns, "edits array<struct<start:int,end:int,new:string>>"))


def edited_counts(docs: DataFrame, path: str, rules: Sequence[tuple[str, str]] = CLEANING) -> DataFrame:
    """<doc_id, n_tokens, n_edits, n_tokens_after, n_redone> of a cleaning pass over every row.

    The trees are written as a table first; the pass reads it and encodes the
    edited regions only, as :func:`with_edits` and :func:`apply_edits` do.

    Null text counts as empty, without token and edit; repeated rows each have
    a row; no row gives no row; other columns are not read.
    """
    trees = stored(build_trees(docs, path), "zstd")
    done = _edited(trees, path, ("doc_id",), None, rules, False)
    return done.selectExpr("doc_id", "n_before AS n_tokens", "n_edits", "n_tokens AS n_tokens_after", "n_redone")
