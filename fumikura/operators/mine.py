"""Mining titles: grams, compounds, suffixes, subjects, fields, rankings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .. import settings
from ..functions import words as w
from ..functions.variants import as_list, field, is_json_object, is_kind
from ..session import checkpointed, stored
from .scale import bound_batches, lookup_join, pinned, top_per_group, top_rows, with_dense_rank

INLINE_GRAMS = 2_000  # grams tested one by one inside an expression
SPACING = 1 << 24  # room for character positions between two record ordinals


def _base(titles: DataFrame, ord_col: str, spacing: int) -> int | None:
    """Least ordinal, if all places counted from it fit into a BIGINT; else None.

    Reads the ordinals alone.  Both kinds of place give the same result; the
    narrow kind makes the aggregation for its minimum a good deal faster.
    """
    low, high = titles.agg(F.min(ord_col), F.max(ord_col)).first()
    if low is None:
        return 0
    return low if (high - low + 1) * spacing < 1 << 63 else None


def _place(ord_col: str, pos: Column, spacing: int, base: int | None) -> Column:
    """Record ordinal and position in one number, counted from ``base`` or wide enough for every ordinal.

    A single number keeps the aggregation for its minimum a hash aggregation.
    """
    if base is not None:
        return (F.col(ord_col).cast("bigint") - F.lit(base)) * F.lit(spacing) + pos.cast("bigint")
    return (F.col(ord_col).cast("decimal(20,0)") * F.lit(spacing).cast("decimal(12,0)") + pos.cast("decimal(20,0)")).cast("decimal(38,0)")


def _first_pos(at: Column, spacing: int, base: int | None) -> Column:
    """The place as DECIMAL, counted from 0, whichever way it was kept."""
    if not base:
        return at.cast("decimal(38,0)")
    return (F.lit(base).cast("decimal(20,0)") * F.lit(spacing).cast("decimal(12,0)") + at.cast("decimal(20,0)")).cast("decimal(38,0)")


def _chunks(titles: DataFrame, width: int, title: str, keep: Sequence[str], symbols: str | None, before: int = 0) -> DataFrame:
    """<keep, _first, _part>: texts in short chunks <body, size, behind>, each with what its windows look ahead to.

    ``_first`` is the position of the chunk's first character; the body begins
    ``behind`` characters before, at most ``before`` of them.
    """
    text = F.col(title) if symbols is None else w.drop_symbols(title, symbols)
    # A chunk is at least as long as the window, so the next chunk holds all it looks ahead to.
    chunk_size = max(w.CHUNK, width)
    cut = titles.select(
        *keep, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk_size}}}"), F.lit(0)).alias("_chunks")
    )
    chunks = F.col("_chunks")

    def with_next(chunk: Column, i: Column) -> Column:
        ahead = F.coalesce(F.left(F.get(chunks, i + 1), F.lit(width - 1)), F.lit(""))
        if not before:
            return F.struct(F.concat(chunk, ahead).alias("body"), F.length(chunk).alias("size"), F.lit(0).alias("behind"))
        back = F.coalesce(F.right(F.get(chunks, i - 1), F.lit(before)), F.lit(""))
        return F.struct(F.concat(back, chunk, ahead).alias("body"), F.length(chunk).alias("size"), F.length(back).alias("behind"))

    parts = cut.select(*keep, F.posexplode(F.transform(chunks, with_next)).alias("_no", "_part"))
    return parts.select(*keep, (F.col("_no").cast("bigint") * chunk_size).alias("_first"), "_part")


def _windows(parts: DataFrame, width: int, keep: Sequence[str]) -> DataFrame:
    """<keep, pos, win>: one window per character of the chunks."""
    starts = parts.select(
        *keep, "_first", "_part.body", F.explode(F.sequence(F.lit(0), F.col("_part.size") - 1)).alias("_at")
    )
    return starts.select(
        *keep, (F.col("_first") + F.col("_at")).alias("pos"), F.substring("body", F.col("_at") + 1, F.lit(width)).alias("win")
    )


def text_windows(
    titles: DataFrame,
    width: int,
    title: str = "title",
    keep: Sequence[str] = (),
    symbols: str | None = settings.GRAM_SYMBOLS,
) -> DataFrame:
    """One row per character: the window of ``width`` characters that starts there.

    Windows at the end of a title are shorter.  Every n-gram with n <= width
    is the head of exactly one window, so one pass serves all sizes.  Titles
    are cut into short chunks first, which keeps the work linear in the
    length of a title and lets one huge title stream through.
    """
    return _windows(_chunks(titles, width, title, keep, symbols), width, keep)


def text_chunks(titles: DataFrame, width: int, title: str = "title", keep: Sequence[str] = (), before: int = 0) -> DataFrame:
    """<keep, first, behind, size, body>: texts in chunks of at least ``width`` characters, each with the ``width - 1`` after it.

    What is at most ``width`` long and begins in a chunk lies in its body
    whole.  The body begins with the last ``before`` characters of the chunk
    before, ``behind`` of them; the chunk itself has ``size`` and begins at ``first``.
    """
    parts = _chunks(titles, width, title, keep, None, before)
    return parts.select(*keep, F.col("_first").alias("first"), "_part.behind", "_part.size", "_part.body")


def _heads(sizes: Sequence[int]) -> Column:
    """Rows <n, gram> for every size that fits into the window."""
    heads = [F.struct(F.lit(n).alias("n"), F.left("win", F.lit(n)).alias("gram")) for n in sizes]
    return F.inline(F.array(*heads))


def gram_counts(
    titles: DataFrame,
    sizes: Sequence[int] = settings.GRAM_SIZES,
    ord_col: str = "ord",
    title: str = "title",
    symbols: str | None = settings.GRAM_SYMBOLS,
    spacing: int = SPACING,
) -> DataFrame:
    """Occurrences and first position of every n-gram: <n, gram, cnt, first_pos>.

    Windows of the longest size are counted first, with partial aggregation
    before the shuffle; shorter grams are then summed up from the distinct
    windows instead of from the text.
    """
    base = _base(titles, ord_col, spacing)
    wins = text_windows(titles, max(sizes), title, [ord_col], symbols).select(
        "win", _place(ord_col, F.col("pos"), spacing, base).alias("at")
    )
    counted = wins.groupBy("win").agg(F.count("*").alias("c"), F.min("at").alias("at"))
    grams = (
        counted.select("c", "at", _heads(sizes))
        .where(F.length("gram") == F.col("n"))
        .groupBy("n", "gram")
        .agg(F.sum("c").alias("cnt"), F.min("at").alias("at"))
    )
    return grams.select("n", "gram", "cnt", _first_pos(F.col("at"), spacing, base).alias("first_pos"))


def top_grams(counts: DataFrame, k: int = settings.TOP_GRAMS) -> DataFrame:
    """Top ``k`` grams per size, ties by first appearance: adds ``rank``."""
    order = [F.desc("cnt"), F.asc("first_pos"), F.asc("gram")]
    return top_per_group(counts, ["n"], order, k)


def frequent_grams(
    titles: DataFrame,
    k: int = settings.TOP_GRAMS,
    sizes: Sequence[int] = settings.GRAM_SIZES,
    ord_col: str = "ord",
    title: str = "title",
    symbols: str | None = settings.GRAM_SYMBOLS,
    spacing: int = SPACING,
    listed: int | None = None,
) -> DataFrame:
    """Top ``k`` grams per size, <n, gram, cnt, first_pos, rank>; equal to :func:`top_grams` of :func:`gram_counts`.

    A threshold algorithm, so that rare grams, which are nearly all of them,
    never leave the part of the input they were counted in:

    1. The input is dealt out by chunks of text.  A task counts PART_CHARS
       characters at a time, a part, by itself and hands on the first
       ``listed`` (4 * ``k``) grams per size.
    2. The sums over the lists give a lower bound of the k-th largest count.
       In a part that does not list it, a gram has at most the least count
       listed there; grams that cannot reach the bound even so drop out.
    3. A gram that is left and listed in every part is counted already.  Any
       other is counted again in the whole input, and so are all grams of a
       size where one that no part lists could still reach the bound.

    Equal counts are ranked by first position, then by gram.  Null and empty
    titles have no gram; fewer than ``k`` grams of a size give them all.
    """
    tasks = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = 4 * k if listed is None else listed
    base = _base(titles, ord_col, spacing)
    width = max(sizes)
    chunks = _chunks(titles, width, title, [ord_col], symbols)
    dealt = chunks.select(F.col(ord_col).alias("_ord"), "_first", "_part.size", "_part.body").repartition(tasks, F.xxhash64("_ord", "_first"))
    bound_batches(titles.sparkSession)
    order = dealt.schema["_ord"].dataType.simpleString()
    found = dealt.mapInArrow(_part_lists(sizes, listed), f"_in bigint, n int, gram string, cnt bigint, rank bigint, _ord {order}, _pos bigint")
    every = stored(found.withColumn("at", _place("_ord", F.col("_pos"), spacing, base)).drop("_ord", "_pos"))
    lists = every.where(F.col("n") > 0)
    parts = every.where(F.col("n") == 0).count()  # one row per part

    # What is not listed: at most the least count of a full list, or one where all repeated grams are listed.
    full = lists.where(F.col("rank") == listed).select("_in", "n", F.col("cnt").alias("_least"))  # one row per part and size
    unseen = full.groupBy("n").agg(F.sum(F.col("_least") - 1).alias("_rest"))
    known = lists.join(full, ["_in", "n"], "left").groupBy("n", "gram").agg(
        F.sum("cnt").alias("cnt"), F.min("at").alias("at"), F.count("*").alias("_seen"), F.sum(F.coalesce("_least", F.lit(1))).alias("_known")
    )
    known = known.join(F.broadcast(unseen), "n", "left")  # one row per size
    most = F.col("cnt") + parts + F.coalesce("_rest", F.lit(0)) - F.col("_known")
    wide = stored(known.select("n", "gram", "cnt", "at", "_seen", most.alias("_most")))
    last = top_per_group(wide.select("n", "cnt"), ["n"], [F.desc("cnt")], k).where(F.col("rank") == k)
    bound = {r.n: r.cnt for r in last.select("n", "cnt").collect()}  # one number per size
    least = F.create_map(*[F.lit(x) for n in sizes for x in (n, bound.get(n, 0))])[F.col("n")]
    left = wide.where(F.col("_most") >= least)
    exact = left.where(F.col("_seen") == parts).select("n", "gram", "cnt", "at")
    again = left.where(F.col("_seen") < parts).select("n", "gram")
    # A gram that no part lists can have as many as all unlisted places together.  Where that reaches the bound, or
    # where fewer grams are listed than wanted, the size is counted whole.
    hidden = {r.n: r["_rest"] for r in unseen.collect()}  # one number per size
    short = [n for n in sizes if n not in bound or parts + hidden.get(n, 0) >= bound[n]]
    open_sizes = sorted({r.n for r in again.select("n").distinct().collect()} | set(short))
    if open_sizes:
        at = _place(ord_col, F.col("pos"), spacing, base)
        whole = text_windows(titles, max(open_sizes), title, [ord_col], symbols).select(at.alias("at"), _heads(open_sizes)).where(F.length("gram") == F.col("n"))
        missed = lookup_join(whole.where(~F.col("n").isin(short)), again, ["n", "gram"], "left_semi")
        missed = missed.unionByName(whole.where(F.col("n").isin(short))).groupBy("n", "gram").agg(F.count("*").alias("cnt"), F.min("at").alias("at"))
        exact = exact.where(~F.col("n").isin(short)).unionByName(missed.select("n", "gram", "cnt", "at"))
    return top_grams(exact.select("n", "gram", "cnt", _first_pos(F.col("at"), spacing, base).alias("first_pos")), k)


#: Characters whose grams are counted together.
PART_CHARS = 1 << 20


def _part_lists(sizes: Sequence[int], listed: int):
    """For mapInArrow over chunks <_ord, _first, size, body>: of every part a row with n = 0 and the lists of its grams."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held, chars = [], 0
        for batch in batches:
            held.append(batch)
            chars += pc.sum(batch.column("size")).as_py() or 0
            if chars >= PART_CHARS:
                yield _part_list(pa.Table.from_batches(held), sizes, listed, number)
                held, chars, number = [], 0, number + 1
        if chars:
            yield _part_list(pa.Table.from_batches(held), sizes, listed, number)

    return lists


def _part_list(chunks: pa.Table, sizes: Sequence[int], listed: int, number: int) -> pa.RecordBatch:
    """The ``listed`` most frequent grams per size that repeat in the chunks, each with its first place."""
    chunks = chunks.sort_by([("_ord", "ascending"), ("_first", "ascending")])  # nulls come last
    ords, width = chunks.column("_ord").combine_chunks(), max(sizes)
    bodies, length = chunks.column("body").to_pylist(), chunks.column("size").to_numpy()
    text = "".join(bodies)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    long = np.fromiter(map(len, bodies), np.int64, len(bodies))
    row = np.repeat(np.arange(len(long)), long)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(long) - long, long)
    # Characters are numbered from 1; rows stand apart by as many zeros as a window reaches.
    seen = np.flatnonzero(np.bincount(codes, minlength=1))
    ids = np.zeros(len(codes) + width * len(long), np.int64)
    ids[np.arange(len(codes)) + row * width] = np.searchsorted(seen, codes) + 1
    at = np.flatnonzero(inside < length[row])
    pos, which = chunks.column("_first").to_numpy()[row[at]] + inside[at], row[at]
    same = pc.rank(ords, "ascending", tiebreaker="min").to_numpy().astype(np.int64)[which]
    if (np.diff(same) == 0)[np.diff(pos) < 0].any():  # texts with the same ordinal
        order = np.lexsort((pos, same))
        at, pos, which = at[order], pos[order], which[order]
    place = at + row[at] * width
    out, wins = [(number, 0, None, 0, 0, None, 0)], None
    key, span = np.zeros(len(at), np.int64), 1
    if (len(seen) + 1) ** width < 1 << 62:
        # Shorter grams begin longer windows, which are sorted: one sort serves all sizes.
        for j in range(width):
            key = key * (len(seen) + 1) + ids[place + j]
        wins, starts, times = np.unique(key, return_index=True, return_counts=True)
    for n in range(1, width + 1):
        if wins is None:
            if span * (len(seen) + 1) >= 1 << 62:
                known, key = np.unique(key, return_inverse=True)
                span = len(known)
            key, span = key * (len(seen) + 1) + ids[place + n - 1], span * (len(seen) + 1)
        if n in sizes:
            if wins is None:
                _, first, count = np.unique(key, return_index=True, return_counts=True)
            else:
                heads = wins // (len(seen) + 1) ** (width - n)
                new = np.flatnonzero(np.diff(heads, prepend=-1))
                first, count = np.minimum.reduceat(starts, new), np.add.reduceat(times, new)
            best = np.flatnonzero((count > 1) & (ids[place[first] + n - 1] > 0))  # none that the text ends in
            best = best[np.argsort(-count[best], kind="stable")[:listed]]
            for rank, i in enumerate(best.tolist(), 1):
                f = first[i]
                out.append((number, n, text[at[f]:at[f] + n], int(count[i]), rank, ords[which[f]].as_py(), int(pos[f])))
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), ords.type, pa.int64())
    arrays = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["_in", "n", "gram", "cnt", "rank", "_ord", "_pos"])


class _Firsts:
    """Of every gram the first ``limit`` distinct titles met so far: at most grams * limit entries.

    Two of them merge by giving one what the other holds.
    """

    def __init__(self, grams: Sequence[str], limit: int):
        self.grams, self.limit = grams, limit
        self.held: list[dict[bytes, int]] = [{} for _ in grams]
        # Only an ordinal below this changes what a gram has.
        self.below = np.full(len(grams), np.iinfo(np.int64).max)

    def see(self, ord_: int, key: bytes, text: str) -> None:
        for i in np.flatnonzero(self.below > ord_):
            if self.grams[i] in text:
                self.put(int(i), ord_, key)

    def put(self, i: int, ord_: int, key: bytes) -> None:
        held = self.held[i]
        if key in held:
            held[key] = min(held[key], ord_)
        else:
            held[key] = ord_
            if len(held) > self.limit:
                del held[max(held, key=held.__getitem__)]
        if len(held) == self.limit:
            self.below[i] = max(held.values())


def _first_titles(
    titles: DataFrame, grams: DataFrame, limit: int, ord_col: str, title: str, symbols: str | None
) -> DataFrame:
    """<n, gram, place, ord> of the first distinct titles; equal titles meet by digest.

    For a list of usual length every task keeps the first titles of each gram
    and hands on no more than these.  A gram that has them is not looked for
    behind them again, so nearly all texts are only looked at for grams that
    are rare.  A longer list is joined to the windows.
    """
    text = F.col(title) if symbols is None else w.drop_symbols(title, symbols)
    keyed = titles.where((F.col(title) != "") & F.col(ord_col).isNotNull())
    digest = F.unhex(F.sha2(title, 256))
    few = grams.limit(INLINE_GRAMS + 1).collect()
    if len(few) <= INLINE_GRAMS:
        wanted = [(r.n, r.gram) for r in few]

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = _Firsts([gram for _, gram in wanted], limit)
            for batch in batches:
                for ord_, key, body in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    if state.below.max() > ord_:
                        state.see(ord_, key.as_py(), body.as_py())
            rows = [(n, gram, key, ord_) for (n, gram), held in zip(wanted, state.held) for key, ord_ in held.items()]
            kinds = (pa.int32(), pa.string(), pa.binary(), pa.int64())
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["n", "gram", "_key", ord_col])

        ready = keyed.select(F.col(ord_col).cast("bigint"), digest.alias("_key"), text.alias("_text"))
        hits = ready.mapInArrow(first, f"n int, gram string, _key binary, `{ord_col}` bigint")
    else:
        sizes = [r.n for r in grams.select("n").distinct().collect()]  # one row per gram size
        ready = keyed.select(ord_col, title, digest.alias("_key"))
        wins = text_windows(ready, max(sizes), title, [ord_col, "_key"], symbols)
        heads = wins.select(ord_col, "_key", _heads(sizes)).where(F.length("gram") == F.col("n"))
        hits = lookup_join(heads, grams.select("n", "gram"), ["n", "gram"], "left_semi", derived=False)
    firsts = hits.groupBy("n", "gram", "_key").agg(F.min(ord_col).alias(ord_col))
    return top_per_group(firsts, ["n", "gram"], [F.asc(ord_col)], limit, "place").drop("_key")


def gram_examples(
    titles: DataFrame,
    top: DataFrame,
    limit: int = settings.MAX_SAMPLES,
    ord_col: str = "ord",
    title: str = "title",
    symbols: str | None = settings.GRAM_SYMBOLS,
) -> DataFrame:
    """Up to ``limit`` distinct example titles per top gram, in input order.

    Result is long: <n, gram, place, title>.  What is shuffled are the first
    examples of each task; titles join by the ordinals that were chosen.
    """
    top = checkpointed(top.select("n", "gram"))
    if top.isEmpty():
        empty = "n int, gram string, place bigint, title string"
        return titles.sparkSession.createDataFrame([], empty)
    found = checkpointed(_first_titles(titles, top, limit, ord_col, title, symbols))  # at most sizes x top words x limit rows
    last = found.agg(F.max(ord_col)).first()[0]
    texts = titles.select(ord_col, title).where(F.col(ord_col) <= F.lit(last))
    return lookup_join(texts, found, [ord_col], "inner", derived=False).select(
        "n", "gram", "place", F.col(title).alias("title")
    )


def samples_by_gram(examples: DataFrame) -> DataFrame:
    """<n, gram, samples>; a group holds at most the example limit."""
    listed = F.array_sort(F.collect_list(F.struct("place", "title")))
    return examples.groupBy("n", "gram").agg(F.transform(listed, lambda x: x.title).alias("samples"))


def compound_counts(
    titles: DataFrame,
    run: str = settings.COMPOUND_RUN,
    end: str = settings.COMPOUND_END,
    ord_col: str = "ord",
    title: str = "title",
    spacing: int = SPACING,
) -> DataFrame:
    """Occurrences and first position of every compound: <word, cnt, first_pos>."""
    base = _base(titles, ord_col, spacing)
    found = titles.select(ord_col, F.posexplode(w.compounds(title, run, end)).alias("_i", "word"))
    at = _place(ord_col, F.col("_i"), spacing, base)
    counted = found.groupBy("word").agg(F.count("*").alias("cnt"), F.min(at).alias("at"))
    return counted.select("word", "cnt", _first_pos(F.col("at"), spacing, base).alias("first_pos"))


def ranked_vocabulary(counts: DataFrame) -> DataFrame:
    """Whole vocabulary, most frequent first; a range sort, no single task."""
    return counts.orderBy(F.desc("cnt"), F.asc("first_pos"), F.asc("word"))


def suffixes(words: DataFrame, sizes: Sequence[int] = settings.SUFFIX_SIZES, word: str = "word") -> DataFrame:
    """One row per word and size that fits: adds <n, suffix>."""
    tails = [F.struct(F.lit(n).alias("n"), F.right(word, F.lit(n)).alias("suffix")) for n in sizes]
    return words.select("*", F.inline(F.array(*tails))).where(F.length("suffix") == F.col("n"))


def suffix_ranking(
    counts: DataFrame,
    sizes: Sequence[int] = settings.SUFFIX_SIZES,
    k: int = settings.TOP_SUFFIXES,
) -> DataFrame:
    """Top ``k`` word endings per size, by occurrences: <n, rank, word, cnt>."""
    totals = (
        suffixes(counts, sizes)
        .groupBy("n", "suffix")
        .agg(F.sum("cnt").alias("cnt"), F.min("first_pos").alias("first_pos"))
        .withColumnRenamed("suffix", "word")
    )
    order = [F.desc("cnt"), F.asc("first_pos"), F.asc("word")]
    return top_per_group(totals, ["n"], order, k).select("n", "rank", "word", "cnt")


def wide_ranking(
    ranked: DataFrame, sizes: Sequence[int], k: int, word: str = "gram", names: dict[int, str] | None = None
) -> DataFrame:
    """Row i holds the i-th word of every size; shorter lists end in NULL.

    Columns are ``Rank`` and, per size, ``X-gram`` and ``X-Count``.
    """
    names = names or settings.GRAM_NAMES
    spine = ranked.sparkSession.range(1, k + 1).select(F.col("id").alias("rank"))
    pivoted = ranked.groupBy("rank").pivot("n", list(sizes)).agg(
        F.first(word).alias("word"), F.first("cnt").alias("cnt")
    )
    cols = [F.col("rank").alias("Rank")]
    for n in sizes:
        cols.append(F.col(f"{n}_word").alias(f"{names.get(n, n)}-gram"))
        cols.append(F.col(f"{n}_cnt").alias(f"{names.get(n, n)}-Count"))
    return spine.join(pivoted, "rank", "left").select(*cols)


def packed_ranking(ranked: DataFrame, sizes: Sequence[int], k: int) -> DataFrame:
    """Row i holds ``word (count)`` of the i-th word of every size, else ''."""
    spine = ranked.sparkSession.range(1, k + 1).select(F.col("id").alias("rank"))
    cells = ranked.select("rank", "n", w.pack("word", "cnt").alias("cell"))
    wide = cells.groupBy("rank").pivot("n", list(sizes)).agg(F.first("cell"))
    cols = [F.coalesce(F.col(str(n)), F.lit("")).alias(f"Last{n}") for n in sizes]
    return spine.join(wide, "rank", "left").select(F.col("rank").alias("Rank"), *cols)


def vocabulary_rollup(
    counts: DataFrame, size: int = settings.ROOT_SIZE, examples: int = settings.ROOT_EXAMPLES
) -> DataFrame:
    """Per ending of ``size`` letters: <root, total, variations, examples>.

    The vocabulary is written once, since totals and examples are aggregated
    apart: sums combine before the shuffle, and the examples are limited per
    root before it.
    """
    return _rollup(stored(counts), size, examples).drop("is_word")


def _rollup(counts: DataFrame, size: int, examples: int) -> DataFrame:
    rooted = counts.where(F.length("word") >= size).withColumn("root", F.right("word", F.lit(size)))
    totals = rooted.groupBy("root").agg(
        F.sum("cnt").alias("total"),
        F.count("*").alias("variations"),
        F.max(F.length("word") == size).alias("is_word"),
    )
    order = [F.desc("cnt"), F.asc("first_pos"), F.asc("word")]
    best = top_per_group(rooted, ["root"], order, examples)
    item = F.concat("word", F.lit("("), F.col("cnt").cast("string"), F.lit(")"))
    shown = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
    listed = best.groupBy("root").agg(F.array_join(F.transform(shown, lambda x: x["item"]), ", ").alias("shown"))
    more = F.when(F.col("variations") > examples, F.lit("...")).otherwise(F.lit(""))
    return totals.join(listed, "root").select(
        "root", "total", "variations", F.concat("shown", more).alias("examples"), "is_word"
    )


def rollup_with_orphans(
    counts: DataFrame,
    size: int = settings.ROOT_SIZE,
    examples: int = settings.ROOT_EXAMPLES,
    least: int = 2,
    no_parent: str = settings.NO_PARENT,
) -> DataFrame:
    """Rollup of the roots that are words themselves, then the orphan words.

    Adds ``orphan``; order by ``orphan, total desc`` gives the stored layout.
    """
    counts = stored(counts)
    roots = _rollup(counts, size, examples).where("is_word").drop("is_word")
    heads = counts.where(F.length("word") == size).select(F.col("word").alias("root"))
    tails = counts.where(F.col("cnt") >= least).withColumn("root", F.right("word", F.lit(size)))
    orphans = lookup_join(tails, heads, ["root"], "left_anti", derived=False).select(
        F.col("word").alias("root"),
        F.col("cnt").alias("total"),
        F.lit(1).cast("bigint").alias("variations"),
        F.lit(no_parent).alias("examples"),
        F.lit(True).alias("orphan"),
    )
    return roots.withColumn("orphan", F.lit(False)).unionByName(orphans)


def field_presence(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Records per top-level key and their share: <field, cnt, percent>."""
    whole = records.where(is_json_object(raw))
    # Records are counted with the fields, under a key of their own, so the input is parsed once.
    keys = F.array_distinct(F.json_object_keys(raw))
    marked = F.concat(F.transform(keys, lambda k: F.struct(k.alias("field"))), F.array(F.struct(F.lit(None).cast("string").alias("field"))))
    counts = stored(whole.select(F.inline(marked)).groupBy("field").agg(F.count("*").alias("cnt")))
    total = counts.where(F.col("field").isNull()).select("cnt").scalar()
    return counts.where(F.col("field").isNotNull()).withColumn("percent", w.percent("cnt", total))


def subject_keywords(records: DataFrame, rec: str = "rec", key: str = settings.ABOUT_KEY) -> DataFrame:
    """One row per subject: scalars, list members, and the ``@id`` of objects."""
    members = records.select(F.explode(as_list(field(rec, key))).alias("_v"))
    text = F.when(
        is_kind(F.col("_v"), "OBJECT"), F.try_variant_get("_v", '$["@id"]', "string")
    ).otherwise(F.try_variant_get("_v", "$", "string"))
    return members.select(text.alias("word")).where(F.col("word") != "")


def subject_ranking(
    records: DataFrame, k: int | None = settings.TOP_SUBJECTS, rec: str = "rec", key: str = settings.ABOUT_KEY
) -> DataFrame:
    """Subjects by number of occurrences: <rank, word, cnt>; all when k is None."""
    counts = subject_keywords(records, rec, key).groupBy("word").agg(F.count("*").alias("cnt"))
    order = [F.desc("cnt"), F.asc("word")]
    ranked = with_dense_rank(counts, order) if k is None else top_rows(counts, order, k)
    return ranked.select("rank", "word", "cnt")
