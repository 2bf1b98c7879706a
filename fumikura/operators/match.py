"""Word lists against titles: hits, verdicts, noise rules, covered words."""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import settings
from ..functions import words as w
from ..functions.words import _col
from ..session import checkpointed, stored
from .mine import text_chunks, text_windows
from .scale import bound_batches, is_small, lookup_join

# Above this many words a title is cut into grams and joined instead of being
# tested word by word (see README for the measurement).
INLINE_WORDS = 200
#: Most characters of the piece by which a word is looked up.
ANCHOR = 6
#: Keys per range that are looked at to choose where ranges begin.
CUT_SAMPLE = 20
#: One in so many titles is read to see which pieces are rare.
SHARE = 8


def first_hit(text: Column | str, words: Sequence[str]) -> Column:
    """First word *in list order* found inside the text, else NULL.

    One CASE expression: it stops at the first hit.  For long lists use
    :func:`first_hit_join`.
    """
    text = _col(text)
    if not words:
        return F.lit(None).cast("string")
    cases = F
    for word in words:
        cases = cases.when(F.contains(text, F.lit(word)), F.lit(word))
    return cases


_META = frozenset("\\.[]{}()*+-?^$|&#")


def _literal(text: str) -> str:
    return "".join("\\" + c if c in _META else c for c in text)


def alternation(words: Sequence[str]) -> str:
    """Pattern that matches like ``a|b|c``, with common beginnings factored out.

    Words with different first letters never match at the same place, so they
    may be grouped by it as long as a group keeps its order.  A word that ends
    inside a group hides all later words of that group.
    """
    groups: dict[str, list[str]] = {}
    ends = None
    for at, word in enumerate(words):
        if not word:
            ends = at
            break
        groups.setdefault(word[0], []).append(word)
    branches = []
    for members in groups.values():
        shared = os.path.commonprefix(members)
        rest = [m[len(shared):] for m in members]
        branches.append(_literal(shared) + (alternation(rest) if any(rest) else ""))
    if ends is not None:
        branches.append("")
    return branches[0] if len(branches) == 1 and not any("|" in b for b in branches) else "(?:" + "|".join(branches) + ")"


def leftmost_hit(text: Column | str, words: Sequence[str]) -> Column:
    """Word found earliest *in the text*, ties by list order, else NULL."""
    if not words:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(text, alternation(words), 0), F.lit(""))


def rarest_anchors(titles: DataFrame, words: DataFrame, title: str = "title", share: int = SHARE) -> DataFrame:
    """<anchor, offset, word>: of every word the piece that is rarest in the titles, and where it stands in the word.

    Pieces have the length of the shortest word, at most ANCHOR characters.
    All pieces of all words are counted in one pass over one in ``share``
    titles, chosen by hash; of equally rare ones the first is taken.  Any piece
    would find its word, a rare one finds little else.  ``words`` is <word>, each once.
    """
    size = min(ANCHOR, words.agg(F.min(F.length("word"))).first()[0])
    starts = F.sequence(F.lit(0), F.length("word") - size)
    pieces = words.select("word", F.explode(starts).alias("offset"))
    pieces = checkpointed(pieces.withColumn("anchor", F.substring("word", F.col("offset") + 1, F.lit(size))))
    some = titles.where((F.col(title) != "") & (F.pmod(F.xxhash64(title), F.lit(share)) == 0))
    wins = text_windows(some, size, title, (), symbols=None).select(F.col("win").alias("anchor"))
    counted = lookup_join(wins, pieces.select("anchor").distinct(), ["anchor"], "left_semi").groupBy("anchor").agg(F.count("*").alias("cnt"))
    order = F.struct(F.coalesce("cnt", F.lit(0)).alias("cnt"), "offset", "anchor")
    best = pieces.join(counted, "anchor", "left").groupBy("word").agg(F.min(order).alias("_b"))
    return best.select(F.col("_b.anchor").alias("anchor"), F.col("_b.offset").alias("offset"), "word")


def _anchored(texts: DataFrame, anchors: DataFrame, size: int, longest: int) -> DataFrame:
    """<_title_key, pos, _word_ord> of all places of all words; the words are few enough to be at hand in every task.

    Places where no anchor can stand are left out in arrays (:func:`_may_begin`)
    before there is a row for each.  A place comes with as much text on both
    sides as the longest word needs.  The joined rows are looked up by the
    anchor alone, and only for one that is there is the word compared with what
    stands round it.
    """
    bound_batches(texts.sparkSession)
    listed = [r.anchor for r in anchors.select("anchor").distinct().collect()]  # few enough to be broadcast
    kind = "_title_key binary, _at bigint, behind int, body string, anchor string"
    keyed = texts.select("_title_key", "_title").mapInArrow(_may_begin(listed, size, longest - 1), kind)
    met = keyed.join(F.broadcast(anchors), "anchor")
    start = F.col("behind") - F.col("offset")
    right = met.where((start >= 0) & (F.substring(F.col("body"), start + 1, F.col("size")) == F.col("word")))
    return right.select("_title_key", (F.col("_at") - F.col("offset")).alias("pos"), "_word_ord")


#: Places whose surroundings are written out together.
PLACES = 1 << 14


def _may_begin(anchors: Sequence[str], size: int, around: int):
    """For mapInArrow over <_title_key, _title>: places where an anchor may begin, each with the text ``around`` it.

    The first bytes of all anchors, as one number, are looked for in a table of
    hashes and then in the sorted list of these numbers.
    """
    coded = [anchor.encode() for anchor in anchors]
    head = min(8, *map(len, coded)) if len(coded) > 1 else min(8, len(coded[0]))
    heads = np.unique(np.array([int.from_bytes(c[:head], "little") for c in coded], np.uint64))
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)
    table = np.zeros(1 << 20, bool)
    table[heads * mix >> shift] = True

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in (batch.slice(*part).columns for batch in batches for part in w.slices(batch.column(1))):
            raw, at, starts = w.utf8(texts)
            if len(raw) < head:
                continue
            number = np.zeros(len(raw) - head + 1, np.uint64)
            for i in range(head):
                number |= raw[i:len(raw) - head + 1 + i].astype(np.uint64) << np.uint64(8 * i)
            maybe = np.flatnonzero(table[number * mix >> shift])
            maybe = maybe[heads[np.minimum(np.searchsorted(heads, number[maybe]), len(heads) - 1)] == number[maybe]]
            row = np.searchsorted(at, maybe, "right") - 1
            maybe, row = maybe[maybe + head <= at[row + 1]], row[maybe + head <= at[row + 1]]
            place, first = np.searchsorted(starts, maybe), np.searchsorted(starts, at)  # in characters of the batch
            ends = np.append(starts, len(raw))
            low, high = np.maximum(place - around, first[row]), np.minimum(place + around + size, first[row + 1])
            stop = np.minimum(place + size, first[row + 1])
            blob = raw.tobytes()
            for i in range(0, len(maybe), PLACES):
                part = slice(i, i + PLACES)
                body = [blob[a:b] for a, b in zip(ends[low[part]].tolist(), ends[high[part]].tolist())]
                piece = [blob[a:b] for a, b in zip(maybe[part].tolist(), ends[stop[part]].tolist())]
                columns = [
                    keys.take(pa.array(row[part])),
                    pa.array(place[part] - first[row[part]], pa.int64()),
                    pa.array((place - low)[part], pa.int32()),
                    pa.array(body, pa.binary()).cast(pa.string()),
                    pa.array(piece, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_title_key", "_at", "behind", "body", "anchor"])

    return places


def _anchored_by_chunk(texts: DataFrame, anchors: DataFrame, size: int, longest: int) -> DataFrame:
    """The same for any number of words: places of anchors meet the chunks of text by number, where words are compared."""
    wins = text_windows(texts, size, "_title", ["_title_key"], symbols=None).select("_title_key", "pos", F.col("win").alias("anchor"))
    met = wins.join(anchors, "anchor")
    starts = met.select("_title_key", (F.col("pos") - F.col("offset")).alias("_start"), "size", "word", "_word_ord").where(F.col("_start") >= 0)
    # The chunk where the word would begin reaches as far as the longest word does.
    piece = max(w.CHUNK, longest)
    number = lambda at: F.call_function("div", F.col(at), F.lit(piece))
    tries = F.collect_set(F.struct((F.col("_start") % piece).cast("int").alias("at"), "size", "word", "_word_ord"))
    wanted = starts.groupBy("_title_key", number("_start").alias("_no")).agg(tries.alias("_tries"))
    bodies = text_chunks(texts, longest, "_title", ["_title_key"]).select("_title_key", number("first").alias("_no"), "first", "body")
    right = F.filter("_tries", lambda t: F.substring(F.col("body"), t["at"] + 1, t["size"]) == t["word"])
    checked = bodies.join(wanted, ["_title_key", "_no"]).select("_title_key", "first", F.inline(right))
    return checked.select("_title_key", (F.col("first") + F.col("at")).alias("pos"), "_word_ord")


def first_hit_join(
    titles: DataFrame,
    words: DataFrame,
    title: str = "title",
    hit: str = "hit",
    leftmost: bool = False,
) -> DataFrame:
    """First hit for long lists: adds ``hit`` (NULL if none).

    The word that comes first in the list wins or, with ``leftmost``, the one
    found earliest in the text, ties by list order.

    The hit of a row depends on its title alone, so titles meet their hits by
    a digest; ids may repeat or be missing.

    ``words`` is <ord, word>, ``ord`` unique.  Every word is looked up by its
    anchor, a piece of it that is rare in the titles (:func:`rarest_anchors`):
    what is joined is as wide as an anchor however long the words are, and few
    places of a text are an anchor.  Words that are measured to be few are
    compared on the spot, others where their chunks of text meet their anchors.
    """
    listed = checkpointed(words.where(F.col("word") != "").select(F.col("ord").cast("bigint").alias("ord"), "word"))
    unique = listed.groupBy("word").agg(F.min("ord").alias("_word_ord"))
    longest = listed.agg(F.max(F.length("word"))).first()[0]
    if longest is None:
        return titles.withColumn(hit, F.lit(None).cast("string"))
    keyed = titles.withColumn("_title_key", F.unhex(F.sha2(F.col(title), 256)))
    texts = keyed.where(F.col(title) != "").select("_title_key", F.col(title).alias("_title"))
    anchors = checkpointed(rarest_anchors(texts, unique.select("word"), "_title").join(unique, "word").withColumn("size", F.length("word")))
    width = anchors.agg(F.max(F.length("anchor"))).first()[0]
    found = (_anchored if is_small(anchors) else _anchored_by_chunk)(texts, anchors, width, longest)
    if leftmost:
        best = found.groupBy("_title_key").agg(F.min(F.struct("pos", "_word_ord"))["_word_ord"].alias("ord"))
    else:
        best = found.groupBy("_title_key").agg(F.min("_word_ord").alias("ord"))
    named = lookup_join(best, listed.withColumnRenamed("word", hit), ["ord"], "inner", derived=False)
    return lookup_join(keyed, named.select("_title_key", hit), ["_title_key"], "left").drop("_title_key")


def _long_list(
    titles: DataFrame, words: Sequence[str] | DataFrame, title: str, hit: str, inline: int, leftmost: bool, short
) -> DataFrame:
    """A list of usual length goes into an expression; a longer one, or one that is a frame <ord, word>, is joined."""
    if not isinstance(words, DataFrame):
        words = [word for word in words if word]
        if len(words) <= inline:
            return titles.withColumn(hit, short(title, words))
        words = titles.sparkSession.createDataFrame(list(enumerate(words)), "ord bigint, word string")
    return first_hit_join(titles, words, title, hit, leftmost)


def with_first_hit(
    titles: DataFrame,
    words: Sequence[str] | DataFrame,
    title: str = "title",
    hit: str = "hit",
    inline: int = INLINE_WORDS,
) -> DataFrame:
    """List-order first hit, in the form that suits the length of the list; a frame <ord, word> never leaves Spark."""
    return _long_list(titles, words, title, hit, inline, False, first_hit)


def with_leftmost_hit(
    titles: DataFrame, words: Sequence[str] | DataFrame, title: str = "title", hit: str = "hit", inline: int = INLINE_WORDS
) -> DataFrame:
    """Word found earliest in the text, in the form that suits the length of the list; a frame <ord, word> never leaves Spark."""
    return _long_list(titles, words, title, hit, inline, True, leftmost_hit)


def with_keep_first(
    titles: DataFrame, keep: Sequence[str] | DataFrame, drop: Sequence[str] | DataFrame, title: str = "title", inline: int = INLINE_WORDS
) -> DataFrame:
    """Adds <verdict, reason, rescued> for lists of any length; the keep list wins."""
    tagged = with_leftmost_hit(with_leftmost_hit(titles, keep, title, "_kept", inline), drop, title, "_dropped", inline)
    verdict = _keep_first(F.col("_kept"), F.col("_dropped"))
    return tagged.select(*titles.columns, verdict.alias("_v")).select(*titles.columns, "_v.*")


def keep_first_verdict(text: Column | str, keep: Sequence[str], drop: Sequence[str]) -> Column:
    """Keep list wins: struct <verdict 'keep'|'drop', reason, rescued>; for short lists."""
    return _keep_first(leftmost_hit(text, keep), leftmost_hit(text, drop))


def _keep_first(kept: Column, dropped: Column) -> Column:
    goes = kept.isNull() & dropped.isNotNull()
    return F.struct(
        F.when(goes, F.lit("drop")).otherwise(F.lit("keep")).alias("verdict"),
        F.when(goes, F.concat(F.lit("NG Hit: "), dropped)).alias("reason"),
        (kept.isNotNull() & dropped.isNotNull()).alias("rescued"),
    )


def drop_only_verdict(hit: Column | str) -> Column:
    """struct <verdict 'keep'|'drop', reason> from a list-order hit."""
    hit = _col(hit)
    return F.struct(
        F.when(hit.isNull(), F.lit("keep")).otherwise(F.lit("drop")).alias("verdict"),
        hit.alias("reason"),
    )


def three_way_verdict(drop_hit: Column | str, keep_hit: Column | str) -> Column:
    """Drop list wins: struct <verdict 'ng'|'ok'|'gray', word, reason, is_score>."""
    ng, ok = _col(drop_hit), _col(keep_hit)
    return F.struct(
        F.when(ng.isNotNull(), F.lit("ng")).when(ok.isNotNull(), F.lit("ok")).otherwise(F.lit("gray")).alias("verdict"),
        F.coalesce(ng, ok).alias("word"),
        F.coalesce(F.concat(F.lit("NG: "), ng), F.concat(F.lit("OK: "), ok)).alias("reason"),
        F.when(ng.isNull() & ok.isNotNull(), F.lit(True)).alias("is_score"),
    )


def split_three_ways(
    titles: DataFrame,
    drop: Sequence[str],
    keep: Sequence[str],
    title: str = "title",
) -> DataFrame:
    """Every row with its verdict, word, reason and flag; no row is lost."""
    tagged = with_first_hit(titles, drop, title, "_ng")
    tagged = with_first_hit(tagged, keep, title, "_ok")
    verdict = three_way_verdict("_ng", "_ok")
    return tagged.withColumn("_v", verdict).select(
        *[c for c in titles.columns], "_v.verdict", "_v.word", "_v.reason", "_v.is_score"
    )


def annotate(raw: Column | str, **fields: Column) -> Column:
    """JSON object text with keys set at its end; NULL values are left out.

    ``raw`` must be the text of a JSON object.  Its bytes stay as they are,
    unless it already holds one of the keys: then that key is taken out first,
    which writes the rest of the object anew.
    """
    raw = _col(raw)
    names = F.array(*[F.lit(key) for key in fields])
    old = F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>")
    rest = F.to_json(F.map_filter(old, lambda key, _: ~F.array_contains(names, key)))
    raw = F.when(F.arrays_overlap(F.json_object_keys(raw), names), rest).otherwise(raw)
    body = F.regexp_replace(raw, r"^\s*\{|\}\s*$", "")
    added = F.to_json(F.struct(*[value.alias(key) for key, value in fields.items()]))
    inner = F.substring(added, F.lit(2), F.length(added) - 2)
    joint = F.when((F.regexp_replace(body, r"\s", "") != "") & (inner != ""), F.lit(", ")).otherwise(F.lit(""))
    return F.concat(F.lit("{"), body, joint, inner, F.lit("}"))


def verdict_line(raw: Column | str, reason: Column | str, is_score: Column | str) -> Column:
    """Line to write after a split: undecided rows as they came, others with their reason."""
    marked = annotate(raw, _filter_reason=_col(reason), is_score=_col(is_score))
    return F.when(_col(reason).isNull(), _col(raw)).otherwise(marked)


def reason_counts(rows: DataFrame, verdict: str = "verdict", word: str = "word") -> DataFrame:
    """Hits per verdict and word: <verdict, word, cnt>."""
    hits = rows.where(F.col(word).isNotNull())
    return hits.groupBy(verdict, word).agg(F.count("*").alias("cnt"))


def verdict_counts(rows: DataFrame, verdict: str = "verdict") -> DataFrame:
    return rows.groupBy(verdict).agg(F.count("*").alias("cnt"))


def noise_pattern(
    word: Column | str,
    noise: Sequence[str] = settings.NOISE_WORDS,
    safe: Sequence[str] = settings.SAFE_WORDS,
    exceptions: Sequence[tuple[str, str]] = settings.NOISE_EXCEPTIONS,
) -> Column:
    """First noise pattern inside the word, NULL if none or if the word is safe.

    A word is safe when it equals a safe word, or when it holds a safe word
    and the pattern that struck is excused by its protector.
    """
    word = _col(word)
    struck = first_hit(word, noise)
    excused = F.lit(False)
    for pattern, protector in exceptions:
        excused = excused | ((struck == pattern) & F.contains(word, F.lit(protector)))
    is_safe = word.isin(*safe) | (first_hit(word, safe).isNotNull() & excused)
    return F.when(~F.coalesce(is_safe, F.lit(False)), struck)


def noise_words(
    candidates: DataFrame,
    extra: Sequence[str] = settings.MANUAL_DROPS,
    noise: Sequence[str] = settings.NOISE_WORDS,
    safe: Sequence[str] = settings.SAFE_WORDS,
    exceptions: Sequence[tuple[str, str]] = settings.NOISE_EXCEPTIONS,
) -> DataFrame:
    """Candidates struck by a noise pattern, plus words added by hand."""
    hit = noise_pattern("word", noise, safe, exceptions)
    struck = candidates.where(hit.isNotNull()).select("word")
    added = candidates.sparkSession.createDataFrame([(x,) for x in extra], "word string")
    return struck.unionByName(added).distinct()


class _Stack:
    """Chosen words on the way to the last key, which all begin it, shortest first."""

    def __init__(self, words: Sequence[str] = ()):
        self.words = list(words)

    def reach(self, key: str) -> str | None:
        """The longest chosen word that begins a key; keys come in order."""
        while self.words and not key.startswith(self.words[-1]):
            self.words.pop()
        return self.words[-1] if self.words else None


def longest_heads(keys: DataFrame, chosen: DataFrame) -> DataFrame:
    """<word, head>: for every key <word, key> the longest chosen word <word> that it begins with, if any.

    Keys and chosen words are sorted together, in ranges between cut words.
    Passing through a range in order, a task holds the chosen words that begin
    the present key, one inside the other.  Those that reach into a range from
    before it begin its cut word, so they are looked up once for all ranges;
    a range then needs nothing from its neighbours.
    """
    spark = keys.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = chosen.select(F.lit(None).cast("string").alias("word"), F.col("word").alias("key"), F.lit(0).alias("_kind"))
    both = keys.select("word", "key", F.lit(1).alias("_kind")).unionByName(marked)
    # About CUT_SAMPLE keys per range are looked at; they decide the balance of the ranges alone.
    step = max(1, both.count() // (CUT_SAMPLE * ranges))
    some = sorted({r.key for r in both.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("key").collect()})
    cuts = some[len(some) // (2 * ranges)::max(1, -(-len(some) // ranges))]
    heads = [(i + 1, cut[:n]) for i, cut in enumerate(cuts) for n in range(len(cut) + 1)]
    open_: dict[int, list[str]] = {}
    if heads:
        begun = spark.createDataFrame(heads, "_range int, word string").join(chosen.select("word"), "word", "left_semi")
        for row in begun.orderBy("_range", F.length("word")).collect():  # at most the characters of the cut words
            open_.setdefault(row["_range"], []).append(row.word)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pa.array([bisect_right(cuts, key) for key in batch.column("key").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, place], names=["word", "key", "_kind", "_range"])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, last = _Stack(), None
        for batch in batches:
            words, found = [], []
            for word, key, kind, number in zip(*[c.to_pylist() for c in batch.columns]):
                if number != last:
                    stack, last = _Stack(open_.get(number, ())), number
                head = stack.reach(key)
                if kind == 0:
                    if head != key:
                        stack.words.append(key)
                elif head is not None:
                    words.append(word)
                    found.append(head)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(found, pa.string())], names=["word", "head"])

    dealt = both.mapInArrow(placed, "word string, key string, _kind int, _range int").repartition(ranges, "_range")
    return dealt.sortWithinPartitions("_range", "key", "_kind").mapInArrow(passed, "word string, head string")


def covering_parent(
    words: DataFrame, chosen: DataFrame, how: str = "suffix", parent: str = "parent"
) -> DataFrame:
    """<word, parent>: the chosen word that covers each unchosen word.

    Covered means a shorter chosen word is its ending (``suffix``) or lies
    inside it (``substring``).  The longest such word is given, then the
    lowest.  An ending is a beginning of the word read backwards, and a piece
    is a beginning of one of its endings, so both are a matter of
    :func:`longest_heads`, with one key per word or per character.
    """
    chosen = checkpointed(chosen.select("word").where(F.col("word") != "").distinct())
    open_words = words.select("word").distinct().join(chosen, "word", "left_anti")
    if how == "suffix":
        backwards = chosen.select(F.reverse("word").alias("word"))
        found = longest_heads(stored(open_words.select("word", F.reverse("word").alias("key"))), backwards)
        return found.select("word", F.reverse("head").alias(parent))
    starts = F.explode(F.sequence(F.lit(1), F.length("word")))
    tails = open_words.where(F.col("word") != "").select("word", starts.alias("_at"))
    found = longest_heads(stored(tails.select("word", F.expr("substring(word, _at)").alias("key"))), chosen)
    best = F.min(F.struct((-F.length("head")).alias("size"), F.col("head").alias("name")))
    return found.groupBy("word").agg(best.alias("_b")).select("word", F.col("_b.name").alias(parent))


def cover_state(words: DataFrame, chosen: DataFrame, how: str = "suffix") -> DataFrame:
    """Words with <checked, covered, parent> against one chosen list."""
    marks = chosen.select("word").distinct().withColumn("_in", F.lit(True))
    parents = covering_parent(words, chosen, how)
    return (
        words.join(marks, "word", "left")
        .join(parents, "word", "left")
        .withColumn("checked", F.coalesce("_in", F.lit(False)))
        .withColumn("covered", F.col("parent").isNotNull())
        .drop("_in")
    )


def dual_cover_state(words: DataFrame, drop: DataFrame, keep: DataFrame) -> DataFrame:
    """Words with <state, parent, parent_list>; the drop list is asked first.

    ``state`` is NG or OK for chosen words and NULL otherwise; only unchosen
    words look for a shorter word inside them.
    """
    both = drop.select("word").unionByName(keep.select("word")).distinct()
    free = words.select("word").distinct().join(both, "word", "left_anti")
    by_drop = covering_parent(free, drop, "substring", "_ng_parent")
    by_keep = covering_parent(free, keep, "substring", "_ok_parent")
    in_drop = drop.select("word").distinct().withColumn("_ng", F.lit(True))
    in_keep = keep.select("word").distinct().withColumn("_ok", F.lit(True))
    out = words
    for side in (in_drop, in_keep, by_drop, by_keep):
        out = out.join(side, "word", "left")
    return (
        out.withColumn("state", F.when(F.col("_ng"), "NG").when(F.col("_ok"), "OK"))
        .withColumn("parent", F.coalesce("_ng_parent", "_ok_parent"))
        .withColumn(
            "parent_list",
            F.when(F.col("_ng_parent").isNotNull(), "NG").when(F.col("_ok_parent").isNotNull(), "OK"),
        )
        .drop("_ng", "_ok", "_ng_parent", "_ok_parent")
    )


def protection(word: Column | str, protected: Sequence[str]) -> Column:
    """struct <protected, key>: the first protected keyword inside the word."""
    key = first_hit(word, [p for p in protected if p])
    return F.struct(key.isNotNull().alias("protected"), F.coalesce(key, F.lit("")).alias("key"))
