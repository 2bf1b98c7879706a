"""License scan by diagonal voting, in DataFrame functions only.

All rolling word k-grams of a document are joined by hash to the places of the
same k-gram in the license templates.  A match at document word p and template
word q votes for the diagonal p - q: where the template would begin.  Votes of
neighbouring diagonals are merged, as words put in or left out shift the rest,
and a merged span counts when enough of the template's k-grams voted for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Words are runs of letters and digits of ASCII and of any other character; what parts them:
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest k-gram; shorter templates take all their words as one k-gram.
GRAM = 3
#: Diagonals at most so far apart belong to one span.
DRIFT = 4
#: Share of a template's k-grams that must vote for a span.
SHARE = 0.75
#: Parts of a band of diagonals; more than any template has k-grams.
UNIT = 1_000_000

#: Characters of all templates up to which their k-grams are broadcast.
BROADCAST_CHARS = 1 << 20

# Phrases with their labels (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Opening or key sentences of common license notices.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("released under the mit license", "mit"),
)


def words(text: Column | str) -> Column:
    """Words of a text, ASCII letters in lower case; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN, -1), "")


def template_grams(spark, templates: Sequence[tuple[str, str]], base: int) -> DataFrame:
    """<k, hash, gram, template, at, votes, label, base>: every k-gram place of every template.

    The first ``base`` templates are phrases; ``votes`` is the number of k-grams a template has.
    """
    rows = [(i, text, label, i < base) for i, (text, label) in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template int, text string, label string, base boolean")
    frame = frame.withColumn("_w", words("text")).where(F.size("_w") > 0)
    frame = frame.withColumn("k", F.least(F.size("_w"), F.lit(GRAM))).withColumn("votes", F.size("_w") - F.col("k") + 1)
    places = frame.select("template", "label", "base", "k", "votes", "_w", F.explode(F.sequence(F.lit(0), F.col("votes") - 1)).alias("at"))
    gram = F.slice("_w", F.col("at") + 1, F.col("k"))
    return places.select("k", F.array_join(gram, " ").alias("gram"), gram.alias("_g"), "template", "at", "votes", "label", "base").select(
        "k", reduce(lambda out, k: out.when(F.col("k") == k, F.xxhash64(*[F.get("_g", F.lit(i)) for i in range(k)])), range(1, GRAM + 1), F).alias("hash"), "gram", "template", "at", "votes", "label", "base"
    )


def scan_licenses(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
    share: float = SHARE,
) -> DataFrame:
    """Per row <doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score>.

    ``phrases`` count at every place where all their words stand in a row;
    their number of places, first and last start (in words) and labels are the
    base columns.  ``labels`` adds those of the notices; ``spans`` lists
    <label, start, end, score> of all; ``score`` is the best share of a
    template's k-grams found, 0 without a span.

    * Null or empty text, or text without a word: zero words, nothing found, no places.
    * Rows that share doc_id and text give equal results, once per row; a null doc_id is a key like any other.
    * Equal spans of several templates are all listed; other columns are not read.
    """
    spark = docs.sparkSession
    templates = [*phrases, *notices]
    grams = template_grams(spark, templates, len(phrases))
    sizes = sorted({min(GRAM, len(text.split())) for text, _ in templates})

    read = docs.select("doc_id", F.xxhash64("text").alias("_text"), words("text").alias("_w"))
    # One small struct per word: a generator copies every other column it hands on.
    rolled = F.transform("_w", lambda w, i: F.struct(F.size("_w").cast("bigint").alias("n_words"), i.alias("_pos"), *[_rolled(w, i, k).alias(f"_h{k}") for k in sizes], F.slice("_w", i + 1, sizes[-1]).alias("_near")))
    start = F.array(F.struct(F.size("_w").cast("bigint").alias("n_words"), F.lit(-1).alias("_pos"), *[F.lit(None).cast("bigint").alias(f"_h{k}") for k in sizes], F.array().cast("array<string>").alias("_near")))
    read = read.select("doc_id", "_text", F.inline(F.concat(start, rolled)))
    # Templates are the caller's list, so their size is known here.
    near = F.broadcast if sum(len(text) for text, _ in templates) <= BROADCAST_CHARS else (lambda frame: frame)
    votes = []
    for k in sizes:
        side = grams.where(F.col("k") == k).select(F.col("hash").alias(f"_h{k}"), F.struct("gram", "template", "at").alias(f"_t{k}"))
        same = side.groupBy(f"_h{k}").agg(F.collect_list(f"_t{k}").alias(f"_t{k}"))
        read = read.join(near(same), f"_h{k}", "left")
        # Equal hashes are verified on the words themselves.
        votes.append(_verified(f"_t{k}", k))
    head = F.array(F.struct(F.lit(None).cast("int").alias("template"), F.lit(None).cast("int").alias("diagonal"), F.lit(0).alias("pos"), F.lit(0).alias("k")))
    first = F.col("_pos") < 0
    hit = reduce(lambda a, b: a | b, [F.col(f"_t{k}").isNotNull() for k in sizes])
    none = F.slice(head, 1, 0)
    found = read.where(first | hit).select(
        "doc_id", "_text", "n_words", F.inline(F.concat(F.when(first, head).otherwise(none), *[F.coalesce(v, none) for v in votes]))
    )
    key = ["doc_id", "_text", "n_words"]
    hits = found.groupBy(*key, "template", "diagonal", "pos", "k").agg(F.count("*").alias("rows"))
    names = grams.select("template", "label", "base", F.col("votes").alias("full")).distinct()
    spans = _verified_spans(hits.join(near(names), "template", "left"), key, share)
    base = F.col("base")
    span = F.struct("label", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "score")
    noticed = F.col("template").isNotNull()
    out = spans.groupBy(*key).agg(
        F.max(F.when(~noticed, F.col("rows"))).alias("_rows"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.array_sort(F.collect_list(F.when(noticed, span))).alias("spans"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    )
    names_out = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"]
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows")))).select(*names_out)


def _verified_spans(hits: DataFrame, key: list[str], share: float) -> DataFrame:
    """Spans <key, template, label, base, start, end, score> of the templates, and the rows whose template is null as they are.

    A phrase stands by itself: each of its hits is a span.  The hits of a
    notice on neighbouring diagonals form a chain.  From every diagonal of a
    chain a band reaches as many diagonals on as the notice has k-grams, and is
    worth the share of different template places that are hit in it, so a
    place that votes again and again counts once and a long chain hides
    nothing.  Bands worth ``share`` are spans, unless a better one (or an
    equal one before) begins within a band's reach.
    """
    by = Window.partitionBy(*key, "template").orderBy("diagonal", "pos")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT, F.lit(True))
    chain = F.sum(F.when(apart, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    # Diagonals in units of a band, so that one range holds for templates of all sizes.
    place = F.call_function("div", (F.col("diagonal") + F.col("full")).cast("bigint") * UNIT, F.col("full"))
    chained = hits.withColumn("_chain", chain).withColumn("_place", place)
    along = Window.partitionBy(*key, "template", "_chain").orderBy("_place")
    band = along.rangeBetween(0, UNIT)
    valued = (
        chained.withColumn("_places", F.size(F.collect_set(F.col("pos") - F.col("diagonal")).over(band)))
        .withColumn("start", F.min("pos").over(band))
        .withColumn("end", F.max(F.col("pos") + F.col("k")).over(band))
        .dropDuplicates([*key, "template", "_chain", "diagonal"])
        .withColumn("score", F.when(F.col("template").isNotNull(), F.col("_places") / F.col("full")))
        .where(F.col("template").isNull() | (F.col("score") >= share))
    )
    order = F.struct("_places", -F.col("_place"))
    best = F.max(order).over(along.rangeBetween(-UNIT, UNIT))
    return valued.withColumn("_best", order == best).where(F.col("template").isNull() | F.col("_best")).drop("_best")


def _rolled(word: Column, at: Column, k: int) -> Column:
    """Hash of the k words from one on; null where the text ends before."""
    hashed = F.xxhash64(word, *[F.get("_w", at + i) for i in range(1, k)])
    return hashed if k == 1 else F.when(F.size("_w") >= at + k, hashed)


def _verified(places: str, k: int) -> Column:
    """Votes of one word: the template places whose k-gram has the same words."""
    gram = F.array_join(F.slice("_near", 1, k), " ")
    same = F.filter(places, lambda t: t["gram"] == gram)
    return F.transform(same, lambda t: F.struct(t["template"].alias("template"), (F.col("_pos") - t["at"]).alias("diagonal"), F.col("_pos").alias("pos"), F.lit(k).alias("k")))
