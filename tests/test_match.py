import random
import re

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from fumikura import settings
from fumikura.operators import match, scale, search
from fumikura.plans.mining import drop_list_from_ranking
from fumikura.sources import rankings


def titles(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, title string")


def hits(df):
    return [r.hit for r in df.orderBy("id").collect()]


def test_list_order_beats_text_order(spark):
    df = titles(spark, "伝記--人名録類", "x人名録y伝記", "none")
    assert hits(match.with_first_hit(df, ["伝記", "伝記--人名録類", "人名録"])) == ["伝記", "伝記", None]
    found = match.leftmost_hit("title", ["伝記", "伝記--人名録類", "人名録"])
    assert hits(df.withColumn("hit", found)) == ["伝記", "人名録", None]


def test_factored_pattern_matches_like_the_plain_one(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab.譜|") for _ in range(12)) for _ in range(150)]
    df = titles(spark, *texts)
    for _ in range(6):
        words = list(dict.fromkeys("".join(rnd.choice("ab.譜|") for _ in range(rnd.randint(1, 4))) for _ in range(9)))
        plain = re.compile("|".join(map(re.escape, words)))
        want = [m.group() if (m := plain.search(x)) else None for x in texts]
        assert hits(df.withColumn("hit", match.leftmost_hit("title", words))) == want
    stock = [f"https://k.example/term/{x}" for x in ("伝記", "伝記--人名録類", "俳諧", "俳文")]
    assert match.alternation(stock).count("https") == 1


def test_verdict_lines(spark):
    df = titles(spark, "目録", "楽譜", "x").withColumn("raw", F.concat(F.lit('{"t":"'), "title", F.lit('"}')))
    split = match.split_three_ways(df, ["目録"], ["楽譜"])
    got = split.orderBy("id").select(match.verdict_line("raw", "reason", "is_score").alias("x")).collect()
    assert [r.x for r in got] == [
        '{"t":"目録", "_filter_reason":"NG: 目録"}', '{"t":"楽譜", "_filter_reason":"OK: 楽譜","is_score":true}', '{"t":"x"}'
    ]


def test_words_are_literal(spark):
    df = titles(spark, "a.b", "axb", "c\\Ed", "(x)*")
    found = match.leftmost_hit("title", ["a.b", "c\\Ed", "(x)*"])
    assert hits(df.withColumn("hit", found)) == ["a.b", None, "c\\Ed", "(x)*"]
    assert hits(match.with_first_hit(df, ["a.b", "(x)*"])) == ["a.b", None, None, "(x)*"]


def test_empty_lists_switch_rules_off(spark):
    df = titles(spark, "abc", "")
    assert hits(match.with_first_hit(df, [])) == [None, None]
    assert hits(match.with_first_hit(df, [""])) == [None, None]
    verdict = df.select("id", match.keep_first_verdict("title", [], []).alias("v")).select("id", "v.*")
    assert [tuple(r) for r in verdict.orderBy("id").collect()] == [(0, "keep", None, False), (1, "keep", None, False)]


def test_opposite_priorities(spark):
    df = titles(spark, "楽譜目録", "目録", "楽譜", "other")
    first = df.select("id", match.keep_first_verdict("title", ["楽譜"], ["目録"]).alias("v")).select("id", "v.*")
    assert [tuple(r)[1:] for r in first.orderBy("id").collect()] == [
        ("keep", None, True), ("drop", "NG Hit: 目録", False), ("keep", None, False), ("keep", None, False)
    ]
    three = match.split_three_ways(df, ["目録"], ["楽譜"]).orderBy("id").collect()
    assert [(r.verdict, r.reason, r.is_score) for r in three] == [
        ("ng", "NG: 目録", None), ("ng", "NG: 目録", None), ("ok", "OK: 楽譜", True), ("gray", None, None)
    ]
    counts = {r.verdict: r.cnt for r in match.verdict_counts(match.split_three_ways(df, ["目録"], ["楽譜"])).collect()}
    assert sum(counts.values()) == 4
    drop = df.select(match.drop_only_verdict(match.first_hit("title", ["目録"])).alias("v")).select("v.*")
    assert [r.verdict for r in drop.collect()] == ["drop", "drop", "keep", "keep"]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_long_list_join_equals_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", broadcast_rows)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc𠮷") for _ in range(rnd.choice([0, 1, 5, 70, 300]))) for _ in range(60)]
    texts += ["abab" * 40] * 30  # one title holds a third of all rows
    words = list(dict.fromkeys("".join(rnd.choice("abc𠮷") for _ in range(rnd.randint(2, 7))) for _ in range(80)))
    want = [next((x for x in words if x in text), None) for text in texts]
    df = titles(spark, *texts)
    assert hits(match.with_first_hit(df, words, inline=0)) == want
    assert hits(match.with_first_hit(df, words)) == want
    earliest = [min(((text.find(x), i) for i, x in enumerate(words) if x in text), default=None) for text in texts]
    early = [None if e is None else words[e[1]] for e in earliest]
    assert hits(match.with_leftmost_hit(df, words, inline=0)) == early
    assert hits(match.with_leftmost_hit(df, words)) == early


@pytest.mark.parametrize("inline", [0, 10_000])
def test_long_words_and_ids_that_repeat_or_miss(spark, inline):
    long = "".join(chr(97 + i % 23) for i in range(90))
    rows = [(None, "x" * at + long + "y") for at in (0, 30, 60, 63, 64, 65, 127)] + [(1, "short"), (1, "ab"), (None, None), (1, long[:89])]
    words = [long, "zz", "ab" * 40, "short"]
    want = [next((w for w in words if t and w in t), None) for _, t in rows]
    df = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(rows)], "id bigint, n int, title string")
    got = match.with_first_hit(df, words, inline=inline).orderBy("n").collect()
    assert [r.hit for r in got] == want
    kept = match.with_keep_first(df, ["short"], words, inline=inline).orderBy("n").collect()
    assert [r.verdict for r in kept] == ["keep" if w in (None, "short") else "drop" for w in want]
    assert [r.rescued for r in kept] == [w == "short" for w in want]


def test_annotation_replaces_a_key_it_finds(spark):
    df = spark.createDataFrame([('{"a":1, "is_score":false}',), ('{ "a" : 2 }',), ("{}",)], "raw string")
    got = [r.x for r in df.select(match.annotate("raw", is_score=F.lit(True)).alias("x")).collect()]
    assert got == ['{"a":1, "is_score":true}', '{ "a" : 2 , "is_score":true}', '{"is_score":true}']


def test_noise_rules(spark):
    words = ["系譜", "名譜", "仮名譜", "長崎名譜", "歌譜", "大歌譜", "歌詩譜", "楽譜", "雅楽系譜", "桜譜笛譜", "琴"]
    df = spark.createDataFrame([(x,) for x in words], "word string")
    got = {r.word: r.n for r in df.select("word", match.noise_pattern("word").alias("n")).collect()}
    assert got == {
        "系譜": "系譜", "名譜": "名譜", "仮名譜": None, "長崎名譜": "名譜", "歌譜": None, "大歌譜": None,
        "歌詩譜": "詩譜", "楽譜": None, "雅楽系譜": "系譜", "桜譜笛譜": "桜譜", "琴": None,
    }


def test_drop_list_from_packed_ranking(spark):
    table = spark.createDataFrame(
        [(1, "曲譜 (186)", "仮名譜 (50)"), (2, "香譜 (9)", "合香譜 (4)"), (3, "名譜 (2)", ""), (4, None, "椿譜")],
        ["Rank", "Last2 (a)", "Last3 (b)"],
    )
    assert sorted(r.word for r in drop_list_from_ranking(table).collect()) == ["合香譜", "名譜", "系図", "系譜", "香譜"]
    assert sorted(tuple(r) for r in rankings.unpack_ranking(table).collect()) == [
        (2, "名譜", 2), (2, "曲譜", 186), (2, "香譜", 9), (3, "仮名譜", 50), (3, "合香譜", 4)
    ]


def words_df(spark, *words):
    return spark.createDataFrame([(x,) for x in words], "word string")


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_cover(spark, rows, monkeypatch, broadcast_rows):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", broadcast_rows)
    words = words_df(spark, "家譜", "諸家譜", "重修諸家譜", "家譜集", "曲")
    got = match.cover_state(words, words_df(spark, "家譜", "諸家譜"), "suffix")
    assert rows(got, "word", "checked", "covered", "parent") == sorted([
        ("家譜", True, False, None), ("諸家譜", True, False, None), ("重修諸家譜", False, True, "諸家譜"),
        ("家譜集", False, False, None), ("曲", False, False, None),
    ], key=repr)
    inside = match.cover_state(words, words_df(spark, "家譜"), "substring")
    assert rows(inside.where("covered"), "word", "parent") == sorted(
        [("諸家譜", "家譜"), ("重修諸家譜", "家譜"), ("家譜集", "家譜")], key=repr
    )
    assert match.cover_state(words, words_df(spark, "x").where("false")).where("covered").count() == 0


def test_dual_cover_asks_drop_first(spark, rows):
    words = words_df(spark, "楽譜目録", "楽譜集", "目録", "楽譜", "他")
    got = match.dual_cover_state(words, words_df(spark, "目録"), words_df(spark, "楽譜"))
    assert rows(got, "word", "state", "parent", "parent_list") == sorted([
        ("楽譜目録", None, "目録", "NG"), ("楽譜集", None, "楽譜", "OK"), ("目録", "NG", None, None),
        ("楽譜", "OK", None, None), ("他", None, None, None),
    ], key=repr)


def test_protection(spark):
    df = words_df(spark, "音楽と楽譜", "x")
    got = df.select(match.protection("word", settings.PROTECTED_WORDS.split(",")).alias("p")).select("p.*")
    assert [tuple(r) for r in got.collect()] == [(True, "楽譜"), (False, "")]


def test_searches(spark):
    df = spark.createDataFrame([("ÉTUDE [1]", "r"), ("étude", None), (None, "x")], "label string, reason string")
    assert df.where(search.holds_text("label", "étude [")).count() == 1
    assert df.where(search.any_holds_pattern(["label", "reason"], "étude|X")).count() == 3
    assert df.where(search.holds_pattern("label", "^é")).count() == 1
    verdicts = spark.createDataFrame([(True,), (False,), (None,)], "is_score boolean")
    assert [search.by_verdict(verdicts, x).count() for x in (True, False, None, "all")] == [1, 1, 1, 3]
    head, more = search.head_of(df.where("label is not null"), [F.asc("label")], 1)
    assert head.withColumn("m", more).first().m is True
    head, more = search.head_of(df, [F.asc("label")], 3)
    assert head.withColumn("m", more).first().m is False


def test_reason_counts(spark, rows):
    df = titles(spark, "目録", "目録2", "楽譜", "x")
    got = match.reason_counts(match.split_three_ways(df, ["目録"], ["楽譜"]))
    assert rows(got, "verdict", "word", "cnt") == [("ng", "目録", 2), ("ok", "楽譜", 1)]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("longest", [5, 90])
def test_long_lists_by_rare_pieces(spark, monkeypatch, small, longest):
    """Words compared on the spot and words that meet their chunks give what testing one by one gives."""
    monkeypatch.setattr(match, "is_small", lambda *_: small)
    rng = random.Random(longest)
    texts = ["".join(rng.choice("ab譜𠮷") for _ in range(rng.choice([0, 1, 5, 70, 400]))) for _ in range(60)]
    words = ["a", "譜b"] if longest == 5 else []
    for _ in range(80):
        text = rng.choice([t for t in texts if len(t) > 5])
        at = rng.randrange(len(text) - 3)
        words.append(text[at:at + rng.randint(3, longest)] + rng.choice(["", "", "x"]))
    words = list(dict.fromkeys(words))
    df = titles(spark, *texts, texts[3], None)
    listed = spark.createDataFrame([(10 * i, word) for i, word in enumerate(words)], "ord bigint, word string")
    want = [next((x for x in words if t and x in t), None) for t in [*texts, texts[3], None]]
    assert hits(match.with_first_hit(df, listed)) == want
    early = [min(((t.index(x), i, x) for i, x in enumerate(words) if x in t), default=(0, 0, None))[2] if t else None for t in [*texts, texts[3], None]]
    assert hits(match.with_leftmost_hit(df, listed)) == early
    assert hits(match.with_first_hit(df, listed.limit(0))) == [None] * len(want)


def test_anchor_is_the_rarest_piece(spark):
    df = titles(spark, *["abcdef" * 20, "xyz", "cdefgh", "quick"] * 9)
    words = spark.createDataFrame([("abcxyz",), ("efghab",), ("nowhere",)], "word string").withColumn("word", F.col("word"))
    got = {r.word: (r.anchor, r.offset) for r in match.rarest_anchors(df, words, share=1).collect()}
    assert all(word[offset:offset + len(anchor)] == anchor for word, (anchor, offset) in got.items())
    assert got["nowhere"][1] == 0
    short = {r.word: r.anchor for r in match.rarest_anchors(df, spark.createDataFrame([("abc",), ("bcdefgh",)], "word string"), share=1).collect()}
    assert short == {"abc": "abc", "bcdefgh": "efg"}


@pytest.mark.parametrize("sample", [1, 20])
@pytest.mark.parametrize("how", ["suffix", "substring"])
def test_covering_parent_over_ranges(spark, rows, monkeypatch, how, sample):
    """Chosen words inside one another, over the borders of ranges."""
    monkeypatch.setattr(match, "CUT_SAMPLE", sample)
    rng = random.Random(sample)
    every = list({"".join(rng.choice("ab𠮷") for _ in range(rng.randint(0, 9))) for _ in range(400)})
    picked = set(rng.sample([x for x in every if x], 60))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    inside = (lambda c, x: x.endswith(c)) if how == "suffix" else (lambda c, x: c in x)
    want = []
    for x in every:
        found = [c for c in picked if len(c) < len(x) and inside(c, x)]
        if x not in picked and found:
            want.append((x, min(found, key=lambda c: (-len(c), c))))
    assert rows(match.covering_parent(frame(every), frame(picked), how)) == sorted(want, key=repr)
    assert match.covering_parent(frame(every), frame([]), how).count() == 0


def test_places_of_anchors_are_found_without_a_row_for_each_character():
    keys, texts = pa.array([b"1", b"2", b"3"], pa.binary()), pa.array(["éxabcd", None, "abc ab"], pa.string())
    batch = pa.RecordBatch.from_arrays([keys, texts], names=["_title_key", "_title"])
    got = [tuple(r.values()) for out in match._may_begin(["abc", "bcd"], 3, 2)(iter([batch])) for r in out.to_pylist()]
    assert got == [(b"1", 2, 2, "éxabcd", "abc"), (b"1", 3, 2, "xabcd", "bcd"), (b"3", 0, 0, "abc a", "abc")]
