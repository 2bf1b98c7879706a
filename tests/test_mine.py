import random
from collections import Counter, defaultdict

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from fumikura.operators import mine, scale
from fumikura.plans.mining import mine_grams
from fumikura.sources.records import parse_records
from test_texts import brute_ngrams

RND = random.Random(5)
TEXTS = ["".join(RND.choice("ab 譜楽𠮷（.") for _ in range(RND.choice([0, 1, 3, 8, 150]))) for _ in range(40)]
TEXTS += ["楽譜楽譜楽譜"] * 25  # one title holds a third of all rows


def titles(spark, parts=5):
    return spark.createDataFrame(list(enumerate(TEXTS)), "ord bigint, title string").repartition(parts)


def brute_counts():
    counts = {n: Counter() for n in (2, 3, 4, 5)}
    for text in TEXTS:
        for n in counts:
            counts[n].update(brute_ngrams(text, n))
    return counts


def test_gram_counts_and_tie_order(spark):
    counts = mine.gram_counts(titles(spark))
    got = {(r.n, r.gram): r.cnt for r in counts.collect()}
    assert got == {(n, g): c for n, counter in brute_counts().items() for g, c in counter.items()}
    assert sum(c for (n, _), c in got.items() if n == 3) == sum(len(brute_ngrams(x, 3)) for x in TEXTS)
    # equal counts keep the order of first appearance, as Counter.most_common does
    top = mine.top_grams(counts, 12).orderBy("n", "rank").collect()
    assert [(r.n, r.gram, r.cnt) for r in top] == [
        (n, g, c) for n, counter in brute_counts().items() for g, c in counter.most_common(12)
    ]


@pytest.mark.parametrize("broadcast_rows, inline", [(200_000, 99), (200_000, 0), (0, 0), (0, 99)])
def test_examples(spark, monkeypatch, broadcast_rows, inline):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(mine, "INLINE_GRAMS", inline)
    want = defaultdict(list)
    for text in TEXTS:
        for n in (2, 3):
            for gram in brute_ngrams(text, n):
                if len(want[n, gram]) < 4 and text not in want[n, gram]:
                    want[n, gram].append(text)
    top = mine.top_grams(mine.gram_counts(titles(spark), (2, 3)), 15)
    shown = mine.samples_by_gram(mine.gram_examples(titles(spark), top, 4))
    got = {(r.n, r.gram): r.samples for r in shown.collect()}
    assert got == {(r.n, r.gram): want[r.n, r.gram] for r in top.collect()}


def test_tasks_hand_on_no_more_than_the_first_examples(spark):
    """Whatever the order of the titles, a task keeps ``limit`` titles per gram."""
    rng = random.Random(3)
    rows = [(i, rng.choice(TEXTS)) for i in range(600)]
    rng.shuffle(rows)
    state = mine._Firsts(["a", "b ", "楽譜"], 3)
    for ord_, text in rows:
        state.see(ord_, text.encode(), text)
        assert all(len(held) <= 3 for held in state.held)
    for gram, held in zip(state.grams, state.held):
        first = {}
        for ord_, text in sorted(rows):
            if gram in text:
                first.setdefault(text.encode(), ord_)
        assert sorted(held.values()) == sorted(first.values())[:3]


@pytest.mark.parametrize("k, listed", [(12, None), (12, 12), (3, 1), (5000, None)])
def test_frequent_grams_equal_a_full_count(spark, k, listed):
    """Also with lists so short that grams must be counted again, and with fewer grams than wanted."""
    rng = random.Random(k)
    texts = TEXTS + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(len(texts), None)], "ord bigint, title string")
    want = mine.top_grams(mine.gram_counts(df), k).orderBy("n", "rank").collect()
    got = mine.frequent_grams(df, k, listed=listed).orderBy("n", "rank").select("n", "gram", "cnt", "first_pos", "rank").collect()
    assert [tuple(r) for r in got] == [(r.n, r.gram, r.cnt, r.first_pos, r["rank"]) for r in want]


def test_frequent_grams_of_nothing(spark):
    none = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "ord bigint, title string")
    assert mine.frequent_grams(none, 5).count() == 0 and mine.frequent_grams(none.limit(0), 5).count() == 0


def test_ordinals_of_any_size_keep_first_positions(spark):
    rows = [(-(1 << 62), "ab"), (1 << 62, "ab cd"), (5, "cd")]
    df = spark.createDataFrame(rows, "ord bigint, title string")
    got = {r.gram: int(r.first_pos) for r in mine.gram_counts(df, (2,)).collect()}
    assert got["ab"] == -(1 << 62) * mine.SPACING and got["cd"] == 5 * mine.SPACING
    near = {r.gram: int(r.first_pos) for r in mine.gram_counts(df.where("ord > 0"), (2,)).collect()}
    assert near["ab"] == (1 << 62) * mine.SPACING and near["cd"] == 5 * mine.SPACING


def test_wide_table_is_padded(spark):
    done = mine_grams(titles(spark), k=30, examples=2)
    wide = done.wide.orderBy("Rank").collect()
    assert [r.Rank for r in wide] == list(range(1, 31))
    assert wide[0].asDict().keys() == {
        "Rank", "Bi-gram", "Bi-Count", "Tri-gram", "Tri-Count", "Tetra-gram", "Tetra-Count", "Penta-gram", "Penta-Count"
    }
    assert wide[0]["Bi-gram"] == brute_counts()[2].most_common(1)[0][0]
    assert all(len(r.samples) <= 2 for r in done.samples.collect())
    empty = mine.wide_ranking(done.top.where("n = 2 and rank <= 2"), (2, 3), 3).orderBy("Rank").collect()
    assert empty[2]["Bi-gram"] is None and empty[0]["Tri-gram"] is None


VOCAB = [("曲譜", 5), ("平曲譜", 7), ("大平曲譜", 1), ("琴曲譜", 1), ("小曲譜", 1), ("古曲譜", 1), ("家系譜", 3), ("新家系譜", 1), ("家図譜", 1)]


def vocab(spark):
    return spark.createDataFrame([(x, c, i) for i, (x, c) in enumerate(VOCAB)], "word string, cnt bigint, first_pos bigint")


def test_rollups(spark, rows):
    full = {r.root: (r.total, r.variations, r.examples) for r in mine.vocabulary_rollup(vocab(spark)).collect()}
    assert full["曲譜"] == (16, 6, "平曲譜(7), 曲譜(5), 大平曲譜(1), 琴曲譜(1), 小曲譜(1)...")
    assert full["系譜"] == (4, 2, "家系譜(3), 新家系譜(1)")
    got = mine.rollup_with_orphans(vocab(spark))
    assert rows(got, "root", "total", "variations", "orphan") == sorted(
        [("曲譜", 16, 6, False), ("家系譜", 3, 1, True)], key=repr
    )
    # relation between both tables: roots equal, hidden words all of count 1
    kept = sum(r.total for r in got.collect())
    assert sum(c for _, c in VOCAB) - kept == 2
    salted = mine._rollup(vocab(spark), 2, 5).where("is_word")
    assert salted.count() == 1


def test_orphans_on_the_salted_path(spark, rows, monkeypatch):
    want = rows(mine.rollup_with_orphans(vocab(spark)))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    assert rows(mine.rollup_with_orphans(vocab(spark))) == want


def test_suffix_ranking_and_packing(spark):
    ranked = mine.suffix_ranking(vocab(spark), (2, 3), 4)
    top = [(r.n, r["rank"], r.word, r.cnt) for r in ranked.orderBy("n", "rank").collect()]
    assert top[:3] == [(2, 1, "曲譜", 16), (2, 2, "系譜", 4), (2, 3, "図譜", 1)]
    assert top[3] == (3, 1, "平曲譜", 8)
    packed = mine.packed_ranking(ranked, (2, 3), 4).orderBy("Rank").collect()
    assert packed[0].asDict() == {"Rank": 1, "Last2": "曲譜 (16)", "Last3": "平曲譜 (8)"}
    assert packed[3].Last2 == ""


def test_compounds_first_positions(spark):
    df = spark.createDataFrame([(1, "琴譜・曲譜"), (0, "曲譜 曲譜")], "ord bigint, title string")
    ranked = mine.ranked_vocabulary(mine.compound_counts(df))
    assert [(r.word, r.cnt) for r in ranked.collect()] == [("曲譜", 3), ("琴譜", 1)]


def test_fields_and_subjects(spark, rows):
    raw = [
        '{"@id":"a","schema:about":"u"}',
        '{"@id":"b","schema:about":["u",{"@id":"v"},""]}',
        '{"@id":"c","schema:about":{"@id":"u"}}',
        '{"@id":"d"}',
        "[1]",
        "broken",
    ]
    lines = spark.createDataFrame([(x,) for x in raw], "raw string")
    assert rows(mine.field_presence(lines), "field", "cnt", "percent") == sorted(
        [("@id", 4, "100.0%"), ("schema:about", 3, "75.0%")], key=repr
    )
    want = [(1, "u", 3), (2, "v", 1)]
    records = parse_records(lines)
    assert rows(mine.subject_ranking(records), "rank", "word", "cnt") == want
    assert rows(mine.subject_ranking(records, k=None), "rank", "word", "cnt") == want
    assert rows(mine.subject_ranking(records, k=1), "rank", "word", "cnt") == want[:1]


def test_top_per_group_beyond_the_preshuffle_limit(spark):
    df = spark.range(20_000).select((F.col("id") % 3 == 0).alias("g"), F.col("id").alias("v"))
    got = scale.top_per_group(df, ["g"], [F.desc("v")], 1500)
    assert got.count() == 3000
    first = got.where("g and rank = 1").first()
    assert first.v == 19_998
    assert got.where("g and rank = 1500").first().v == 19_998 - 3 * 1499


def test_dense_rank_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(9)
    got = scale.with_dense_rank(df, [F.desc("v")]).collect()
    assert sorted((r["rank"], r.v) for r in got) == [(i + 1, 4999 - i) for i in range(5000)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_salts_like_a_plain_join(spark, rows, how):
    left = spark.range(300).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 20).alias("k"), "id")
    right = spark.range(0, 30, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    assert rows(scale.lookup_join(left, right, ["k"], how, rows=1)) == rows(left.join(right, ["k"], how))
    assert rows(scale.lookup_join(left, right, ["k"], how)) == rows(left.join(right, ["k"], how))


def test_stage_tables_go_with_their_owner(spark):
    import os

    from fumikura.session import scratch_path, stages, stored

    out = scratch_path(spark, "kept")
    with stages(spark) as folder:
        stored(spark.range(10)).where("id > 3").write.parquet(out)
        assert os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and spark.read.parquet(out).count() == 6
    assert scratch_path(spark, "x").rsplit("/", 1)[0] == out.rsplit("/", 1)[0]


def test_a_part_lists_its_repeated_grams_with_their_first_places():
    """Equal ordinals, characters beyond one byte and a null ordinal; the gram a text ends in is none."""
    rows = [(7, 0, 3, "éab"), (7, 0, 4, "xabc"), (None, 0, 2, "ab")]
    names, kinds = ["_ord", "_first", "size", "body"], [pa.int64(), pa.int64(), pa.int32(), pa.string()]
    chunks = pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
    got = mine._part_list(chunks, (1, 2), 5, 3).to_pylist()
    assert [tuple(r.values()) for r in got if r["n"] == 2] == [(3, 2, "ab", 3, 1, 7, 1)]
    assert [(r["gram"], r["cnt"], r["_pos"]) for r in got if r["n"] == 1] == [("a", 3, 1), ("b", 3, 2)]
    assert sum(r["n"] == 0 for r in got) == 1


def test_a_part_with_a_large_alphabet_gives_the_same():
    text = "".join(chr(0x4E00 + i % 9000) for i in range(20_000))
    chunks = pa.table({"_ord": pa.array([1], pa.int64()), "_first": pa.array([0], pa.int64()), "size": pa.array([len(text)], pa.int32()), "body": [text]})
    got = [r for r in mine._part_list(chunks, (5,), 3, 0).to_pylist() if r["n"]]
    assert [(r["gram"], r["cnt"], r["_pos"]) for r in got][0][1] == 3 and all(text.startswith(r["gram"], r["_pos"]) for r in got)
