import random

import pytest
from pyspark.sql import functions as F

from fumikura.functions import replies
from fumikura.operators import judge, review, scale
from fumikura.plans.curation import curate, final_filter, mine_and_curate
from fumikura.sources import rankings
from fumikura.sources.records import parse_records

ACTIONS = ["TOGGLE_NG", "TOGGLE_OK", "NG", "OK", "RESET"]


def brute_fold(actions):
    state = None
    for action in actions:
        if action.startswith("TOGGLE_"):
            target = action[len("TOGGLE_"):]
            state = None if state == target else target
        else:
            state = None if action == "RESET" else action
    return state


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_fold_equals_replay(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", broadcast_rows)
    rnd = random.Random(11)
    logs = {f"w{i}": [rnd.choice(ACTIONS if i % 2 else ACTIONS[:2]) for _ in range(rnd.randint(1, 9))] for i in range(150)}
    logs["hot"] = [rnd.choice(ACTIONS) for _ in range(700)]
    seq = {w: sorted(rnd.sample(range(5000), len(a))) for w, a in logs.items()}
    rows = [(w, s, a) for w, acts in logs.items() for s, a in zip(seq[w], acts)]
    rnd.shuffle(rows)
    folded = review.fold_decisions(spark.createDataFrame(rows, "word string, seq bigint, action string"))
    got = {r.word: r.state for r in folded.collect()}
    assert got == {w: brute_fold(a) for w, a in logs.items()}
    drop, keep = review.lists_of(folded)
    assert drop.intersect(keep).count() == 0


def test_fold_from_two_halves_and_any_seq(spark, rows):
    rng = random.Random(9)
    actions = list(review.ACTIONS)
    for far in (0, (1 << 63) - 400):
        log = [(f"w{rng.randrange(4)}", far + i, rng.choice([*actions, None, "?"])) for i in range(300)]
        frame = spark.createDataFrame(log, "word string, seq bigint, action string")
        want = {}
        for word in {w for w, _, _ in log}:
            want[word] = brute_fold([a for w, _, a in log if w == word and a in actions])
        assert dict(rows(review.fold_decisions(frame))) == want
        early, late = frame.where(F.col("seq") < far + 130), frame.where(F.col("seq") >= far + 130)
        kept = review.fold_functions(review.decision_functions(early, segment=7))
        assert dict(rows(review.fold_decisions(late, kept))) == want


def test_functions_compose(spark):
    codes = range(27)
    digits = lambda f: (f % 3, f // 3 % 3, f // 9)
    pairs = spark.createDataFrame([(a, b) for a in codes for b in codes], "a int, b int")
    for r in pairs.select("a", "b", review._then(F.col("a"), F.col("b")).alias("c")).collect():
        assert digits(r.c) == tuple(digits(r.b)[x] for x in digits(r.a))


def test_last_decision_at_any_seq(spark, rows):
    log = spark.createDataFrame([("a", (1 << 63) - 1, True), ("a", (1 << 63) - 2, False), ("b", -(1 << 63), True), ("b", 5, False)], "id string, seq bigint, decision boolean")
    assert rows(review.last_decisions(log)) == [("a", True), ("b", False)]


def test_toggles_and_bulk_selection(spark, rows):
    log = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), ("c",), ("c",)], "word string")
    assert rows(review.fold_toggles(log)) == [("b",), ("c",)]
    sel = spark.createDataFrame([("a",), ("b",)], "word string")
    vis = spark.createDataFrame([("b",), ("c",)], "word string")
    assert rows(review.select_all(sel, vis)) == [("a",), ("b",), ("c",)]
    assert rows(review.clear_all(sel, vis)) == [("a",)]


def judged(spark):
    data = [("1", "one", True, "r"), ("2", "two", False, None), ("3", "three", None, ""), ("4", "four", None, "x")]
    return spark.createDataFrame(data, "id string, label string, judgment boolean, reason string")


def test_verified(spark, rows):
    log = spark.createDataFrame([("1", 5, False), ("1", 2, True), ("3", 1, True), ("2", 3, None), ("9", 1, True)], "id string, seq bigint, decision boolean")
    got = review.verified(judged(spark), review.last_decisions(log))
    assert rows(got) == [
        ("1", "one", False, "r", True), ("2", "two", False, "", False), ("3", "three", True, "", True), ("4", "four", False, "x", False)
    ]
    marked = review.with_override(review.unify_columns(judged(spark)), review.last_decisions(log))
    assert {r.is_score: r.overrides for r in review.verdict_summary(marked).collect()} == {True: 1, False: 0, None: 1}
    summary = {r.is_score: r.cnt for r in review.verdict_summary(review.unify_columns(judged(spark))).collect()}
    assert summary == {True: 1, False: 1, None: 2}


def test_unify_columns(spark):
    df = spark.createDataFrame([(True, "t")], "judgment boolean, thought string")
    assert review.unify_columns(df).columns == ["is_score", "reason"]


@pytest.mark.parametrize("count, size", [(50, 300), (300, 300), (900, 300)])
def test_sample_size(spark, count, size):
    df = spark.range(count).select(F.col("id").cast("string").alias("id"))
    first = [r.id for r in review.sample_rows(df, size, "s").collect()]
    assert len(set(first)) == min(count, size)
    assert first == [r.id for r in review.sample_rows(df.repartition(7), size, "s").collect()]
    if count > size:
        assert first != [r.id for r in review.sample_rows(df, size, "other").collect()]


def test_row_ids(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "line bigint, label string")
    assert {r.label: r.id for r in review.with_row_id(df, [F.col("line")]).collect()} == {"a": "row_0", "b": "row_1", "c": "row_2"}


REPLIES = {
    "json": ('{"is_score": true, "reason": "楽"}', True, "楽"),
    "prose": ('Sure:\n{"is_score": false,\n "reason": "n"} bye', False, "n"),
    "null": ('{"is_score": null}', None, ""),
    "trailing": ('{"is_score": true, "reason": "r"} thanks', True, "r"),
    "two": ('{"is_score": true} and {"is_score": false}', None, replies.CALL_ERROR + "braced block is not JSON"),
    "text": ("no braces here", None, replies.PARSE_ERROR),
    "broken": ("{not json}", None, replies.CALL_ERROR + "braced block is not JSON"),
    "list": ("[1]", None, replies.CALL_ERROR + "reply is not an object"),
    "literal": ("null", None, replies.CALL_ERROR + "reply is not an object"),
    "empty": ("", None, replies.PARSE_ERROR),
    "fail": (None, None, replies.CALL_ERROR + "down"),
}


def test_replies(spark):
    data = [(k, k, v[0], "down" if k == "fail" else None) for k, v in REPLIES.items()]
    got = judge.judgments(spark.createDataFrame(data, "id string, label string, reply string, error string"))
    assert {r.id: (r.judgment, r.reason) for r in got.collect()} == {k: v[1:] for k, v in REPLIES.items()}


def test_judge_survives_failing_calls(spark):
    def scorer(prompt):
        if "bad" in prompt:
            raise ValueError("no answer")
        return '{"is_score": true, "reason": "ok"}'

    raw = ['{"@id":"1","rdfs:label":"good"}', '{"@id":"2","rdfs:label":"bad"}', '{"rdfs:label":"no id"}', '{"@id":""}', '{"uri":"5"}']
    got = judge.judge(parse_records(spark.createDataFrame([(r,) for r in raw], "raw string")), judge.one_by_one(scorer))
    assert {r.id: (r.label, r.judgment, r.reason) for r in got.collect()} == {
        "1": ("good", True, "ok"), "2": ("bad", None, "API Error: no answer"), "5": ("No Title", True, "ok")
    }


def test_cascade_loses_no_record(spark, rows):
    names = ["家系譜", "平曲譜", "楽譜目録", "謎譜", "別譜", "絵本"]
    raw = [(str(i), f'{{"@id":"{i}","rdfs:label":"{n}"}}') for i, n in enumerate(names)]
    records = parse_records(spark.createDataFrame(raw, "id string, raw string"))
    decisions = spark.createDataFrame([("3", True)], "id string, decision boolean")
    done = curate(records, ["絵本"], ["系譜", "目録"], ["曲譜"], judge.keyword_scorer(["別"], []), decisions)
    assert rows(done.split, "id", "verdict") == [("0", "ng"), ("1", "ok"), ("2", "ng"), ("3", "gray"), ("4", "gray")]
    assert rows(done.judged, "id", "judgment") == [("3", None), ("4", True)]
    assert rows(done.final, "id", "is_score", "verified_by_human") == [("3", True, True), ("4", True, False)]
    assert done.sample.count() == 2


def test_queues(spark, rows):
    ranked = spark.createDataFrame([("http://k/" + "x" * 30 + "music", 3), ("楽譜", 5), ("plain", 1)], "word string, cnt bigint")
    sel = spark.createDataFrame([("plain",)], "word string")
    got = review.subject_queue(ranked, sel, ["music", "楽譜"], limit=2)
    assert [(r["rank"], r.checked, r.protected, r.key) for r in got.orderBy("rank").collect()] == [(1, False, True, "楽譜"), (2, False, True, "music")]
    assert review.subject_queue(ranked, sel, [], uris_only=True).count() == 1
    words = spark.createDataFrame([(2, 1, "家譜", 9), (3, 1, "諸家譜", 4)], "n int, rank bigint, word string, cnt bigint")
    samples = spark.createDataFrame([(3, "諸家譜", ["t1", "t2"])], "n int, word string, samples array<string>")
    rows_ = {r.word: r for r in review.word_queue(words, words.where("n = 2"), samples).collect()}
    assert rows_["諸家譜"].parent == "家譜" and rows_["諸家譜"].examples == "・t1\n・t2"
    assert rows_["家譜"].checked and rows_["家譜"].examples == review.NO_SAMPLE


def test_batches_are_asked_again_row_by_row(spark):
    def scorer(prompts):
        if len(prompts) > 1 and any("bad" in p for p in prompts):
            raise RuntimeError("batch")
        return [ValueError("no") if "bad" in p else p.upper() for p in prompts]

    rows = spark.createDataFrame([(i, "bad" if i == 7 else f"p{i}") for i in range(20)], "id bigint, prompt string").coalesce(1)
    got = {r.id: (r.reply, r.error) for r in judge.ask(rows, scorer, batch_rows=8).collect()}
    assert got == {i: (None, "no") if i == 7 else (f"P{i}", None) for i in range(20)}


def test_each_record_is_judged_once(spark, tmp_path):
    path = str(tmp_path / "calls")

    def scorer(prompts):
        with open(path, "a") as file:
            file.write("x" * len(prompts))
        return ['{"is_score": true}' for _ in prompts]

    raw = [f'{{"@id":"{i}","rdfs:label":"別の譜{i}"}}' for i in range(30)]
    recs = parse_records(spark.createDataFrame([(r,) for r in raw], "raw string"))
    from fumikura.functions import titles as t

    records = recs.select(t.record_id("rec").alias("id"), "raw", "rec")
    decisions = spark.createDataFrame([("3", False)], "id string, decision boolean")
    done = curate(records, [], [], [], scorer, decisions)
    assert done.final.count() == 30 and done.sample.count() == 30 and done.judged.count() == 30
    assert len(open(path).read()) == 30
    assert done.final.where("not is_score").count() == 1


def test_final_filter_writes_both_outputs_and_counts(spark, rows, tmp_path):
    raw = [
        '{"@id":"1","rdfs:label":"楽譜 花譜"}', '{"@id":"2",  "rdfs:label":"花譜,\\n\\"絵\\"","schema:about":["k1","k2"]}', '{"@id":"3","schema:name":"茶"}',
        '{"@id":"4","exclusion_reason":"old","schema:about":{"@id":"http://k/茶道"}}', '{"@id":"5"}', "[1]", "broken",
    ]
    recs = parse_records(spark.createDataFrame([(r,) for r in raw], "raw string"))
    drop = [f"none{i}" for i in range(240)] + ["花譜", "茶道"]
    for name, words in (("list", drop), ("frame", spark.createDataFrame(list(enumerate(drop)), "ord bigint, word string"))):
        kept, dropped = str(tmp_path / name / "kept"), str(tmp_path / name / "dropped")
        assert final_filter(recs, ["楽譜"], words, kept, dropped) == {"kept": 3, "rescued": 1, "dropped": 2}
        assert sorted(r.value for r in spark.read.text(kept).collect()) == sorted([raw[0], raw[2], raw[4]])
        table = rankings.read_table(spark, dropped, multiline=True)
        assert table.columns == ["exclusion_reason", "rdfs:label", "@id", "schema:about"]
        assert [tuple(r) for r in table.orderBy("`@id`").collect()] == [
            ("NG Hit: 花譜", '花譜,\n"絵"', "2", '["k1","k2"]'), ("NG Hit: 茶道", None, "4", '{"@id":"http://k/茶道"}')
        ]


def test_final_filter_of_nothing(spark, tmp_path):
    recs = parse_records(spark.createDataFrame([], "raw string"))
    assert final_filter(recs, [], ["x"], str(tmp_path / "k"), str(tmp_path / "d")) == {"kept": 0, "rescued": 0, "dropped": 0}
    assert spark.read.text(str(tmp_path / "k")).isEmpty()


def test_mined_list_feeds_the_cascade(spark, rows):
    names = ["源氏家譜", "諸家譜", "平曲譜", "琴楽譜", "平家の系図", "絵本", "仮名譜"]
    raw = [(i, str(i), f'{{"@id":"{i}","rdfs:label":"{n}"}}') for i, n in enumerate(names)]
    records = parse_records(spark.createDataFrame(raw, "ord bigint, id string, raw string"))
    decisions = spark.createDataFrame([], "id string, decision boolean")
    done = mine_and_curate(records, ["絵本"], ["楽譜"], judge.keyword_scorer(["曲"], []), decisions)
    # Endings with 家譜 are struck, 仮名譜 is excused, 系図 is added by hand; the list is in word order.
    words = [r.word for r in done.drop.orderBy("ord").collect()]
    assert words == sorted(words) and {"家譜", "諸家譜", "源氏家譜", "系図", "系譜"} <= set(words) and "名譜" in words and "仮名譜" not in words
    assert rows(done.curation.split, "id", "verdict", "reason") == [
        ("0", "ng", "NG: 家譜"), ("1", "ng", "NG: 家譜"), ("2", "gray", None), ("3", "ok", "OK: 楽譜"), ("4", "ng", "NG: 系図"), ("6", "ng", "NG: 名譜")
    ]
    assert rows(done.curation.judged, "id", "judgment") == [("2", True)]
    # Only titles of the class are mined, all records are split.
    some = mine_and_curate(records, [], [], judge.keyword_scorer([], []), decisions, wanted=F.col("ord") == 2)
    assert rows(some.drop, "word") == [("系図",), ("系譜",)] and some.curation.split.count() == 7
