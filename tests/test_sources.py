import json
import os

import pytest
from pyspark.sql import functions as F

from fumikura.operators import judge, match
from fumikura.sources import rankings, records, samples, triples, wordlists
from fumikura.streaming import split as streaming


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


LINES = '{"@id":"1","rdfs:label":"家系譜"}\nbroken {\n\n3\n[]\n{"@id": "2",  "rdfs:label":"曲譜"}\n   \n"text"\n'


def test_tolerant_scan_and_counts(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", LINES)
    assert sorted(r.raw for r in records.read_records(spark, path).collect()) == sorted([LINES.split("\n")[0], LINES.split("\n")[5]])
    counts = records.scan_counts(records.read_lines(spark, path)).first()
    assert (counts.lines, counts.parsed, counts.objects) == (8, 5, 2)


def test_leftovers_after_a_value_spoil_the_line(spark):
    bad = ['{"a":1} x', '{"a":1}]', '{"a":1}}', '{"a":1},"q":2', '{"a":1}{"b":2}', '1,"e":5', "", "  ", "{"]
    good = ['{"a":1}', ' {"a":{"r":[1]}}\t', '{"r":1,"e":0}', '{}']
    lines = spark.createDataFrame([(x,) for x in bad + good], "raw string")
    assert sorted(r.raw for r in records.parse_records(lines).collect()) == sorted(good)
    counts = records.scan_counts(lines).first()
    assert (counts.parsed, counts.objects) == (4, 4)


def test_line_numbers_across_files_and_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(2000)]
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        put(folder / f"part-{i}.txt", "\n".join(lines[i * 500:(i + 1) * 500]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = records.read_lines(spark, str(folder))
        got = {r.ord: r.raw for r in records.numbered(read).collect()}
        first = judge.first_lines(read, 700).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(lines))
    assert [r.raw for r in first] == lines[:700]


def test_written_rows_keep_their_bytes(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", LINES)
    rows = records.read_records(spark, path).withColumn("title", F.try_variant_get("rec", '$["rdfs:label"]', "string"))
    split = match.split_three_ways(rows, ["系譜"], ["曲譜"])
    out = str(tmp_path / "out")
    records.write_by_verdict(split, out)
    assert [r.value for r in spark.read.text(out + "/verdict=ok").collect()] == ['{"@id": "2",  "rdfs:label":"曲譜"}']
    assert sorted(x for x in os.listdir(out) if x.startswith("verdict")) == ["verdict=ng", "verdict=ok"]


def test_jsonl_sink_keeps_null_and_letters(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "楽譜")], "id string, judgment boolean, reason string")
    records.write_jsonl(df, str(tmp_path / "o"))
    line = spark.read.text(str(tmp_path / "o")).first().value
    assert json.loads(line) == {"id": "1", "judgment": None, "reason": "楽譜"} and "楽譜" in line


def test_resume_appends_each_key_once(spark, tmp_path):
    out = str(tmp_path / "docs")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "uri string, n bigint")
    records.append_pending(rows.where("n < 3"), out)
    records.append_pending(rows.orderBy(F.desc("n")), out)
    assert sorted(r.uri for r in spark.read.json(out).collect()) == ["a", "b", "c"]


def test_new_keys_never_read_the_old_output(spark, tmp_path, rows, monkeypatch):
    out = str(tmp_path / "out")
    frame = lambda first, last: spark.range(first, last).select(F.concat(F.lit("k"), "id").alias("uri"), "id")
    records.append_pending(frame(0, 300), out)
    asked = []
    read = records.written_keys
    monkeypatch.setattr(records, "written_keys", lambda *args: asked.append(1) or read(*args))
    records.append_pending(frame(1000, 1200), out)
    assert not asked  # the filter alone told that all are new
    records.append_pending(frame(100, 400), out)
    assert len(asked) == 1
    records.append_pending(frame(0, 1200), out)
    back = spark.read.json(out)
    assert rows(back.select("id")) == sorted([(i,) for i in range(1200)], key=repr)


def test_filter_rules_out_nothing_that_was_written(spark, tmp_path, monkeypatch):
    from fumikura.sources import membership

    monkeypatch.setattr(membership, "BLOCKS", 16)  # crowded, so that some keys are taken for written ones
    path = str(tmp_path / "x")
    assert membership.read_filter(spark, path) is None
    keys = spark.range(400).select(F.col("id").cast("string").alias("uri"))
    known = membership.write_filter(keys.unionByName(spark.createDataFrame([(None,)], "uri string")), path, "uri")
    assert membership.possible(keys, known, "uri").count() == 400
    others = spark.range(1000, 3000).select(F.col("id").cast("string").alias("uri"))
    assert membership.possible(others, known, "uri").count() < 1500
    known = membership.write_filter(others, path, "uri")
    assert membership.possible(others, known, "uri").count() == 2000 and known.count() <= 16


def test_counters_of_the_writing_pass(spark, tmp_path):
    lines = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("oops",), ("",), ('{"a": 1} x',), ('  {"b": 2}',)], "raw string")
    assert records.write_objects(lines, str(tmp_path / "o")) == {"lines": 6, "parsed": 3, "objects": 2}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ['  {"b": 2}', '{"a": 1}']
    split = spark.createDataFrame([("x", "ng", None), ("y", "ok", True), ("z", "gray", None), ("q", "ok", False)], "raw string, verdict string, is_score boolean")
    assert records.write_split(split, str(tmp_path / "s")) == {"ng": (1, 0), "ok": (2, 1), "gray": (1, 0), "all": (4, 1)}


@pytest.mark.parametrize("header", ["Rank,Keyword,Count", " Rank , Word , Count ", "Rank,Term,Count"])
def test_ranking_headers(spark, tmp_path, header):
    path = put(tmp_path / "r.csv", f'﻿{header}\n1,"楽,""譜""",12\n2,雅楽,x\n')
    df = rankings.read_ranking(spark, path)
    assert df.columns == ["Rank", "Word", "Count"]
    assert [tuple(r) for r in df.collect()] == [(1, '楽,"譜"', 12), (2, "雅楽", None)]


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', "NG Hit: x")], "n int, label string, exclusion_reason string").coalesce(1)
    rankings.write_csv(df, str(tmp_path / "q"), ["exclusion_reason", "missing", "label"], quote_all=True)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "q")).collect())
    assert text == '"exclusion_reason","label","n"\n"NG Hit: x","a ""q"", b","1"'
    rankings.write_csv(df, str(tmp_path / "b"), bom=True)
    name = next(x for x in os.listdir(tmp_path / "b") if x.endswith(".csv"))
    assert (tmp_path / "b" / name).read_bytes().startswith(b"\xef\xbb\xbfn,")
    rankings.write_csv(df, str(tmp_path / "c"), ["label"], bom=True, quote_all=True)
    name = next(x for x in os.listdir(tmp_path / "c") if x.endswith(".txt"))
    assert (tmp_path / "c" / name).read_text("utf-8") == '\ufeff"label","n","exclusion_reason"\n"a ""q"", b","1","NG Hit: x"\n'


def test_discarded_records_as_table(spark, tmp_path):
    raw = ['{"b":["x",1],"rdfs:label":"l"}', '{"a":{"k":null},"rdfs:label":null}']
    recs = records.parse_records(spark.createDataFrame([(r,) for r in raw], "raw string"))
    names = records.field_names(recs)
    assert names == ["a", "b", "rdfs:label"]
    table = records.as_columns(recs.withColumn("exclusion_reason", F.lit("NG Hit: x")), names, kept=["exclusion_reason"])
    assert sorted((tuple(r) for r in table.collect()), key=repr) == sorted(
        [("NG Hit: x", None, '["x",1]', "l"), ("NG Hit: x", '{"k":null}', None, None)], key=repr
    )
    rankings.write_csv(table, str(tmp_path / "d"), ["exclusion_reason", "rdfs:label"], quote_all=True)
    back = rankings.read_table(spark, str(tmp_path / "d"))
    assert back.columns == ["exclusion_reason", "rdfs:label", "a", "b"] and back.count() == 2


def test_packed_ranking_file(spark, tmp_path):
    path = put(tmp_path / "p.csv", "﻿Rank,Last2 (例:家譜),Last3 (例)\n1,曲譜 (186),平曲譜 (79)\n2,琴 (x) (3),\n3,plain,\n")
    assert sorted(tuple(r) for r in rankings.read_packed_ranking(spark, path).collect()) == [
        (2, "曲譜", 186), (2, "琴 (x)", 3), (3, "平曲譜", 79)
    ]
    assert sorted(r.word for r in rankings.read_candidates(spark, path).collect()) == ["平曲譜", "曲譜", "琴"]


def test_word_lists(spark, tmp_path):
    path = put(tmp_path / "w.txt", "　伝記 \n\n伝記--人名\n  　\n伝記\n*x\n")
    listed = wordlists.read_word_list(spark, path)
    assert wordlists.as_literals(listed) == ["伝記", "伝記--人名", "伝記", "*x"]
    assert wordlists.read_word_set(spark, path).count() == 3
    assert wordlists.read_word_list(spark, str(tmp_path / "none.txt")).count() == 0
    assert wordlists.write_word_list(listed, str(tmp_path / "out")) == 3
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == sorted({"伝記", "伝記--人名", "*x"})


def test_list_as_code(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("楽",)], "word string")
    assert [r.code for r in wordlists.list_as_code(df, "STRONG_KEYWORDS").collect()] == ['STRONG_KEYWORDS = ["a",\n    "b",\n    "楽"]']
    pages = wordlists.list_as_code(df, "X", 2).orderBy("page").collect()
    assert [r.code for r in pages] == ['X = ["a",\n    "b"]', 'X += ["楽"]']
    names: dict = {}
    exec("\n".join(r.code for r in pages), names)
    assert names["X"] == ["a", "b", "楽"]


def test_samples(spark, tmp_path, rows):
    df = spark.createDataFrame([(2, "曲譜", ["t1", "t2"]), (3, "平曲譜", ["t1"]), (2, "琴譜", [])], "n int, word string, samples array<string>")
    samples.write_samples(df, str(tmp_path / "s"))
    assert rows(samples.read_samples(spark, str(tmp_path / "s"))) == rows(df)
    flat = put(tmp_path / "flat.json", '{\n "曲譜": ["t1"],\n "x": []\n}')
    assert rows(samples.read_samples(spark, flat, flat=True)) == [("x", []), ("曲譜", ["t1"])]


def test_saved_bindings(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    for i in range(2):
        terms = [{"s": {"type": "uri", "value": f"s{i}"}, "p": {"value": "p"}, "o": {"value": f"o{j}"}} for j in range(2)]
        put(folder / f"{i}.json", json.dumps({"head": {}, "results": {"bindings": terms}}, indent=1))
    got = triples.numbered_triples(triples.read_bindings(spark, str(folder))).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [("s0", "p", "o0", 1), ("s0", "p", "o1", 2), ("s1", "p", "o0", 3), ("s1", "p", "o1", 4)]


def test_streaming_split_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.jsonl", LINES)
    lines = streaming.stream_lines(spark, str(folder))
    out = str(tmp_path / "out")
    query = streaming.write_split(streaming.stream_split(lines, ["系譜"], ["曲譜"]), out, str(tmp_path / "ck"))
    query.awaitTermination()
    put(folder / "b.jsonl", '{"rdfs:label":"other"}\n')
    lines = streaming.stream_lines(spark, str(folder))
    streaming.write_split(streaming.stream_split(lines, ["系譜"], ["曲譜"]), out, str(tmp_path / "ck")).awaitTermination()
    got = {(r.verdict, r.reason) for r in spark.read.parquet(out).collect()}
    assert got == {("ng", "NG: 系譜"), ("ok", "OK: 曲譜"), ("gray", None)}
