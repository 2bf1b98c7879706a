import re

import pytest
from pyspark.sql import functions as F

from fumikura import settings
from fumikura.functions import replies, titles as t, uris, words as w
from fumikura.operators import match
from fumikura.sources.records import parse_records


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expr(F.col("v")).alias("x")).first().x


def rec(spark, *raw):
    return parse_records(spark.createDataFrame([(r,) for r in raw], "raw string"))


@pytest.mark.parametrize(
    "raw, plain, listed",
    [
        ('{"rdfs:label":"楽譜"}', "楽譜", "楽譜"),
        ('{"rdfs:label":"","schema:name":"名"}', "名", "名"),
        ('{"rdfs:label":null,"schema:name":"名"}', "名", "名"),
        ('{"schema:name":"名"}', "名", "名"),
        ('{"rdfs:label":["あ","い"],"schema:name":"名"}', '["あ","い"]', "あ"),
        ('{"rdfs:label":[],"schema:name":"名"}', "名", "名"),
        ('{"rdfs:label":{},"schema:name":["名"]}', '["名"]', "名"),
        ('{"rdfs:label":["",""],"schema:name":"名"}', '["",""]', ""),
        ('{"rdfs:label":0,"schema:name":7}', "7", "7"),
        ('{"rdfs:label":"0"}', "0", "0"),
        ('{"rdfs:label":true}', "True", "True"),
        ('{"rdfs:label":false}', "", ""),
        ('{"a":1}', "", ""),
    ],
)
def test_title(spark, raw, plain, listed):
    row = rec(spark, raw).select(t.title("rec").alias("p"), t.title_of_list("rec").alias("l")).first()
    assert (row.p, row.l) == (plain, listed)


def test_title_default_and_first_filled(spark):
    assert rec(spark, '{"a":1}').select(t.title("rec", default="No Title").alias("x")).first().x == "No Title"
    df = spark.createDataFrame([("", "b"), (None, None)], "l string, n string")
    assert [r.x for r in df.select(t.first_filled("l", "n", default="-").alias("x")).collect()] == ["b", "-"]


def test_id_takes_first_present_key(spark):
    found = rec(
        spark,
        '{"uri":"u","@id":"a"}',
        '{"id":"","@id":"a"}',
        '{"url":"x"}',
        '{"id":null,"url":"x"}',
        '{"z":1}',
    ).select(t.record_id("rec").alias("x"))
    assert [r.x for r in found.collect()] == ["a", "", "x", None, None]


def test_search_text(spark):
    body = lambda raw: rec(spark, raw).select(t.search_text("rec", t.title("rec")).alias("x")).first().x
    assert body('{"rdfs:label":"a","schema:about":["u","v"]}') == 'a ||| ["u","v"]'
    assert body('{"rdfs:label":"a","schema:about":"楽譜"}') == 'a ||| "楽譜"'
    assert body('{"rdfs:label":"a"}') == "a ||| "
    assert body('{"rdfs:label":"a","schema:about":[]}') == "a ||| "


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ('{"schema:about":"https://jpsearch.go.jp/term/keyword/楽譜"}', True),
        ('{"schema:about":["https://jpsearch.go.jp/term/keyword/楽譜"]}', False),
        ('{"schema:about":{"@id":"https://jpsearch.go.jp/term/keyword/楽譜"}}', False),
        ('{"schema:description":"これは楽譜です"}', True),
        ('{"schema:description":["x",3,"楽譜"]}', True),
        ('{"schema:description":[["楽譜"]]}', False),
        ('{"schema:description":{"a":"楽譜"}}', False),
        ('{"rdfs:label":"楽譜"}', False),
    ],
)
def test_class(spark, raw, wanted):
    assert rec(spark, raw).select(t.in_class("rec").alias("x")).first().x is wanted


def test_strip_takes_ideographic_blank(spark):
    assert one(spark, "　 a　b \t", w.strip) == "a　b"


def brute_ngrams(text, n):
    text = re.sub(settings.GRAM_SYMBOLS, "", text)
    return [text[i:i + n] for i in range(len(text) - n + 1)] if len(text) >= n else []


@pytest.mark.parametrize("text", ["", "a", "ab", "()「」", "𠮷野家の𠮷", "a b（c）d・e、f", "x" * 64, "xyz" * 43, "ab\ncd"])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_ngrams(spark, text, n):
    assert one(spark, text, lambda c: w.ngrams(w.drop_symbols(c), n)) == brute_ngrams(text, n)


def test_compounds(spark):
    assert one(spark, "平曲譜・琴譜 譜面ノート譜x", w.compounds) == ["平曲譜", "琴譜", "譜面ノート譜"]
    assert one(spark, "楽譜系譜", w.compounds) == ["楽譜系譜"]


def test_pack_and_unpack(spark):
    df = spark.createDataFrame([("曲譜", 186), ("a (b)", 3), ("x (1) (2)", 44)], "w string, c bigint")
    cell = w.pack("w", "c")
    got = df.select("w", "c", w.packed_word(cell).alias("w2"), w.packed_count(cell).alias("c2"), w.candidate_word(cell).alias("cand"))
    assert [(r.w2, r.c2) for r in got.collect()] == [(r.w, r.c) for r in got.collect()]
    assert [r.cand for r in got.collect()] == ["曲譜", "a", "x"]
    for cell in ("plain", "", None, "a(3)"):
        assert one(spark, cell, w.packed_word) is None
    assert one(spark, "語 (１２) rest", w.packed_word) == "語"


def test_labels_and_links(spark):
    assert one(spark, "あ" * 16, w.short_label) == "あ" * 15 + ".."
    assert one(spark, "あ" * 15, w.short_label) == "あ" * 15
    uri = "https://example.org/term/keyword/abcdefghijk"
    assert one(spark, uri, w.short_uri_label) == "..." + uri[-25:]
    assert one(spark, "x" * 40, w.short_uri_label) == "x" * 40
    assert one(spark, "http://a", w.lookup_link) == "http://a"
    from urllib.parse import quote

    for word in ("楽譜", "a b/c~d*e", "100%+1"):
        assert one(spark, word, w.lookup_link) == settings.SEARCH_URL + quote(f"{word} とは")


def test_comma_words(spark):
    assert one(spark, " 楽譜, ,音楽　,,score ", w.comma_words) == ["楽譜", "音楽", "score"]


def test_percent_of_the_stored_field_table(spark):
    counts = {17908: "100.0%", 16593: "92.7%", 8630: "48.2%", 8033: "44.9%", 61: "0.3%", 8: "0.0%", 1683: "9.4%"}
    df = spark.createDataFrame([(c,) for c in counts], "c bigint")
    assert {r.c: r.p for r in df.select("c", w.percent("c", F.lit(17908)).alias("p")).collect()} == counts


def test_shorten_uri(spark):
    short = lambda u: one(spark, u, uris.shorten)
    assert short("http://schema.org/name") == "schema:name"
    assert short("https://jpsearch.go.jp/term/property#sourceInfo") == "https://jpsearch.go.jp/term/property#sourceInfo"
    assert short("http://schema.org/a?u=http://schema.org/b") == "schema:a?u=schema:b"
    assert short("urn:x") == "urn:x"


def test_subnode(spark):
    test = lambda o, r, b=None: one(spark, o, lambda c: uris.is_subnode(c, F.lit(r), b), "string")
    assert test("_:b1", "http://x1") and test("http://x1#a", "http://x1") and test("http://x10", "http://x1")
    assert not test("http://y", "http://x1")
    assert not test("http://x10", "http://x1", "[#/]")
    assert test("http://x1/a", "http://x1", "[#/]") and test("http://x1", "http://x1", "[#/]")


def test_prompt_keeps_braces_of_values(spark):
    df = spark.createDataFrame([("{label}", "L", None)], "t string, l string, d string")
    text = df.select(replies.prompt(F.col("t"), F.col("l"), F.col("d"), "T={title} L={label} D={description}.").alias("x"))
    assert text.first().x == "T={label} L=L D=."


def test_annotate(spark):
    df = spark.createDataFrame([('{"a": 1}', "楽"), ("{ }", "x"), ('{"b":"}"} ', None)], "raw string, r string")
    got = [x.j for x in df.select(match.annotate("raw", _removed_reason=F.col("r")).alias("j")).collect()]
    assert got == ['{"a": 1, "_removed_reason":"楽"}', '{ "_removed_reason":"x"}', '{"b":"}"}']
