import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fumikura.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] > 0.97 and held[1] > 200
    assert found.where("score < 0 or score > 1 or score is null").isEmpty()


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([("a", "abab abba baab"), ("a", "bab"), ("b", "caca ccc abc"), ("b", "é")], "lang string, text string")
    return langid.train(rows)


def counts_of(texts):
    """Followers of every context of up to ORDER bytes."""
    seen = {}
    for text in texts:
        raw = text.encode()
        for i, byte in enumerate(raw):
            for k in range(min(i, langid.ORDER) + 1):
                follow = seen.setdefault(raw[i - k:i], {})
                follow[byte] = follow.get(byte, 0) + 1
    return seen


def chances(seen, context):
    """PPM by the book: every byte's chance after a context."""
    p = np.full(256, 1 / 256)
    for k in range(len(context) + 1):
        follow = seen.get(context[len(context) - k:])
        if not follow:
            continue
        total, kinds = sum(follow.values()), len(follow)
        rest = sum(p[b] for b in range(256) if b not in follow)
        p = np.array([follow[b] / (total + kinds) if b in follow else p[b] / rest * kinds / (total + kinds) for b in range(256)])
    return p


@pytest.mark.parametrize("text", ["a", "abba", "cab cc", "zzé a\n", "ébaab", "", "c" * 50])
def test_code_lengths_by_the_book(model, text):
    raw = text.encode()
    got = model.lengths(np.frombuffer(raw, np.uint8), np.array([len(raw)]))[0]
    for column, texts in enumerate((["abab abba baab", "bab"], ["caca ccc abc", "é"])):
        seen = counts_of(texts)
        # A context with a byte that no language knows begins after that byte.
        known = {b for t in ("abab abba baab", "bab", "caca ccc abc", "é") for b in t.encode()}
        want = 0.0
        for i, byte in enumerate(raw):
            context = raw[max(0, i - langid.ORDER):i]
            while any(b not in known for b in context):
                context = context[1:]
            want -= math.log2(chances(seen, context)[byte])
        assert got[column] == pytest.approx(want, rel=1e-4)


def test_no_context_is_dropped():
    # 30 languages and some 150 kinds of bytes: a dense table of 6 million cells had room for 1,300 contexts.
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in [*range(32, 127), *range(0xC0, 0x100), *range(0x400, 0x420)]]
    texts = ["".join(rng.choice(rng.permutation(letters)[:40], 3000)) for _ in range(30)]
    lang, runs, times = [], [], []
    for i, text in enumerate(texts):
        code = [256] * langid.ORDER + list(text.encode())
        seen = {}
        for at in range(langid.ORDER, len(code)):
            run = 0
            for digit in code[at - langid.ORDER:at + 1]:
                run = run * 257 + digit
            seen[run] = seen.get(run, 0) + 1
        lang += [i] * len(seen)
        runs += seen
        times += seen.values()
    many = langid.Model([f"l{i:02}" for i in range(30)], np.array(lang), np.array(runs), np.array(times, float))
    known = {b for t in texts for b in t.encode()}
    for i in (0, 7, 29):
        raw = (texts[i][500:540] + texts[i - 1][:20]).encode()
        got = many.lengths(np.frombuffer(raw, np.uint8), np.array([len(raw)]))[0]
        assert set(raw) <= known and got.argmin() == i
        for column in (i, i - 1):
            seen = counts_of([texts[column]])
            want = -sum(math.log2(chances(seen, raw[max(0, k - langid.ORDER):k])[byte]) for k, byte in enumerate(raw))
            assert got[column] == pytest.approx(want, rel=1e-4)


def test_pieces_agree(model, monkeypatch):
    texts = ["abab" * 9, "", "c", "cab" * 40, "zz"]
    raws = [t.encode() for t in texts]
    data, sizes = np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws])
    whole = model.lengths(data, sizes)
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert np.allclose(model.lengths(data, sizes), whole)


def test_edges(edge_docs, no_docs, rows):
    found = langid.identify(edge_docs)
    got = {(r.doc_id, r.lang_pred, r.score == 0) for r in found.collect()}
    assert found.count() == edge_docs.count()
    assert {(1, "und", True), (2, "und", True), (3, "und", True), (6, "und", True)} <= got
    kept = langid.keep_known(edge_docs)
    assert kept.columns == edge_docs.columns and kept.where("score = 'x' and _row = 4").count() == 5
    assert langid.identify(no_docs).count() == 0 and langid.keep_known(no_docs).count() == 0
