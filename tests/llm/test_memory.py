"""What a Python worker keeps between tasks, and what one batch brings."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fumikura.llm import bpe, bytewords, decontam, jaccard, langid, rows
from fumikura.llm.queries import vocabulary

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _task(make):
    """A lean task of one batch that asks for what ``make`` gives."""

    def run(batches):
        for batch in batches:
            make()
            yield batch

    return list(rows.lean(run)(iter([pa.RecordBatch.from_pydict({"x": [1]})])))


def test_a_worker_drops_what_later_tasks_do_not_ask_for():
    words = [("1", [b"a", b"b"])]
    _task(lambda: decontam._built("one", 10, words))
    kept = decontam._BUILT["one"]
    _task(lambda: decontam._built("one", 10, words))
    assert decontam._BUILT["one"] is kept  # tasks of one pass share it
    _task(lambda: bpe.codec(vocabulary()))
    assert not decontam._BUILT and list(bpe._CODECS) == [vocabulary()]
    kept = bpe.codec(vocabulary())
    _task(lambda: bpe.codec(vocabulary()))
    assert bpe.codec(vocabulary()) is kept
    _task(lambda: None)
    assert not bpe._CODECS


def test_a_task_keeps_all_that_it_asks_for():
    def both():
        decontam._built("two", 10, [("1", [b"a"])])
        bpe.codec(vocabulary())
        assert decontam._BUILT and bpe._CODECS

    _task(both)
    assert decontam._BUILT and bpe._CODECS
    decontam._BUILT.clear()


def test_tables_that_stay_in_a_worker_are_small():
    assert bytewords._UP.nbytes + bytewords._DOWN.nbytes <= 1 << 20


@pytest.mark.parametrize("stage", ["languages", "copies", "passages", "codes"])
def test_batches_of_the_pipeline_are_small(spark, stage):
    docs = spark.createDataFrame([(1, "some words of a text", "en")], "doc_id bigint, text string, lang string")
    bench = spark.createDataFrame([(1, "an item")], "item_id bigint, text string")
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "64m")
        {
            "languages": lambda: langid.keep_known(docs),
            "copies": lambda: jaccard.keep_one(docs),
            "passages": lambda: decontam.decontaminate(docs, bench),
            "codes": lambda: bpe.encode_documents(docs, vocabulary()),
        }[stage]()
        assert int(spark.conf.get(BATCH)) <= 2 << 20
    finally:
        spark.conf.set(BATCH, before)


def test_word_hashes_do_not_depend_on_where_sums_begin(monkeypatch):
    texts = pa.array(["x" * 200_000 + " " + "Yy zz\t" * 30_000, None, "", "q w", "é" * 70_000])
    small = [(i, words.tolist()) for i, words in bytewords.document_words(texts)]
    for step in (1 << 10, 1 << 20):
        monkeypatch.setattr(bytewords, "_STEP", step)
        monkeypatch.setattr(bytewords, "PIECE", step)
        monkeypatch.setattr(bytewords, "_UP", bytewords._powers(bytewords._RADIX, step))
        monkeypatch.setattr(bytewords, "_DOWN", bytewords._powers(bytewords._BACK, step))
        assert [(i, words.tolist()) for i, words in bytewords.document_words(texts)] == small


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_repeated_grams_of_a_block(monkeypatch, block):
    """Counts of two and more, by counting; one, none and all alike among them."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcd"), n)) for n in (0, 1, 2, 3, 30, 300)] + ["a b c", "a b c", None, "z"]
    got = list(jaccard._count_blocks(3)(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts)})])))
    sets = [bytewords.shingles(words, 3).tolist() for _, words in bytewords.document_words(pa.array(texts))]
    want, held = [], []
    for own in sets:
        held += own
        if len(held) >= block:
            want, held = [*want, held], []
    want += [held] if held else []
    assert [dict(zip(b["h"].to_numpy().view(np.uint64).tolist(), b["n"].to_pylist())) for b in got] == [
        {h: n for h, n in Counter(block).items() if n > 1} for block in want
    ]
