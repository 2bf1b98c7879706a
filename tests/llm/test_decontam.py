import random
import re

import pytest

from fumikura.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        own = words(item)
        size = min(window, len(own))
        runs = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in runs:
                hit.update(range(i, i + size))
                found.update([] if name is None else [str(name)])
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def cases(spark, docs):
    rng = random.Random(6)
    vocabulary = "a b c d e f g h".split()
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(1, 40)]
    items = [x for x in items if len(x[1].split()) != 1] + [(50, "Zeta-zeta. ZETA"), (51, None), (None, "q q q"), (52, "..."), (53, "éa b")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 40, 150]))) for _ in range(50)]
    for _ in range(40):
        own = [x[1] or "" for x in rng.sample(items, 2)]
        texts.append("x y. " + own[0].upper() + " - z " + own[1] + "\nend")
    texts += [None, "", "zeta zeta zeta zeta zeta"]
    return items, texts, spark.createDataFrame(items, "item_id bigint, text string"), docs(texts)


def test_against_brute_force(cases):
    items, texts, bench, frame = cases
    for r in decontam.find_overlap(frame, bench).collect():
        n, hit, found = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items) == (n, hit, len(found), found), texts[r.doc_id]


def test_many_blocks_give_the_same(cases, monkeypatch):
    items, texts, bench, frame = cases
    frame = frame.unionByName(frame.where("doc_id < 3"))  # repeated rows
    every = lambda: [sorted(map(tuple, x.collect()), key=repr) for x in (decontam.find_overlap(frame, bench), decontam.decontaminate(frame, bench))]
    one = every()
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 80)
    assert len(list(decontam._blocks(bench))) >= 5 and every() == one


def test_an_automaton_is_built_once_a_pass(cases, spark, tmp_path, monkeypatch):
    """With several blocks a worker builds each of them once, not once per batch."""
    items, texts, bench, frame = cases
    log, build = tmp_path / "built", decontam.Automaton

    def counted(block, window):
        with open(log, "a") as file:
            file.write("x")
        return build(block, window)

    names = [f"b{i}" for i in range(5)]
    monkeypatch.setattr(decontam, "Automaton", counted)
    for name in names:
        for _ in range(20):  # batches of a pass
            decontam._built(name, 10, [("1", [b"a", b"b"])])
    assert log.read_text() == "x" * 5
    decontam._BUILT.clear()


def test_spans_are_cut(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    long = "keep " * 40
    frame = docs([long + "One, two three four five six seven eight nine ten! and " + long, item, "clean", None])
    got = {r.doc_id: r for r in decontam.decontaminate(frame, bench).collect()}
    assert set(got) == {0, 2, 3}  # the second is nothing but an item
    assert got[0].text == long + "! and " + long and got[0].n_chars == len(got[0].text)
    assert got[2].text == "clean" and got[3].text is None


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "hello small world")], "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.find_overlap(edge_docs, bench).where("n_hit = 3").count() == 3
    assert decontam.find_overlap(edge_docs, none).where("n_hit > 0").isEmpty()
    kept = decontam.decontaminate(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3
    assert decontam.decontaminate(edge_docs, none).count() == edge_docs.count()
    assert decontam.decontaminate(no_docs, bench).count() == 0
