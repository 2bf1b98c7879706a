import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from hypothesis import given, settings, strategies as st

from fumikura.llm import spelling


def counted(rows, least=7, times=2):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= times}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(words, ratio=10):
    """From the definition, every word against every other."""
    forms, rows = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        rows[w] = len(others)
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, rows[w], words[forms[w]] if forms[w] else None))
    return sorted(out)


def test_random_words(spark):
    rng = random.Random(4)
    words = {}
    while len(words) < 700:
        w = "".join(rng.choice("abÿÀ×") for _ in range(rng.randint(1, 7)))
        words[w] = rng.choice([2, 3, 20, 21, 200, 4000])
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert sorted(map(tuple, spelling.variants(frame, 10).collect())) == grouped(words)
    assert sorted(map(tuple, spelling.variants(frame, 2).collect())) == grouped(words, 2)


def test_long_chain_of_forms(spark):
    words = {"a" * 7 + "b" * i: 10 ** i for i in range(9)}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert all(r.root == "a" * 7 + "b" * 8 for r in got.values()) and got["a" * 7].form == "a" * 7 + "b"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=6), min_size=1, max_size=60, unique=True), st.lists(st.text("abc", max_size=6), max_size=8, unique=True))
def test_numbers_are_nodes(words, cuts):
    """Whatever the cuts: equal beginnings have equal numbers, and different ones different numbers."""
    cuts = sorted(cuts)
    by = defaultdict(list)
    for w in words:
        by[spelling.Numbering(cuts).range_of(w)].append(w)
    of_node, of_prefix = {}, {}
    ranges = list(by)
    random.Random(len(words)).shuffle(ranges)
    for r in ranges:  # each range by itself, as tasks do
        trie = spelling.Numbering(cuts)
        for w in sorted(by[r]):
            path = trie.nodes(w, r)
            assert len(path) == len(w) + 1
            for i, node in enumerate(path):
                assert of_node.setdefault(node, w[:i]) == w[:i]
                assert of_prefix.setdefault(w[:i], node) == node


def test_documents(docs):
    rng = random.Random(8)
    base = ["morgenstern", "Überfahrt", "railway", "kingdoms", "mississippi"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(80)) + ", railwei RAILWAY's kingdoom") for i in range(60)]
    words = counted(rows)
    assert sorted(map(tuple, spelling.spelling_groups(docs(rows)).collect())) == grouped(words)
    assert any(r[1] for r in grouped(words))


def test_edges(edge_docs, no_docs, docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, spelling.spelling_groups(edge_docs, least=1).collect())) == grouped(counted(rows, least=1))
    assert spelling.spelling_groups(no_docs).count() == 0
    assert spelling.spelling_groups(docs([None, "", "12"])).count() == 0
    long = "ab" * 30_000
    got = {r.word: r for r in spelling.spelling_groups(docs([f"{long} {long} {long}c {long}c"]), drop=None).collect()}
    assert {len(w) for w in got} == {60_000, 60_001} and all(r.n_near == 1 and r.form is None for r in got.values())


def test_runs_flush_and_ratio(docs, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = [(i, f"Letters{chr(97 + i)} common commons uncommonly") for i in range(20)]
    assert {r.word: r.n for r in spelling.word_counts(docs(rows + rows)).collect()} == counted(rows + rows)
    with pytest.raises(ValueError):
        spelling.variants(docs([]), 1)
