import random

import pytest

from fumikura.llm import jaccard
from fumikura.llm.components import components


def sets_of(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def brute(pairs, size, percent):
    """component_id per row, and links between different sets."""
    sets = [sets_of(t, size) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
                if a != b:
                    links.add(frozenset([a, b]))
    least = {}
    for i, (key, _) in enumerate(pairs):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(pairs)], links


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of"] * 60
    out = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 40, 120]))
        for _ in range(rng.choice([1, 1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy) + rng.choice(["", " ", "\n"]))
    out += ["", None, " \t\x0b", "a b", "A  b", "a c"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 90), (2, 5, 80), (3, 2, 50), (4, 3, 100)])
def test_components_against_brute_force(docs, seed, size, percent):
    pairs = corpus(seed)
    members, _ = jaccard.similarity_join(docs(pairs), size, percent)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in members.collect())
    want, links = brute(pairs, size, percent)
    assert got == sorted(want)
    assert jaccard.every_link(docs(pairs), size, percent).count() == len(links)


def test_chain_of_near_copies_is_one_component(docs):
    words = [f"v{i}" for i in range(200)]
    chain = []
    for i in range(30):
        words = words[:5 * i % 200] + [f"n{i}"] + words[5 * i % 200 + 1:]
        chain.append((i, " ".join(words)))
    members, _ = jaccard.similarity_join(docs(chain), 3, 90)
    assert {r.component_id for r in members.collect()} == {r[2] for r in brute(chain, 3, 90)[0]}


def test_components_of_a_graph(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(x, find(x)) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_edges(edge_docs, no_docs):
    members, _ = jaccard.similarity_join(edge_docs, 3, 90)
    got = sorted(((r.doc_id, r.n_shingles > 0, r.component_id) for r in members.collect()), key=repr)
    assert got == sorted([(1, False, 1), (2, False, 2), (3, False, 3), (4, True, 4), (5, True, 5), (5, True, 5), (None, True, 5), (6, True, 6), (7, True, 7)], key=repr)
    kept = jaccard.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7] and kept.where("class = 2 and _text = 1").count() == 7
    assert jaccard.similarity_join(no_docs)[0].count() == 0 and jaccard.keep_one(no_docs).count() == 0
