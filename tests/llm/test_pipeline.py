import random
import re
from hashlib import sha256

import public_tokenizers
from test_decontam import WORD, words
from test_jaccard import brute as groups_of
from test_secrets import ASSIGN
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import DOCS

SF = "/root/testdata/sf0.001"


def cut(text, items, window=10):
    """Text without item windows, and the share of words that were hit."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.lower())]
    w, hit = words(text), set()
    for item in items:
        own = words(item)
        size = min(window, len(own))
        runs = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in runs:
                hit.update(range(i, i + size))
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(raw[at:places[i][0]])
        if i + 1 not in hit:
            at = places[i][1]
    return b"".join([*out, raw[at:]]).decode(), len(hit) / max(1, len(w))


def redacted(text):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text)]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def brute(docs, items):
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    docs = sorted(docs, key=lambda d: d[0])
    rows, _ = groups_of(docs, 5, 80)
    root = dict((key, component) for key, _, component in rows)
    out = {}
    for i, text in docs:
        if root[i] != i:
            continue
        text, share = cut(text, items)
        if share <= corpus_pipeline.COVERAGE:
            out[i] = redacted(text)
    return out


def check(got, want):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        ids = library.encode(want[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids), r.doc_id
        assert r.decoded_sha256 == sha256(want[r.doc_id].encode()).hexdigest()


def test_whole_pipeline_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    check(corpus_pipeline.run(spark, SF).collect(), brute(docs, items))


def test_planted_cases(spark, tmp_path):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("river stone cloud winter garden letter market yellow silent bridge".split()) + str(rng.randrange(40)) for _ in range(n)) + "."
    item = prose(30)
    first = prose(120)
    near = first.replace(" ", "  ", 3).split()
    near[60] = "changed"
    texts = {
        1: first, 2: first, 3: " ".join(near), 4: prose(80), 5: prose(60) + " " + item + " " + prose(60), 6: item,
        7: "key password=hunter2hunter2 " + prose(40), 8: "123 456", 9: "", 10: prose(6), 11: "<|endoftext|> " + prose(9),
    }
    folder = str(tmp_path)
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    want = brute(list(texts.items()), [item])
    assert set(want) == {1, 4, 5, 7, 10, 11} and item.split()[5] not in want[5].split()[55:70]
    check(corpus_pipeline.run(spark, folder).collect(), want)


def test_stages_keep_the_columns_and_survive_edges(spark, edge_docs, no_docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "no such words anywhere")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (edge_docs, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns, name
        assert sorted(r.doc_id for r in now.collect()) == ([4, 5, 7] if docs is edge_docs else [])
