import random
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fumikura.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", "ing", " ", "\n", "é", "ß", "   ", "1", "23", "'s", "!", "ation", "x", " zz", "日本", "\t", "　", "\x1c", "\x85", "😀", " AKIA", "==", "́"]


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def texts(n, special=0.1):
    rng = random.Random(5)
    for _ in range(n):
        parts = PARTS + (["<|endoftext|>"] if rng.random() < special else [])
        yield "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4, 30, 200])))


def test_encodes_and_decodes_like_the_library(own, library):
    letters = ("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=25)) for i in range(2000))
    for text in [*texts(2000), *letters, "a" * 5000, " " * 3000, "=!" * 3000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_tokens_that_are_no_text(own, library):
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(9)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_memory_gives_the_same(own, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    text = "one two three four five six seven one two"
    small = bpe.Codec(PATH)
    assert small.encode(text) == own.encode(text) and len(small.cache) <= 3


def test_documents(edge_docs, no_docs, library):
    found = bpe.encode_documents(edge_docs, PATH)
    assert found.count() == edge_docs.count() and bpe.encode_documents(no_docs, PATH).count() == 0
    for r in edge_docs.select("doc_id", "text").join(found, "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode_documents(found, PATH)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in edge_docs.collect())


def test_counts_follow_edits(own):
    rng = random.Random(8)
    for text in texts(600):
        tree = token_counts.build(own, text)
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(1, 4))))
            edits = []
            for a, b in zip(cuts[::2], cuts[1::2]):
                edits.append((a, rng.choice([a, b, min(b, a + 2)]), "".join(rng.choices(PARTS, k=rng.choice([0, 1, 3])))))
            tree, text, _ = token_counts.update(own, tree, text, edits)
            assert tree.total == len(own.encode(text)) and tree.size == len(text)


def fine_tree(own, text):
    """A leaf for every pre-token, so every edit is at the boundary of a leaf."""
    places = list(own.spans(text))
    return token_counts.Tree([b - a for a, b in places], [own.n_tokens(text[a:b]) for a, b in places])


def test_edits_at_leaf_boundaries(own, library):
    # What a pre-token's end depends on stands up to two characters beyond it.
    text = "a" + " a" * 30 + "\n\n***\nb"
    at = text.index("***")
    tree, new, _ = token_counts.update(own, token_counts.build(own, text), text, [(at, at + 3, "")])
    assert tree.total == len(library.encode(new, add_special_tokens=False).ids) == 34
    for text, edit in (("it'rx", (4, 5, "e")), ("it'vx", (4, 5, "e")), ("it'lx", (4, 5, "l")), ("a\n\n*b", (3, 4, "")), ("a  b", (3, 4, "\n")), ("a \n *", (4, 5, ""))):
        tree, new, _ = token_counts.update(own, fine_tree(own, text), text, [edit])
        assert tree.total == len(library.encode(new, add_special_tokens=False).ids) and tree.size == len(new)
        assert tree.total == sum(own.n_tokens(new[a:b]) for a, b in own.spans(new))


def test_every_edit_of_small_texts(own):
    rng = random.Random(6)
    letters = ["a", "r", "e", "v", "l", "'", " ", "\n", "*", "1", "\t", "\u3000"]
    for _ in range(6000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 12)))
        cuts = sorted(rng.choices(range(len(text) + 1), k=rng.choice([2, 4])))
        edits = [(a, b, "".join(rng.choices(letters, k=rng.choice([0, 0, 1, 2])))) for a, b in zip(cuts[::2], cuts[1::2])]
        tree, new, _ = token_counts.update(own, fine_tree(own, text), text, edits)
        places = list(own.spans(new))
        assert tree.size == len(new) and tree.total == sum(own.n_tokens(new[a:b]) for a, b in places), (text, edits)
        # Leaves begin where pre-tokens do.
        ends, at = {0} | {b for _, b in places}, 0
        for size in tree.as_leaves()[0]:
            at += size
            assert at in ends, (text, edits)


def test_small_edit_encodes_a_small_region(own):
    text = "some plain words in a row " * 4000
    tree, new, redone = token_counts.update(own, token_counts.build(own, text), text, [(50_000, 50_004, "edit")])
    assert redone < 600 and tree.total == len(own.encode(new))


def test_large_insertions_are_counted_and_split(own):
    """A leaf never takes in more than it should, so nothing but the edited region is encoded anew."""
    text = "some plain words in a row " * 600
    tree = token_counts.build(own, text)
    for round_ in range(4):
        new = "more words come in here " * 2000
        tree, text, redone = token_counts.update(own, tree, text, [(7_000, 7_000, new)])
        assert len(new) <= redone < len(new) + 600
        assert tree.total == len(own.encode(text)) and tree.size == len(text) == sum(tree.as_leaves()[0])
        assert max(tree.as_leaves()[0]) < 600
    tree, text, redone = token_counts.update(own, tree, text, [(10, len(text) - 10, "")])
    assert redone < 600 and tree.total == len(own.encode(text)) and tree.leaves <= 3
    tree, text, _ = token_counts.update(own, tree, text, [(0, len(text), "")])
    assert (tree.total, tree.size, text) == (0, 0, "")
    tree, text, _ = token_counts.update(own, tree, text, [(0, 0, "new text")])
    assert tree.total == len(own.encode("new text"))


def test_kept_trees_take_edits_round_after_round(spark, docs, own, tmp_path):
    rng = random.Random(12)
    path = str(tmp_path / "trees0")
    token_counts.build_trees(docs([None, "", *texts(20)]), PATH).write.parquet(path)
    want = {r.doc_id: r.text for r in spark.read.parquet(path).collect()}
    for round_ in range(1, 3):
        edits = {}
        for key, text in want.items():
            n = len(text or "")
            cuts = sorted(rng.choices(range(n + 1), k=4))
            edits[key] = [(a, b, "".join(rng.choices(PARTS, k=2))) for a, b in zip(cuts[::2], cuts[1::2])]
        frame = spark.createDataFrame([(k, [dict(zip(("start", "end", "new"), e)) for e in v]) for k, v in edits.items()], "doc_id bigint, edits array<struct<start:int,end:int,new:string>>")
        done = token_counts.apply_edits(spark.read.parquet(path).join(frame, "doc_id"), "edits", PATH)
        path = str(tmp_path / f"trees{round_}")
        done.write.parquet(path)
        want = {k: token_counts.applied(t or "", edits[k]) for k, t in want.items()}
        for r in spark.read.parquet(path).collect():
            assert r.text == want[r.doc_id] and r.n_tokens == len(own.encode(r.text)) == sum(r.leaf_tokens) and sum(r.leaf_chars) == len(r.text)


def test_edited_documents(edge_docs, docs, no_docs, own):
    found = token_counts.edited_counts(edge_docs, PATH)
    assert found.count() == edge_docs.count() and found.where("doc_id in (1, 2) and n_tokens_after <> 0").isEmpty()
    mails = docs(["Write to a.b@mail.example now!! or +1 (706) 555-3138", "x&&& y%%%", "plain"])
    got = {r.doc_id: r for r in token_counts.edited_counts(mails, PATH).collect()}
    for i, new in enumerate(["Write to [mail] now! or [number]", "x y", "plain"]):
        assert got[i].n_tokens_after == len(own.encode(new))
    assert (got[0].n_edits, got[1].n_edits, got[2].n_edits, got[2].n_redone) == (3, 2, 0, 0)
    assert token_counts.edited_counts(no_docs, PATH).count() == 0
