import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fumikura.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SUMS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def spans(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        yield [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids]
        found = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            found.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        yield found

    return spans


def brute(rows, spans):
    """One link after the other, from the definition."""
    out, links, pairs = [], [], Counter()
    for doc, text in rows:
        mine, row = [], [doc, 0, 0, 0, 0, 0, 0, ""]
        if text:
            sides = []
            for tokens in spans(text):
                at, places = 0, []
                for i, word in tokens:
                    places.append((at, at + len(word), i))
                    at += len(word)
                sides.append((places, b"".join(w for _, w in tokens)))
            (a, one), (b, two) = sides
            if one == two == (" " + text).encode():
                mine = [(i, j) for s, e, i in a for t, u, j in b if s < u and t < e] if len(a) < 3000 else None
                cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
                spelled, x, y = [], 0, 0
                for cut in cuts:
                    p, q = x, y
                    while x < len(a) and a[x][1] <= cut:
                        x += 1
                    while y < len(b) and b[y][1] <= cut:
                        y += 1
                    spelled.append(",".join(str(t[2]) for t in a[p:x]) + "|" + ",".join(str(t[2]) for t in b[q:y]))
                    if mine is None or len(a) >= 3000:
                        mine = [*(mine or []), *[(i, j) for s, e, i in a[p:x] for t, u, j in b[q:y] if s < u and t < e]]
                row[1:5] = len(a), len(b), len(cuts), len(mine)
                row[7] = sha256(";".join(spelled).encode()).hexdigest()
        pairs.update(mine)
        out.append(row)
        links.append(mine)
    most = defaultdict(int)
    for (_, j), n in pairs.items():
        most[j] = max(most[j], n)
    for row, mine in zip(out, links):
        row[5] = sum(pairs[i, j] == most[j] for i, j in mine)
        row[6] = sum(pairs[i, j] for i, j in mine)
    return sorted(map(tuple, out), key=repr), pairs


TEXTS = [
    None, "", " ", "a", "  two  spaces\n\nand\ttabs ", "été à la mer ÿÿ", "漢字とかな交じり文", "emoji 🙂🙂 and ▁ mark", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "zero\0byte", "don't we'll 12345 %$#!!", "é combining",
    "Hello small world of words.", "Hello small world of words.", " no break", "﻿mark", "x" * 300,
]


@pytest.mark.parametrize("links", [4_000_000, 50])
def test_brute_force(docs, encoders, monkeypatch, links):
    monkeypatch.setattr(alignment, "LINKS", links)
    rng = random.Random(5)
    rows = [(i % 20, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(["straight", "Wörter", "l'été", "qu", "12", ",", "ing"]) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    want, pairs = brute(rows, encoders)
    frame = docs(rows)
    got = alignment.align(frame, A, B)
    assert got.columns == SUMS
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(frame, A, B).collect()} == pairs
    spelled = alignment.align(frame, A, B, groups=True).collect()
    assert all(r.groups_sha256 == (sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in spelled)


def test_long_texts_in_pieces(docs, encoders, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 40)
    rng = random.Random(6)
    long = " ".join(rng.choice(["Straße", "don't", "a", "b  c", "\n\n", "12 3", "x y", "end. New", "it's"]) for _ in range(3_000))
    rows = [(1, long), (2, "q" * 5_000), (3, long[:200] + "▁" + long[:200]), (4, "short one"), (5, "漢" * 500)]
    want, _ = brute(rows, encoders)
    assert sorted(map(tuple, alignment.align(docs(rows), A, B).collect()), key=repr) == want


def test_edges(edge_docs, no_docs, spark, encoders):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    want, _ = brute([r for r in rows if r[0] != 4], encoders)
    got = sorted(map(tuple, alignment.align(edge_docs, A, B).where("doc_id <> 4 or doc_id is null").select(SUMS[:5]).collect()), key=repr)
    assert got == [w[:5] for w in want]
    assert alignment.align(no_docs, A, B).count() == 0 and alignment.pair_counts(no_docs, A, B).count() == 0
    empty = alignment.align(edge_docs.where(F.col("text").isNull()), A, B, keep=("doc_id", "score", "_row"))
    assert [tuple(r) for r in empty.collect()] == [(1, "x", 4, 0, 0, 0, 0, 0, 0, "")]


def test_spaces_at_which_texts_are_cut(encoders):
    """Both tokenizers begin anew at a space between any two visible ASCII characters."""
    signs = [chr(i) for i in range(0x21, 0x7F)]
    for x in signs:
        text = " ".join(f"e{x} {y}s" for y in signs)
        parts = alignment._CUT.split(text)
        assert " ".join(parts) == text and len(parts) == 2 * len(signs)
        apart = [list(encoders(p)) for p in parts]
        for side, tokens in enumerate(encoders(text)):
            assert tokens == [t for found in apart for t in found[side]]


@pytest.mark.parametrize("remembered", [300_000, 30])
def test_words_are_encoded_once(docs, encoders, spark, monkeypatch, remembered):
    """Words that texts repeat, some of which tokenizers do not give back, and which a worker forgets in between."""
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    monkeypatch.setattr(alignment, "_TOGETHER", 60)
    rng = random.Random(7)
    words = [*(f"word{i}" for i in range(40)), "ﬁne", "①st", "don't", "l'été,", "été", "a b", "x  y", "<s>", "▁", "és", "…", "(see", "it's).", "12", "$5", "I"]
    rows = [(i, " ".join(rng.choice(words[:40] if i % 3 else words) for _ in range(rng.randint(1, 60)))) for i in range(90)]
    want, _ = brute(rows, encoders)
    assert len({w[1] > 0 for w in want}) == 2
    assert sorted(map(tuple, alignment.align(docs(rows), A, B).collect()), key=repr) == want

    pair, seen = alignment.Pair(A, B), []
    encoded = pair.encoded
    monkeypatch.setattr(pair, "encoded", lambda texts: seen.extend(texts) or encoded(texts))
    block = alignment._Block(pair, False)
    for _ in range(50):
        block.add("many plain words, again and again.")
        block.encode()
    assert len(seen) == 1 and [row[:2] for row in block.rows] == [block.rows[0][:2]] * 50
