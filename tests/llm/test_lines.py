import random
import re

from fumikura.llm import lines


def brute(pairs, least=lines.LEAST_WORDS):
    seen, out = {}, {}
    for key, text in sorted((p for p in pairs), key=lambda p: p[0]):
        at, n, gone = 0, 0, []
        for line in (text or "").split("\n"):
            words = line.lower().split()
            if words:
                n += 1
                if len(words) >= least:
                    digest = tuple(words)
                    if digest in seen:
                        first = at + len(line) - len(line.lstrip())
                        gone.append((first, first + len(line.strip()), seen[digest]))
                    else:
                        seen[digest] = key
            at += len(line) + 1
        out[key] = (n, gone)
    return out


def corpus():
    rng = random.Random(9)
    pool = [" ".join(rng.choices("ab cd ef gh ij kl".split(), k=rng.choice([1, 3, 6, 8]))) for _ in range(40)]
    out = []
    for i in range(80):
        own = [rng.choice(pool) if rng.random() < 0.4 else f"line {i} {j} of its own words" for j in range(rng.randrange(6))]
        out.append((i, "\n".join(x.upper() if rng.random() < 0.2 else x.replace(" ", "  ") if rng.random() < 0.2 else x for x in own)))
    return out + [(100, None), (101, ""), (102, "\n\n"), (103, "é one two three four five\n  É ONE two  three four FIVE ")]


def test_against_brute_force(docs):
    pairs = corpus()
    want = brute(pairs)
    for r in lines.find_repeats(docs(pairs)).collect():
        n, gone = want[r.doc_id]
        assert r.n_units == n and r.n_removed == len(gone)
        assert [(s.start, s.end, s.kept_in) for s in r.removed] == gone


def test_texts_lose_repeats_only(docs):
    pairs = corpus()
    want, texts = brute(pairs), dict(pairs)
    for r in lines.dedup(docs(pairs)).collect():
        gone = {a for a, _, _ in want[r.doc_id][1]}
        at, kept = 0, []
        for line in (texts[r.doc_id] or "").split("\n"):
            if not line.strip() or at + len(line) - len(line.lstrip()) not in gone:
                kept.append(line)
            at += len(line) + 1
        if not gone:
            assert r.text == texts[r.doc_id]
        else:
            assert r.text == "\n".join(kept) and r.n_chars == len(r.text)


def test_paragraphs(docs):
    got = {r.doc_id: r.text for r in lines.dedup(docs(["one two three\nfour five six\n\nseven eight nine ten", "x\n \nOne two three four five six\n\n\ny"]), "paragraph").collect()}
    assert got == {0: "one two three\nfour five six\n\nseven eight nine ten", 1: "x\n \ny"}


def test_passage_inside_lines(docs):
    passage = "The first part of it stands here. The second part of it follows now! And a third one, quite long, ends it."
    texts = [f"some words {passage} more words", f"{passage} Other text follows.", f"Before that. {passage}\nSecond line."]
    got = {r.doc_id: r for r in lines.dedup(docs(texts), "sentence").collect()}
    assert got[0].text == texts[0] and got[1].text == "The first part of it stands here. Other text follows."
    assert got[2].text == "Before that. Second line." and [u.kept_in for u in got[2].removed_units] == [1, 0, 0]


def nested_brute(pairs, least=lines.LEAST_WORDS):
    """Sentences, lines and paragraphs by the book: spans that go, none inside another."""
    found = []
    for key, text in pairs:
        text, spans = text or "", set()
        for kind in ("sentence", "line", "paragraph"):
            for a, b in lines._cut(text, re.compile(lines.UNITS[kind])):
                piece = text[a:b]
                if piece.strip():
                    spans.add((a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())))
        found += [(key, a, b, tuple(text[a:b].lower().split())) for a, b in spans]
    first, out = {}, {key: [] for key, _ in pairs}
    for key, a, b, words in sorted(found):
        if len(words) >= least and first.setdefault(words, (key, a)) != (key, a):
            out[key].append((a, b, first[words][0]))
    return {key: sorted(x for x in gone if not any(y[0] <= x[0] and x[1] <= y[1] and x[:2] != y[:2] for y in gone)) for key, gone in out.items()}


def test_line_of_short_sentences(docs):
    verse = " ".join(f"Oh come now {i}. And go!" for i in range(20))
    texts = [f"Mine is this first line.\n{verse}\nIt ends.", f"{verse.upper()}\nAnother line of text altogether, longer."]
    for unit, gone in (("sentence", 0), ("line", 1), ("nested", 1)):
        got = {r.doc_id: r for r in lines.find_repeats(docs(texts), unit).collect()}
        assert (got[0].n_removed, got[1].n_removed) == (0, gone)
    assert got[1].removed_words == len(verse.split()) and [(s.start, s.end, s.kept_in) for s in got[1].removed] == [(0, len(verse), 0)]
    assert got[1].n_units == 41
    kept = {r.doc_id: r.text for r in lines.dedup(docs(texts), "nested").collect()}
    assert kept == {0: texts[0], 1: "Another line of text altogether, longer."}


def test_nested_against_brute_force(docs):
    rng = random.Random(4)
    said = [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.choice([1, 2, 3, 6, 9]))) + rng.choice([".", "!", ""]) for _ in range(25)]
    line = [" ".join(rng.choices(said, k=rng.choice([1, 2, 4]))) for _ in range(25)]
    block = ["\n".join(rng.choices(line, k=rng.choice([1, 2, 3]))) for _ in range(15)]
    pairs = [(i, rng.choice(["\n\n", "\n \n\n", "\n"]).join(rng.choices(block + line, k=rng.randrange(5)))) for i in range(60)] + [(90, None), (91, " \n")]
    want, texts = nested_brute(pairs), dict(pairs)
    for r in lines.find_repeats(docs(pairs), "nested").collect():
        assert [(s.start, s.end, s.kept_in) for s in r.removed] == want[r.doc_id]
        assert r.removed_words == sum(len(texts[r.doc_id][a:b].split()) for a, b, _ in want[r.doc_id])
    for r in lines.dedup(docs(pairs), "nested").collect():
        text = texts[r.doc_id] or ""
        rest = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b, _ in want[r.doc_id]))
        assert (r.text or "").split() == rest.split()


def test_edges(edge_docs, no_docs):
    found = lines.find_repeats(edge_docs)
    assert found.count() == edge_docs.count() and found.where("n_removed > 0").count() == 0
    # The row without a rank comes last, so the unit goes there and stays in both rows of document 5.
    assert [r.doc_id for r in lines.find_repeats(edge_docs, least_words=5).where("n_removed > 0").collect()] == [None]
    kept = lines.dedup(edge_docs)
    assert kept.columns == [*edge_docs.columns, "removed_units"] and kept.count() == edge_docs.count()
    assert lines.dedup(no_docs).count() == 0


def test_ids_of_any_type(spark):
    long = "one two three four five six seven"
    frame = spark.createDataFrame([("b", long), ("a", f"{long}\nshort"), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: r.removed for r in lines.find_repeats(frame).collect()}
    assert got["a"] == [] and got["c"] == [] and [(x.start, x.kept_in) for x in got["b"]] == [(0, "a")]
