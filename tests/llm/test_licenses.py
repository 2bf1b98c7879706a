import random
import re

from fumikura.llm.licenses import DRIFT, GRAM, NOTICES, SHARE, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "CC-BY, cc by; CC BY-NC 4.0", "cc", "by cc", "general public general public license", "All Rights\nReserved. all rights reserved all rights",
    "Kcc by", "x cc by", "ccby", "ALL RIGHTS RÉSERVED", "Licensed under the Apache License, Version 2.0.", "nothing here", "", None,
    "This program is free software: you may redistribute it and/or modify it under the terms of the GNU General Public License",
    "cc by " * 300,
]


def test_base_against_brute_force(docs):
    got = {r.doc_id: r for r in scan_licenses(docs(TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_diagonals_merge_over_changed_words(docs):
    got = {r.doc_id: r.labels for r in scan_licenses(docs(TEXTS)).collect()}
    assert got[9] == "apache-2.0"
    assert "gpl-notice" in got[13]  # one word changed
    assert got[10] == ""


def test_edges(edge_docs, no_docs):
    found = scan_licenses(edge_docs)
    assert found.count() == edge_docs.count()
    assert sorted(r.n_words for r in found.where("doc_id in (1, 2, 3)").collect()) == [0, 0, 0]
    assert [r.n_words for r in found.where("doc_id = 5").collect()] == [5, 5] and found.where("doc_id is null").count() == 1
    assert scan_licenses(no_docs).count() == 0


def brute_spans(text):
    """Label, start, end of all spans: chains of diagonals, bands of different places, the best of those that meet."""
    w = WORD.findall((text or "").translate(LOWER))
    out = [(label, i, i + len(phrase.split()), 1.0) for phrase, label in PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    for notice, label in NOTICES:
        own = notice.split()
        full = len(own) - GRAM + 1
        hits = sorted((p - q, p) for p in range(len(w) - GRAM + 1) for q in range(full) if w[p:p + GRAM] == own[q:q + GRAM])
        chains = []
        for hit in hits:
            if not chains or hit[0] - chains[-1][-1][0] > DRIFT:
                chains.append([])
            chains[-1].append(hit)
        for chain in chains:
            bands = {}
            for d in {d for d, _ in chain}:
                inside = [(x, p) for x, p in chain if d <= x <= d + full]
                found = len({p - x for x, p in inside})
                if found / full >= SHARE:
                    bands[d] = (found, min(p for _, p in inside), max(p for _, p in inside) + GRAM)
            for d, (found, start, end) in bands.items():
                if not any((other[0], -e) > (found, -d) for e, other in bands.items() if abs(d - e) <= full):
                    out.append((label, start, end, found / full))
    return sorted(out)


def test_spans_and_labels_against_brute_force(docs):
    rng = random.Random(9)
    texts = list(TEXTS)
    for _ in range(60):
        w = []
        for _ in range(rng.randint(1, 5)):
            own = rng.choice(NOTICES)[0].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):  # words put in, left out, changed
                at = rng.randrange(len(own))
                own[at:at + rng.choice([0, 1])] = rng.choice([[], ["filler"], ["other", "words"], ["a"] * 6])
            w += own + rng.choice([[], ["x"] * rng.randint(1, 9), "general public license".split() * rng.randint(1, 12)])
        texts.append(" ".join(w))
    for r in scan_licenses(docs(texts)).collect():
        want = brute_spans(texts[r.doc_id])
        assert sorted((s.label, s.start, s.end, s.score) for s in r.spans) == want, texts[r.doc_id]
        assert r.labels == ",".join(sorted({x[0] for x in want})) and r.score == max((x[3] for x in want), default=0)


def test_a_repeated_phrase_is_no_notice_and_hides_none(docs):
    phrase, notice = "general public license " * 30, NOTICES[3][0] + " "
    got = {r.doc_id: r for r in scan_licenses(docs([phrase, phrase + notice + phrase, notice * 3])).collect()}
    assert got[0].labels == "gpl" and got[0].n_base == 30
    assert got[1].labels == "gpl,gpl-3.0" and got[1].score == 1.0
    assert [s.label for s in got[2].spans].count("gpl-3.0") == 3
