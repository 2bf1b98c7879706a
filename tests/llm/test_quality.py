import numpy as np

from fumikura.llm import quality

SF = "/root/testdata/sf0.01"


def test_against_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found, model = quality.classify(docs)
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    area = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean()
    assert area > 0.95 and good.keep.mean() > 0.95 and bad.keep.mean() < 0.1
    assert model.accuracy["case"] > 0.9


def test_label_model_recovers_kinds_from_overlapping_votes():
    rng = np.random.default_rng(1)
    n, m = 6000, len(quality.LABELLERS)
    kind = rng.choice(4, n, p=[0.8, 0.1, 0.06, 0.04]) - 1  # -1 is good
    knows = {0: (0, 5), 1: (1, 3), 2: (2, 8)}  # labellers that see a kind, each with misses
    votes = np.zeros((n, m), int)
    votes[:, 4] = np.where(rng.random(n) < np.where(kind < 0, 0.9, 0.3), 1, 0)
    votes[:, 6] = np.where(rng.random(n) < 0.9, 1, 0)
    for k, labellers in knows.items():
        for j in labellers:
            votes[:, j] = np.where((kind == k) & (rng.random(n) < 0.85), -1, votes[:, j])
    false = rng.random(n) < 0.01
    votes[false & (kind < 0), 7] = -1
    packed = np.array([quality._packed(list(v)) for v in votes])
    patterns, counts = np.unique(packed, return_counts=True)
    model = quality.LabelModel(patterns, counts)
    guess = np.array([model.posterior[int(p)] for p in packed]) > 0.5
    assert (guess == (kind < 0)).mean() > 0.97
    assert model.accuracy["case"] > 0.95 and model.accuracy["sentences"] > 0.9


def test_patterns_and_pieces(monkeypatch):
    for vote in ([0] * 9, [1, -1, 0] * 3, [-1] * 9):
        assert quality.unpacked(quality._packed(vote)) == vote
    text = np.frombuffer(("Some plain words. AND SHOUTED!! a | b &&& " * 40).encode(), np.uint8)
    whole = quality.measures(text)
    monkeypatch.setattr(quality, "PIECE", 64)
    pieces = quality.measures(text)
    assert all(abs(whole[0][k] - pieces[0][k]) < 1e-12 for k in whole[0]) and (whole[1] == pieces[1]).all() and (whole[2] == pieces[2]).all()


def test_edges(edge_docs, no_docs):
    found, _ = quality.classify(edge_docs)
    rows = found.collect()
    assert len(rows) == edge_docs.count() and all(r.score == 0 and not r.keep for r in rows if r.doc_id in (1, 2, 3))
    assert quality.classify(no_docs)[0].count() == 0
