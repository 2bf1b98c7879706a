import numpy as np
import pytest
from pyspark.sql import functions as F

from fumikura.llm import neighbours

SF = "/root/testdata/sf0.01"


def brute(vectors, query, own, k):
    scored = [(-float(np.dot(v, query)), i) for i, v in vectors if i != own]
    return [i for _, i in sorted(scored)[:k]]


def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0"), 20, block_vectors=128, block_queries=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(vectors[r.vec_id] @ vectors[r.query_id]), abs=1e-12)
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(brute(vectors.items(), vectors[q], q, 20)))
    assert len(by) == 25 and hits / (20 * len(by)) >= 0.9


@pytest.mark.parametrize("kind", ["clusters", "lengths"])
def test_recall_on_other_shapes(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    x = centres[rng.integers(0, 6, 1500)] + 0.1 * rng.standard_normal((1500, 16)) if kind == "clusters" else rng.standard_normal((1500, 16)) * rng.lognormal(0, 1, (1500, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(table, table.where("vec_id % 50 = 0"), 10).collect()
    hits = sum(r.vec_id in brute(enumerate(x), x[r.query_id], r.query_id, 10) for r in got)
    assert len(got) == 300 and hits / 300 >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [0.5, 0.5]), (9, [1.0, 0.0]), (None, [1.0, 1.0]), (10, [1.0]), (8, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score", "3 AS v", "4 AS q")
    got = neighbours.nearest(table, table.where("vec_id in (0, 2, 8)"), 20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 9), (0, 3, 8), (0, 4, 8), (8, 1, 0), (8, 2, 1), (8, 3, 9)]
    assert neighbours.nearest(table.where(F.lit(False)), table, 3).count() == 0
    assert neighbours.nearest(table, table.where(F.lit(False)), 3).count() == 0
    assert neighbours.nearest(table.where("vec_id = 0"), table.where("vec_id = 0"), 3).count() == 0
