"""Nearest neighbours by collision counting on single projections.

Every vector is projected on ``projections`` random lines; each line keeps its
values sorted.  A query opens a window around its own value on every line.
Growing the search radius widens all windows by the same factor (virtual
rehashing: nothing is hashed anew), and a vector collides once per line whose
window it has entered.  A vector with enough collisions is verified on the
original vectors.  The search of a block ends when the ``k``-th best verified
vector lies within the radius the windows stand for, or when all is verified.

Largest inner product is turned into least distance by one more coordinate:
with M the largest norm, x gets sqrt(M^2 - |x|^2) and a query gets 0.

Vectors are dealt out in blocks, each a sorted index of its own; queries are
dealt out in blocks too and meet every block, so no task or broadcast holds
more than a block of each.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored

#: Random lines; more lines part near from far vectors better.
PROJECTIONS = 48
#: Half width of a window in units of the search radius.
HALF = 2.0
#: Chance, per vector within the radius, of reaching the threshold (normal approximation).
HIT = 0.8
#: First radius as a share of a query's typical distance, and the factor between two radii.
START = 0.65
GROWTH = 1.1
#: Vectors and queries of one block.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 2_048
_TOGETHER = 256
_SEED = 20_240_601


def threshold(projections: int = PROJECTIONS, half: float = HALF, hit: float = HIT) -> int:
    """Collisions that a vector at exactly the radius reaches with chance ``hit``."""
    p = erf(half / sqrt(2))
    low, high = -8.0, 8.0
    for _ in range(60):  # quantile of the normal distribution
        mid = (low + high) / 2
        low, high = (mid, high) if (1 + erf(mid / sqrt(2))) / 2 < 1 - hit else (low, mid)
    return max(1, int(np.floor(projections * p + low * sqrt(projections * p * (1 - p)))))


def usable(vector: Column) -> Column:
    """A vector of finite components, at least one of them not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, most: float, projections: int = PROJECTIONS) -> list[tuple[int, int, float]]:
    """<query, vector, inner product> of up to ``k`` best vectors of one block for every query.

    Queries go through the radii together; those that have ended drop out.
    """
    n, width = vectors.shape
    lines = np.random.default_rng(_SEED).standard_normal((width + 1, projections))
    extra = np.sqrt(np.maximum(most * most - np.einsum("ij,ij->i", vectors, vectors), 0.0))
    value = vectors @ lines[:width] + extra[:, None] * lines[width]
    order = np.argsort(value, 0, kind="stable").T.copy()
    ranked = np.sort(value, 0).T.copy()
    spots = queries @ lines[:width]
    place = np.argsort(ids, kind="stable")
    by_id = ids[place]
    least = threshold(projections)
    # Typical distance of a query, from a spread of every sorted line.
    some = ranked[:, ::max(1, n // 64)]
    typical = np.array([np.median(np.abs(some - s[:, None])) for s in spots]) / 0.6745
    far = np.maximum(np.abs(ranked[:, 0] - spots), np.abs(ranked[:, -1] - spots)).max(1) / HALF
    out: list[tuple[int, int, float]] = []
    for first in range(0, len(queries), _TOGETHER):
        part = slice(first, first + _TOGETHER)
        states = []
        for number, query in zip(query_ids[part], queries[part]):
            own = place[np.searchsorted(by_id, number, "left"):np.searchsorted(by_id, number, "right")]
            states.append(_Search(n, own, vectors, query, k, projections, most))
        _widen_all(states, spots[part], START * typical[part], far[part], order, ranked, least)
        for number, state in zip(query_ids[part], states):
            top = np.lexsort((ids[state.at], -state.score))[:k]
            out.extend((int(number), int(ids[i]), float(s)) for i, s in zip(state.at[top], state.score[top]))
    return out


def _widen_all(states: list[_Search], spots: np.ndarray, radius: np.ndarray, far: np.ndarray, order: np.ndarray, ranked: np.ndarray, least: int) -> None:
    """Takes queries from radius to radius until each search has ended."""
    radius = np.maximum(radius, 1e-9)
    live = np.array([i for i, s in enumerate(states) if s.wanted], np.int64)
    while len(live):
        reach = HALF * radius[live]
        low = np.stack([np.searchsorted(r, spots[live, j] - reach, "left") for j, r in enumerate(ranked)], 1)
        high = np.stack([np.searchsorted(r, spots[live, j] + reach, "right") for j, r in enumerate(ranked)], 1)
        going = []
        for at, i in enumerate(live):
            if not states[i].widen(order, low[at], high[at], least, radius[i]):
                if radius[i] <= far[i]:
                    going.append(i)
                else:  # the windows hold the whole block
                    states[i].verify(np.flatnonzero(~states[i].closed))
        live = np.array(going, np.int64)
        radius[live] *= GROWTH


class _Search:
    """What one query knows of a block."""

    def __init__(self, n: int, own: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int, projections: int, most: float):
        self.vectors, self.query, self.most = vectors, query, most
        self.wanted = min(k, n - len(own))
        self.k = k
        self.projections = projections
        self.misses: np.ndarray | None = None
        self.low = self.high = np.zeros(0, np.int64)
        self.closed = np.zeros(n, bool)  # verified, or the query itself
        self.closed[own] = True
        self.at, self.score = np.zeros(0, np.int64), np.zeros(0)

    def widen(self, order: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, radius: float) -> bool:
        """Opens the windows low..high of all lines; true if the search has ended."""
        n = len(self.closed)
        # Counted as lines whose window a vector has not entered, which are fewer.
        if self.misses is None:
            outside = [o[:a] for o, a in zip(order, low)] + [o[b:] for o, b in zip(order, high)]
            self.misses = np.bincount(np.concatenate(outside), minlength=n).astype(np.int16)
        else:
            entered = [o[a:b] for o, a, b in zip(order, low, self.low)] + [o[a:b] for o, a, b in zip(order, self.high, high)]
            self.misses -= np.bincount(np.concatenate(entered), minlength=n).astype(np.int16)
        self.low, self.high = low, high
        self.verify(np.flatnonzero((self.misses <= self.projections - least) & ~self.closed))
        if len(self.at) < self.wanted:
            return False
        best = np.partition(self.score, len(self.score) - self.wanted)[len(self.score) - self.wanted]
        return self.most * self.most + float(self.query @ self.query) - 2 * best <= radius * radius

    def verify(self, fresh: np.ndarray) -> None:
        if not len(fresh):
            return
        self.closed[fresh] = True
        at = np.concatenate([self.at, fresh])
        score = np.concatenate([self.score, self.vectors[fresh] @ self.query])
        if len(at) > self.k:  # the best stay, with all that equal the last of them
            good = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            at, score = at[good], score[good]
        self.at, self.score = at, score


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    projections: int = PROJECTIONS,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """<query_id, rank, vec_id, score>: the ``k`` found with the largest inner product.

    ``vectors`` and ``queries`` hold <vec_id, embedding>.  A vector whose
    vec_id is the query's is no candidate.  Scores are inner products of the
    original vectors in double precision; ties go to the smaller vec_id.

    * Null, empty or all-zero vectors and those with a null, NaN or infinite
      component take no part, nor do rows without an id or of another length than the most common one.
    * Fewer than ``k`` candidates: all of them.  No usable vector or query: no row.
    * Rows that repeat an id are all candidates, a repeated query is asked once (its first vector by value).
    * Other columns are not read.
    """
    spark = vectors.sparkSession
    ready = lambda frame: frame.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    rows = stored(ready(vectors))
    shape = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("m"))
    common = shape.orderBy(F.desc("n"), "d").first()  # one row per length of vector
    if common is None:
        return spark.createDataFrame([], empty)
    most = sqrt(common.m)
    asked = stored(ready(queries).where(F.size("embedding") == common.d).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], empty)
    v_blocks, q_blocks = -(-common.n // block_vectors), -(-n_queries // block_queries)
    # Every cell of the grid holds one block of vectors and one of queries.
    block = lambda blocks: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.where(F.size("embedding") == common.d).select(block(v_blocks).alias("v"), "vec_id", "embedding").withColumn("q", every(q_blocks))
    right = asked.select(block(q_blocks).alias("q"), "vec_id", "embedding").withColumn("v", every(v_blocks))

    def cell(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        # The order of rows after a shuffle is not fixed; the result must not depend on it.
        one, other = one.sort_values("vec_id", kind="stable"), other.sort_values("vec_id", kind="stable")
        found = search_block(one["vec_id"].to_numpy(), np.stack(one["embedding"].to_numpy()), other["vec_id"].to_numpy(), np.stack(other["embedding"].to_numpy()), k, most, projections)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInPandas(cell, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
