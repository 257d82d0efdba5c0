"""Exact top-k inner-product search in three phases with a uniform threshold.

The coordinates are dealt into ``n_lists`` groups; each group is a *list*
that scores a candidate by its part of the inner product, and the score of a
candidate is the sum over lists.  Per slice of queries:

1. *Gather local score lists.*  Every task takes, for each query, the best
   entries of each list among its candidates, resolves those few exactly and
   reports its best k scores.  The k-th best reported score of a query is a
   safe cutoff: k candidates reach it.
2. *Broadcast the cutoff, collect sufficient entries.*  A candidate that
   reaches the cutoff t has a part of at least t / n_lists in some list.
   Tasks collect exactly the entries at or over that, and leave out those
   whose known parts and the threshold for the unknown ones stay below t.
3. *Resolve* the remaining entries exactly; scores at or over the cutoff go
   into the task's best k, and the best k over all tasks are the result.

Candidates are never shuffled: only k rows per task and query are.  Queries
are taken in slices of a fixed number of vectors, the only data broadcast.
Sums are exact: float64 products of integers below 2**53, else Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.session import materialize

QUERY_SLICE = 8192   # most queries broadcast at once (about; slices are dealt by hash)
BLOCK = 2048         # candidates scored at a time
QUERIES_AT_ONCE = 1024
_MAX = (1 << 63) - 1


def _usable(vector: str):
    """No null, no NaN, no infinity; null vectors give null, which a filter drops."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _matrix(vectors: list, dim: int, scale: float) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled with zeros (no other row needs more than ``dim``)."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :min(len(v), dim)] = np.asarray(v[:dim], dtype=np.float64)
    return np.floor(out * scale)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact q @ c.T: float64 where every sum stays below 2**53, else Python integers."""
    if not len(q) or not len(c) or not q.shape[1]:
        return np.zeros((len(q), len(c)))
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0 ** 53:
        return q @ c.T
    whole = lambda a: np.array([[int(x) for x in row] for row in a], dtype=object)
    return whole(q) @ whole(c).T


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact scores of one query; beyond a long, the nearest long."""
    s = _product(q, c)[0]
    return s if s.dtype != object else np.array([max(-_MAX - 1, min(_MAX, int(x))) for x in s], dtype=object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k and scores.dtype != object:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]] if scores.dtype != object else np.array(
        sorted(near, key=lambda i: (-scores[i], ids[i]))[:k], dtype=int)


class _Kept:
    """The best k (score, id) of each query so far."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if query in self.of:
            s, i = self.of[query]
            scores, ids = np.concatenate((s, scores)), np.concatenate((i, ids))
        best = _best(scores, ids, self.k)
        self.of[query] = scores[best], ids[best]

    def rows(self) -> pd.DataFrame:
        found = [(q, int(i), int(s)) for q, (ss, ii) in self.of.items() for s, i in zip(ss, ii)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list]]:
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK):
            part = pdf.iloc[i:i + BLOCK]
            yield part["id"].to_numpy(np.int64), part["v"].tolist()


def _pieces(q_ids, q, groups, c_ids, c):
    """Per piece of the queries: first query, ids, own-row mask, the parts of each list."""
    for a in range(0, len(q_ids), QUERIES_AT_ONCE):
        ids = q_ids[a:a + QUERIES_AT_ONCE]
        yield a, ids, ids[:, None] == c_ids[None, :], [_product(q[a:a + QUERIES_AT_ONCE, g], c[:, g]) for g in groups]


def _local_lists(queries, k: int, scale: float):
    q_ids, q, groups = queries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = _Kept(k)
        for c_ids, vectors in _blocks(batches):
            c = _matrix(vectors, q.shape[1], scale)
            for a, ids, own, parts in _pieces(q_ids, q, groups, c_ids, c):
                for row in range(len(ids)):
                    others = np.flatnonzero(~own[row])
                    seen = set()
                    for p in parts:
                        seen.update(others[_best(p[row, others], c_ids[others], k)].tolist())
                    seen = np.array(sorted(seen), dtype=int)
                    if len(seen):
                        kept.add(int(ids[row]), _scores(q[a + row:a + row + 1], c[seen]), c_ids[seen])
        yield kept.rows()

    return run


def _resolved(queries, cutoff: np.ndarray, k: int, scale: float):
    q_ids, q, groups = queries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, m = _Kept(k), len(groups)
        for c_ids, vectors in _blocks(batches):
            c = _matrix(vectors, q.shape[1], scale)
            for a, ids, own, parts in _pieces(q_ids, q, groups, c_ids, c):
                t = cutoff[a:a + len(ids), None]
                known, top = 0, 0
                enough = np.zeros(own.shape, bool)
                for p in parts:  # m * part >= t: at or over the threshold t / m, in whole numbers
                    over = m * p >= t
                    enough |= over
                    top = top + np.where(over, m * p, t)
                    known += 1
                enough &= (top >= m * t) & ~own
                for row in np.flatnonzero(enough.any(1)):
                    at = np.flatnonzero(enough[row])
                    scores = _scores(q[a + row:a + row + 1], c[at])
                    good = scores >= cutoff[a + row]
                    if good.any():
                        kept.add(int(ids[row]), scores[good], c_ids[at[good]])
        yield kept.rows()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5,
          scale: float = 256.0, n_lists: int = 4) -> DataFrame:
    """The k highest scores of each query: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x); the score is the whole-number inner
    product; ties go to the smaller id.  Candidates are all rows of
    ``vectors`` with another id than the query's.  Rows without an id, and
    vectors that are null or hold a null or non-finite component, take no
    part.  Vectors of unequal length are compared as if filled with zeros.
    Repeated candidate rows are each a candidate; of repeated query ids the
    least vector asks.  A score beyond a long counts as the nearest long.
    Fewer than k candidates give fewer rows; empty tables give none.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(f"`{vec_id}`").cast("long").alias("id"),
                                F.col(f"`{vector}`").cast("array<double>").alias("v")
                                ).filter(F.col("id").isNotNull() & _usable("v"))
    candidates = pick(vectors)
    asked = materialize(pick(queries).groupBy("id").agg(F.min("v").alias("v")), "topk_queries")
    n, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    slices = max(1, -(-2 * n // QUERY_SLICE)) if n > QUERY_SLICE // 2 else 1
    schema = "query_id long, vec_id long, score long"
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for i in range(slices if n else 0):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == i).collect()  # about QUERY_SLICE / 2
        rows.sort(key=lambda r: r.id)
        q_ids = np.array([r.id for r in rows], dtype=np.int64)
        q = _matrix([r.v for r in rows], dim, scale)
        groups = [g for g in np.array_split(np.arange(dim), n_lists) if len(g)] or [np.arange(0)]
        queries_now = (q_ids, q, groups)
        local = candidates.mapInPandas(_local_lists(queries_now, k, scale), schema)
        kth = local.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") == k)
        safe = {r.query_id: r.score for r in kth.select("query_id", "score").collect()  # one row a query of the slice
                if r.score > -_MAX - 1}  # the least long stands for anything below
        cutoff = np.array([safe.get(int(x), -np.inf) for x in q_ids])
        if np.any(np.abs(cutoff[np.isfinite(cutoff)]) >= 2.0 ** 53 / n_lists):  # compare such in whole numbers
            cutoff = np.array([safe.get(int(x), -(1 << 200)) for x in q_ids], dtype=object)
        part = candidates.mapInPandas(_resolved(queries_now, cutoff, k, scale), schema)
        part = part.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
        part = materialize(part, "topk_found") if slices > 1 else part
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], schema + ", rank int")
    return found.select("query_id", "rank", "vec_id", "score")


def search_embeddings(vectors: DataFrame) -> DataFrame:
    """Every row whose vec_id is divisible by 50 against all rows."""
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
