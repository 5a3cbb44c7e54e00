"""Exact top-k search by no-random-access aggregation over sorted lists.

Vectors are dealt into blocks of rows; each block is searched by each block of queries in a task of its own, and a
query's block winners are merged by rank. So rows and queries are sent once per block of the other side, and work is
rows x queries at worst.

Inside a block every dimension is a list sorted by its share of the score. A query reads its lists in growing steps,
those first that hold most of what is unknown.
What it has read of a row gives a lower bound (unread shares at their lists' worst) and an upper bound (unread shares at
the last value read); rows not met at all have the sum of the last values as upper bound. Rows whose upper bound is
under the k-th lower bound are outsiders and are not looked at again. Once rows not met are outsiders and few others
are left, the scores of these are resolved and the query stops. A query that has met half of the block reads to the
end, which is one product of the whole block; when the first `TRIES` queries of a block all do so, as on vectors without
structure, the others start there.

Vectors that are null or hold null, NaN or infinite components take no part, nor do vectors of another dimension than
the query's. Repeated vec_ids: one query each (the smallest vector), every row with another id is a candidate. Ties go
to the smaller vec_id. Components or scores beyond 64 bits are an error. Further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import table

FIRST_DEPTH, TRIES = 16, 16


class Lists:
    """A block's vectors with every dimension's sorted list."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, largest_query: int):
        top = int(np.abs(x).max(initial=0)) * largest_query * max(1, x.shape[1])
        if top >= 2**63:
            raise OverflowError("inner products do not fit 64 bits")
        # sums are exact: below 2**53 as doubles, else as integers
        self.x, self.ids = x.astype(np.float64 if top < 2**53 else np.int64), ids
        self.order = np.argsort(x, axis=0, kind="stable")
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(x))[:, None], axis=0)
        self.ranked = np.take_along_axis(self.x, self.order, axis=0)

    def stop_early(self, q: np.ndarray, own: int, k: int) -> np.ndarray | None:
        """Rows that hold the k best of one query, found without reading all; None if the lists would be read to the end."""
        n, d = self.x.shape
        use = np.flatnonzero(q)
        q, up = q[use].astype(self.x.dtype), q[use] > 0
        worst = np.where(up, self.ranked[0, use], self.ranked[-1, use])
        best = np.where(up, self.ranked[-1, use], self.ranked[0, use])
        out = np.zeros(n, bool)
        t = np.zeros(len(use), np.int64)
        while True:
            at = np.maximum(t, 1)
            edge = np.where(t > 0, self.ranked[np.where(up, n - at, at - 1), use], best)
            unknown = np.abs((edge - worst) * q)
            deeper = unknown * 4 * len(use) >= unknown.sum()
            if not deeper.any() or not unknown.any():
                return None
            t = np.where(deeper, np.minimum(n, np.maximum(FIRST_DEPTH, 4 * t)), t)
            parts = [self.order[n - m :, i] if rising else self.order[:m, i] for i, m, rising in zip(use, t.tolist(), up) if m]
            met = np.unique(np.concatenate(parts))
            if 2 * len(met) > n:
                return None
            met = met[(self.ids[met] != own) & ~out[met]]
            at = np.maximum(t, 1)
            edge = np.where(t > 0, self.ranked[np.where(up, n - at, at - 1), use], best)
            r, v = self.rank[np.ix_(met, use)], self.x[np.ix_(met, use)]
            read = np.where(up, r >= n - t, r < t)
            upper, lower = np.where(read, v, edge) @ q, np.where(read, v, worst) @ q
            if len(met) > k:
                bar = np.partition(lower, len(met) - k)[len(met) - k]
                out[met[upper < bar]] = True
                left = met[upper >= bar]
                if edge @ q < bar and len(left) <= max(8 * k, n // 50):
                    return left


def nra(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query (row of q) the rows of x with the k highest inner products, and these; how many stopped early."""
    lists = Lists(x, ids, int(np.abs(q).max(initial=0)))
    found: list[np.ndarray | None] = []
    early = 0
    for j in range(len(q)):
        found.append(None if j >= TRIES and not early else lists.stop_early(q[j], own[j], k))
        early += found[-1] is not None
    rest = [j for j, f in enumerate(found) if f is None]
    whole = dict(zip(rest, (lists.x @ q[rest].T.astype(lists.x.dtype)).T)) if rest else {}
    out = []
    for j, at in enumerate(found):
        if at is None:
            at = np.flatnonzero(ids != own[j])
            s = whole[j][at]
        else:
            s = lists.x[at] @ q[j].astype(lists.x.dtype)
        if len(at) > k:
            fit = s >= np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[fit], s[fit]
        best = np.lexsort((ids[at], -s))[:k]
        out.append((at[best], s[best].astype(np.int64)))
    return out, early


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, row_block: int = 8192, query_block: int = 512) -> DataFrame:
    """vectors and queries: (vec_id, embedding) -> query_id, rank, vec_id, score."""

    def whole(df: DataFrame) -> DataFrame:
        fine = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
        return df.where(fine).select("vec_id", F.expr(f"transform(embedding, x -> if(abs({scale} * cast(x as double)) < 9e18D, cast(floor({scale} * cast(x as double)) as bigint), cast(raise_error('a component does not fit 64 bits') as bigint)))").alias("v"))

    rows, asked = whole(vectors), whole(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, n_asked = rows.count(), asked.count()
    n_rb, n_qb = max(1, math.ceil(n_rows / row_block)), max(1, math.ceil(n_asked / query_block))
    left = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_rb))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_qb)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rb - 1).cast("long"))))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d in sorted(set(a["v"].map(len)) & set(b["v"].map(len))):
            rows, asks = a[a["v"].map(len) == d], b[b["v"].map(len) == d]
            x, q = (np.stack(p["v"].to_numpy()).astype(np.int64).reshape(len(p), d) for p in (rows, asks))
            ids, own = rows["vec_id"].to_numpy(), asks["vec_id"].to_numpy()
            for qid, (at, score) in zip(own, nra(x, ids, q, own, k)[0]):
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return top_k(e, e.where("vec_id % 100 = 0"))


ORACLE_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
