"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are cut into blocks.  A task sorts its block once per dimension; for a
query it walks all lists in step, scores what it meets in full, and stops when the
sum of the lists' current values times the query, the best score that anything not
yet met can have, is below the k-th score found.  Blocks' results are merged by one
aggregation that holds at most ``k`` rows per query and block.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Candidates and queries in a block.  They set task sizes and change no result.
BLOCK, QUERY_BLOCK = 8192, 1024
STEP = 32


def whole_numbers(vector: str) -> Column:
    """floor(1024 * x) of every component, NULL for a vector that takes no part.

    Left out are NULL vectors and vectors with NULL or non-finite components.
    """
    v = F.col(vector)
    ok = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return F.when(ok, F.transform(v, lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long")))


class SortedLists:
    """The vectors of a block with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.int64)
        self.order = np.argsort(-self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)
        self.peak = max(abs(int(self.vectors.max(initial=0))), abs(int(self.vectors.min(initial=0))))
        self._cast: dict = {}

    def _as(self, kind: type, name: str) -> np.ndarray:
        if (kind, name) not in self._cast:
            self._cast[kind, name] = getattr(self, name).astype(kind)
        return self._cast[kind, name]

    def top(self, query_id: int, query: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, depth reached) of the k best, ties by smaller id, rows with the query's own id left out.

        Inner products are whole numbers: taken in doubles where these are exact, else
        in 64 bits, and refused where they might not fit.
        """
        n, dims = self.vectors.shape
        peak = self.peak * max((abs(int(x)) for x in query), default=0) * dims
        if peak >= 1 << 63:
            raise OverflowError("integer inner products may exceed 64 bits")
        kind = np.float64 if peak < 1 << 53 else np.int64
        vectors, values, query = self._as(kind, "vectors"), self._as(kind, "values"), query.astype(kind)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.ids == query_id
        best = np.zeros(0, np.int64)
        scores = np.zeros(0, kind)
        depth = 0
        if not len(up) and not len(down):
            best = np.flatnonzero(~seen)[:k]
            return self.ids[best], np.zeros(len(best), kind), 0
        while depth < n:
            upto = min(n, depth + step)
            met = np.unique(np.concatenate([self.order[depth:upto, up].ravel(), self.order[n - upto: n - depth, down].ravel()]))
            met = met[~seen[met]]
            seen[met] = True
            depth, step = upto, step * 2
            if len(met):
                best, scores = np.concatenate([best, met]), np.concatenate([scores, vectors[met] @ query])
                keep = np.lexsort((best, -scores))[:k]
                best, scores = best[keep], scores[keep]
            if len(best) == k:
                bound = values[depth - 1, up] @ query[up] + values[n - depth, down] @ query[down]
                if scores[-1] > bound:
                    break
        return self.ids[best], scores, depth


def _search(k: int, step: int):
    def search(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(block):
            lists = SortedLists(block["vec_id"].to_numpy(), np.stack(block["vector"].to_numpy()).reshape(len(block), -1))
            for q, v in zip(queries["vec_id"], queries["vector"], strict=True):
                ids, scores, _ = lists.top(q, np.asarray(v, dtype=np.int64), k, step)
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})

    return search


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, blocks: int = 1, query_blocks: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates per query; both sides have (vec_id, vector).

    A query meets vectors of its own length only, and no row of its own id.  Rows
    with a NULL id or vector take no part.  A repeated query id is asked once, with
    its smallest vector; repeated candidate rows all count.  Fewer than k candidates
    give all of them, none an empty result.
    """
    some = lambda df: df.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).withColumn("dims", F.size("vector"))
    asked = some(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    q = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    c = some(candidates).withColumn("cb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    q, c = [df.select("dims", F.col("qb").cast("long"), F.col("cb").cast("long"), "vec_id", "vector") for df in (q, c)]
    found = q.groupBy("dims", "qb", "cb").cogroup(c.groupBy("dims", "qb", "cb")).applyInPandas(_search(k, STEP), "query_id long, vec_id long, score long")
    # the k best of each query, kept small before and after the shuffle
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.low")).alias("score"))


def op5(spark, sf_dir: str) -> DataFrame:
    from panelwright.llm.common import read

    vectors = read(spark, sf_dir, "embeddings").select("vec_id", whole_numbers("embedding").alias("vector"))
    n = vectors.count()
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10, max(1, -(-n // BLOCK)), max(1, -(-n // (100 * QUERY_BLOCK))))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
