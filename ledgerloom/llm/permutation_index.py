"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. A block of vectors
keeps, per pivot, an inverted file of (vector, place of the pivot in its
ordering). A query reads the files of its own nearest pivots only and adds up
the footrule distance to the vectors met there; the nearest by footrule are
reranked by the exact inner product.

Vectors are dealt into blocks of a fixed size and queries into tiles, so a task
is one block against one tile whatever the data's shape; a task returns the best
k of the block for each query, and those are merged by a window per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots (drawn from a bounded sample), length of the orderings, and the share of a block that is reranked.
PIVOTS, PREFIX, RERANK = 128, 32, 0.35
#: Vectors in a block, queries in a tile.
BLOCK, TILE = 8192, 4096


def valid(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(__id, __v: array of double) of the vectors that take part: not null, empty or zero, all components finite."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).alias("__id"), v.alias("__v")).where(F.col("__id").isNotNull() & F.coalesce(good, F.lit(False)))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """At most `pivots` distinct vectors, those of the least hash: a fixed, documented sample."""
    picked = rows.groupBy("__v").agg(F.min("__id").alias("i")).orderBy(F.xxhash64("__v"), "i").limit(pivots).select("__v").collect()
    found = [np.array(r[0], np.float64) for r in picked]
    size = max(map(len, found), default=0)
    return np.stack([np.pad(x, (0, size - len(x))) for x in found]) if found else np.zeros((0, 0))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of vectors; shorter ones end in zeros, which changes no inner product."""
    out = np.zeros((len(vectors), max(width, max(map(len, vectors), default=0))))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def orderings(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first (cosine, so that long vectors do not favour anyone)."""
    norm = np.linalg.norm(pivots, axis=1)
    near = x[:, : pivots.shape[1]] @ (pivots / norm[:, None]).T
    prefix = min(prefix, len(pivots))
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int16)


class Block:
    """The inverted files of one block: for each pivot the vectors that have it in their ordering, and where."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.prefix = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.vector, self.place = (by // self.prefix).astype(np.int64), (by % self.prefix).astype(np.int64)
        self.start = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.n = n

    def nearest(self, query: np.ndarray, count: int) -> np.ndarray:
        """The vectors with the least footrule distance; a pivot missing from an ordering counts as at its end."""
        gain = np.zeros(self.n, np.int64)
        for at, pivot in enumerate(query.tolist()):
            a, b = self.start[pivot], self.start[pivot + 1]
            place = self.place[a:b]  # a met pivot costs |at - place| where an unmet one costs both distances to the end
            gain[self.vector[a:b]] += 2 * (self.prefix - np.maximum(place, at))
        if count >= self.n:
            return np.arange(self.n)
        edge = np.partition(gain, self.n - count)[self.n - count]
        above = np.flatnonzero(gain > edge)
        level = np.flatnonzero(gain == edge)[: count - len(above)]  # rows are in order of id: ties go to smaller ids
        return np.sort(np.concatenate((above, level)))


def search(
    df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
    pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of df found for each row of queries, itself (by id) excluded.

    Nearness is the inner product in double precision; ties go to the smaller id. Vectors that are null,
    zero or hold null or non-finite components take no part on either side. Equal vectors are rows like
    any other; rows that repeat an id count once each. With fewer candidates than k all are returned;
    an empty side gives an empty result. Other columns are not looked at.
    """
    rows, asked = valid(df, id_col, vector), valid(queries, id_col, vector)
    chosen = choose_pivots(rows, pivots)
    count, width = len(chosen), chosen.shape[1]
    blocks, tiles = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // TILE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.withColumn("block", F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("tile", every(tiles))
    sought = asked.withColumn("tile", F.pmod(F.xxhash64("__id", F.lit(4)), F.lit(tiles)).cast("int")).withColumn("block", every(blocks))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right) and count:
            left = left.sort_values("__id", kind="stable")
            x, q = matrix(left["__v"], width), matrix(right["__v"], width)
            size = max(x.shape[1], q.shape[1])
            x, q = np.pad(x, ((0, 0), (0, size - x.shape[1]))), np.pad(q, ((0, 0), (0, size - q.shape[1])))
            ids, asks = left["__id"].to_numpy(), right["__id"].to_numpy()
            index, want = Block(orderings(x, chosen, prefix), count), max(4 * k + 1, int(rerank * len(x)))
            for i, order in enumerate(orderings(q, chosen, prefix)):
                at = index.nearest(order, want)
                at = at[ids[at] != asks[i]]
                score = (x[at] * q[i]).sum(axis=1)
                if len(at) > 4 * k:
                    edge = np.partition(score, len(at) - k)[len(at) - k]
                    at, score = at[score >= edge], score[score >= edge]
                best = np.lexsort((ids[at], -score))[:k]
                out["query_id"].append(np.full(len(best), asks[i]))
                out["vec_id"].append(ids[at[best]])
                out["score"].append(score[best])
        empty = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, empty[c]) for c, v in out.items()})

    found = data.groupBy("block", "tile").cogroup(sought.groupBy("block", "tile")).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
