"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are integers. They are dealt into shards; each shard keeps, for every
dimension, posting segments of equal quantised value. For a query, all segments
are ordered by descending quantised impact (|weight| times the quantised value
above the dimension's worst) and added to accumulators in rounds. After every round a
bound on what is still missing tells which members can still reach the best k;
processing stops only when this set is small, or when nothing is left. All
possible members are then scored exactly, so the result is exact, ties included.

Queries are dealt into blocks; a task sees one shard and one block. Missing
trailing components count as 0. Rows that share a query's id are never its
answers and, if several rows have a query's id, the largest vector asks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 16_384     # vectors of a shard
BLOCK = 2_048      # queries of a block
LEVELS = 32        # quantised values of a dimension
ROUNDS = 12
FEW = 64           # possible members at which processing may stop, times k


def matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    arr = vectors.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    lens = arr.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(arr), dims), np.int64)
    row = np.repeat(np.arange(len(arr)), lens)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)] = arr.flatten().to_numpy()
    return out


class Shard:
    """Posting segments of a shard: per dimension, members by quantised value."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.low = vectors.min(axis=0)
        self.width = (vectors.max(axis=0) - self.low) // LEVELS + 1
        level = (vectors - self.low) // self.width
        self.members = np.argsort(level, axis=0, kind="stable").T.astype(np.int32)
        self.edges = np.stack([np.searchsorted(np.sort(level[:, d]), np.arange(LEVELS + 1)) for d in range(vectors.shape[1])])

    def top(self, q: np.ndarray, k: int, allowed: np.ndarray, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
        """Member numbers that can be among the best k, with exact scores (a superset of the best k). The index is
        read until at most k * few members are possible."""
        possible = allowed
        if len(allowed) > k * max(1, few):
            possible = self._possible(q, k, allowed, len(self.vectors), few)
        return possible, self.vectors[possible] @ q

    def _possible(self, q: np.ndarray, k: int, allowed: np.ndarray, n: int, few: int) -> np.ndarray:
        weight = np.abs(q) * self.width
        level = np.arange(LEVELS)
        # a segment's impact: what its members gain over the worst segment of the dimension
        gain = np.where(q[:, None] > 0, level[None, :], LEVELS - 1 - level[None, :]) * weight[:, None]
        filled = np.diff(self.edges, axis=1) > 0
        dim, lev = np.nonzero(filled & (gain > 0))
        impact = gain[dim, lev]
        order = np.argsort(-impact, kind="stable")
        dim, lev, impact = dim[order], lev[order], impact[order]
        sizes = self.edges[dim, lev + 1] - self.edges[dim, lev]
        slack = int((weight - np.abs(q)).sum())  # what quantisation hides of a fully processed member
        acc = np.zeros(n)
        ends = np.searchsorted(np.cumsum(sizes), np.linspace(0, sizes.sum(), ROUNDS + 1)[1:], side="left") + 1
        at = 0
        possible = allowed
        for end in ends:
            end = min(int(end), len(dim))
            if end <= at:
                continue
            ids = np.concatenate([self.members[d, self.edges[d, v]:self.edges[d, v + 1]]
                                  for d, v in zip(dim[at:end].tolist(), lev[at:end].tolist())])
            acc += np.bincount(ids, np.repeat(impact[at:end], sizes[at:end]), minlength=n)
            at = end
            rest = np.zeros(len(q))
            np.maximum.at(rest, dim[at:], impact[at:])
            scores = acc[allowed]
            bar = np.partition(scores, len(scores) - k)[len(scores) - k]
            possible = allowed[scores + rest.sum() + slack >= bar]
            if len(possible) <= k * few:
                break
        return possible


def search(shard_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
           few: int = FEW) -> pa.Table:
    """Best k of one shard for each query: (query_id, vec_id, score). Scores beyond 64 bits raise."""
    if float(np.abs(vectors).max(initial=0)) * float(np.abs(queries.astype(float)).sum(axis=1).max(initial=0)) >= 2.0 ** 62:
        raise OverflowError("inner products do not fit into 64 bits")
    shard, out = Shard(vectors), []
    everyone = np.arange(len(shard_ids))
    for qid, q in zip(query_ids, queries):
        own = shard_ids == qid
        who, score = shard.top(q, k, everyone[~own] if own.any() else everyone, few)
        best = np.lexsort((shard_ids[who], -score))[:k]
        out.append((np.full(len(best), qid), shard_ids[who[best]], score[best]))
    names = ["query_id", "vec_id", "score"]
    return pa.table({n: np.concatenate([x[i] for x in out]).astype(np.int64) for i, n in enumerate(names)})


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector",
          shard: int = SHARD, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products, ties to the smaller id."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<bigint>").alias("v"),
                          is_query.alias("q")).filter("id is not null and v is not null")
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("m"), F.max(F.size("v")).alias("d")).first()
    dims, shards, blocks = max(1, size["d"] or 1), max(1, -(-size["n"] // shard)), max(1, -(-size["m"] // block))
    queries = rows.filter("q").groupBy("id").agg(F.max("v").alias("v"))
    left = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("long")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def both(members, asked):
        if not members.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        return search(members["id"].to_numpy(), matrix(members["v"], dims), asked["id"].to_numpy(), matrix(asked["v"], dims), k, few)

    found = left.select("shard", "block", "id", "v").groupBy("shard", "block").cogroup(
        right.select("shard", "block", "id", "v").groupBy("shard", "block")).applyInArrow(both, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
