"""Exact top-k inner products by no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.session import write_and_read

SCALE = 64
#: Rows of a block of candidates and of a block of queries.
CANDIDATES = 4096
QUERIES = 4096
#: Parts of the sorted lists after which bounds are compared.
DEPTHS = (0.125, 0.25, 0.5)
#: Queries whose score bounds are held at once.
AT_ONCE = 256


def best_of_block(queries: np.ndarray, candidates: np.ndarray, query_rows: np.ndarray, rows_: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of each query's k best candidates of one block but its own row; ties to smaller ids.

    Each dimension is a list of candidates sorted by value, read from the top where the query's component is positive and from
    the bottom where it is negative. After each depth a seen entry counts with its value; an unseen one lies between the list's
    last read value and its far end, which gives bounds of every score without looking at any candidate by itself. Reading stops once the
    candidates that can still reach the k-th best lower bound are few; their scores are then resolved, and only those.
    """
    n, d = candidates.shape
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * d
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else object
    values = candidates.astype(kind)
    ascending = np.sort(values, axis=0)
    found = ([], [], [])
    for at in range(0, len(queries), AT_ONCE):
        part = queries[at : at + AT_ONCE].astype(kind)
        signed = np.concatenate([np.maximum(part, 0), np.minimum(part, 0)], axis=1)
        own = query_rows[at : at + AT_ONCE, None] == rows_[None, :]
        wanted = np.minimum(k, n - own.sum(axis=1))
        alive = [None] * len(part)
        open_ = np.flatnonzero(wanted > 0)
        for depth in DEPTHS if kind is not object and n > 4 * k else ():
            read = max(1, int(n * depth))
            top, bottom = ascending[n - read], ascending[read - 1]
            high = np.concatenate([np.maximum(values, top), np.minimum(values, bottom)], axis=1)
            low = np.concatenate([np.where(values >= top, values, ascending[0]), np.where(values <= bottom, values, ascending[-1])], axis=1)
            lower, upper = signed[open_] @ low.T, signed[open_] @ high.T
            lower[own[open_]] = upper[own[open_]] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k]
            able = upper >= kth[:, None]
            done = able.sum(axis=1) <= max(4 * k, n // 16)
            for i in np.flatnonzero(done):
                alive[open_[i]] = np.flatnonzero(able[i])
            open_ = open_[~done]
            if not len(open_):
                break
        everything = np.arange(n)
        # The lists are read to their end: every score is resolved.
        whole = dict(zip(open_.tolist(), part[open_] @ values.T, strict=True)) if len(open_) else {}
        for i in np.flatnonzero(wanted > 0):
            rows = everything if alive[i] is None else alive[i]
            scores = whole[i] if alive[i] is None else values[rows] @ part[i]
            inside = ~own[i, rows]
            rows, scores = rows[inside], scores[inside]
            m = int(wanted[i])
            if len(rows) > m:
                limit = np.partition(scores, len(scores) - m)[len(scores) - m]
                inside = scores >= limit
                rows, scores = rows[inside], scores[inside]
            if kind is object:  # integers of any size; what 64 bits cannot hold is given as the nearest that they can
                order = np.array(sorted(range(len(rows)), key=lambda j: (-scores[j], ids[rows[j]]))[:m], dtype=np.int64)
                scores = np.clip(scores, -(1 << 63), (1 << 63) - 1)
            else:
                order = np.lexsort((ids[rows], -scores))[:m]
            found[0].append(np.full(len(order), at + i))
            found[1].append(rows[order])
            found[2].append(scores[order].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in found)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v, row): floor(scale * x) of each component, as far as 64 bits reach, and a number of the row. Vectors that are null or empty or hold a
    null or non-finite component drop out, as do rows with a null id; rows that share an id stay rows of their own."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & finite)
    bound = float((1 << 63) - 1024)  # the largest double that is a 64-bit integer
    grid = F.transform(wide, lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(bound)), F.lit(-bound))))
    return kept.select(F.col(vec_id).cast("bigint").alias("id"), grid.alias("v")).withColumn("row", F.monotonically_increasing_id())


def top_k(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", candidates_most: int = CANDIDATES, queries_most: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all other rows, ties to smaller ids.

    `is_query` is a condition on the column `id`. Rows meet in blocks of bounded size, a block of queries with a block of candidates at a
    time; a block's lists are sorted once and read for all its queries. Each block gives at most k rows a query, and ranking these gives the
    result, whole if there are fewer than k candidates. Every query row has a ranking of its own, also where rows share an id, and rows of its id but itself are candidates. Vectors of different lengths don't meet. An empty table gives no rows.
    """
    grid = write_and_read(quantised(vectors, vec_id, vector).withColumn("d", F.size("v")), "topk-grid")
    n = grid.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"))
    blocks = n.select("d", F.ceil(F.col("n") / candidates_most).cast("int").alias("cs"), F.ceil(F.col("q") / queries_most).cast("int").alias("qs")).where("qs > 0")
    sized = grid.join(blocks, "d")
    block = lambda count, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(count)).cast("int")
    candidates = sized.select("d", block("cs", 1).alias("c"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "id", "row", "v", F.lit(False).alias("asks"))
    queries = sized.where(is_query).select("d", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), block("qs", 2).alias("q"), "id", "row", "v", F.lit(True).alias("asks"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(dtype=bool)
        if asks.all() or not asks.any():
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, own, v = rows["id"].to_numpy(dtype=np.int64), rows["row"].to_numpy(dtype=np.int64), np.stack(rows["v"].to_numpy())
        i, j, score = best_of_block(v[asks], v[~asks], own[asks], own[~asks], ids[~asks], k)
        return pd.DataFrame({"row": own[asks][i], "query_id": ids[asks][i], "vec_id": ids[~asks][j], "score": score})

    near = candidates.union(queries).groupBy("d", "c", "q").applyInPandas(meet, "row bigint, query_id bigint, vec_id bigint, score bigint")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
