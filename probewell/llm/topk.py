"""Exact top-k inner products by sorted lists without random access.

Each block of candidates keeps, for every dimension, its values as a sorted list. A query reads a list from the end that raises
its score: from the top where its component is positive, from the bottom where it is negative. The lists are read in step, in
stretches of growing depth; while most candidates are open after one, bounds can't tell yet, and the next stretch goes to the end. What was read gives each candidate a partial score; the value read last bounds the rest from
above, the list's far end bounds it from below. A candidate whose upper bound is under the k-th best lower bound can't
qualify any more and is skipped from then on. Those left get their final scores by reading on to the ends of the lists, or until
nothing of theirs is unread. No candidate's vector is ever looked up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probewell.llm.common import stored

#: Part of a list's length that is read first; each further stretch doubles the depth.
FIRST = 1 / 32
#: Share of candidates still open from which on the rest is read at once.
MOST_OPEN = 0.5
LOWEST = -(2**62)


def block_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, reads: list[int] | None = None, floor: np.ndarray | None = None) -> pd.DataFrame:
    """The k best candidates of a block for each query, ties to the smaller id; fewer if the block has fewer.

    floor: for each query a score that k candidates of other blocks reach; what is below doesn't qualify. The number of list entries read is added
    to `reads`, if given.
    """
    n, dims = x.shape
    # Sums are exact: in floating point as long as they stay below 2 ** 52, else in 64-bit integers.
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * dims
    kind = np.float64 if most < 2**52 else np.int64
    order = np.argsort(x, axis=0, kind="stable")
    ordered = np.take_along_axis(x, order, axis=0).astype(kind)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    value, plus, minus = x.astype(kind), np.maximum(q, 0).astype(kind).T, np.minimum(q, 0).astype(kind).T
    row = np.arange(n)
    own = query_ids[None, :] == ids[:, None]
    sums, open_ = np.zeros((n, len(q)), kind), ~own
    before, depth = 0, 0
    while depth < n:
        busy = before > 0 and open_.mean() > MOST_OPEN
        depth = n if busy else min(n, max(2 * before, int(np.ceil(n * FIRST))))
        top, bottom = (place >= n - depth) & (place < n - before), (place >= before) & (place < depth)
        sums += np.where(top, value, 0) @ plus + np.where(bottom, value, 0) @ minus
        if reads is not None:
            reads[0] += int(top.sum(axis=0) @ (plus > 0).sum(axis=1) + bottom.sum(axis=0) @ (minus < 0).sum(axis=1))
        before = depth
        if depth == n:
            break
        unread_top, unread_bottom = (place < n - depth).astype(kind), (place >= depth).astype(kind)
        if not unread_top.any() and not unread_bottom.any():
            break
        upper = sums + unread_top @ (plus * ordered[n - depth][:, None]) + unread_bottom @ (minus * ordered[depth - 1][:, None])
        lower = sums + unread_top @ (plus * ordered[0][:, None]) + unread_bottom @ (minus * ordered[-1][:, None])
        lower[~open_] = LOWEST
        kth = np.partition(lower, -k, axis=0)[-k] if len(row) > k else LOWEST
        open_ &= upper >= (kth if floor is None else np.maximum(kth, floor))
        alive = open_.any(axis=1)
        if alive.mean() < 0.9:
            row, place, value, sums, open_ = (a[alive] for a in (row, place, value, sums, open_))
    found = []
    for j in range(len(q)):
        at = np.flatnonzero(open_[:, j])
        score, who = sums[at, j].astype(np.int64), ids[row[at]]
        best = np.lexsort((who, -score))[:k]
        found.append(pd.DataFrame({"query_id": query_ids[j], "vec_id": who[best], "score": score[best]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def task_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, block: int = 8192, query_block: int = 128) -> pd.DataFrame:
    """block_top() of a task's candidates and queries in parts that fit in memory, the k best of all parts kept; a part starts from the bounds of those before."""
    out = []
    for j in range(0, len(q), query_block):
        asked = query_ids[j : j + query_block]
        best, floor = None, np.full(len(asked), LOWEST, np.int64)
        for i in range(0, len(x), block):
            found = block_top(ids[i : i + block], x[i : i + block], asked, q[j : j + query_block], k, floor=floor)
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            last = best.groupby("query_id")["score"].agg(["size", "min"])
            last = last[last["size"] == k]["min"]
            floor = last.reindex(asked, fill_value=LOWEST).to_numpy(np.int64)
        out.append(best)
    return pd.concat(out)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 65536, query_block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products for each query.

    vectors, queries: (vec_id, embedding), with components floor(scale * x). A candidate with the query's id is the query's own row and
    isn't returned. Rows with a null id, and vectors that are null, empty or hold null or non-finite components, take no part;
    neither do vectors whose length differs from the query's. Repeated rows are candidates of their own; a repeated
    query is asked once, with its smallest vector. Fewer rows than k give them all.
    Components must keep within 2**31 after scaling, for sums of 64-bit integers.

    Random blocks of candidates, of `block` at most, meet random blocks of queries; a block pair returns k rows for each query
    at most. Candidates are copied once for each block of queries, so these are as large as a task can hold, and
    the blocks of candidates are made smaller where there would be fewer pairs than tasks at a time.
    """
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def prepared(df: DataFrame) -> DataFrame:
        whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
        return df.filter(F.coalesce(sound, F.lit(False))).select("vec_id", whole.alias("x"), F.size("embedding").alias("dims"))

    candidates = stored(prepared(vectors).withColumn("row", F.monotonically_increasing_id()))
    asked = stored(prepared(queries).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dims", F.size("x")))
    n = candidates.count()
    nq = max(1, -(-asked.count() // query_block))
    nc = max(1, -(-n // block), min(-(-n // min(block, 8192)), -(-2 * spark.sparkContext.defaultParallelism // nq)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumn("cb", F.pmod(F.xxhash64("row"), F.lit(nc)).cast("int")).drop("row").withColumn("qb", every(nq))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(nq)).cast("int")).withColumn("cb", every(nc))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, qids = a["vec_id"].to_numpy(np.int64), b["vec_id"].to_numpy(np.int64)
        return task_top(ids, np.stack(a["x"].to_numpy()).astype(np.int64), qids, np.stack(b["x"].to_numpy()).astype(np.int64), k).astype("int64")

    keys = ["dims", "cb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
