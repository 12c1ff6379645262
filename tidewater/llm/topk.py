"""Exact top-k inner-product search by aggregation without random access.

Candidates are dealt out in blocks and queries in blocks; each pair of blocks is one task. Within a
task every dimension is a list sorted by component, read from both ends: large components count for
queries with a positive weight there, small ones for a negative weight. What is read is added to a
candidate's score once; what is not lies between the two places where its lists stand, which gives
a lower and an upper bound. Candidates that no query of a chunk can want any more are read no further.
Lists are read until few candidates' upper bounds reach a query's k-th lower bound; those
candidates' scores are then resolved exactly. The first block is searched before the others, which start from
the k-th score that each query has there. As an entry in a list is read for all queries at once, both
bounds are products of matrices.

Vectors that are null or hold null or non-finite components (also after scaling), and rows without a vec_id, take
no part. Of rows with the same vec_id the one with the largest vector takes part. Missing components of
shorter vectors count as 0. Scores are exact at any magnitude: where 53 bits may not hold them, bounds allow for
rounding and scores are resolved as whole numbers. A score beyond a long counts as the nearest long.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.cluster import ship
from tidewater.llm.common import parallelism, stage

#: Most rows in a block of candidates (and least, where there are more), and in one of queries; queries read at once.
BLOCK, LEAST_BLOCK, QUERY_BLOCK, CHUNK = 1 << 15, 1 << 13, 1 << 14, 128
#: Lists are read in steps of this share of their entries from each end, until so few candidates are left.
STEP, LEFT = 0.125, 0.05
LONG = 1 << 63


def nra(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its k best vectors: highest score, then smallest id. Scores below a
    query's bar may be missing."""
    n, d = vectors.shape
    widest, tallest = (float(np.abs(x).max(initial=0.0)) for x in (queries, vectors))
    exact = widest * tallest * d < 2.0**53
    # beyond 53 bits bounds are of scaled values, and what rounding may move them by is allowed for
    q_all, v_all, slack = (queries, vectors, 0.0) if exact else (queries / widest, vectors / tallest, (d + 4) * d * 2.0**-50)
    edge = float(LONG) / widest / tallest if not exact else np.inf
    bars = np.full(len(queries), -np.inf) if bars is None else np.nextafter(bars if exact else bars / widest / tallest, -np.inf)
    order = np.argsort(v_all, axis=0, kind="stable")
    place = np.empty(order.shape, np.int32)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n, dtype=np.int32)[:, None], (n, d)), axis=0)
    lists = np.take_along_axis(v_all, order, axis=0)
    del order
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), CHUNK):
        q = q_all[at : at + CHUNK]
        live, alive = np.arange(n), query_ids[at : at + CHUNK, None] != ids[None, :]
        known, before, depth = np.zeros(alive.shape), 0, 0
        while True:
            depth = min(depth + max(math.ceil(n * STEP), 1), (n + 1) // 2)
            p = place[live]
            read = (p < depth) | (p >= n - depth)
            new = read & (p >= before) & (p < n - before)
            known += q @ np.where(new, v_all[live], 0.0).T
            lower = upper = known
            if depth < (n + 1) // 2:
                low, high, unread = q * lists[depth], q * lists[n - 1 - depth], (~read).T.astype(float)
                lower = known + np.minimum(low, high) @ unread
                upper = known + np.maximum(low, high) @ unread
            bar = bars[at : at + CHUNK] - slack
            if len(live) > k:
                of_alive = np.where(alive, lower, -np.inf)
                bar = np.maximum(bar, np.partition(of_alive, len(live) - k, axis=1)[:, len(live) - k] - slack)
            if not exact:  # scores beyond a long are ties
                bar = np.where(bar <= -edge, -np.inf, np.minimum(bar, edge - slack))
            alive &= upper + slack >= bar[:, None]
            if depth >= (n + 1) // 2 or alive.sum() <= LEFT * len(q) * n:
                break
            before, wanted = depth, alive.any(axis=0)
            if not wanted.all():
                live, alive, known = live[wanted], alive[:, wanted], known[:, wanted]
        out += [_resolved(queries[at + i], vectors, ids, live[alive[i]], k, exact) for i in range(len(q))]
    return out


def _resolved(q: np.ndarray, vectors: np.ndarray, ids: np.ndarray, left: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """The places and scores of the k best of the vectors left."""
    if exact:
        score = (vectors[left] @ q).astype(np.int64)
        best = np.lexsort((ids[left], -score))[:k]
        return left[best], score[best]
    whole = [int(x) for x in q]
    scores = (sum(a * int(b) for a, b in zip(whole, vectors[i], strict=True)) for i in left)
    found = sorted((-min(max(s, -LONG), LONG - 1), int(ids[i]), int(i)) for i, s in zip(left, scores, strict=True))[:k]
    return np.array([i for _, _, i in found], np.int64), np.array([-s for s, _, _ in found], np.int64)


def _search(k: int):
    def f(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        asks = group["query"].to_numpy()
        ids, bars, d = group["vec_id"].to_numpy(), group["bar"].to_numpy(float), max(map(len, group["v"]))
        m = np.zeros((len(group), d))
        for i, v in enumerate(group["v"]):
            m[i, : len(v)] = v
        found = []
        if asks.any() and not asks.all():
            for query, (places, scores) in zip(ids[asks], nra(m[asks], ids[asks], m[~asks], ids[~asks], k, bars[asks]), strict=True):
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[~asks][places], "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return f


def integer_vectors(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers floor(scale * x)."""
    raw = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale).alias("v"))
    raw = raw.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # doubles from 2 ** 52 on are whole, and a long may not hold them
    ints = raw.where(~bad).select("vec_id", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)).alias("v"))
    return ints.groupBy("vec_id").agg(F.max("v").alias("v"))


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, block: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among all other vectors.
    Queries are the rows whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    ship(spark)
    v = stage(integer_vectors(embeddings), "topk")
    asks = F.col("vec_id") % every == 0
    n, queries = v.agg(F.count("*"), F.count_if(asks)).first()
    block = block or min(max(math.ceil(n / parallelism(spark)), LEAST_BLOCK), BLOCK)
    blocks, query_blocks = max(math.ceil(n / block), 1), max(math.ceil(queries / query_block), 1)
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    own_q = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")
    sides = v.select("vec_id", "v", F.lit(False).alias("query"), F.lit(-math.inf).alias("bar"), own.alias("block"))
    asked = v.where(asks).select("vec_id", "v", F.lit(True).alias("query"), own_q.alias("query_block"))

    def search(bars: DataFrame, of: str, first: int, last: int) -> DataFrame:
        here = sides.where(of).select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
        there = bars.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("block"))
        return here.unionByName(there).groupBy("block", "query_block").applyInPandas(_search(k), "query_id long, vec_id long, score long")

    found = search(asked.withColumn("bar", F.lit(-math.inf)), "block = 0", 0, 0)
    if blocks > 1:
        found = stage(found, "topk")
        bars = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count("*").alias("of")).where(f"of = {k} and least > {-LONG + 1}")
        known = asked.join(bars, "vec_id", "left").withColumn("bar", F.coalesce(F.col("least").cast("double"), F.lit(-math.inf))).drop("least", "of")
        found = found.unionByName(search(known, "block > 0", 1, blocks - 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
