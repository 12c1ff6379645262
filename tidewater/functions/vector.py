"""Vectors: array<double> columns of a fixed dimension, with distances and elementwise arithmetic as
built-in expressions. Vectors of different length have no distance (null), and so has a null vector."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.cluster import ship

#: SQL names, for statements; the bodies are inlined by the analyzer.
SQL_FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vec_cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE coalesce(try_divide(vec_dot(a, b), vec_norm(a) * vec_norm(b)), IF(size(a) = size(b), 0D, NULL)) END"),
    "vec_cosine_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN vec_cosine_similarity(a, b) IS NULL THEN NULL ELSE greatest(0D, 1D - vec_cosine_similarity(a, b)) END"),
    "vec_l2_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "vec_negative_inner_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "-vec_dot(a, b)"),
    "vec_add": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x + y)"),
    "vec_multiply": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x * y)"),
    "vec_filter_range": ("a ARRAY<DOUBLE>, low DOUBLE, high DOUBLE", "ARRAY<DOUBLE>", "filter(a, x -> x >= low AND x <= high)"),
    "vec_compare": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<BOOLEAN>", "slice(zip_with(a, b, (x, y) -> x = y), 1, least(size(a), size(b)))"),
    "vec_normalize": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(a, x -> coalesce(try_divide(x, vec_norm(a)), 0D))"),
}


def _dot_sql(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"


def _norm_sql(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (s, x) -> s + x * x))"


#: The distance operators of the dialect, written out: Spark takes no SQL function in ORDER BY.
OPERATORS = {
    "<=>": lambda a, b: f"greatest(0D, 1D - IF({_norm_sql(a)} * {_norm_sql(b)} = 0D, 0D, try_divide({_dot_sql(a, b)}, {_norm_sql(a)} * {_norm_sql(b)})))",
    "<->": lambda a, b: f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "<#>": lambda a, b: f"-{_dot_sql(a, b)}",
}


def distance_sql(op: str, a: str, b: str) -> str:
    """`a op b`; infinite where a vector is missing or of another dimension."""
    a, b = (f"CAST({x} AS ARRAY<DOUBLE>)" for x in (a, b))
    # greatest() skips nulls, so sizes are compared first
    return f"IF(size({a}) = size({b}), coalesce({OPERATORS[op](a, b)}, double('Infinity')), double('Infinity'))"


def register(spark: SparkSession) -> None:
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _c(v: Column | str | Sequence[float]) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return (v if isinstance(v, Column) else literal(v)).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a, b) -> Column:
    """0 where a vector has no length."""
    d, n = dot(a, b), norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(d, n))


def cosine_distance(a, b) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - cosine_similarity(a, b))


def l2_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def negative_inner_product(a, b) -> Column:
    return -dot(a, b)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def multiply(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def normalize(a) -> Column:
    """A vector without length stays as it is: zeros."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))


def filtered(a, keep: Callable[[Column], Column]) -> Column:
    """The components that a condition holds for, in their order."""
    return F.filter(_c(a), keep)


def filter_range(a, low: float, high: float) -> Column:
    """The components from low to high, both included."""
    return filtered(a, lambda x: (x >= low) & (x <= high))


def compare(a, b) -> Column:
    """Where components are equal, as far as both vectors go."""
    x, y = _c(a), _c(b)
    return F.slice(F.zip_with(x, y, lambda s, t: s == t), F.lit(1), F.least(F.size(x), F.size(y)))


DISTANCES = {"cosine": cosine_distance, "l2": l2_distance, "ip": negative_inner_product}


def top_k(df: DataFrame, column: str, query: Sequence[float], k: int, metric: str = "cosine", id_column: str = "vec_id") -> DataFrame:
    """The k nearest rows, exact; rows without a vector come last, ties by id."""
    distance = F.coalesce(DISTANCES[metric](column, query), F.lit(float("inf")))
    return df.withColumn("distance", distance).orderBy("distance", id_column).limit(k)


#: Vectors and queries of a task at most; queries whose distances are in memory at once.
BLOCK, QUERY_BLOCK, CHUNK = 8192, 1024, 128


def _exact(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of rows of q and v, summed in the order of the built-in expressions."""
    s, nq, nv = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for x, y in zip(q.T, v.T, strict=True):
        s += (x - y) * (x - y) if metric == "l2" else x * y
        if metric == "cosine":
            nq, nv = nq + x * x, nv + y * y
    if metric == "l2":
        return np.sqrt(s)
    if metric == "ip":
        return -s
    n = np.sqrt(nq) * np.sqrt(nv)
    return np.maximum(0.0, 1.0 - np.where(n == 0, 0.0, s / np.where(n == 0, 1.0, n)))


def _surely_farther(metric: str, q: np.ndarray, v: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Of each pair, whether rounding can't hide that k vectors are nearer."""
    nq, nv, d = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(v, axis=1)[None, :], -(q @ v.T)
    if metric == "l2":
        d, slack = nq**2 + nv**2 + 2 * d, 1e-9 * (nq**2 + nv.max() ** 2)
    elif metric == "ip":
        slack = 1e-9 * nq * nv.max()
    else:
        n = nq * nv
        d, slack = np.maximum(0.0, 1 + np.where(n == 0, 0.0, d / np.where(n == 0, 1.0, n))), 1e-9
    d[own] = np.inf
    return d > np.partition(d, k - 1, axis=1)[:, k - 1 : k] + slack


def _nearest(k: int, metric: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The k nearest vectors of a block for each of its queries; pairs without a distance come last."""

    def f(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        asks, ids = group["__ask"].to_numpy(), group["__id"].to_numpy()
        _, code = np.unique(ids, return_inverse=True)
        size = np.array([-1 if x is None else len(x) for x in group["__v"]], dtype=int)
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for n in np.unique(size[asks]):
            q, v = np.flatnonzero(asks & (size == n)), np.flatnonzero(~asks & (size == n) & (n >= 0))
            others = np.flatnonzero(~asks & ((size != n) | (n < 0)))
            others = others[np.argsort(code[others], kind="stable")]
            m = np.array([x for x in group["__v"].iloc[v]], dtype=float).reshape(len(v), max(n, 0))
            for at in range(0, len(q), CHUNK):
                some = q[at : at + CHUNK]
                if len(v):
                    own = code[some][:, None] == code[v][None, :]
                    mine, left = np.array([x for x in group["__v"].iloc[some]], dtype=float).reshape(len(some), n), ~own
                    with np.errstate(all="ignore"):
                        if len(v) > k:
                            left &= ~_surely_farther(metric, mine, m, own, k)
                        a, b = np.nonzero(left)
                        for i in range(0, len(a), 1 << 17):
                            x, y = a[i : i + (1 << 17)], b[i : i + (1 << 17)]
                            found.append((some[x], v[y], _exact(metric, mine[x], m[y])))
                for i in some:  # what has no distance fills up the places that are left
                    if sum(code[v] != code[i]) < k and len(others):
                        fill = others[code[others] != code[i]][:k]
                        found.append((np.full(len(fill), i), fill, np.full(len(fill), np.inf)))
        a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
        none = size[a] != size[b]
        none |= size[a] < 0
        order = np.lexsort((code[b], d, none, a))
        a, b, d, none = a[order], b[order], d[order], none[order]
        first = np.searchsorted(a, a)
        best = np.arange(len(a)) - first < k
        out = pd.DataFrame({"query_id": ids[a[best]], "vec_id": ids[b[best]], "distance": pd.array(d[best], dtype="object")})
        out.loc[none[best], "distance"] = None
        return out

    return f


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str, keys: Sequence[str]) -> DataFrame:
    """query_id, vec_id, distance: the k nearest vectors of each query in each group of keys. A query is not its
    own neighbour; rows without an id take no part."""
    ship(queries.sparkSession)

    def side(df: DataFrame, name: str, column: str, ask: bool) -> DataFrame:
        v = F.col(column).cast("array<double>")
        whole = F.when(~F.exists(v, lambda x: x.isNull()), v)
        return df.where(F.col(name).isNotNull()).select(*keys, F.col(name).alias("__id"), whole.alias("__v"), F.lit(ask).alias("__ask"))

    rows = side(queries, "query_id", "q", True).unionByName(side(vectors, "vec_id", "v", False))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("distance", T.DoubleType())])
    return rows.groupBy(*keys).applyInPandas(_nearest(k, metric), schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, distance, rank: each query's k nearest, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "distance", "rank")


def numbers(n: int) -> Column:
    """0 to n - 1, a row each."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def dealt(column: str, n: int | Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), n if isinstance(n, Column) else F.lit(n)).cast("int")


def knn_batch(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "ip", id_column: str = "vec_id", column: str = "embedding", blocks: int | None = None) -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest vectors of each query. Queries are dealt out in
    blocks against blocks of vectors, each keeps its own k best, and those are merged. Within a block, products of
    matrices tell which vectors may be near, and only their distances are worked out."""
    n = blocks or max(1, math.ceil(vectors.count() / BLOCK))
    parts = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    q = queries.select(F.col(id_column).alias("query_id"), F.col(column).alias("q"), dealt(id_column, parts, 1).alias("__part"), numbers(n).alias("__block"))
    v = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).alias("v"), dealt(id_column, n).alias("__block"), numbers(parts).alias("__part"))
    return ranked(nearest(q, v, k, metric, ["__block", "__part"]), k)
