import math

import pytest
from pyspark.sql import functions as F

from tidewater import registry
from tidewater.functions import vector
from tidewater.operators.ann import IVFIndex


def plain(queries, vectors, k, metric):
    """Every pair, by the built-in expressions."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = q.crossJoin(v).where("query_id <> vec_id").select("query_id", "vec_id", vector.DISTANCES[metric]("q", "v").alias("distance")).collect()
    out = {}
    for i, j, d in pairs:
        out.setdefault(i, []).append((d is None, d or 0.0, j))
    return sorted((i, r, j, None if none else d) for i, xs in out.items() for r, (none, d, j) in enumerate(sorted(xs)[:k], 1))


def got(df):
    return sorted((x["query_id"], x["rank"], x["vec_id"], None if x["distance"] is None else x["distance"] + 0.0) for x in df.collect())


@pytest.mark.parametrize("metric", sorted(vector.DISTANCES))
def test_no_neighbour_is_lost(spark, sf, metric):
    """With the defaults of the index; its 4 nearest cells alone hold only some of the neighbours."""
    e = registry.load(spark, sf, "embeddings")
    q, index = e.where("vec_id % 20 = 0"), IVFIndex(e)
    want = plain(q, e, 10, metric)
    assert len(want) == 250 and got(index.batch(q, 10, metric)) == want and got(vector.knn_batch(q, e, 10, metric)) == want
    assert got(index.batch(q, 10, metric, exact=False)) != want
    v = [float(x) for x in q.where("vec_id = 20").first()["embedding"]]
    near = [(r["vec_id"], r["distance"]) for r in index.search(v, 10, metric).collect()]
    assert near == [(r["vec_id"], r["distance"]) for r in vector.top_k(e, "embedding", v, 10, metric).collect()]


@pytest.mark.parametrize("metric", sorted(vector.DISTANCES))
def test_far_cells_stay_unread(spark, metric):
    """Clusters of different lengths, far apart: exact, though bounds leave cells out."""
    rows = [(i, [math.cos(i % 5) * 10 * (i % 5 + 1) + (i * 37 % 11) / 50, math.sin(i % 5) * 10 * (i % 5 + 1) + (i * 53 % 13) / 50]) for i in range(200)] + [(300, [0.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q, index = e.where("vec_id % 20 = 0"), IVFIndex(e, cells=6)
    assert got(index.batch(q, 5, metric, probes=1)) == plain(q, e, 5, metric)


def test_odd_vectors(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(30)] + [(40, None), (41, [1.0]), (42, []), (60, [None, 2.0]), (80, [0.0, 0.0]), (None, [1.0, 1.0]), (100, [1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for metric in ("l2", "ip"):  # cosine_distance itself gives 0 without a vector
        for k in (3, 50):
            assert got(vector.knn_batch(e.where("vec_id % 20 = 0"), e, k, metric, blocks=3)) == plain(e.where("vec_id % 20 = 0"), e, k, metric)


def test_recall_is_of_every_20th_vector_and_defaults(spark, sf, monkeypatch):
    asked, passed = [], []
    batch = IVFIndex.batch
    monkeypatch.setattr(IVFIndex, "batch", lambda self, q, k, *a, **b: (asked.extend(r["vec_id"] for r in q.collect()), passed.append((a, b))) and batch(self, q, k, *a, **b))
    assert registry.ann_recall(spark, sf).first()[0] >= 0.9
    assert sorted(asked) == list(range(0, 500, 20)) and passed == [((), {})]


def test_search_set_grows_with_the_table(spark, sf):
    from oracle import connect, rows

    found = registry.QUERIES["knn_search_set"](spark, sf).toPandas()
    assert set(found["query_id"]) == set(range(0, 500, 20)) and rows(found) == rows(connect(sf).sql(registry.SQL["knn_search_set"]).df())
