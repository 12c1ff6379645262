"""Nearest neighbours over an inverted file of k-means cells. Exhaustive search is in functions.vector.

A search reads the cells whose centroids are nearest first, and then every other cell that may hold a nearer
vector by the triangle inequality, so that no neighbour is lost. With exact=False it stops after the first."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.vector import BLOCK, DISTANCES, QUERY_BLOCK, dealt, dot, l2_distance, literal, nearest, norm, numbers, ranked

#: Share of the lengths at hand by which bounds are widened, for rounding.
SLACK = 1e-9


class IVFIndex:
    """Vectors by the cell of their nearest centroid."""

    def __init__(self, df: DataFrame, id_column: str = "vec_id", column: str = "embedding", cells: int = 16, seed: int = 7):
        v = df.select(F.col(id_column).alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where("v is not null")
        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f", predictionCol="cell").fit(v.withColumn("f", array_to_vector("v")))
        self.centers = [c.tolist() for c in model.clusterCenters()]
        self.vectors = model.transform(v.withColumn("f", array_to_vector("v"))).select("vec_id", "v", "cell")
        center = F.element_at(F.array(*[literal(c) for c in self.centers]), F.col("cell") + 1)
        sizes = self.vectors.groupBy("cell").agg(F.count("*").alias("n"), F.max(l2_distance("v", center)).alias("radius"), F.min(norm("v")).alias("shortest"), F.max(norm("v")).alias("longest"))
        #: Of each cell that has vectors: how many, the largest distance from its centroid, the least and the largest length.
        self.sizes = {r["cell"]: r for r in sizes.collect()}

    def _cells(self, q, probes: int):
        near = F.array_sort(F.array(*[F.struct(DISTANCES["l2"](q, c).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(self.centers)]))
        return F.transform(F.slice(near, 1, probes), lambda x: x["cell"])

    def _least(self, q: Column | str | Sequence[float], cell: int, metric: str) -> Column:
        """No vector of the cell has a smaller distance from q."""
        c, r = self.centers[cell], self.sizes[cell]
        if metric == "l2":
            d = l2_distance(q, c)
            return d - r["radius"] - SLACK * (d + r["radius"])
        spread = norm(q) * (r["radius"] + SLACK * (r["longest"] + r["radius"]))
        most = dot(q, c) + spread
        if metric == "ip":
            return -most
        length = norm(q) * F.when(most > 0, F.lit(r["shortest"])).otherwise(F.lit(r["longest"]))
        # a vector without length has the distance 1
        return F.when((length > 0) & F.lit(r["shortest"] > 0), 1.0 - most / length - SLACK).otherwise(F.lit(0.0))

    def search(self, query: Sequence[float], k: int, metric: str = "l2", probes: int = 4, exact: bool = True) -> DataFrame:
        order = sorted(range(len(self.centers)), key=lambda i: sum((a - b) ** 2 for a, b in zip(self.centers[i], query, strict=True)))
        read = order[:probes]

        def best(cells: list[int]) -> DataFrame:
            return self.vectors.where(F.col("cell").isin(cells)).select("vec_id", DISTANCES[metric]("v", query).alias("distance")).orderBy("distance", "vec_id").limit(k)

        left = [i for i in order[probes:] if i in self.sizes]
        if exact and left:
            kth = best(read).agg(F.when(F.count("*") == k, F.max("distance")).otherwise(float("inf"))).first()[0]
            least = self.vectors.sparkSession.range(1).select(*[self._least(query, i, metric).alias(f"c{i}") for i in left]).first()
            read = read + [i for i, x in zip(left, least, strict=True) if x <= kth]
        return best(read)

    def _near(self, q: DataFrame, parts: int, k: int, metric: str) -> DataFrame:
        """The nearest in each block of the cells of q (query_id, q, part, cell)."""
        blocks = F.element_at(F.array(*[F.lit(math.ceil(self.sizes[i]["n"] / BLOCK) if i in self.sizes else 0) for i in range(len(self.centers))]), F.col("cell") + 1)
        q = q.where(blocks > 0).select("query_id", "q", "part", "cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        v = self.vectors.select("vec_id", "v", "cell", dealt("vec_id", blocks).alias("block"), numbers(parts).alias("part"))
        return nearest(q, v, k, metric, ["cell", "block", "part"])

    def batch(self, queries: DataFrame, k: int, metric: str = "l2", probes: int = 4, id_column: str = "vec_id", column: str = "embedding", exact: bool = True) -> DataFrame:
        """query_id, vec_id, distance, rank."""
        parts = max(1, math.ceil(queries.count() / QUERY_BLOCK))
        q = queries.select(F.col(id_column).alias("query_id"), F.col(column).cast("array<double>").alias("q"), dealt(id_column, parts, 1).alias("part"))
        q = q.withColumn("cells", self._cells("q", probes))
        found = self._near(q.withColumn("cell", F.explode("cells")).drop("cells"), parts, k, metric)
        if exact and probes < len(self.centers):
            first = ranked(found, k)
            kth = first.groupBy("query_id").agg(F.when(F.count("distance") == k, F.max("distance")).alias("kth"))
            bounds = [F.struct(F.lit(i).alias("cell"), self._least("q", i, metric).alias("least")) for i in self.sizes]
            more = q.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
            more = more.withColumn("cell", F.explode(F.transform(F.filter(F.array(*bounds), lambda x: (x["least"] <= F.col("kth")) & ~F.array_contains("cells", x["cell"])), lambda x: x["cell"])))
            found = first.drop("rank").unionByName(self._near(more.select("query_id", "q", "part", "cell"), parts, k, metric))
        return ranked(found, k)
