"""Learned indexes as DataFrames: piecewise-linear segments over sorted keys (PGM), and a model of models
(RMI). A position is a key's place in the sorted order, from 0."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.cluster import ship
from tidewater.functions.statistics import fit_line
from tidewater.operators.relational import asof_join

#: The error that positions may have, and the least size and the share of the main
#: part at which a buffer of new keys is merged in.
EPSILON, LEAST_BUFFER, BUFFER_SHARE = 16, 64, 8
SEGMENT_BYTES = 48
SEGMENTS = "first double, last double, slope double, position long, n long"


def positions(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """(key, position): range-partitioned, numbered within partitions, one offset a partition added."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(F.col(key).cast("double").alias("key")).where("key is not null").repartitionByRange(n, "key")
    ranged = ranged.withColumn("__part", F.spark_partition_id())
    local = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy("key")) - 1)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("key").alias("low"))  # one row a partition
    start = counts.select("__part", (F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    return local.join(F.broadcast(start), "__part").select("key", (F.col("start") + F.col("__n")).alias("position"))


def cone(keys: np.ndarray, at: np.ndarray, epsilon: int) -> list[tuple[float, float, float, int, int]]:
    """Greedy segments: each goes on while some slope from its first key keeps all positions within
    epsilon. (first key, last key, slope, position, keys)"""
    out, i = [], 0
    while i < len(keys):
        low, high, j = 0.0, float("inf"), i + 1
        while j < len(keys):
            dx, dy = keys[j] - keys[i], at[j] - at[i]
            if dx == 0:
                if dy > epsilon:
                    break
            else:
                new_low, new_high = max(low, (dy - epsilon) / dx), min(high, (dy + epsilon) / dx)
                if new_low > new_high:
                    break
                low, high = new_low, new_high
            j += 1
        slope = (low + high) / 2 if high != float("inf") else low
        out.append((float(keys[i]), float(keys[j - 1]), slope, int(at[i]), j - i))
        i = j
    return out


class PGMIndex:
    """Segments of a table's keys; segments end at the borders of partitions, too."""

    def __init__(self, placed: DataFrame, segments: DataFrame, epsilon: int):
        self.placed, self.segments, self.epsilon = placed, segments, epsilon
        self.keys = placed.select("key")
        self._local: list | None = None

    @classmethod
    def build(cls, df: DataFrame, key: str, epsilon: int = EPSILON) -> PGMIndex:
        ship(df.sparkSession)
        placed = positions(df, key)

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame(cone(b["key"].to_numpy(), b["position"].to_numpy(), epsilon), columns=["first", "last", "slope", "position", "n"])

        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        index = cls(placed, placed.repartitionByRange(n, "key").sortWithinPartitions("key", "position").mapInPandas(fit, SEGMENTS), epsilon)
        index.keys = df.select(F.col(key).cast("double").alias("key"))  # as read, for quantiles
        return index

    def predict(self, keys: DataFrame, key: str = "key", buckets: int = 64) -> DataFrame:
        """keys with the position that their segment predicts, within epsilon of the true one: one row each, by the
        last segment that begins at or before the key. Keys and segments meet in ranges of about equally many
        indexed keys; within them both are put in order, and the last segment is carried on to the keys after it."""
        s = self.segments
        cuts = sorted(set(self.keys.approxQuantile("key", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)))) if buckets > 1 else []

        def bucket(c: Column) -> Column:
            return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= c)) if cuts else F.lit(0)

        spans = F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("last"))))
        parts = s.select(F.col("first").alias(key), F.struct("first", "last", "slope", "position").alias("__s"), spans.alias("__bucket"))
        placed = keys.where(F.col(key).isNotNull()).withColumn("__bucket", bucket(F.col(key)))
        found = asof_join(placed, parts, key, ["__bucket"], ["__s"]).where(F.col(key) <= F.col("__s.last"))
        return found.select(*keys.columns, (F.col("__s.position") + F.col("__s.slope") * (F.col(key) - F.col("__s.first"))).alias("predicted"))

    def search(self, key: float) -> list[int]:
        """All positions of a key, looked for only where its segment says."""
        hits = [s for s in self._loaded() if s[0] <= key <= s[1]]
        if not hits:
            return []
        low = min(s[3] + s[2] * (key - s[0]) for s in hits) - self.epsilon - 1
        high = max(s[3] + s[2] * (key - s[0]) for s in hits) + self.epsilon + 1
        return sorted(r["position"] for r in self.placed.where(F.col("position").between(low, high) & (F.col("key") == key)).collect())

    def range(self, low: float, high: float) -> DataFrame:
        return self.placed.where(F.col("key").between(low, high))

    def _loaded(self) -> list:
        """The segments, in order: few for each many keys, read once for single look-ups."""
        if self._local is None:
            self._local = sorted(tuple(r) for r in self.segments.collect())
        return self._local

    def rank(self, key: float) -> float:
        """About how many keys are smaller."""
        segments = self._loaded()
        i = bisect_right([s[0] for s in segments], key) - 1
        if i < 0:
            return 0.0
        first, last, slope, position, n = segments[i]
        return float(min(position + slope * (key - first), position + n) if key <= last else position + n)

    def bytes(self) -> int:
        return len(self._loaded()) * SEGMENT_BYTES


class DynamicPGMIndex:
    """An index with a buffer: new keys are read beside the main part, and merged in when there are many."""

    def __init__(self, df: DataFrame, key: str, epsilon: int = EPSILON):
        self.key, self.epsilon, self.df = key, epsilon, df.select(F.col(key).cast("double").alias(key))
        self.main, self.size = PGMIndex.build(self.df, key, epsilon), self.df.count()
        self.buffer: DataFrame | None = None
        self.buffered = 0

    def insert(self, rows: DataFrame) -> None:
        rows = rows.select(F.col(self.key).cast("double").alias(self.key))
        self.buffer = rows if self.buffer is None else self.buffer.union(rows)
        self.buffered += rows.count()
        if self.buffered >= max(LEAST_BUFFER, self.size // BUFFER_SHARE):
            self.df = self.df.union(self.buffer)
            self.main, self.size = PGMIndex.build(self.df, self.key, self.epsilon), self.size + self.buffered
            self.buffer, self.buffered = None, 0

    def range(self, low: float, high: float) -> DataFrame:
        out = self.main.range(low, high).select("key")
        if self.buffer is not None:
            out = out.union(self.buffer.select(F.col(self.key).alias("key")).where(F.col("key").between(low, high)))
        return out.orderBy("key")


class RMI:
    """Two stages of lines: the first tells which of `leaves` models of the second predicts the position."""

    def __init__(self, df: DataFrame, key: str, leaves: int = 16):
        placed = positions(df, key)
        self.leaves, self.root = leaves, fit_line(placed, "key", "position")
        self.n = placed.count()
        slope, intercept = (self.root.slope, self.root.intercept) if self.root else (0.0, 0.0)
        leaf = F.greatest(F.lit(0), F.least(F.lit(leaves - 1), F.floor((F.col("key") * slope + intercept) * leaves / max(self.n, 1)))).cast("int")
        self.placed = placed.withColumn("leaf", leaf)
        k, p = F.col("key"), F.col("position").cast("double")
        self.models = self.placed.groupBy("leaf").agg(F.coalesce(F.regr_slope(p, k), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(p, k), F.avg(p)).alias("intercept"))

    def predict(self) -> DataFrame:
        """key, position, predicted."""
        return self.placed.join(F.broadcast(self.models), "leaf").select("key", "position", (F.col("key") * F.col("slope") + F.col("intercept")).alias("predicted"))
