"""Partitioners: hash, range, round robin and random."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("hash", "range", "round_robin", "random")


def partition(df: DataFrame, kind: str, n: int, column: str | None = None, seed: int = 0) -> DataFrame:
    """df dealt over n partitions."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is not one of {', '.join(KINDS)}")
    if kind in ("hash", "range") and column is None:
        raise ValueError(f"{kind} partitioning needs a column")
    if kind == "hash":
        return df.repartition(n, column)
    if kind == "range":
        return df.repartitionByRange(n, column)
    return df.repartition(n) if kind == "round_robin" else df.repartition(n, F.rand(seed))


def sizes(df: DataFrame) -> DataFrame:
    """part, n: how many rows each partition has."""
    return df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
