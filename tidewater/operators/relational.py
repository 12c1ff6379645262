"""Relational operators that Spark has no single call for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], right_columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with the right row of the same `by` that is the last at or before it in `on`. Both
    sides are put in one order per key, and the last right row is carried forward: one shuffle, and no
    pairs are made. Left rows without one get nulls."""
    r = right.select(*by, on, F.struct(*right_columns).alias("__r"), F.lit(1 if strict else 0).alias("__side"))
    left_side = 0 if strict else 1
    both = left.select(*by, on, F.struct(*left.columns).alias("__l"), F.lit(left_side).alias("__side")).unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__m", F.last("__r", ignorenulls=True).over(order)).where(F.col("__l").isNotNull())
    return out.select("__l.*", *[F.col("__m")[c].alias(c) for c in right_columns])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high] that hold them. Ranges are laid out over buckets of a width near
    their usual length, so that only rows of one bucket meet."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    r = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__b").where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__b")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """A join on a key of which a few values hold most of left's rows: these are dealt over `salts`
    partitions, against as many copies of right's row."""
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    ls = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    rs = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return ls.join(rs, [key, "__salt"], how).drop("__salt")


def distinct_ordered(df: DataFrame, columns: Sequence[str], order: Sequence[Column | str], ascending: bool = True) -> DataFrame:
    """DISTINCT columns ordered by something that isn't among them: by its least (or greatest) value."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    pick = F.min if ascending else F.max
    out = df.groupBy(*columns).agg(*[pick(k).alias(f"__o{i}") for i, k in enumerate(keys)])
    return out.orderBy(*[F.col(f"__o{i}").asc() if ascending else F.col(f"__o{i}").desc() for i in range(len(keys))], *columns).select(*columns)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the first row in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def merged_names(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join, columns that both have named table__column."""
    both = set(map(str.lower, left.columns)) & set(map(str.lower, right.columns))
    rename = lambda df, name: df.select(*[F.col(c).alias(f"{name}__{c}" if c.lower() in both else c) for c in df.columns])
    return rename(left, left_name), rename(right, right_name)
