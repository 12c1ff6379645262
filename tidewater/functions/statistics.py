"""Column statistics: ANALYZE in one aggregate, distributions with selectivities, least-squares fits."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the selectivity that is assumed where nothing is known.
DEFAULT_SELECTIVITY = 0.5


@dataclass
class ColumnDistribution:
    """What ANALYZE knows of a column. Numeric columns: the ranks of some of their sorted values, at
    most `steps` apart. Others: the counts of their most frequent values."""

    rows: int
    nulls: int
    distinct: int
    low: float | None = None
    high: float | None = None
    values: list[float] = field(default_factory=list)  # quantiles, in order
    common: dict[str, int] = field(default_factory=dict)

    @property
    def present(self) -> int:
        return self.rows - self.nulls

    def below(self, x: float, inclusive: bool) -> float:
        """Share of the values that are smaller (or equal)."""
        if not self.values:
            return DEFAULT_SELECTIVITY
        at = bisect_right(self.values, x) if inclusive else bisect_left(self.values, x)
        return at / len(self.values)

    def selectivity(self, op: str, value: float | str) -> float:
        """Share of all rows that satisfy `column op value`; nulls satisfy nothing."""
        held = self.present / self.rows if self.rows else 0.0
        if isinstance(value, str) or not self.values:
            if op in ("=", "!=", "<>") and self.distinct:
                share = self.common.get(str(value), 0) / self.present if str(value) in self.common and self.present else 1 / self.distinct
                return held * (share if op == "=" else 1 - share)
            return DEFAULT_SELECTIVITY
        equal = self.below(value, True) - self.below(value, False) or (1 / self.distinct if self.distinct and self.low <= value <= self.high else 0.0)
        share = {
            "=": equal, "!=": 1 - equal, "<>": 1 - equal, "<": self.below(value, False), "<=": self.below(value, True),
            ">": 1 - self.below(value, True), ">=": 1 - self.below(value, False),
        }.get(op)
        return DEFAULT_SELECTIVITY if share is None else held * min(max(share, 0.0), 1.0)

    def row_estimate(self, op: str, value: float | str) -> int:
        return round(self.selectivity(op, value) * self.rows)


def analyze(df: DataFrame, steps: int = 200) -> dict[str, ColumnDistribution]:
    """Statistics of all columns from one pass: counts, distinct values, ranges and quantiles."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    plain = [f.name for f in df.schema if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(F.col(c)).alias(f"n{i}"))
        if c in plain:
            aggs.append(F.approx_count_distinct(F.col(c), 0.01).alias(f"d{i}"))
        if c in numeric:
            q = [j / steps for j in range(steps + 1)]
            aggs += [F.min(F.col(c)).alias(f"l{i}"), F.max(F.col(c)).alias(f"h{i}"), F.percentile_approx(F.col(c).cast("double"), q, 10_000).alias(f"q{i}")]
    row = df.agg(*aggs).first().asDict()
    out = {}
    for i, c in enumerate(df.columns):
        d = ColumnDistribution(row["rows"], row["rows"] - row[f"n{i}"], row.get(f"d{i}") or 0)
        if c in numeric and row[f"n{i}"]:
            d.low, d.high, d.values = float(row[f"l{i}"]), float(row[f"h{i}"]), list(row[f"q{i}"])
        out[c] = d
    return out


def common_values(df: DataFrame, column: str, most: int = 100) -> dict[str, int]:
    """The most frequent values of a column, `most` of them at most."""
    got = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(most).collect()
    return {str(r[0]): r[1] for r in got}


@dataclass
class LinearModel:
    slope: float
    intercept: float

    def __call__(self, x: float) -> float:
        return self.slope * x + self.intercept


def fit_line(df: DataFrame, x: str, y: str) -> LinearModel | None:
    """Least squares; None for fewer than two rows or x without variance."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    row = df.agg(F.regr_slope(b, a).alias("s"), F.regr_intercept(b, a).alias("i"), F.count("*").alias("n"), F.var_pop(a).alias("v")).first()
    if row["n"] < 2 or row["v"] is None or row["v"] < 1e-10 or row["s"] is None or math.isnan(row["s"]):
        return None
    return LinearModel(row["s"], row["i"])
