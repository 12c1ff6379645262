"""Mixing sources to target weights by capped water-filling.

Sources share a number of words by weight. A source's target stops at max_epochs times its own
size; the excess is shared again by weight among the others until none is above. A document is then
repeated as often as whole epochs fit, and a seeded sample of its source is taken once more: sources'
documents stand in a seeded random order, and are taken from the front until the target is met. At
most one document a source, where the sample ends, is taken in part.

Null texts have no words. A null source is a source of its own and comes last. Repeated rows count
once each, also in the mix. An empty table has no rows; a source without words has the target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, global_rank, join_on_hot, stage

SEED = 17
BUCKETS = 4096


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """sources (weight, source_size) with their target. Each round is one aggregate of sources."""
    level, cap = 0.0, F.col("source_size") * F.lit(max_epochs)
    while True:
        above = F.lit(level) * F.col("weight") > cap
        row = sources.agg(F.sum(F.when(above, cap)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if not row["free"]:
            return sources.withColumn("target", cap.cast("double"))
        now = (total - (row["held"] or 0.0)) / row["free"]
        if now <= level:
            return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")).cast("double"))
        level = now


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, whole (full repetitions), taken (words in all). The
    weights go to the sources in their order, and start again after the last. A column `row` that tells rows apart
    is passed on, if named."""
    own = [row] if row else []
    # source as (is null, value): null-safe, and null comes last
    light = docs.select(
        *own,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("none"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    light = stage(light.withColumn("order", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("order", 52).cast("int")), "mix")
    buckets = stage(light.groupBy("none", "source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "mix")
    sources = buckets.groupBy("none", "source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs"))
    sources = global_rank(sources, [F.col("none"), F.col("source")], "mix", "rank")
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    sources = water_fill(sources, total, max_epochs)
    words = F.round("target").cast("long")
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("try_divide(target, source_size)").cast("long")).otherwise(0))
    sources = sources.withColumn("extra", F.greatest(words - F.col("whole") * F.col("source_size"), F.lit(0)))
    # where in the order of its documents a source's extra words end: in which bucket, and after how many words
    before = F.sum("words").over(Window.partitionBy("none", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = buckets.select("none", "source", "bucket", "words", F.coalesce(before, F.lit(0)).alias("before")).join(sources.select("none", "source", "extra"), ["none", "source"])
    ends = ends.where("before <= extra and extra < before + words").groupBy("none", "source").agg(F.max("bucket").alias("cut"), F.max("before").alias("before"))
    sources = stage(sources.join(ends, ["none", "source"], "left").select("none", "source", "docs", "source_size", "target", "whole", "extra", F.coalesce("cut", F.lit(BUCKETS)).alias("cut"), F.coalesce("before", F.lit(0)).alias("before")), "mix")

    rows = join_on_hot(light, sources, ["none", "source"], "docs", "inner")
    rest = rows.where("bucket <> cut").withColumn("part", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0))
    inside = Window.partitionBy("none", "source").orderBy("order", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("bucket = cut").withColumn("part", F.greatest(F.least(F.col("extra") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0)), F.col("size")), F.lit(0)))
    out = rest.unionByName(edge)
    return out.select(*own, "doc_id", F.when(~F.col("none"), F.col("source")).alias("source"), "size", "source_size", "target", "whole", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken. A document that is taken in part
    comes with its first words. Rows are numbered first, so that repeated rows are taken each by its own plan."""
    rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "mix")
    plan = mixture(rows, row="__row", **kw).select("__row", F.col("size").alias("__size"), F.col("whole").alias("__whole"), (F.col("taken") - F.col("whole") * F.col("size")).alias("__part"))
    rows = rows.join(plan, "__row")
    whole = F.when(F.col("__part") >= F.col("__size"), F.lit(1)).otherwise(0) + F.col("__whole")
    copies = F.when(whole > 0, F.array_repeat(F.lit(-1).cast("long"), whole.cast("int"))).otherwise(F.array().cast("array<long>"))
    part = F.when((F.col("__part") > 0) & (F.col("__part") < F.col("__size")), F.array(F.col("__part"))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("__cut", F.explode(F.concat(copies, part)))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("__cut"), F.lit(0)).cast("int")), "")
    return rows.select(*[F.when(F.col("__cut") < 0, F.col("text")).otherwise(head).alias("text") if c == "text" else c for c in docs.columns])
