"""Exact deduplication through an extendible-hash index on shared files, in DataFrame operations.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Keys are 64-bit
hashes of the normalised text. The directory starts with one bucket and doubles until no bucket
holds more than `capacity` keys: a bucket is the shortest prefix of the key with few enough of them.
Without a given capacity, it is such that there are at least OWNED buckets a task.

Copies are combined by their bytes before they are dealt out, so a large group reaches its owner as one
row. Rows are dealt out by the directory: owner tasks hold ranges of buckets, a bucket is never split, and
there different texts of one key become a chain. The index is written to the shared folder, in this order.
Documents are looked up through the directory: by bucket, key, and the text's digest in the chain.

Of equal texts the row with the largest doc_id stays (null is the smallest). Of rows repeated with
the same doc_id and text one is kept. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import join_on_hot, lower_ascii, parallelism, stage

#: Least number of buckets a task, and the most that the directory doubles: it has up to 2 ** DEPTH entries.
OWNED, DEPTH = 4, 14


def directory(keys: DataFrame, capacity: int | None = None, depth: int = DEPTH) -> DataFrame:
    """slot (the key's first `depth` bits), bucket, local_depth: up to 2 ** depth rows. A bucket's number is its first slot."""
    slots = keys.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("slot")).agg(F.count("*").alias("n"))
    if capacity is None:
        slots = stage(slots, "exact")
        capacity = max((slots.agg(F.sum("n")).first()[0] or 0) // (OWNED * parallelism(keys.sparkSession)), 1)
    # every doubling at once: the load of the bucket that a slot is in after each of them
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - local_depth), {depth} - local_depth)"))
    loads = levels.groupBy("local_depth", "bucket").agg(F.sum("n").alias("load"))
    fit = levels.join(F.broadcast(loads), ["local_depth", "bucket"]).where((F.col("load") <= capacity) | (F.col("local_depth") == depth))
    return fit.groupBy("slot").agg(F.min(F.struct("local_depth", "bucket")).alias("at")).select("slot", "at.bucket", "at.local_depth")


def index(docs: DataFrame, capacity: int | None = None, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, bucket, key, text_sha256), rows repeated `times`; and the index: bucket,
    local_depth, key, chain (place among the texts of its key), text_sha256, rows, keep_id."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(F.col("text").cast("string")).alias("norm")).withColumn("key", F.xxhash64("norm"))
    light = stage(norm.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")).groupBy("doc_id", "key", "text_sha256").agg(F.count("*").alias("times")), "exact")
    slots = F.broadcast(stage(directory(light.select("key").distinct(), capacity, depth), "exact"))  # 2 ** depth rows at most
    slot: Column = F.shiftrightunsigned("key", 64 - depth).alias("slot")
    entries = norm.groupBy("key", "norm").agg(F.count("*").alias("rows"), F.max("doc_id").alias("keep_id"))
    entries = entries.select("key", F.sha2("norm", 256).alias("text_sha256"), "rows", "keep_id", slot).join(slots, "slot")
    owned = entries.repartitionByRange(parallelism(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "key", "text_sha256")
    owned = owned.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256")))
    files = stage(owned.select("bucket", "local_depth", "key", "chain", "text_sha256", "rows", "keep_id"), "exact")
    return light.select("*", slot).join(slots, "slot").drop("slot", "local_depth"), files


def groups(docs: DataFrame, capacity: int | None = None, depth: int = DEPTH) -> DataFrame:
    """doc_id, key, text_sha256, times, keep_id, group_size: one row for each doc_id and text."""
    light, entries = index(docs, capacity, depth)
    several = entries.where("rows > 1").select("bucket", "key", "text_sha256", F.col("keep_id").alias("__keep"), F.col("rows").alias("__rows"))
    out = join_on_hot(light, several, ["bucket", "key", "text_sha256"], "__rows")
    keep = F.when(F.col("__rows").isNull(), F.col("doc_id")).otherwise(F.col("__keep"))
    return out.select("doc_id", "key", "text_sha256", "times", keep.alias("keep_id"), F.coalesce("__rows", F.lit(1)).cast("long").alias("group_size"))


def exact_duplicates(docs: DataFrame, capacity: int | None = None, depth: int = DEPTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    out = groups(docs, capacity, depth).select("*", F.explode(F.expr("sequence(1, times)")).alias("nth"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs' rows that stay, with all their columns."""
    stays = groups(docs).where("doc_id <=> keep_id").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "times")
    key = F.xxhash64(lower_ascii(F.col("text").cast("string")))
    rows = docs.withColumn("__doc", F.col("doc_id").cast("long")).withColumn("__hash", key)
    rows = rows.join(stays, rows["__doc"].eqNullSafe(stays["__id"]) & (rows["__hash"] == stays["__key"]))
    once = rows.where("times = 1").select(*docs.columns)
    again = rows.where("times > 1").dropDuplicates(["__doc", "__hash"]).select(*docs.columns)
    return once.unionByName(again)
