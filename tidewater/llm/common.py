"""What the training-data operators share: staging in the cluster's shared folder, global
positions, hot-key joins, word hashing and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.cluster import ship

#: Words are runs of anything but ASCII white space; bytes.split() splits at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The setting of how many rows Python gets at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_dirs: dict[str, str] = {}
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a
    temporary folder, but only in local mode, where there is just one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tidewater-")
    return _own_dirs[app]


def stage(df: DataFrame, name: str, compression: str = "zstd", batch: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back. It cuts the lineage; a lost executor
    loses nothing that was written. batch: rows that Python gets at once meanwhile, where rows are large."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, batch or before)
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    _staged.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*staged: DataFrame) -> None:
    """Delete what stage() wrote, once all that reads it is written itself."""
    for df in staged:
        if path := getattr(df, "_staged", None):
            delete(df.sparkSession, path)
            _staged.remove(path)


def clear(spark: SparkSession, first: int = 0) -> None:
    """Delete all that was staged, from the first-th on: for callers whose results are written."""
    for path in _staged[first:]:
        delete(spark, path)
    del _staged[first:]


def staged() -> int:
    """How many tables are staged now."""
    return len(_staged)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only what an operator reads, so that other columns can't clash with its own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_arrow(df: DataFrame, f: Callable[..., Iterable[pa.RecordBatch]], schema: str, **kw) -> DataFrame:
    """mapInArrow with a function of (batches, **kw)."""
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: f(batches, **kw), schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterable[pa.RecordBatch]:
    """Smaller batches, so that what is derived from long texts stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


# --- positions and hot keys ----------------------------------------------------------------


def global_rank(df: DataFrame, keys: list[Column], name: str, rank: str, parts: int | None = None) -> DataFrame:
    """Number all rows from 0 in the order of keys. Rows are range-partitioned and numbered within
    their partition; only one count per partition meets in one place."""
    n = parts or parallelism(df.sparkSession)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranged = stage(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__pos")), name)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__pos").alias("__first")).collect()
    total, offsets = 0, {}
    for row in sorted(counts, key=lambda r: r["__part"]):  # one row a partition
        offsets[row["__part"]] = total - row["__first"]
        total += row["n"]
    if not offsets:
        return ranged.select("*", F.lit(0).cast("long").alias(rank)).drop("__part", "__pos")
    at = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    return ranged.select("*", (F.col("__pos") + at[F.col("__part")]).alias(rank)).drop("__part", "__pos")


def join_on_hot(left: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "left", most: int = 1000) -> DataFrame:
    """left joined with one row a group, safe where a few groups hold most of left's rows.
    groups[size] is the number of left's rows in it. At most `most` groups can hold over a
    `most`-th of all rows: those are broadcast, under that bound, and the rest is shuffled."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    bar = max(total // most, 1)
    hot = F.broadcast(groups.where(F.col(size) > bar).select(*keys, F.struct(*[c for c in groups.columns if c not in keys]).alias("__hot")))
    rest = groups.where(F.col(size) <= bar).select(*keys, F.struct(*[c for c in groups.columns if c not in keys]).alias("__rest"))
    marked = left.join(hot, keys, "left")
    # rows of hot groups need no partner in the shuffle: a salted null-like key spreads them
    cold = marked.where(F.col("__hot").isNull()).drop("__hot").join(rest, keys, how).withColumnRenamed("__rest", "__group")
    warm = marked.where(F.col("__hot").isNotNull()).withColumnRenamed("__hot", "__group")
    out = cold.unionByName(warm)
    return out.select(*left.columns, *[F.col("__group")[c].alias(c) for c in groups.columns if c not in keys])


def join_checked(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = 500_000) -> DataFrame:
    """left joined with a staged table of few columns, which is broadcast if it has at most `most` rows."""
    return left.join(F.broadcast(right) if right.count() <= most else right, key, how)


# --- words ---------------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngrams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, w holding the words' hashes."""
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i] + np.uint64(i + 1))
    return h


# --- components ----------------------------------------------------------------------------

#: Edges that one task joins; more are joined in rounds of all tasks.
ONE_TASK = 1 << 20


class UnionFind(dict):
    """Sets of numbers, each with its least one."""

    def __missing__(self, x: int) -> int:
        return x

    def find(self, x: int) -> int:
        root = x
        while (up := self[root]) != root:
            root = up
        while (up := self[x]) != root and x != root:
            self[x], x = root, up
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self[max(x, y)] = min(x, y)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    links, nodes = UnionFind(), set()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            links.join(x, y)
            nodes |= {x, y}
    ids = sorted(nodes)
    for i in range(0, len(ids), 10_000):
        some = ids[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([links.find(x) for x in some], pa.int64())], ["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id with an edge; staged. Few edges (ONE_TASK) are
    joined by one task; more by alternating large-star and small-star steps, where each round is written to
    the shared folder, and rounds grow with the logarithm of the longest path."""
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    pairs = stage(pairs, "cc")
    if pairs.count() <= ONE_TASK:
        return stage(map_arrow(pairs.repartition(1), _joined, "id long, component long"), "cc")
    seen = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, pairs = pairs, stage(small.where("u <> v").distinct(), "cc")
        drop(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stage(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots), "cc")
