"""Quality classifier by importance resampling: the ratio of two hashed n-gram models, one of target
text and one of the raw text, sampled by Gumbel top-k.

Tokens are runs of word characters and runs of punctuation; features are single tokens, pairs of
neighbours, and one feature for a token that repeats the one before it, hashed into 2 ** BITS slots.
The raw model counts every n-gram of every document. The target model counts the documents labelled
as good among at most `sample` labelled ones (those with the smallest hashes). A document's
log weight is the sum over its n-grams of log target / raw minus a tilt; the tilt, an
amount a n-gram, is where held-out good and bad labelled documents are told apart best. As many
documents are drawn as weigh over 0: the k highest of log weight / temperature + seeded Gumbel noise.

Null and empty texts have no n-grams, weight -infinity, and go. Without good labels there is no
target, and all stay. Rows that tie with the k-th stay with it, so repeated rows share their fate.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import id_and_text, map_arrow, mix, slices, stage

BITS = 16
#: Labelled documents that the target model and the tilt are fitted on.
SAMPLE = 20_000
TEMPERATURE = 1.0
SEED = 29
REPEAT = 1
_tokens = re.compile(r"\w+|[^\w\s]+").findall


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


_hash = TokenHashes()


def features(text: str) -> np.ndarray:
    """The slots of a text's n-grams, repetitions included."""
    tokens = _tokens(text)
    h = np.fromiter(map(_hash.__getitem__, tokens), np.uint64, len(tokens))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pairs[h[:-1] == h[1:]] = REPEAT
    return (np.concatenate([mix(h), pairs]) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """slot, raw, target: one row for each slot that a task has seen."""
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for b in slices(batches):
        found = [features(t or "") for t in b.column(1).to_pylist()]
        fit = [f for f, good in zip(found, b.column(2).to_pylist(), strict=True) if good]
        raw += np.bincount(np.concatenate(found), minlength=len(raw))
        if fit:
            target += np.bincount(np.concatenate(fit), minlength=len(raw))
    seen = np.flatnonzero(raw)
    for i in range(0, len(seen), 10_000):
        at = seen[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["slot", "raw", "target"])


def _weigh(batches: Iterable[pa.RecordBatch], ratio: np.ndarray) -> Iterable[pa.RecordBatch]:
    for b in slices(batches):
        found = [features(t or "") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([float(ratio[f].sum()) for f in found], pa.float64()), b.column(2), b.column(3)],
            ["doc_id", "n_grams", "log_ratio", "quality", "held_out"],
        )


def tilt_of(good: np.ndarray, bad: np.ndarray) -> float:
    """The log ratio a n-gram that tells good from bad documents with the best balanced accuracy."""
    if not len(good):
        return 0.0
    if not len(bad):
        return float(np.quantile(good, 0.005))
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2])
    right = np.mean(good[:, None] >= cuts[None, ::max(1, len(cuts) // 2000)], axis=0) + np.mean(bad[:, None] < cuts[None, ::max(1, len(cuts) // 2000)], axis=0)
    return float(cuts[::max(1, len(cuts) // 2000)][int(np.argmax(right))])


def kth_largest(df: DataFrame, column: str, k: int, small: int = 10_000) -> float:
    """The k-th largest value: the range is narrowed by histograms until few values are left in it."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        if low == high or inside.count() <= small:
            left = [r[0] for r in inside.select(column).orderBy(F.desc(column)).limit(small).collect()]
            return left[min(k - above, len(left)) - 1]
        width = (high - low) / 1000
        slot = F.least(F.floor((F.col(column) - low) / F.lit(width)), F.lit(999))
        for row in sorted(inside.groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda r: -r["s"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]


def importance(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, key (with noise), kept: one row for each row of docs."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)) == 0)
    # at most `sample` rows
    rows = id_and_text(docs).join(F.broadcast(stage(chosen, "dsir")), "doc_id", "left")
    fit = (F.col("quality") > 0) & ~F.col("held_out")
    counts = map_arrow(rows.select("doc_id", "text", F.coalesce(fit, F.lit(False)).alias("fit")), _count, "slot long, raw long, target long")
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for slot, r, t in counts.groupBy("slot").agg(F.sum("raw"), F.sum("target")).collect():  # at most 2 ** BITS rows
        raw[slot], target[slot] = r, t
    smooth = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * len(c)))
    ratio = smooth(target) - smooth(raw) if target.any() else np.zeros(len(raw))
    weighed = stage(map_arrow(rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality"), "held_out"), _weigh, "doc_id long, n_grams long, log_ratio double, quality int, held_out boolean", ratio=ratio), "dsir")
    held = weighed.where("held_out and n_grams > 0").select("quality", F.expr("log_ratio / n_grams").alias("mean")).limit(2 * sample).toPandas()
    held = held.dropna()
    tilt = tilt_of(held.loc[held.quality > 0, "mean"].to_numpy(), held.loc[held.quality <= 0, "mean"].to_numpy()) if target.any() else -1.0
    weight = F.when(F.col("n_grams") > 0, F.col("log_ratio") - F.lit(tilt) * F.col("n_grams"))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed + 2)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = weighed.select("doc_id", "n_grams", weight.alias("log_weight"), (weight / temperature - F.log(-F.log(uniform))).alias("key"))
    keyed = stage(keyed, "dsir")
    k = keyed.where("log_weight > 0").count()
    bar = kth_largest(keyed.where("key is not null"), "key", k) if k else float("inf")
    kept = F.coalesce(F.col("key") >= bar, F.lit(not target.any()))
    return keyed.select("doc_id", "n_grams", F.coalesce("log_weight", F.lit(float("-inf"))).alias("log_weight"), "key", kept.alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """docs' rows that are drawn, with all their columns; of rows that share a doc_id all stay if one does."""
    drawn = importance(docs, labels, **kw).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(drawn["__id"]), "left_semi")
