"""Toxicity by a classifier chain: categories are predicted one after another, each by a linear model
that also sees the earlier categories' probabilities.

A document's features are which words it holds (lower case), and which beginnings of words, so that
inflected forms count together; they are hashed into 2 ** BITS slots. For each category the slots most associated with it among the training rows are kept, and a logistic
regression is fitted on them and on the log odds of the categories before. While training, those
log odds are out of fold: each row's come from models that have not seen it. Models are fitted on at
most `sample` labelled rows (those with the smallest hashes); every whole text is scored.

Null and empty texts hold no words. Rows of labels with a null category are not trained on; without
labels, or with one class only, a category's probability is its share. Repeated rows get equal results; of a labelled
document that comes several times one row is trained on. Slots are counted and selected by Spark; the driver gets the
labelled rows with no slots but those that a model may select, so its memory does not grow with the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import id_and_text, map_arrow, slices, stage

BITS = 20
#: Labelled rows to train on, folds, words a model looks at, and the least z-score of such a word.
SAMPLE, FOLDS, WORDS, LEAST_Z = 8_000, 5, 256, 4.0
#: Lengths of the beginnings.
STEMS = range(3, 9)
SEED = 31
_words = re.compile(r"\w+").findall


class Slots(dict):
    """A word's slots: its own and those of its beginnings, as bytes."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 150_000:
            self.clear()
        parts = [word, *[f"{word[:k]}*" for k in STEMS if k < len(word)]]
        h = self[word] = np.array([xxhash.xxh64_intdigest(p) & ((1 << BITS) - 1) for p in parts], np.int32).tobytes()
        return h


_slots = Slots()


def words_of(text: str) -> np.ndarray:
    """The slots of a text's words and their beginnings, once each."""
    return np.unique(np.frombuffer(b"".join(map(_slots.__getitem__, set(_words(text.lower())))), np.int32))


@dataclass
class Linear:
    """A logistic regression on a few slots and on the log odds of earlier categories."""

    slots: np.ndarray
    weights: np.ndarray  # of the slots, then of the earlier categories
    bias: float

    def design(self, rows: Sequence[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), len(self.slots) + earlier.shape[1]))
        x[:, len(self.slots) :] = earlier
        if len(self.slots) and len(rows):
            flat = np.concatenate(rows)
            at = np.minimum(np.searchsorted(self.slots, flat), len(self.slots) - 1)
            hit = self.slots[at] == flat
            x[np.repeat(np.arange(len(rows)), [len(r) for r in rows])[hit], at[hit]] = 1.0
        return x

    def log_odds(self, rows: Sequence[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        return np.clip(self.design(rows, earlier) @ self.weights + self.bias, -12, 12)


def fit(rows: Sequence[np.ndarray], earlier: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Linear:
    """Newton's method on the slots that y depends on most."""
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    model = Linear(np.zeros(0, np.int32), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
    held = np.repeat(y, [len(r) for r in rows])
    n, hits = np.bincount(flat, minlength=1 << BITS), np.bincount(flat, weights=held, minlength=1 << BITS)
    z = np.abs(hits - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    top = np.argsort(-z, kind="stable")[:WORDS]
    model.slots = np.sort(top[(z[top] >= LEAST_Z) & (n[top] >= 4)]).astype(np.int32)
    x = np.column_stack([model.design(rows, earlier), np.ones(len(rows))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    w[-1], penalty[-1] = model.bias, 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def fit_chain(rows: Sequence[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """A model for each column of labels; later ones see out-of-fold log odds of the earlier ones."""
    models: list[Linear] = []
    earlier = np.zeros((len(rows), 0))
    for j in range(labels.shape[1]):
        y, own = labels[:, j].astype(float), np.zeros(len(rows))
        for f in range(FOLDS):
            out = np.flatnonzero(folds == f)
            inside = np.flatnonzero(folds != f)
            own[out] = fit([rows[i] for i in inside], earlier[inside], y[inside]).log_odds([rows[i] for i in out], earlier[out])
        models.append(fit(rows, earlier, y))
        earlier = np.column_stack([earlier, own])
    return models


def predict_chain(models: Sequence[Linear], rows: Sequence[np.ndarray]) -> np.ndarray:
    """Probabilities, a column for each category."""
    earlier = np.zeros((len(rows), 0))
    for m in models:
        earlier = np.column_stack([earlier, m.log_odds(rows, earlier)])
    return 1 / (1 + np.exp(-earlier))


def _featurize(batches: Iterable[pa.RecordBatch], seed: int) -> Iterable[pa.RecordBatch]:
    for b in slices(batches, 64):
        found = [words_of(t or "") for t in b.column(1).to_pylist()]
        folds = [xxhash.xxh64_intdigest(str(d), seed) % FOLDS for d in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(folds, pa.int32()), *b.columns[2:]], ["doc_id", "slots", "fold", *b.schema.names[2:]])


def _only(batches: Iterable[pa.RecordBatch], slots: np.ndarray) -> Iterable[pa.RecordBatch]:
    """The rows with no slots but the given ones."""
    for b in slices(batches, 64):
        found = [np.intersect1d(np.array(x, np.int32), slots) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), *b.columns[2:]], b.schema.names)


def selected(rows: DataFrame, targets: Sequence[str]) -> np.ndarray:
    """All slots that some model of the chain, over all folds but one or over all, may select: counted by Spark, so that
    the driver gets no more than WORDS a model whatever the texts' length."""
    folds = range(FOLDS)
    sums = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in targets]).collect()}  # a row a fold
    counts = rows.select(F.explode("slots").alias("slot"), "fold", *targets).groupBy("slot").agg(
        *[F.count_if(F.col("fold") == f).alias(f"n{f}") for f in folds],
        *[F.sum(F.when(F.col("fold") == f, F.col(y)).otherwise(0)).alias(f"{y}_{f}") for y in targets for f in folds],
    )
    counts, best = stage(counts, "chain"), []
    for y in targets:
        for left_out in (None, *folds):
            of = [f for f in folds if f != left_out]
            total, held = (sum(sums[f][c] for f in of if f in sums) for c in ("n", y))
            if 0 < held < total:
                share = min(max(held / total, 1e-4), 1 - 1e-4)
                n, hits = (sum((F.col(c.format(f)) for f in of[1:]), F.col(c.format(of[0]))) for c in ("n{}", y + "_{}"))
                z = F.abs(hits - n * share) / F.sqrt(F.greatest(n, F.lit(1)) * share * (1 - share))
                some = counts.where(n > 0).select("slot", z.alias("z"))
                best.append(some.orderBy(F.desc("z"), "slot").limit(WORDS).select("slot"))
    found = reduce(DataFrame.union, best).distinct().collect() if best else []
    return np.sort(np.array([r["slot"] for r in found], np.int32))


def _score(batches: Iterable[pa.RecordBatch], models: list[Linear]) -> Iterable[pa.RecordBatch]:
    for b in slices(batches):
        p = predict_chain(models, [words_of(t or "") for t in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, j]) for j in range(p.shape[1])]], ["doc_id", *[f"p{j}" for j in range(p.shape[1])]])


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE, seed: int = SEED) -> list[Linear]:
    """The chain's models, from at most `sample` labelled documents."""
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *[(F.col(c) > 0).cast("int").alias(f"y{j}") for j, c in enumerate(categories)]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(f"y{j}").alias(f"y{j}") for j in range(len(categories))])
    known = stage(known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample), "chain")
    rows = id_and_text(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", *[f"y{j}" for j in range(len(categories))])
    targets = [f"y{j}" for j in range(len(categories))]
    schema = "doc_id long, slots array<int>, fold int, " + ", ".join(f"{y} int" for y in targets)
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    one = rows.groupBy("doc_id").agg(F.min("h").alias("h"))  # as many rows as known has, at most
    rows = rows.join(F.broadcast(one), ["doc_id", "h"]).select("doc_id", "text", *targets)
    rows = stage(map_arrow(rows, _featurize, schema, seed=seed).dropDuplicates(["doc_id"]), "chain")
    kept = map_arrow(rows, _only, schema, slots=selected(rows, targets))  # a document holds at most as many as are selected
    found = kept.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "slots").collect()
    slots = [np.array(r["slots"], np.int32) for r in found]
    y = np.array([[r[f"y{j}"] for j in range(len(categories))] for r in found], float).reshape(len(found), len(categories))
    folds = np.array([r["fold"] for r in found], int)
    return fit_chain(slots, y, folds)


def toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("toxic",), threshold: float = 0.5, **kw) -> DataFrame:
    """doc_id, p_<category> for each, and toxic: whether the last category's probability reaches the threshold."""
    models = train(docs, labels, categories, **kw)
    scored = map_arrow(id_and_text(docs), _score, "doc_id long, " + ", ".join(f"p{j} double" for j in range(len(categories))), models=models)
    last = f"p{len(categories) - 1}"
    return scored.select("doc_id", *[F.col(f"p{j}").alias(f"p_{c}") for j, c in enumerate(categories)], (F.col(last) >= threshold).alias("toxic"))
