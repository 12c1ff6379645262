"""Substring deduplication over indexed blocks: words that stand in a run of 50 which also starts in a
document with a smaller doc_id are removed. Blocks are grouped by hash; nothing is parsed into longest
factors (the README says why).

Of every WINDOW consecutive words the run of GRAM words with the smallest hash is the anchor (the first of
equals), so equal windows have equal anchors at the same place; the windows of one anchor form a block,
and all words under them are hashed as one. Every block of every document is indexed, with the smallest
doc_id that holds it.

A block that a smaller document holds, too, repeats as a whole. Where documents share an anchor but not its
block, a repeated span ends within: these blocks are checked window by window, among the first documents
of each such block only.

Windows are judged on the input. A window that repeats only within its own document, or rows that share
a doc_id, remove nothing. Null texts have no words; texts of fewer than 50 words lose none. Rows with
a null doc_id neither lose words nor make others lose any. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import WordHashes, join_on_hot, map_arrow, mix, slices, stage

WINDOW, GRAM = 50, 26
BASE = 0x9E3779B97F4A7C15
_hash = WordHashes()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n, and its inverse."""
    if len(_powers[0]) <= n:
        size = max(2 * n, 1 << 15)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size + 1, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Words:
    """A text's words, with hashes of any run of them."""

    def __init__(self, text: str):
        self.words = text.encode().split()
        self.n = len(self.words)
        if self.n >= WINDOW:
            up, self.down = powers(self.n)
            self.sums = np.append(np.uint64(0), np.cumsum(_hash.of(self.words) * up[:-1], dtype=np.uint64))

    def runs(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from first to before end."""
        return mix((self.sums[end] - self.sums[first]) * self.down[first] + (end - first).astype(np.uint64))

    def windows(self, first: np.ndarray) -> np.ndarray:
        return self.runs(first, first + WINDOW)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors' and blocks' hashes, and the first and last window of each block."""
        if self.n < WINDOW:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        at = np.arange(self.n - GRAM + 1)
        grams = self.runs(at, at + GRAM)
        wide = WINDOW - GRAM + 1
        anchor = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1) + np.arange(self.n - WINDOW + 1)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(first[1:], len(anchor)) - 1
        place = (anchor[first] - first).astype(np.uint64)
        return grams[anchor[first]], mix(self.runs(first, last + WINDOW) + place), first, last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _index(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in slices(batches):
        ids, anchors, blocks = [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, k, _, _ = Words(t or "").blocks()
            k, keep = np.unique(k, return_index=True)
            ids.append(np.full(len(k), d))
            anchors.append(a[keep])
            blocks.append(k)
        if ids:
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(anchors)), _signed(np.concatenate(blocks)), pa.array(np.concatenate(ids).astype(np.int64))], ["anchor", "block", "doc_id"])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])


def _unpacked(column: pa.Array) -> list[str]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(p).decode() for p in column.to_pylist()]


def _boundaries(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """doc_id, packed, blocks: the windows of the given blocks."""
    for b in slices(batches, 256):
        ids, anchors, found = [], [], []
        for d, t, asked in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), b.column(2).to_pylist(), strict=True):
            w = Words(t)
            a, k, first, last = w.blocks()
            asked = np.isin(k.view(np.int64), np.array(asked, np.int64))
            n = last[asked] - first[asked] + 1
            at = np.repeat(first[asked] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            if len(at):
                h = np.unique(w.windows(at))
                found.append(h)
                ids.append(np.full(len(h), d))
        if ids:
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), pa.array(np.concatenate(ids).astype(np.int64))], ["window", "doc_id"])


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """doc_id, packed, blocks, windows: what is left without the repeated blocks and windows."""
    for b in slices(batches, 256):
        words, removed, digests, left = [], [], [], []
        for t, blocks, windows in zip(_unpacked(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            w = Words(t)
            gone = np.zeros(w.n, bool)
            if w.n >= WINDOW and (blocks or windows):
                _, k, first, last = w.blocks()
                starts = np.zeros(w.n - WINDOW + 1, bool)
                if blocks:
                    whole = np.isin(k.view(np.int64), np.array(blocks, np.int64))
                    starts = np.repeat(whole, last - first + 1)
                if windows:
                    starts |= np.isin(w.windows(np.arange(w.n - WINDOW + 1)).view(np.int64), np.array(windows, np.int64))
                edge = np.zeros(w.n + 1, np.int64)
                edge[: len(starts)] += starts
                edge[WINDOW : WINDOW + len(starts)] -= starts
                gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([x for x, g in zip(w.words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(w.words)
            words.append(w.n)
            removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            left.append(kept.decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(left)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def repeated_spans_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = stage(map_arrow(docs.where("doc_id is not null"), _index, "anchor long, block long, doc_id long"), "rlz")
    # anchors of several documents: their first, and whether they stand in one block only
    anchors = index.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("block").alias("b0"), F.max("block").alias("b1"), F.count("*").alias("n"))
    anchors = anchors.where("first < last").select("anchor", "first", (F.col("b0") != F.col("b1")).alias("split"), "n")
    shared = stage(join_on_hot(index, stage(anchors, "rlz"), ["anchor"], "n", "inner"), "rlz")
    whole = shared.where("not split and doc_id > first").select("doc_id", "block")
    mixed = shared.where("split").select("anchor", "block", "doc_id")
    firsts = mixed.groupBy("anchor", "block").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    mixed = stage(join_on_hot(mixed, stage(firsts, "rlz"), ["anchor", "block"], "n", "inner").select("block", "doc_id", "first"), "rlz")
    whole = whole.union(mixed.where("doc_id > first").select("doc_id", "block"))
    asked = mixed.where("doc_id = first").groupBy("doc_id").agg(F.collect_set("block").alias("blocks"))
    packed = map_arrow(docs, _packed, "doc_id long, packed binary")
    windows = stage(map_arrow(packed.join(asked, "doc_id").select("doc_id", "packed", "blocks"), _boundaries, "window long, doc_id long"), "rlz")
    again = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("window", "first", "n")
    again = join_on_hot(windows, stage(again, "rlz"), ["window"], "n", "inner").where("doc_id > first")
    # a document's own blocks and windows: as many as it has words at most
    found = whole.select("doc_id", "block", F.lit(None).cast("long").alias("window")).unionByName(again.select("doc_id", F.lit(None).cast("long").alias("block"), "window"))
    found = stage(found.groupBy("doc_id").agg(F.collect_set("block").alias("blocks"), F.collect_set("window").alias("windows")), "rlz")
    rows = packed.where("doc_id is not null").join(found, "doc_id", "left").unionByName(packed.where("doc_id is null").withColumns({c: F.lit(None).cast("array<long>") for c in ("blocks", "windows")}))
    return map_arrow(rows.select("doc_id", "packed", "blocks", "windows"), _remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
