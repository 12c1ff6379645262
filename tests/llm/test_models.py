import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from tidewater.llm import common, mixing, queries, resampling, sharding, topk, toxicity

LABELS = "doc_id long, quality int, toxic int, other string"


# importance resampling --------------------------------------------------------------------------


def test_held_out_quality(spark, sf):
    """Labelled documents that are hidden while fitting are told apart."""
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    shown, hidden = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = resampling.importance(docs, shown).join(hidden, "doc_id").agg(F.avg((F.col("kept") == (F.col("quality") > 0)).cast("int"))).first()[0]
    assert got > 0.95


def test_resampling_of_odd_documents(spark, make):
    good = [(100 + i, f"plain words of some kind number {i} and more of them here", "a") for i in range(40)]
    bad = [(200 + i, f"BUY!! NOW!! {i}!! CHEAP!! " * 5, "a") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0, "") for i, *_ in good[:30]] + [(i, 0, 0, "") for i, *_ in bad[:10]] + [(None, 1, 1, ""), (1, None, 0, ""), (100, 1, 0, "")], LABELS)
    docs = make([*good, *bad, *ODD])
    got = resampling.importance(docs, labels).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(got) == 60 + len(ODD) and {i for i, *_ in good} <= kept and not kept & {i for i, *_ in bad} and not kept & {1, 2}
    assert sorted(r["key"] or 0 for r in got) == sorted(r["key"] or 0 for r in resampling.importance(docs, labels).collect())
    assert resampling.resampled(docs, labels).columns == docs.columns
    assert resampling.importance(docs, labels.limit(0)).where("not kept").count() == 0
    assert resampling.importance(make([]), labels).count() == 0


def test_kth_largest(spark):
    values = [random.Random(1).gauss(0, 1) for _ in range(3000)] + [0.5] * 500
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for k in (1, 100, 1500, 3500):
        assert resampling.kth_largest(df, "x", k, small=50) == sorted(values, reverse=True)[k - 1]


# toxicity ---------------------------------------------------------------------------------------


def test_held_out_toxicity(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    shown, hidden = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = toxicity.toxicity(docs, shown, ("toxic",)).withColumnRenamed("toxic", "said").join(hidden.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got["said"] == (got["toxic"] > 0)).mean() > 0.95 and got.loc[got["toxic"] == 0, "said"].mean() < 0.01


def test_chain_uses_earlier_categories():
    r = np.random.default_rng(5)
    first = r.integers(0, 2, 600)
    second = np.where(first == 1, r.integers(0, 2, 600), 0)  # only where the first is
    rows = [np.unique(np.concatenate([[10 + f], [20 + s] if r.random() < 0.6 else [], r.integers(1000, 9000, 20)])).astype(np.int32) for f, s in zip(first, second, strict=True)]
    models = toxicity.fit_chain(rows, np.column_stack([first, second]), np.arange(600) % 5)
    p = toxicity.predict_chain(models, rows)
    assert len(models[1].weights) == len(models[1].slots) + 1
    assert ((p[:, 0] > 0.5) == first).mean() > 0.98 and p[first == 0, 1].max() < 0.5


def test_toxicity_of_odd_documents(spark, make):
    rows = [(100 + i, f"a text of the usual kind {i} {'you idiot' if i % 3 == 0 else 'thank you'}", "a") for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int((i - 100) % 3 == 0), "") for i, *_ in rows[:60]] + [(None, 1, 1, ""), (1, 1, None, "")], LABELS)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(make([*rows, *ODD]), labels).collect()}
    assert all(got[i] == ((i - 100) % 3 == 0) for i, *_ in rows) and not any(got[i] for i in (1, 2, 4, 7))
    assert toxicity.toxicity(make(ODD), labels.limit(0)).where("toxic").count() == 0
    assert toxicity.toxicity(make([]), labels).count() == 0
    two = toxicity.toxicity(make(rows), labels, ("quality", "toxic"))
    assert two.columns == ["doc_id", "p_quality", "p_toxic", "toxic"]


def test_slots_selected_by_spark(spark, make):
    """Trained on what Spark selects, the chain is the one that is fitted on all slots of all labelled texts."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(700)]
    rows, marks = [], []
    for i in range(260):
        low, toxic = r.random() < 0.4, r.random() < 0.3
        rows.append((i, " ".join(r.choices(words, k=30) + ["junk"] * (low and r.random() < 0.8) + ["nasty"] * (toxic and r.random() < 0.8)), "a"))
        marks.append((i, int(low), int(toxic), ""))
    models = toxicity.train(make([*rows, rows[3], *ODD]), spark.createDataFrame([*marks, (7, None, 1, "")], LABELS), ("quality", "toxic"))
    order = [x["id"] for x in spark.range(260).orderBy(F.xxhash64("id", F.lit(toxicity.SEED)), "id").collect() if x["id"] not in {i for i, *_ in ODD}]
    slots = [toxicity.words_of(rows[i][1]) for i in order]
    folds = np.array([toxicity.xxhash.xxh64_intdigest(str(i), toxicity.SEED) % toxicity.FOLDS for i in order])
    want = toxicity.fit_chain(slots, np.array([marks[i][1:3] for i in order]), folds)
    texts = [toxicity.words_of(t or "") for _, t, *_ in rows + ODD]
    assert len(models) == 2 and len(models[1].slots)
    assert np.abs(toxicity.predict_chain(models, texts) - toxicity.predict_chain(want, texts)).max() < 0.05


# sharding ---------------------------------------------------------------------------------------


def held(got, n):
    counts = got.groupby("shard").size().reindex(range(n), fill_value=0)
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_shards(make):
    """Links stay whole where a shard has room; a text with a third of all rows takes few shards."""
    rows = [(i, f"copy of {i % 40}", "a") for i in range(200)] + [(1000 + i, "hot", "a") for i in range(400)] + [(2000 + i, f"alone {i}", "a") for i in range(600)]
    got = sharding.shards(make(rows), 12).toPandas()
    held(got, 12)
    texts = dict(zip([x[0] for x in rows], [x[1] for x in rows], strict=True))
    spread = got.assign(text=got["doc_id"].map(texts)).groupby("text")["shard"].nunique()
    assert spread["hot"] <= 7 and (spread.filter(like="copy") == 1).mean() > 0.8
    assert sharding.shards(make([])).count() == 0


def test_shards_of_odd_documents(make):
    got = sharding.shards(make(ODD), 5).toPandas()
    held(got, 5)
    assert len(got) == len(ODD) and got.loc[got["doc_id"] == 1, "size"].item() == 16 and got.loc[got["doc_id"] == 1, "text_crc32"].item() == 0


# mixing -----------------------------------------------------------------------------------------


def targets(sizes, share=1.5, most=2.0):
    """Water-filling by bisection."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, low, high = share * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * sizes[s], mid * weight[s]) for s in sizes) < total else (low, mid)
    return {s: min(most * sizes[s], high * weight[s]) for s in sizes}


@pytest.mark.parametrize("odd", [False, True])
def test_mixture(make, odd):
    r = random.Random(2)
    rows = ODD if odd else [(i, "w " * int(r.paretovariate(1.1)), r.choice(["a", "a", "a", "b", "c", None, "é", "Z"])) for i in range(500)]
    got = mixing.mixture(make(rows)).toPandas()
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = targets(sizes)
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    for s, g in got.groupby(got["source"].fillna("∅")):
        key = None if s == "∅" else s
        assert g["target"].iloc[0] == pytest.approx(want[key], abs=1e-3) and abs(g["taken"].sum() - want[key]) <= 1 and g["source_size"].iloc[0] == sizes[key]
    again = mixing.mixture(make(rows, 5)).toPandas()
    assert sorted(zip(got["doc_id"].fillna(-1), got["size"], got["taken"], strict=True)) == sorted(zip(again["doc_id"].fillna(-1), again["size"], again["taken"], strict=True))


def test_mixed_texts(make):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 17 + 1)) + "\n", "abc"[i % 3]) for i in range(120)]
    plan = {r["doc_id"]: r["taken"] for r in mixing.mixture(make(rows)).collect()}
    out = {}
    mix = mixing.mixed(make(rows))
    assert mix.columns == make([]).columns
    for x in mix.collect():
        out[x["doc_id"]] = out.get(x["doc_id"], 0) + len(x["text"].split())
    assert out == {k: v for k, v in plan.items() if v}
    assert mixing.mixture(make([])).count() == 0 and mixing.mixed(make([])).count() == 0


# top-k ------------------------------------------------------------------------------------------


def top_by_force(rows, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]
            best[i] = max(best.get(i, w), w)
    out = []
    for q in best:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(best[q], v)), i) for i, v in best.items() if i != q)[:k]  # noqa: B905
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 1024), (37, 3)])
def test_top_k(spark, blocks):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=16)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 16) for i in range(50)]  # ties
    rows += [(1, None), (500, [float("nan")] * 16), (520, [None] * 16), (None, [1.0] * 16), (540, [1.0]), (0, rows[0][1]), (560, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    assert sorted(map(tuple, topk.top_k(df, 20, block=blocks[0], query_block=blocks[1]).collect())) == top_by_force(rows, 20)


def test_vectors_of_any_magnitude(spark):
    """Beyond 53 bits whole numbers decide; beyond a long the nearest long; beyond a double vectors take no part."""
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(size=4) * 10.0 ** r.integers(0, 40)]) for i in range(150)]
    rows += [(200 + i, [float(2**30 + i), 1.0, 0.0, -float(2**29)]) for i in range(40)] + [(400, [1e307, 1.0, 1.0, 1.0])]  # 64e307 is no double
    whole = {i: [math.floor(64 * Fraction(x)) if abs(64 * x) < 2**52 else int(64 * x) for x in v] for i, v in rows if i != 400}
    want = []
    for q in sorted(whole):
        if q % 20 == 0:
            scores = {i: sum(a * b for a, b in zip(whole[q], v, strict=True)) for i, v in whole.items() if i != q}
            scored = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for i, s in scores.items())[:20]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bars_lose_nothing():
    """A bar that k candidates reach somewhere leaves all rows that reach it."""
    r = np.random.default_rng(7)
    q, v = np.floor(r.normal(size=(9, 8)) * 64), np.floor(r.normal(size=(4000, 8)) * 64)
    scores = q @ v.T
    bars = np.sort(scores, axis=1)[:, -10]
    for i, (places, found) in enumerate(topk.nra(q, np.full(9, -1), v, np.arange(4000), 20, bars)):
        assert found[:10].tolist() == np.sort(scores[i])[::-1][:10].tolist() and (scores[i][places] == found).all()


def test_few_vectors(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.top_k(df([])).count() == 0 and topk.top_k(df([(0, [1.0])])).count() == 0
    assert [tuple(x) for x in topk.top_k(df([(0, [1.0]), (5, [-1.0])])).collect()] == [(0, 1, 5, -4096)]


def test_sql(spark, sf):
    from oracle import connect, rows

    duck = connect(sf)
    for name, sql in queries.SQL.items():
        assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(sql).df()), name


def test_mix_of_repeated_rows(make):
    """Each row is taken by its own plan: the mix holds as many words as the plan takes."""
    rows = [*[(None, "five words are in this", "a")] * 5, (1, "some more words of this source to mix", "a"), (2, "b has a longer text of its own, with more words than the other one has", "b"), *ODD]
    plan = sum(r["taken"] for r in mixing.mixture(make(rows)).collect())
    assert sum(len((r["text"] or "").encode().split()) for r in mixing.mixed(make(rows)).collect()) == plan


def test_shards_whatever_the_split(make):
    rows = [(i, f"copy of {i % 60}", "a") for i in range(300)] + [(1000 + i, f"alone {i}", "a") for i in range(300)] + ODD
    got = [sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shards(make(rows, parts), 7).collect()), key=str) for parts in (1, 7)]
    sizes = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    assert got[0] == got[1] and sorted((x[:3] for x in got[0]), key=str) == sizes


def test_noise_decides_at_a_high_temperature(make, spark):
    """Keys are weight / temperature + Gumbel noise, and the rows with the k highest are kept. At a temperature far above
    the weights seeds draw different documents; at the default one these texts are too clear for that."""
    good = [(i, "calm sober words about rivers and hills " * 3, "a") for i in range(40)]
    bad = [(100 + i, "win cash now click here fast " * 3, "a") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0, "") for i, *_ in good[:30]] + [(i, 0, 0, "") for i, *_ in bad[:30]], LABELS)
    drawn = []
    for seed in (1, 2):
        got = resampling.importance(make([*good, *bad]), labels, temperature=1000.0, seed=seed).collect()
        kept = sorted((r["key"] for r in got if r["kept"]), reverse=True)
        assert kept == sorted((r["key"] for r in got), reverse=True)[: len(kept)] and len(kept) == sum(r["log_weight"] > 0 for r in got)
        assert abs(float(np.mean([r["key"] - r["log_weight"] / 1000 for r in got])) - 0.5772) < 0.6  # Gumbel's mean
        drawn.append({r["doc_id"] for r in got if r["kept"]})
    assert drawn[0] != drawn[1] and any(i >= 100 for x in drawn for i in x)
