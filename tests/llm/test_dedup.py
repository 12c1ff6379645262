import hashlib
import random
from collections import Counter, defaultdict

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from tidewater.llm import common, exact_dedup, jaccard_join, substring_dedup

r = random.Random(11)
VOCABULARY = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]


def prose(n):
    return [r.choice(VOCABULARY) for _ in range(n)]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words) + 1)
        kind = r.random()
        if kind < 0.4 and words:
            words[min(at, len(words) - 1)] = r.choice(VOCABULARY)
        elif kind < 0.7:
            words.insert(at, r.choice(VOCABULARY))
        elif words:
            words.pop(min(at, len(words) - 1))
    return words


@pytest.fixture(scope="module")
def corpus():
    """Prose with copies, near copies in chains and stars, shared passages and very short texts."""
    passages = [prose(r.randint(30, 120)) for _ in range(6)]
    texts = [prose(r.choice([3, 6, 8, 30, 60, 200])) for _ in range(120)]
    texts += [edited(texts[r.randrange(len(texts))], r.randint(0, 6)) for _ in range(150)]
    chain = prose(80)
    for _ in range(15):
        chain = edited(chain, 3)
        texts.append(chain)
    star = prose(60)
    texts += [edited(star, 2) for _ in range(60)] + [star] * 20
    texts += [prose(r.randint(0, 40)) + r.choice(passages) + prose(r.randint(0, 40)) for _ in range(60)]
    texts += [["a", "b"], ["A", "b"], ["a"], ["x"] * 200, ["x"] * 201, ["x", "y"] * 70]
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def groups_by_force(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted(((row[0], len(s), least.get(find(i)) if s else row[0]) for i, (row, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_jaccard_by_force(make, corpus):
    assert sorted(map(tuple, jaccard_join.similar_documents(make(corpus)).collect()), key=str) == groups_by_force(corpus)


def test_jaccard_with_frequent_shingles_last(make, corpus, monkeypatch):
    """Shingles that count as frequent change the order, never the result."""
    monkeypatch.setattr(jaccard_join, "HOT", 8)
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    assert sorted(map(tuple, jaccard_join.similar_documents(make(corpus, 1)).collect()), key=str) == groups_by_force(corpus)


def test_jaccard_of_odd_documents(make):
    assert sorted(map(tuple, jaccard_join.similar_documents(make(ODD)).collect()), key=str) == groups_by_force(ODD)
    assert jaccard_join.similar_documents(make([])).count() == 0


def test_one_document_of_each_group_stays(make, corpus):
    left = jaccard_join.without_near_duplicates(make(corpus))
    assert left.columns == make([]).columns
    assert Counter(x["doc_id"] for x in left.collect()) == Counter({c for _, _, c in groups_by_force(corpus)})


def spans_by_force(rows):
    first = {}
    words = [(t or "").encode().split() for _, t, *_ in rows]
    for (i, *_), w in zip(rows, words, strict=True):
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, *_), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_spans_by_force(make, corpus):
    got = substring_dedup.repeated_spans_removed(make(corpus)).drop("kept_text")
    want = spans_by_force(corpus)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(x[2] for x in want) > 1000


def test_spans_of_odd_documents(make):
    rows = [*ODD, (30, "long text " * 40, "a"), (2, "long text " * 40, "a"), (31, " ".join(prose(49)), "a")]
    assert sorted(map(tuple, substring_dedup.repeated_spans_removed(make(rows)).drop("kept_text").collect()), key=str) == spans_by_force(rows)
    assert substring_dedup.repeated_spans_removed(make([])).count() == 0


def exact_by_force(rows):
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    seen, out = set(), []
    for i, t, *_ in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep and (i, norm(t)) not in seen, hashlib.sha256(norm(t).encode()).hexdigest()))
        seen.add((i, norm(t)))
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [1, 1 << 20])
def test_exact(make, corpus, capacity):
    rows = corpus + ODD
    assert sorted(map(tuple, exact_dedup.exact_duplicates(make(rows), capacity).collect()), key=str) == exact_by_force(rows)


def test_exact_rows_that_stay(make):
    left = exact_dedup.without_duplicates(make(ODD))
    assert left.columns == make([]).columns
    assert Counter(x["doc_id"] for x in left.collect()) == Counter(i for i, _, _, kept, _ in exact_by_force(ODD) if kept)
    assert exact_dedup.exact_duplicates(make([])).count() == 0 and exact_dedup.without_duplicates(make([])).count() == 0


def test_directory_doubles(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    d = exact_dedup.directory(keys, 100, 10)
    assert d.count() == d.select("slot").distinct().count() and d.agg(F.max("local_depth")).first()[0] > 4
    placed = keys.withColumn("slot", F.shiftrightunsigned("key", 54)).join(d, "slot").groupBy("bucket").count()
    assert placed.agg(F.max("count")).first()[0] <= 100
    assert exact_dedup.directory(keys, 10**9, 10).select("bucket").distinct().count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert {k: got[k] for k in want} == want and common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_global_rank_and_hot_join(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = common.global_rank(df, [F.col("x")], "t", "rank", 5)
    assert got.where("x <> rank").count() == 0 and got.count() == 1000
    left = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"))
    groups = left.groupBy("k").agg(F.count("*").alias("n")).where("k < 950")
    out = common.join_on_hot(left, groups, ["k"], "n", "left", most=2)
    assert out.count() == 1000 and out.where("n is null").count() == 50 and out.where("n = 900").count() == 900
    assert common.join_on_hot(left, groups, ["k"], "n", "inner", most=2).count() == 950


def test_index_of_the_query(spark, sf):
    """With the query's own parameters buckets split, each has one owner file, and every key is where the directory says."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    light, entries = exact_dedup.index(docs)
    rows = entries.withColumn("file", F.input_file_name()).collect()
    assert len({r["bucket"] for r in rows}) > 8 and len({r["local_depth"] for r in rows}) > 1
    owner = defaultdict(set)
    for r in rows:
        owner[r["bucket"]].add(r["file"])
        assert (r["key"] % (1 << 64)) >> (64 - r["local_depth"]) == r["bucket"] >> (exact_dedup.DEPTH - r["local_depth"])
    assert all(len(x) == 1 for x in owner.values()) and len(set.union(*owner.values())) > 1
    assert {(r["bucket"], r["key"], r["text_sha256"]) for r in light.collect()} == {(r["bucket"], r["key"], r["text_sha256"]) for r in rows}


def test_components_in_rounds(spark, monkeypatch):
    """More edges than one task may join: the rounds give the same."""
    monkeypatch.setattr(common, "ONE_TASK", 0)
    test_components(spark)


def rows_of_joins(spark, f):
    """The most rows that a join on tokens makes while f runs, and what f returns."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList(before, 10_000)
    most = 0
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if "Join" not in node.name() or "token#" not in node.desc():
                continue
            for m in range(node.metrics().size()):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most, out


def test_far_copies_do_not_all_meet(spark, make):
    """Copies of one text with so many edits that they are not similar, and few tokens of the text left in their prefixes."""
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(300):
        words = list(base)
        for at in r.sample(range(2, 150, 5), 6 if i < 290 else 1):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    most, out = rows_of_joins(spark, lambda: [tuple(x) for x in jaccard_join.similar_documents(make(rows)).collect()])
    assert sorted(out, key=str) == groups_by_force(rows)
    assert 0 < most < 300 * 37  # as many as tokens of prefixes, not as pairs


@pytest.mark.parametrize("group", [1 << 21, 1 << 12])
def test_crowds_become_one_group(spark, make, monkeypatch, group):
    """Copies of one text with few and many edits, which went with many leaders or none, as one group and in blocks."""
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    own, base, texts = random.Random(3), [f"w{i}" for i in range(240)], []
    for i in range(300):
        words = list(base)
        for k in range(own.choice(range(3, 13))):
            words[own.randrange(240)] = f"x{i}-{k}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    most, out = rows_of_joins(spark, lambda: [tuple(x) for x in jaccard_join.similar_documents(make(rows)).collect()])
    assert sorted(out, key=str) == groups_by_force(rows)
    assert group < 1 << 21 or 0 < most < 300 * 60  # as many as tokens of prefixes, not as pairs


def test_unlike_sizes_ask_nothing(make, monkeypatch):
    """Groups of a short and a long text, and texts of a size between that share a passage with both: none comes to them with its set."""
    own, rows = random.Random(5), []
    for i in range(12):
        long = [f"w{i}-{k}" for k in range(300)]
        texts = [long, long[:44]]
        for q in range(10):
            words, at = [f"x{i}-{q}-{k}" for k in range(150)], own.randrange(30)
            words[70:84] = long[at : at + 14]
            texts.append(words)
        texts.append([*texts[-1][:149], "y"])  # similar to the one before
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate(texts)]
    sent, given = [], jaccard_join.Matrix._open

    def opened(self, rows, f, schema):
        if f is jaccard_join._across:
            sent.append(rows.where("query").count())
        return given(self, rows, f, schema)

    monkeypatch.setattr(jaccard_join.Matrix, "_open", opened)
    out = jaccard_join.similar_documents(make(rows)).collect()
    assert sorted(map(tuple, out), key=str) == groups_by_force(rows)
    assert sent == [0]
