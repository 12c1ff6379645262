import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidewater import cli
from tidewater.assistant import Assistant
from tidewater.errors import BindingError, ParseError
from tidewater.functions import vector
from tidewater.functions.statistics import ColumnDistribution, fit_line
from tidewater.operators import learned_index, partitioning, relational
from tidewater.operators.learned_index import DynamicPGMIndex, PGMIndex, RMI, cone
from tidewater.plans import dialect, optimizer
from tidewater.server import make_server
from tidewater.sources import files
from tidewater.sources.retention import RetentionModel
from tidewater.streaming.ingest import upsert_stream, windowed_counts


def test_dialect_leaves_strings_and_comments_alone():
    assert dialect.statements("SELECT ';'; -- no ; here\nSELECT 2") == ["SELECT ';'", "SELECT 2"]
    assert dialect.parameters("SELECT '?' WHERE a = ? -- ?\n AND b = ?")[1] == 2
    assert dialect.rewrite_vectors("SELECT 'a <-> b'") == "SELECT 'a <-> b'"
    assert "aggregate" in dialect.rewrite_vectors("SELECT e <-> '[1,2]'")
    assert dialect.rewrite_vectors("SELECT a <=> b") == "SELECT a <=> b"
    assert "aggregate" in dialect.rewrite_vectors("SELECT t.e <=> b", lambda n: n == "t.e")
    with pytest.raises(BindingError):
        dialect.parameters("SELECT ?, $1")
    with pytest.raises(ParseError):
        dialect.parse_vector("[1, x]")


def test_vector_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()[0]
    lit = vector.literal
    assert get(vector.dot(lit(range(1, 9)), lit([2] * 8))) == 72
    assert get(vector.cosine_distance(lit([0, 0]), lit([1, 0]))) == 1.0
    assert get(vector.l2_distance(lit([0, 3]), lit([4, 0]))) == 5.0
    assert get(vector.normalize(lit([0, 0]))) == [0.0, 0.0] and get(vector.normalize(lit([3, 4]))) == [0.6, 0.8]
    assert get(vector.add(lit([1, 2]), lit([3, 4]))) == [4, 6] and get(vector.multiply(lit([1, 2]), lit([3, 4]))) == [3, 8]
    vector.register(spark)
    assert spark.sql("SELECT vec_l2_distance(array(0D, 3D), array(4D, 0D)), vec_cosine_distance(array(0D), array(1D))").first()[:] == (5.0, 1.0)


def test_join_estimates():
    d = lambda rows, n: {"k": ColumnDistribution(rows, 0, n)}
    assert optimizer.join_rows(1000, 1000, 500, 10) == 2000 and optimizer.join_rows(1000, 1000) == 100_000
    stats = {"a": d(200, 200), "b": d(10_000, 10), "c": d(5, 5)}
    edges = [optimizer.JoinEdge("a", "k", "b", "k"), optimizer.JoinEdge("a", "k", "c", "k")]
    assert optimizer.order_joins(["a", "b", "c"], edges, stats)[0] in (["a", "c", "b"], ["c", "a", "b"])
    assert optimizer.order_joins([f"t{i}" for i in range(12)], [], {})[0] == [f"t{i}" for i in range(12)]
    assert optimizer.cost("Scan", 100) == 11


def test_distribution():
    d = ColumnDistribution(10, 2, 4, 1.0, 4.0, [1.0, 2.0, 3.0, 4.0])
    assert d.selectivity(">", 2) == 0.4 and d.selectivity("=", 9) == 0 and d.selectivity("like", 1) == 0.5
    assert ColumnDistribution(10, 0, 2, common={"x": 9, "y": 1}).selectivity("=", "x") == 0.9


def test_fit_line(spark):
    df = spark.range(10).selectExpr("id", "id * 2 + 1 AS y")
    m = fit_line(df, "id", "y")
    assert abs(m(20) - 41) < 1e-9 and fit_line(df.limit(1), "id", "y") is None and fit_line(df.selectExpr("1 AS id", "y"), "id", "y") is None


def test_pgm(spark):
    keys = spark.range(5000).select((F.col("id") * F.col("id") % 7919).cast("double").alias("k")).distinct()
    index = PGMIndex.build(keys, "k", 8)
    ordered = sorted(r[0] for r in keys.collect())
    for i in (0, 17, len(ordered) - 1):
        assert index.search(ordered[i]) == [i] and abs(index.rank(ordered[i]) - i) <= 9
    assert index.search(-5.0) == [] and index.bytes() > 0
    asked = spark.createDataFrame([(x, "a") for x in [*ordered[::7], ordered[0], -5.0, 1e9, float("nan"), None]], "k double, tag string")
    for buckets in (1, 9):
        found = index.predict(asked, "k", buckets).collect()
        assert sorted(r["k"] for r in found) == sorted([*ordered[::7], ordered[0]]) and {r["tag"] for r in found} == {"a"}
        assert all(abs(r["predicted"] - ordered.index(r["k"])) <= 8 for r in found)
    index._local = [(0.0, 10.0, 5.0, 0, 3)]  # the segment's end bounds the prediction
    assert isinstance(index.rank(9.0), float) and index.rank(9.0) == 3
    assert "NestedLoop" not in index.predict(asked, "k")._jdf.queryExecution().executedPlan().toString()
    import numpy as np

    assert sum(s[4] for s in cone(np.ones(100), np.arange(100), 8)) == 100


def test_dynamic_pgm(spark):
    rows = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "k double")
    index = DynamicPGMIndex(rows([10, 30, 50, 70]), "k")
    index.insert(rows([20, 40, 60]))
    assert [r[0] for r in index.range(25, 65).collect()] == [30, 40, 50, 60]
    index.insert(rows(range(100, 200)))
    assert index.buffered == 0 and index.range(0, 1000).count() == 107


def test_rmi(spark):
    r = RMI(spark.range(1000).select((F.col("id") * 5).alias("k")), "k").predict()
    assert r.where(F.abs(F.col("predicted") - F.col("position")) > 2).count() == 0
    assert learned_index.SEGMENT_BYTES == 48


def test_partitioners(spark):
    df = spark.range(1000)
    for kind in partitioning.KINDS:
        sizes = partitioning.sizes(partitioning.partition(df, kind, 5, "id"))
        assert sizes.agg(F.sum("n")).first()[0] == 1000 and sizes.count() == 5
    with pytest.raises(ValueError):
        partitioning.partition(df, "odd", 2)


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 5, "now"), ("a", 3, "then")], "k string, t long, v string")
    got = lambda strict: {r["id"]: r["v"] for r in relational.asof_join(left, right, "t", ["k"], ["v"], strict).collect()}
    assert got(False) == {1: "now", 2: None, 3: None} and got(True) == {1: "then", 2: None, 3: None}


def test_relational(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 0)], "k string, v long")
    assert [r[0] for r in relational.distinct_ordered(df, ["k"], ["v"]).collect()] == ["a", "b"]
    assert {(r["k"], r["v"]) for r in relational.distinct_on(df, ["k"], [F.desc("v")]).collect()} == {("a", 3), ("b", 1)}
    a, b = relational.merged_names(df, df, "x", "y")
    assert a.columns == ["x__k", "x__v"] and b.columns == ["y__k", "y__v"]
    assert relational.salted_join(df, df.distinct(), "k").count() == df.join(df.distinct(), "k").count()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    for kind in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / f"t.{kind}")
        files.write(df, path, kind, **({"header": True} if kind == "csv" else {}))
        assert files.read(spark, path).count() == 2
    store = files.Store(spark, str(tmp_path / "s"))
    assert store.create("log/1.json", "é") and not store.create("log/1.json", "x") and store.text("log/1.json") == "é"
    assert store.names("log") == ["1.json"]


def test_retention():
    m = RetentionModel()
    assert not m.due("t", 3) and m.due("t", 9)
    for i in range(40):
        m.observe("t", i, 2 * i)
    assert abs(m.predict(10) - 20) < 1


def test_streams(spark, engine, tmp_path):
    engine.sql("CREATE TABLE e (id INT PRIMARY KEY, v INT)")
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1), (2, 2)], "id long, v long").coalesce(1).write.parquet(source)
    spark.createDataFrame([(2, 5)], "id long, v long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(source)
    upsert_stream(engine, stream, "e", str(tmp_path / "cp")).awaitTermination()
    assert {r["id"] for r in engine.table("e").collect()} == {1, 2}
    batch = spark.sql("SELECT timestamp'2024-01-01 00:00:30' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:01:30', 'a'")
    assert windowed_counts(batch, "ts", "1 minute", "5 minutes", "k").count() == 2


def test_command_line(shop, capsys):
    assert "Nadia" in cli.run(shop, "SELECT * FROM growers") and cli.run(shop, "DELETE FROM growers") == "2 rows affected"
    assert "crates" in cli.command(shop, "\\dt") and "grower" in cli.command(shop, "\\d crates") and cli.command(shop, "\\q") is None
    assert "NULL" in cli.run(shop, "SELECT NULL AS x") and "tables" in cli.command(shop, "\\?")


def test_assistant(shop):
    a = Assistant(shop, lambda prompt: "Sure:\n```sql\nSELECT count(*) AS n FROM growers\n```")
    assert a.reply("how many growers?")["rows"] == [[2]]
    assert "error" in Assistant(shop, lambda p: "```sql\nDELETE FROM growers\n```").reply("x")
    assert shop.table("growers").count() == 2 and "growers(" in a.reply("tables")["text"] and "No language model" in Assistant(shop).reply("hi")["text"]


def test_server(shop):
    s = make_server(shop, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"
    try:
        assert json.load(urllib.request.urlopen(f"{base}/health", timeout=30)) == {"status": "ok"}
        assert len(json.load(urllib.request.urlopen(f"{base}/api/tables", timeout=30))) == 2
        ask = urllib.request.Request(f"{base}/api/query", json.dumps({"sql": "SELECT name FROM growers ORDER BY id"}).encode())
        assert json.load(urllib.request.urlopen(ask, timeout=60))["rows"] == [["Nadia"], ["Piet"]]
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(urllib.request.Request(f"{base}/api/query", b'{"sql": "DROP TABLE x"}'), timeout=60)
    finally:
        s.shutdown()
