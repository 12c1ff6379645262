import threading

import pytest

from tidewater.errors import BindingError, ConflictError, ConstraintError, EngineError, ParseError, TypeMismatchError
from tidewater.session import Engine


def values(df):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.collect()]


def test_select(shop):
    assert values(shop.sql("SELECT name FROM growers WHERE age >= 18")) == ["Nadia"]
    assert values(shop.sql("SELECT g.name, c.kilos FROM growers g JOIN crates c ON g.id = c.grower ORDER BY c.kilos")) == [("Nadia", 3.5), ("Nadia", 8.0), ("Piet", 21.0)]
    assert values(shop.sql("SELECT grower, COUNT(*) AS n, SUM(kilos) AS s FROM crates GROUP BY grower ORDER BY grower")) == [(1, 2, 11.5), (2, 1, 21.0)]
    assert values(shop.sql("SELECT grower FROM crates GROUP BY grower HAVING SUM(kilos) > 15")) == [2]
    assert values(shop.sql("SELECT id FROM crates ORDER BY id LIMIT 1 OFFSET 1")) == [32]
    assert values(shop.sql("SELECT DISTINCT grower FROM crates ORDER BY grower DESC")) == [2, 1]


def test_unsupported_fails(shop):
    for sql in ("DROP TABLE growers", "MERGE INTO growers USING crates ON true", "BEGIN", ""):
        with pytest.raises(ParseError):
            shop.sql(sql)
    with pytest.raises(BindingError):
        shop.sql("SELECT nothing FROM growers")
    with pytest.raises(BindingError):
        shop.sql("SELECT * FROM nowhere")
    with pytest.raises(TypeMismatchError):
        shop.sql("SELECT * FROM growers WHERE age = 'thirty'")
    with pytest.raises(ParseError):
        shop.sql("SELECT 1; SELECT 2")


def test_nulls(engine):
    engine.sql("CREATE TABLE t (id INT PRIMARY KEY, fk INT)")
    engine.sql("INSERT INTO t VALUES (1, NULL), (2, 5)")
    assert values(engine.sql("SELECT id FROM t WHERE fk = NULL")) == []
    assert values(engine.sql("SELECT a.id FROM t a JOIN t b ON a.fk = b.fk")) == [2]
    assert values(engine.sql("SELECT id FROM t ORDER BY fk")) == [1, 2]


def test_insert(shop):
    assert values(shop.sql("INSERT INTO growers (id, name) VALUES (3, 'Cy')")) == [1]
    assert values(shop.sql("SELECT age FROM growers WHERE id = 3")) == [None]
    shop.sql("INSERT INTO growers VALUES (3, 'Di', 4)")
    assert values(shop.sql("SELECT name, age FROM growers WHERE id = 3")) == [("Di", 4)]
    assert values(shop.sql("INSERT INTO growers SELECT id, 'x', grower FROM crates")) == [3]
    for sql, error in (
        ("INSERT INTO growers VALUES (4, 'x')", BindingError),
        ("INSERT INTO growers VALUES ('a', 'x', 1)", TypeMismatchError),
        ("INSERT INTO growers VALUES (9, NULL, 1)", ConstraintError),
        ("INSERT INTO growers (id, nope) VALUES (1, 2)", BindingError),
    ):
        with pytest.raises(error):
            shop.sql(sql)
    assert shop.table("growers").count() == 6


def test_apostrophes(engine):
    engine.sql("CREATE TABLE t (id INT PRIMARY KEY, s TEXT)")
    s = engine.prepare("INSERT INTO t VALUES (?, ?)")
    engine.execute(s, [1, "it's; DROP -- ? $1"])
    assert values(engine.sql("SELECT s FROM t")) == ["it's; DROP -- ? $1"]


def test_update(shop):
    assert values(shop.sql("UPDATE crates SET kilos = kilos * 2 WHERE grower = 1")) == [2]
    assert values(shop.sql("SELECT kilos FROM crates ORDER BY id")) == [16.0, 7.0, 21.0]
    shop.sql("UPDATE growers SET age = age / 7")
    assert values(shop.sql("SELECT age FROM growers ORDER BY id")) == [5, 2]
    shop.sql("UPDATE growers SET age = age / 0, name = name + '!' WHERE id = 1")
    assert values(shop.sql("SELECT name, age FROM growers WHERE id = 1")) == [("Nadia!", None)]
    for sql, error in (("UPDATE growers SET id = 3", ConstraintError), ("UPDATE growers SET age = name + 1", TypeMismatchError), ("UPDATE growers SET nope = 1", BindingError)):
        with pytest.raises(error):
            shop.sql(sql)


def test_delete(shop):
    assert values(shop.sql("DELETE FROM crates WHERE kilos < 15")) == [2]
    assert values(shop.sql("SELECT id FROM crates")) == [33]
    assert values(shop.sql("DELETE FROM crates")) == [1]
    shop.sql("INSERT INTO crates VALUES (33, 7, 1.0)")
    assert values(shop.sql("SELECT grower FROM crates")) == [7]


def test_vectors(engine):
    engine.sql("CREATE TABLE items (id INT PRIMARY KEY, name TEXT, embedding VECTOR(3))")
    engine.sql("INSERT INTO items VALUES (1, 'x', '[1.0, 0.0, 0.0]'), (2, 'y', '[0.0, 1.0, 0.0]'), (3, 'xy', '[0.707, 0.707, 0.0]'), (4, 'none', NULL)")
    assert values(engine.sql("SELECT id FROM items ORDER BY embedding <=> '[0.9,0.1,0.0]' LIMIT 2")) == [1, 3]
    assert values(engine.sql("SELECT id FROM items ORDER BY embedding <-> '[0.0,0.9,0.0]' LIMIT 1")) == [2]
    assert values(engine.sql("SELECT id FROM items ORDER BY embedding <#> '[1,0,0]' LIMIT 1")) == [1]
    assert values(engine.sql("SELECT id, embedding <=> '[1,0,0]' AS distance FROM items ORDER BY distance, id LIMIT 1")) == [(1, 0.0)]
    assert values(engine.sql("SELECT id FROM items ORDER BY embedding <-> '[0,0,0]', id"))[-1] == 4
    assert values(engine.execute(engine.prepare("SELECT id FROM items ORDER BY embedding <=> ? LIMIT 1"), [[0.0, 1.0, 0.0]])) == [2]
    assert values(engine.sql("SELECT id FROM items WHERE id <=> 2")) == [2]
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO items VALUES (5, 'short', '[1.0, 2.0]')")


def test_prepared(shop):
    s = shop.prepare("SELECT name FROM growers WHERE age > ? AND name <> '?'")
    assert values(shop.execute(s, [20])) == ["Nadia"] and values(shop.execute(s, [40])) == []
    assert values(shop.execute(shop.prepare("SELECT id FROM crates WHERE grower = $2 AND kilos > $1 ORDER BY id"), [6.0, 1])) == [31]
    assert values(shop.execute(shop.prepare("UPDATE growers SET age = ? WHERE id = ?"), [99, 2])) == [1]
    for bad in ([], [1, 2]):
        with pytest.raises(BindingError):
            shop.execute(s, bad)
    with pytest.raises(BindingError):
        shop.prepare("SELECT * FROM growers WHERE id = ? OR id = $1")
    with pytest.raises(BindingError):
        shop.sql("SELECT * FROM growers WHERE id = ?")
    with pytest.raises(ParseError):
        shop.prepare("CREATE TABLE x (id INT)")


def test_snapshots_and_transactions(shop):
    before = shop.database.latest()
    with shop.transaction() as t:
        t.sql("DELETE FROM crates WHERE id = 31")
        t.sql("UPDATE growers SET age = 1")
        assert shop.table("crates").count() == 3
    assert shop.table("crates").count() == 2 and shop.table("crates", before).count() == 3
    with pytest.raises(BindingError), shop.transaction() as t:
        t.sql("DELETE FROM crates")
        t.sql("DELETE FROM nowhere")
    assert shop.table("crates").count() == 2


def test_first_committer_wins(shop):
    with pytest.raises(ConflictError), shop.transaction() as t:
        t.sql("UPDATE growers SET age = 50 WHERE id = 1")
        shop.sql("UPDATE growers SET age = 60 WHERE id = 1")
    assert values(shop.sql("SELECT age FROM growers WHERE id = 1")) == [60]


def test_no_lost_updates(engine):
    engine.sql("CREATE TABLE counters (id INT PRIMARY KEY, val INT)")
    engine.sql("INSERT INTO counters VALUES (1, 0)")
    threads = [threading.Thread(target=lambda: [engine.sql("UPDATE counters SET val = val + 1") for _ in range(3)]) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert values(engine.sql("SELECT val FROM counters")) == [9]


def test_reopen_and_orphans(spark, tmp_path):
    path = str(tmp_path / "db")
    e = Engine.open(spark, path)
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    e.sql("CREATE INDEX by_v ON t(v)")
    e.sql("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    e.database.write("t", spark.createDataFrame([(9, "lost")], "id long, v string"), "I", e.database.latest())  # never committed
    again = Engine.open(spark, path)
    assert values(again.sql("SELECT id FROM t ORDER BY id")) == [1, 2]
    assert again.describe("t").indexes == {"by_v": "v"}
    assert again.database.vacuum() == 1
    again.database.compact("t")
    again.sql("DELETE FROM t WHERE id = 1")
    assert values(Engine.open(spark, path).sql("SELECT id FROM t")) == [2]


def test_create(shop):
    with pytest.raises(BindingError):
        shop.sql("CREATE TABLE growers (id INT PRIMARY KEY)")
    shop.sql("CREATE TABLE IF NOT EXISTS growers (id INT PRIMARY KEY)")
    shop.sql("CREATE TABLE big AS SELECT * FROM crates WHERE kilos > 6")
    assert shop.table("big").count() == 2
    assert shop.tables() == ["big", "crates", "growers"]
    kinds = {r["column"]: r["type"] for r in shop.sql("DESCRIBE growers").collect()}
    assert kinds == {"id": "bigint", "name": "string", "age": "bigint"}


def test_estimates(engine, spark):
    engine.sql("CREATE TABLE s (id INT PRIMARY KEY, amount INT)")
    spark.range(1000).selectExpr("id", "IF(id < 950, 10, 999) AS amount").createOrReplaceTempView("skewed")
    engine.sql("INSERT INTO s SELECT id, amount FROM skewed")
    q = "SELECT * FROM s WHERE amount >= 999"
    assert engine.explain(q).estimated_rows == 500
    engine.sql("ANALYZE TABLE s")
    assert abs(engine.explain(q).estimated_rows - 50) <= 20
    with pytest.raises(EngineError):
        engine.explain("DELETE FROM s")


def test_compaction_policy(shop):
    for i in range(12):
        shop.sql(f"UPDATE growers SET age = {i} WHERE id = 1")
    before = values(shop.sql("SELECT * FROM growers ORDER BY id"))
    assert shop.database.maybe_compact("growers")
    assert values(shop.sql("SELECT * FROM growers ORDER BY id")) == before and shop.database.dead_versions("growers") == 0


def test_transaction_reads_its_own_writes(shop):
    with shop.transaction() as t:
        t.sql("UPDATE crates SET kilos = 10.0 WHERE id = 31")
        t.sql("UPDATE crates SET kilos = kilos + 1 WHERE id = 31")
        assert values(t.read("SELECT kilos FROM crates WHERE id = 31")) == [11.0]
        t.sql("INSERT INTO crates VALUES (40, 1, 1.0), (41, 1, 2.0)")
        assert t.sql("DELETE FROM crates WHERE id >= 41") == 1
        assert values(shop.sql("SELECT kilos FROM crates WHERE id = 31")) == [8.0]
    assert values(shop.sql("SELECT id, kilos FROM crates ORDER BY id")) == [(31, 11.0), (32, 3.5), (33, 21.0), (40, 1.0)]


def test_conditions_on_the_key_reach_the_scan(shop):
    shop.sql("UPDATE crates SET kilos = 1 WHERE id = 32")
    plan = shop.sql("SELECT kilos FROM crates WHERE id = 32")
    assert "EqualTo(id,32)" in plan._jdf.queryExecution().executedPlan().toString() and values(plan) == [1.0]


def test_large_commits_conflict_by_their_rows(shop, monkeypatch):
    """Where keys aren't listed, the files tell whether two commits have changed the same rows."""
    from tidewater.sources import database

    monkeypatch.setattr(database, "LISTED_KEYS", 0)
    with shop.transaction() as t:
        t.sql("UPDATE crates SET kilos = 50 WHERE id <> 32")
        shop.sql("UPDATE crates SET kilos = 60 WHERE id = 32")
    assert values(shop.sql("SELECT kilos FROM crates ORDER BY id")) == [50.0, 60.0, 50.0]
    with pytest.raises(ConflictError), shop.transaction() as t:
        t.sql("UPDATE crates SET kilos = 1 WHERE id <> 32")
        shop.sql("UPDATE crates SET kilos = 2 WHERE id = 33")


def test_vacuum_with_a_horizon(shop):
    before = shop.database.latest()
    shop.sql("UPDATE growers SET age = 1")
    shop.database.compact("growers")
    assert shop.database.vacuum(before) == 0 and shop.table("growers", before).count() == 2
    assert shop.database.vacuum(shop.database.latest()) == 2
    assert values(shop.sql("SELECT age FROM growers")) == [1, 1]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_leads_to_keys(shop):
    shop.sql("CREATE INDEX by_grower ON crates(grower)")
    found = shop.sql("SELECT c.id FROM crates AS c WHERE c.grower = 1 AND kilos > 4 ORDER BY id")
    assert "In(id, [31,32])" in scans(found) and values(found) == [31]
    shop.sql("UPDATE crates SET grower = 2 WHERE id = 31")
    shop.sql("INSERT INTO crates VALUES (34, 1, NULL), (35, NULL, 1.0)")
    assert shop.database.lookup("crates", "grower", "value = 1") == [31, 32, 34]  # 31 has it no more
    assert values(shop.sql("SELECT id FROM crates WHERE grower = 1 ORDER BY id")) == [32, 34]
    assert values(shop.sql("SELECT id FROM crates WHERE grower = 9")) == []
    assert values(shop.sql("SELECT id FROM crates WHERE grower = 1 OR id = 33 ORDER BY id")) == [32, 33, 34]
    assert values(shop.sql("UPDATE crates SET kilos = 2 WHERE grower = 2")) == [2]
    assert values(shop.sql("DELETE FROM crates WHERE grower = 1 AND kilos IS NULL")) == [1]
    shop.database.compact("crates")
    assert shop.database.lookup("crates", "grower", "value = 1") == [32]
    shop.database.vacuum(shop.database.latest())
    assert values(shop.sql("SELECT id FROM crates WHERE grower = 2 ORDER BY id")) == [31, 33]


def test_index_in_a_transaction_and_of_a_version(shop):
    shop.sql("CREATE INDEX by_grower ON crates(grower)")
    with shop.transaction() as t:
        t.sql("INSERT INTO crates VALUES (50, 3, 1.0)")
        assert values(t.read("SELECT id FROM crates WHERE grower = 3")) == [50]
        assert t.sql("UPDATE crates SET kilos = 5 WHERE grower = 3") == 1
    assert values(shop.sql("SELECT kilos FROM crates WHERE grower = 3")) == [5.0]


def test_without_an_index_on_all_folders_the_table_is_read(shop, monkeypatch):
    from tidewater.sources import database

    base = shop.database.latest()
    late = shop.database.write("crates", shop.spark.createDataFrame([(60, 1, 1.0)], "id long, grower long, kilos double"), "I", base)
    shop.sql("CREATE INDEX by_grower ON crates(grower)")
    shop.database.commit([late])  # written when there was no index
    assert shop.database.lookup("crates", "grower", "value = 1") is None
    assert values(shop.sql("SELECT id FROM crates WHERE grower = 1 ORDER BY id")) == [31, 32, 60]
    shop.database.compact("crates")
    assert shop.database.lookup("crates", "grower", "value = 1") == [31, 32, 60]
    monkeypatch.setattr(database, "LOOKUP_KEYS", 2)
    assert shop.database.lookup("crates", "grower", "value = 1") is None
    assert values(shop.sql("SELECT id FROM crates WHERE grower = 1 ORDER BY id")) == [31, 32, 60]


def test_equalities():
    from tidewater.plans.dialect import equalities, only_table, significant

    assert equalities(significant("a = 1 AND t.b = 'x' AND c > 2 AND d = -3 AND (e = 1 OR f = 2)")) == [("a", "1"), ("b", "'x'"), ("d", "- 3")]
    for other in ("a = 1 OR b = 2", "a BETWEEN 1 AND b = 2", "NOT a = 1", "a = b", "a = NULL", "a = 1 + 1"):
        assert equalities(significant(other)) == []
    assert only_table(significant("SELECT a FROM t x WHERE a = 1 ORDER BY a"))[0] == "t"
    for other in ("SELECT a FROM t JOIN u WHERE a = 1", "SELECT a FROM t, u WHERE a = 1", "SELECT a FROM t WHERE a IN (SELECT a FROM t)", "SELECT a FROM t WHERE a = 1 UNION TABLE t"):
        assert only_table(significant(other)) is None


def test_distinct_is_rewritten(shop):
    shop.sql("INSERT INTO crates VALUES (36, 3, NULL)")
    assert values(shop.sql("SELECT DISTINCT grower FROM crates ORDER BY kilos DESC")) == [2, 1, 3]
    assert values(shop.sql("SELECT DISTINCT grower AS g FROM crates WHERE kilos > 0 ORDER BY kilos LIMIT 1")) == [1]
    assert values(shop.sql("SELECT DISTINCT grower FROM crates ORDER BY grower + 1 DESC")) == [3, 2, 1]
    assert values(shop.sql("SELECT DISTINCT ON (grower) id, kilos k FROM crates ORDER BY grower DESC, k")) == [(36, None), (33, 21.0), (32, 3.5)]
    assert len(values(shop.sql("SELECT DISTINCT ON (grower) id FROM crates"))) == 3
    assert values(shop.sql("SELECT DISTINCT ON (grower) * FROM crates ORDER BY grower, id DESC LIMIT 1")) == [(32, 1, 3.5)]


def test_functions_and_vector_filters(shop):
    from pyspark.sql import functions as F

    from tidewater.functions import vector

    shop.register_function("twice_age", "x * 2", "BIGINT", "x BIGINT")
    shop.register_function("longer", lambda s: s + "!", "string")
    assert values(shop.sql("SELECT twice_age(age), longer(name) FROM growers ORDER BY id")) == [(76, "Nadia!"), (32, "Piet!")]
    v = shop.spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 5.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = v.select(vector.filter_range("a", 2, 3), vector.compare("a", "b"), vector.filtered("a", lambda x: x < F.lit(2)))
    assert values(got) == [([2.0, 3.0], [True, False], [1.0]), (None, None, None)]
    assert values(v.selectExpr("vec_filter_range(a, 2D, 3D)", "vec_compare(a, b)"))[0] == ([2.0, 3.0], [True, False])


def test_header_of_a_join(shop):
    from tidewater.cli import run

    header = lambda sql: shop.header(sql, shop.sql(sql))
    assert header("SELECT * FROM growers g JOIN crates ON g.id = grower WHERE kilos > 1") == ["g.id", "g.name", "g.age", "crates.id", "crates.grower", "crates.kilos"]
    assert header("SELECT * FROM growers, crates ORDER BY kilos")[3] == "crates.id"
    assert header("SELECT * FROM growers ORDER BY id, name") == header("SELECT id, name, age FROM growers") == ["id", "name", "age"]
    assert "| g.id " in run(shop, "SELECT * FROM growers g CROSS JOIN crates c")
