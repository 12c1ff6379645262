"""The registered queries of the engine and their SQL.

Queries of the SQL surface are SQL text, run by Spark after the dialect's rewriting; where DuckDB spells
something differently, the second text is the one for it. The others are functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import statistics, vector
from tidewater.operators import learned_index, partitioning, relational
from tidewater.operators.ann import IVFIndex
from tidewater.plans import dialect, optimizer
from tidewater.session import Engine
from tidewater.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A fixed query vector: sin(1), sin(2), ... of 64 components, rounded.
PROBE = [round(__import__("math").sin(i), 3) for i in range(1, 65)]
PROBE_TEXT = "[" + ", ".join(map(str, PROBE)) + "]"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over the tables of a folder."""
    vector.register(spark)
    words = {t.text.lower() for t in dialect.significant(sql) if t.kind == "name"}
    for t in TABLES:
        if t in words:
            load(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(dialect.rewrite_vectors(sql, lambda name: name.split(".")[-1] == "embedding"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and revenue by market segment, of segments with more than one order."""
    return run_sql(
        """SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_mktsegment HAVING count(*) > 1 ORDER BY c_mktsegment""",
        spark,
        sf_dir,
    )


# name: SQL for both, or (Spark's, DuckDB's)
STATEMENTS: dict[str, str | tuple[str, str]] = {
    # filters and projection
    "scan_all_nation": "SELECT * FROM nation",
    "project_alias": "SELECT n_name AS name, n_regionkey region FROM nation",
    "filter_eq": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7",
    "filter_range_pk": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 7500",
    "filter_and_or_parens": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_custkey < 500",
    "filter_ne": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "filter_col_col": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey < l_suppkey",
    "filter_string": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_bool_expr": "SELECT p_partkey FROM part WHERE NOT (p_size > 10) AND p_retailprice >= 1000",
    "null_compare_excluded": "SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON s_nationkey = n_nationkey WHERE n_name <> 'X'",
    "null_literal_matches_nothing": "SELECT o_orderkey FROM orders WHERE o_orderstatus = NULL",
    "point_lookup": "SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) t WHERE o_orderkey = 42",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000",
    "join_using": "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)",
    "join_natural": "SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM nation) b",
    "join_cross": "SELECT a.r_name AS r1, b.r_name AS r2 FROM region a CROSS JOIN region b",
    "join_comma_3way": "SELECT s_suppkey, n_name, r_name FROM nation, region, supplier WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey",
    "join_theta": "SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "join_equi_residual": "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey",
    "join_right": "SELECT o_orderkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN orders ON c_custkey = o_custkey",
    "join_full": "SELECT a.c_custkey AS a_key, b.c_custkey AS b_key FROM (SELECT * FROM customer WHERE c_acctbal > 3000) a FULL OUTER JOIN (SELECT * FROM customer WHERE c_acctbal < 6000) b ON a.c_custkey = b.c_custkey",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "join_self": "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_many_to_many": "SELECT c_nationkey, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_nationkey",
    "join_null_keys": "SELECT a.k AS ak, b.k AS bk FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS k FROM nation) a JOIN (SELECT CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_nationkey END AS k FROM nation) b ON a.k = b.k",
    "join_int_double": "SELECT n_name, r_name FROM nation JOIN (SELECT CAST(r_regionkey AS DOUBLE) AS rk, r_name FROM region) r ON n_regionkey = rk",
    "join_4way_star": "SELECT r_name, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_lateral": "SELECT r_name, t.n AS n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) t",
    # aggregates
    "agg_count_star": "SELECT count(*) AS n FROM lineitem",
    "agg_count_col": "SELECT count(n_name) AS n FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) x ON s_nationkey = n_nationkey",
    "agg_sum_avg_min_max": "SELECT round(sum(CAST(l_quantity AS DOUBLE)), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem",
    "agg_empty_input": "SELECT count(*) AS n, sum(CAST(o_totalprice AS DOUBLE)) AS s, min(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0",
    "agg_min_max_string": "SELECT min(n_name) AS lo, max(n_name) AS hi FROM nation",
    "group_by_one": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "group_by_multi": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_no_agg": "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment",
    "group_null_keys": "SELECT k, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS k FROM orders) t GROUP BY k",
    "having_agg": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "having_hidden_agg": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000",
    "having_key_and_agg": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING o_custkey < 100 AND (count(*) > 12 OR max(o_totalprice) > 290000)",
    "group_after_join": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big FROM lineitem GROUP BY l_returnflag",
    "agg_expression": "SELECT round(sum(l_quantity * l_extendedprice) + sum(l_tax), 1) AS x FROM lineitem",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    # order, limit, distinct, sets
    "order_asc_desc": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey LIMIT 100",
    "order_hidden_col": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5",
    "offset_only": "SELECT n_name FROM nation ORDER BY n_name OFFSET 20",
    "offset_past_end": "SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 100",
    "topk": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50",
    "order_nulls": ("SELECT k FROM (SELECT CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey END AS k FROM nation) t ORDER BY k LIMIT 12", "SELECT k FROM (SELECT CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey END AS k FROM nation) t ORDER BY k NULLS FIRST LIMIT 12"),
    "order_after_group": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 3",
    "distinct_cols": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_star": "SELECT DISTINCT * FROM region",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "union": "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 5",
    # beyond the reference
    "window_rank": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders",
    "window_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "window_lag": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)",
    "correlated_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 280000)",
    "case_when": "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bin, count(*) AS n FROM part GROUP BY 1",
    "like_in_between": "SELECT p_partkey FROM part WHERE p_type LIKE '%A%' AND p_size IN (1, 2, 3, 4, 5) AND p_retailprice BETWEEN 900 AND 1500",
    "is_null": "SELECT count(*) AS n FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 2) x ON s_nationkey = n_nationkey WHERE n_name IS NULL",
    "json_props": ("SELECT event_type, CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type"),
    "date_trunc_events": "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1",
    # vectors
    "vec_topk_cosine": (f"SELECT vec_id, label FROM embeddings ORDER BY embedding <=> '{PROBE_TEXT}', vec_id LIMIT 10", f"SELECT vec_id, label FROM embeddings ORDER BY round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST({PROBE} AS DOUBLE[])), 12), vec_id LIMIT 10"),
    "vec_topk_l2": (f"SELECT vec_id, label FROM embeddings ORDER BY embedding <-> '{PROBE_TEXT}', vec_id LIMIT 10", f"SELECT vec_id, label FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({PROBE} AS DOUBLE[])), vec_id LIMIT 10"),
    "vec_topk_ip": (f"SELECT vec_id, label FROM embeddings ORDER BY embedding <#> '{PROBE_TEXT}', vec_id LIMIT 10", f"SELECT vec_id, label FROM embeddings ORDER BY -list_dot_product(CAST(embedding AS DOUBLE[]), CAST({PROBE} AS DOUBLE[])), vec_id LIMIT 10"),
    "vec_distance_project": (f"SELECT vec_id, round(embedding <=> '{PROBE_TEXT}', 6) AS distance FROM embeddings", f"SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST({PROBE} AS DOUBLE[])), 6) AS distance FROM embeddings"),
    "vec_norm": ("SELECT vec_id, round(vec_norm(CAST(embedding AS ARRAY<DOUBLE>)), 6) AS norm FROM embeddings", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings"),
    "vec_filter_then_topk": (f"SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY embedding <-> '{PROBE_TEXT}', vec_id LIMIT 5", f"SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({PROBE} AS DOUBLE[])), vec_id LIMIT 5"),
    "vec_normalize": (
        "SELECT vec_id, round(vec_norm(vec_normalize(CAST(embedding AS ARRAY<DOUBLE>))), 6) AS norm, round(vec_normalize(CAST(embedding AS ARRAY<DOUBLE>))[0], 6) AS x0 FROM embeddings",
        "SELECT vec_id, CAST(1.0 AS DOUBLE) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS x0 FROM embeddings",
    ),
    "vec_add_mul": (
        "SELECT vec_id, round(vec_add(v, v)[1], 6) AS a, round(vec_multiply(v, v)[2], 6) AS m FROM (SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM embeddings) t",
        "SELECT vec_id, round(2 * CAST(embedding[2] AS DOUBLE), 6) AS a, round(CAST(embedding[3] AS DOUBLE) * CAST(embedding[3] AS DOUBLE), 6) AS m FROM embeddings",
    ),
    "vec_filter_range": (
        "SELECT vec_id, size(vec_filter_range(CAST(embedding AS ARRAY<DOUBLE>), -0.5D, 0.5D)) AS n FROM embeddings",
        "SELECT vec_id, CAST(len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x >= -0.5 AND x <= 0.5)) AS INTEGER) AS n FROM embeddings",
    ),
    "vec_compare": (
        "SELECT vec_id, size(filter(vec_compare(CAST(embedding AS ARRAY<DOUBLE>), array_sort(CAST(embedding AS ARRAY<DOUBLE>))), x -> x)) AS n FROM embeddings",
        "SELECT vec_id, CAST(sum(CAST(x = y AS INTEGER)) AS INTEGER) AS n FROM (SELECT vec_id, unnest(embedding) AS x, unnest(list_sort(embedding)) AS y FROM embeddings) t GROUP BY vec_id",
    ),
}


def distinct_hidden_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_ordered(load(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_totalprice"]).limit(3)


def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = relational.distinct_on(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return first.select("o_custkey", "o_orderkey", "o_totalprice")


def _orders_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A statement that an engine has to rewrite first, over orders."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.register("orders", load(spark, sf_dir, "orders"))
        return e.sql(sql)

    return f


def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(load(spark, sf_dir, "events"), "ts", "2 hours", "1 day", "event_type", slide="1 hour")


def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.session_counts(load(spark, sf_dir, "events"), "ts", "6 hours", "1 day", "user_id")


def udf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function given as an expression, and one in Python."""
    e = Engine(spark)
    e.register("customer", load(spark, sf_dir, "customer"))
    e.register_function("tw_cents", "CAST(round(x * 100) AS BIGINT)", "BIGINT", "x DOUBLE")
    e.register_function("tw_half", lambda s: s // 2, "long")
    return e.sql("SELECT c_custkey, tw_cents(c_acctbal) AS cents, tw_half(c_custkey) AS half FROM customer")


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    clicks, views = (e.where(F.col("event_type") == t) for t in ("purchase", "view"))
    views = views.groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return relational.asof_join(clicks.select("event_id", "user_id", "ts"), views, "ts", ["user_id"], ["view_id"]).select("event_id", "view_id")


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    r = load(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 40 + 900).alias("low"), (F.col("n_nationkey") * 40 + 960).alias("high"))
    return relational.range_join(p, r, "p_retailprice", "low", "high", 60).select("p_partkey", "n_nationkey")


def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity")
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return relational.salted_join(li, s, "k").groupBy("s_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    out = vector.knn_batch(e.where("vec_id < 20"), e, 5, "l2")
    return out.select("query_id", "rank", "vec_id")


def knn_search_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knn_batch with every 20th vector as a query."""
    e = load(spark, sf_dir, "embeddings")
    return vector.knn_batch(e.where("vec_id % 20 = 0"), e, 5, "l2").select("query_id", "rank", "vec_id")


def analyze_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    aggs = [x for c in ("o_orderkey", "o_custkey", "o_totalprice") for x in (F.count(c).alias(f"{c}_n"), F.count_distinct(c).alias(f"{c}_ndv"), F.min(c).cast("double").alias(f"{c}_lo"), F.max(c).cast("double").alias(f"{c}_hi"))]
    return o.agg(*aggs)


def selectivity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.agg(*[F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in (("lt", F.col("o_totalprice") < 100000), ("eq", F.col("o_orderstatus") == "F"), ("ge", F.col("o_orderkey") >= 700))])


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated against true rows of some filters."""
    o = load(spark, sf_dir, "orders")
    d = statistics.analyze(o.select("o_orderkey", "o_totalprice"))
    cases = [("o_totalprice", "<", 100000.0), ("o_totalprice", ">=", 250000.0), ("o_orderkey", ">", 700.0)]
    rows = [(f"{c} {op} {v:g}", float(d[c].row_estimate(op, v)), o.where(f"{c} {op} {v}").count()) for c, op, v in cases]
    return spark.createDataFrame(rows, "predicate string, estimated double, actual long")


def join_card_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    n, ndv = c.agg(F.count("*"), F.count_distinct("c_custkey")).first()
    m, mdv = o.agg(F.count("*"), F.count_distinct("o_custkey")).first()
    return spark.createDataFrame([(float(optimizer.join_rows(n, m, ndv, mdv)),)], "estimate double")


# versioned tables ---------------------------------------------------------------------------------


def _orders_engine(spark: SparkSession, sf_dir: str) -> Engine:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    e = Engine(spark, f"{shared.rstrip('/')}/orders-{uuid.uuid4().hex}" if shared else None)
    e.sql("CREATE TABLE o (k BIGINT PRIMARY KEY, cust BIGINT, price DOUBLE, status TEXT)")
    load(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS cust", "o_totalprice AS price", "o_orderstatus AS status").createOrReplaceTempView("source_orders")
    e.sql("INSERT INTO o SELECT k, cust, price, status FROM source_orders")
    return e


def _after(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _orders_engine(spark, sf_dir)
        for s in statements:
            e.sql(s)
        return e.table("o")

    return f


def dml_snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders_engine(spark, sf_dir)
    before = e.database.latest()
    e.sql("DELETE FROM o WHERE cust < 100")
    return e.table("o", before)


def dml_compaction_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders_engine(spark, sf_dir)
    e.sql("UPDATE o SET status = 'X' WHERE price > 200000")
    e.database.compact("o")
    return e.table("o")


def dml_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders_engine(spark, sf_dir)
    with e.transaction() as t:
        t.sql("DELETE FROM o WHERE status = 'F'")
        t.sql("INSERT INTO o VALUES (-1, 1, 1.5, 'N')")
    return e.table("o")


def dml_transaction_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a transaction see the changes before them; of a row's changes the last one counts."""
    e = _orders_engine(spark, sf_dir)
    with e.transaction() as t:
        t.sql("UPDATE o SET price = 10.0 WHERE k < 1000")
        t.sql("UPDATE o SET price = price + 1 WHERE price < 11")
        t.sql("INSERT INTO o VALUES (-1, 1, 1.5, 'N'), (-2, 1, 2.5, 'N')")
        t.sql("DELETE FROM o WHERE k = -1 OR status = 'P'")
    return e.table("o")


def _indexed(spark: SparkSession, sf_dir: str) -> Engine:
    """Orders with an index on the customer, which some have changed since."""
    e = _orders_engine(spark, sf_dir)
    e.sql("CREATE INDEX by_cust ON o(cust)")
    e.sql("UPDATE o SET cust = 7 WHERE cust = 8")
    return e


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).sql("SELECT k, cust, price FROM o WHERE cust = 7 AND price > 1000")


def index_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that the index still lists and no row has any more, and one that rows have got since."""
    e = _indexed(spark, sf_dir)
    return e.sql("SELECT count(*) AS n FROM o WHERE cust = 8").unionAll(e.sql("SELECT count(*) AS n FROM o WHERE cust = 7"))


def dml_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _indexed(spark, sf_dir)
    e.sql("DELETE FROM o WHERE cust = 7 AND status = 'F'")
    return e.table("o")


def prepared_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders_engine(spark, sf_dir)
    return e.execute(e.prepare("SELECT k, price FROM o WHERE cust = $1 OR price > $2"), [7, 290000.0])


ORDERS = "SELECT o_orderkey AS k, o_custkey AS cust, o_totalprice AS price, o_orderstatus AS status FROM orders"

# learned indexes, neighbours, partitions ------------------------------------------------------------


def rmi_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = learned_index.positions(load(spark, sf_dir, "orders"), "o_orderkey")
    k, at = F.col("key"), F.col("position").cast("double")
    return p.agg(F.round(F.regr_slope(at, k), 6).alias("slope"), F.round(F.regr_intercept(at, k), 3).alias("intercept"))


def pgm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of which the segments' prediction is within the error bound: all of them."""
    index = learned_index.PGMIndex.build(load(spark, sf_dir, "orders"), "o_orderkey")
    near = index.predict(index.placed).where(F.abs(F.col("predicted") - F.col("position")) <= index.epsilon + 1e-6)
    return near.select(F.col("key").cast("long").alias("key"), "position")


def pgm_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = learned_index.PGMIndex.build(load(spark, sf_dir, "orders"), "o_totalprice")
    return index.range(100000, 120000).select(F.round("key", 2).alias("key"), "position")


def cdf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that the index predicts, against the true ones."""
    o = load(spark, sf_dir, "orders")
    index = learned_index.PGMIndex.build(o, "o_totalprice")
    rows = [(float(x), index.rank(x), o.where(F.col("o_totalprice") < x).count()) for x in (50_000.0, 150_000.0, 250_000.0)]
    return spark.createDataFrame(rows, "key double, predicted double, actual long")


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of the inverted file as it is by default; every 20th vector is a query."""
    e = load(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0")
    exact = vector.knn_batch(q, e, 10, "l2").select("query_id", "vec_id")
    near = IVFIndex(e).batch(q, 10).select("query_id", "vec_id")
    found = exact.join(near.withColumn("found", F.lit(1.0)), ["query_id", "vec_id"], "left")
    return found.agg(F.coalesce(F.sum("found") / F.count("*"), F.lit(0.0)).alias("recall"))


def hash_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = partitioning.sizes(partitioning.partition(load(spark, sf_dir, "orders"), "hash", 16, "o_custkey"))
    return p.agg(F.sum("n").alias("n"))


def range_partition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = partitioning.partition(load(spark, sf_dir, "orders"), "range", 8, "o_orderkey")
    return p.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("t")).agg(F.sum("n").alias("n"), F.round(F.sum("t"), 1).alias("total"))


def analyze_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ANALYZE finds in orders; whether its distinct values are within 5 % of the true number."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    found = statistics.analyze(o)
    true = o.agg(*[F.count_distinct(c).alias(c) for c in o.columns]).first()
    rows = [(c, d.rows, d.nulls, d.low, d.high, abs(d.distinct - true[c]) <= 0.05 * true[c]) for c, d in found.items()]
    return spark.createDataFrame(rows, "name string, n long, nulls long, low double, high double, ndv_close boolean")


def estimates_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters' true rows, and whether the estimates are within 2 % of all rows."""
    n = load(spark, sf_dir, "orders").count()
    close = F.abs(F.col("estimated") - F.col("actual")) <= 0.02 * n
    return estimates(spark, sf_dir).select("predicate", "actual", close.alias("close"))


def rmi_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that a recursive model index of 16 leaves predicts."""
    index = learned_index.RMI(load(spark, sf_dir, "orders"), "o_orderkey", 16)
    return index.predict().select(F.col("key").cast("long").alias("key"), "position", F.round("predicted", 3).alias("predicted"))


def cdf_rank_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True ranks, and whether the predicted ones are within the index's bound and the key's own gap."""
    close = F.abs(F.col("predicted") - F.col("actual")) <= learned_index.EPSILON + 1
    return cdf_rank(spark, sf_dir).select("key", "actual", close.alias("close"))


def ann_recall_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_recall(spark, sf_dir).select((F.col("recall") >= 0.9).alias("reached"))


def hash_partition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys there are, and how many of them hash partitioning puts into more than one partition."""
    p = partitioning.partition(load(spark, sf_dir, "orders").select("o_custkey"), "hash", 16, "o_custkey")
    keys = p.groupBy("o_custkey", F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.count("*").alias("parts"))
    return keys.agg(F.count("*").alias("keys"), F.count_if(F.col("parts") > 1).alias("split"))


def range_partition_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys stand in the partitions, and how many partitions begin before their predecessor ends."""
    p = partitioning.partition(load(spark, sf_dir, "orders").select("o_orderkey"), "range", 8, "o_orderkey")
    ranges = p.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    before = F.lag("high").over(Window.orderBy("part"))  # a row a partition
    return ranges.withColumn("before", before).agg(F.sum("n").alias("n"), F.count_if(F.col("low") <= F.col("before")).alias("overlaps"))


FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "flagship": (flagship, "SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment HAVING count(*) > 1"),
    "distinct_hidden_order": (distinct_hidden_order, "SELECT o_orderpriority FROM (SELECT o_orderpriority, min(o_totalprice) AS m FROM orders GROUP BY 1) t ORDER BY m, o_orderpriority LIMIT 3"),
    "distinct_on": (distinct_on, "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    "distinct_hidden_order_sql": (_orders_sql("SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_custkey > 3 ORDER BY o_totalprice DESC LIMIT 3"), "SELECT p FROM (SELECT o_orderpriority AS p, max(o_totalprice) AS m FROM orders WHERE o_custkey > 3 GROUP BY 1) t ORDER BY m DESC LIMIT 3"),
    "distinct_on_sql": (_orders_sql("SELECT DISTINCT ON (o_custkey) o_custkey AS cust, o_orderkey, o_totalprice FROM orders ORDER BY cust, o_totalprice DESC, 2"), "SELECT DISTINCT ON (o_custkey) o_custkey AS cust, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    "window_sliding": (window_sliding, "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) t GROUP BY ALL"),
    "window_session": (window_session, """
        WITH e AS (SELECT user_id, ts, CAST(coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, TRUE) AS INTEGER) AS first FROM events),
        s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
        SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, session"""),
    "udf_sql": (udf_sql, "SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_custkey // 2 AS half FROM customer"),
    "asof_join": (asof_join, "SELECT c.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') c ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON c.user_id = v.user_id AND c.ts >= v.ts"),
    "range_join": (range_join, "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_retailprice BETWEEN n_nationkey * 40 + 900 AND n_nationkey * 40 + 960"),
    "salted_join": (salted_join, "SELECT s_name, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name"),
    "knn_batch": (knn_batch, "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id < 20 AND q.vec_id <> v.vec_id) t WHERE rank <= 5"),
    "knn_search_set": (knn_search_set, "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) t WHERE rank <= 5"),
    "analyze_orders": (analyze_orders, "SELECT " + ", ".join(f"count({c}) AS {c}_n, count(DISTINCT {c}) AS {c}_ndv, CAST(min({c}) AS DOUBLE) AS {c}_lo, CAST(max({c}) AS DOUBLE) AS {c}_hi" for c in ("o_orderkey", "o_custkey", "o_totalprice")) + " FROM orders"),
    "selectivity_exact": (selectivity_exact, "SELECT round(avg(CAST(o_totalprice < 100000 AS DOUBLE)), 6) AS lt, round(avg(CAST(o_orderstatus = 'F' AS DOUBLE)), 6) AS eq, round(avg(CAST(o_orderkey >= 700 AS DOUBLE)), 6) AS ge FROM orders"),
    "estimates": (estimates, None),
    "join_card_formula": (join_card_formula, "SELECT CAST(n AS DOUBLE) * m / greatest(nd, md) AS estimate FROM (SELECT count(*) AS n, count(DISTINCT c_custkey) AS nd FROM customer) c, (SELECT count(*) AS m, count(DISTINCT o_custkey) AS md FROM orders) o"),
    "dml_insert": (_after("INSERT INTO o VALUES (-1, 5, 10.5, 'N'), (-2, NULL, 1.0, NULL)"), f"{ORDERS} UNION ALL SELECT * FROM (VALUES (-1, 5, 10.5, 'N'), (-2, NULL, 1.0, NULL)) t(k, cust, price, status)"),
    "dml_upsert_dup_pk": (_after("INSERT INTO o (k, cust, price) VALUES (1, 9, 2.5)"), f"SELECT k, CASE WHEN k = 1 THEN 9 ELSE cust END AS cust, CASE WHEN k = 1 THEN 2.5 ELSE price END AS price, CASE WHEN k = 1 THEN NULL ELSE status END AS status FROM ({ORDERS}) t"),
    "dml_update_arith": (_after("UPDATE o SET price = price + 1, cust = cust / 2 WHERE status = 'F'"), f"SELECT k, CASE WHEN status = 'F' THEN cust // 2 ELSE cust END AS cust, CASE WHEN status = 'F' THEN price + 1 ELSE price END AS price, status FROM ({ORDERS}) t"),
    "dml_update_swap": (_after("UPDATE o SET cust = price, price = cust WHERE k < 100"), f"SELECT k, CASE WHEN k < 100 THEN CAST(trunc(price) AS BIGINT) ELSE cust END AS cust, CASE WHEN k < 100 THEN CAST(cust AS DOUBLE) ELSE price END AS price, status FROM ({ORDERS}) t"),
    "dml_delete": (_after("DELETE FROM o WHERE price > 150000 OR cust = 3"), f"SELECT * FROM ({ORDERS}) t WHERE NOT (price > 150000 OR cust = 3)"),
    "dml_snapshot_as_of": (dml_snapshot_as_of, ORDERS),
    "dml_compaction_noop": (dml_compaction_noop, f"SELECT k, cust, price, CASE WHEN price > 200000 THEN 'X' ELSE status END AS status FROM ({ORDERS}) t"),
    "dml_transaction_rewrite": (dml_transaction_rewrite, f"SELECT * FROM (SELECT k, cust, CASE WHEN k < 1000 THEN 11.0 WHEN price < 11 THEN price + 1 ELSE price END AS price, status FROM ({ORDERS}) t) u WHERE status <> 'P' UNION ALL SELECT -2, 1, 2.5, 'N'"),
    "dml_point_update": (_after("UPDATE o SET price = 0.5 WHERE k = 7", "DELETE FROM o WHERE k = 3"), f"SELECT k, cust, CASE WHEN k = 7 THEN 0.5 ELSE price END AS price, status FROM ({ORDERS}) t WHERE k <> 3"),
    "dml_transaction": (dml_transaction, f"SELECT * FROM ({ORDERS}) t WHERE status <> 'F' UNION ALL SELECT -1, 1, 1.5, 'N'"),
    "index_lookup": (index_lookup, f"SELECT k, 7 AS cust, price FROM ({ORDERS}) t WHERE cust IN (7, 8) AND price > 1000"),
    "index_stale": (index_stale, f"SELECT CAST(0 AS BIGINT) AS n UNION ALL SELECT count(*) FROM ({ORDERS}) t WHERE cust IN (7, 8)"),
    "dml_indexed": (dml_indexed, f"SELECT k, CASE WHEN cust = 8 THEN 7 ELSE cust END AS cust, price, status FROM ({ORDERS}) t WHERE NOT (cust IN (7, 8) AND status = 'F')"),
    "prepared_select": (prepared_select, f"SELECT k, price FROM ({ORDERS}) t WHERE cust = 7 OR price > 290000"),
    "rmi_fit": (rmi_fit, "SELECT round(regr_slope(p, k), 6) AS slope, round(regr_intercept(p, k), 3) AS intercept FROM (SELECT CAST(o_orderkey AS DOUBLE) AS k, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS DOUBLE) AS p FROM orders) t"),
    "pgm_lookup": (pgm_lookup, "SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders"),
    "pgm_range": (pgm_range, "SELECT round(k, 2) AS key, position FROM (SELECT o_totalprice AS k, row_number() OVER (ORDER BY o_totalprice) - 1 AS position FROM orders) t WHERE k BETWEEN 100000 AND 120000"),
    "cdf_rank": (cdf_rank, None),
    "ann_recall": (ann_recall, None),
    "hash_partition_counts": (hash_partition_counts, "SELECT count(*) AS n FROM orders"),
    "range_partition_totals": (range_partition_totals, "SELECT count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders"),
    "analyze_columns": (analyze_columns, " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) - count({c}) AS nulls, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, TRUE AS ndv_close FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice"))),
    "estimates_close": (estimates_close, " UNION ALL ".join(f"SELECT '{c}' AS predicate, count(*) AS actual, TRUE AS close FROM orders WHERE {c}" for c in ("o_totalprice < 100000", "o_totalprice >= 250000", "o_orderkey > 700"))),
    "rmi_predict": (rmi_predict, """
        WITH p AS (SELECT CAST(o_orderkey AS DOUBLE) AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders),
        r AS (SELECT regr_slope(pos, k) AS s, regr_intercept(pos, k) AS i, count(*) AS n FROM p),
        l AS (SELECT k, pos, greatest(0, least(15, floor((k * s + i) * 16 / n))) AS leaf FROM p, r),
        m AS (SELECT leaf, coalesce(regr_slope(pos, k), 0.0) AS s, coalesce(regr_intercept(pos, k), avg(pos)) AS i FROM l GROUP BY leaf)
        SELECT CAST(k AS BIGINT) AS key, pos AS position, round(k * s + i, 3) AS predicted FROM l JOIN m USING (leaf)"""),
    "cdf_rank_close": (cdf_rank_close, " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS key, count(*) AS actual, TRUE AS close FROM orders WHERE o_totalprice < {x}" for x in (50_000, 150_000, 250_000))),
    "ann_recall_reached": (ann_recall_reached, "SELECT TRUE AS reached"),
    "hash_partition_keys": (hash_partition_keys, "SELECT count(DISTINCT o_custkey) + max(CAST(o_custkey IS NULL AS INTEGER)) AS keys, CAST(0 AS BIGINT) AS split FROM orders"),
    "range_partition_order": (range_partition_order, "SELECT count(*) AS n, CAST(0 AS BIGINT) AS overlaps FROM orders"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: partial(run_sql, s if isinstance(s, str) else s[0]) for k, s in STATEMENTS.items()} | {k: f for k, (f, _) in FUNCTIONS.items()}
SQL: dict[str, str] = {k: s if isinstance(s, str) else s[1] for k, s in STATEMENTS.items()} | {k: s for k, (_, s) in FUNCTIONS.items() if s}
