"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, jaccard_join, mixing, pieces, resampling, sharding, substring_dedup, topk, toxicity
from tidewater.llm.common import table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans_removed(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.toxicity(table(spark, sf_dir, "documents"), labels, ("low_quality", "toxic"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_importance_resampling, op2_token_counts, op3_exact_dedup, op4_label_propagation_shards, op5_ngram_jaccard_join,
        op6_substring_dedup, op7_sentencepiece, op8_source_mixing, op9_exact_top_k, op10_toxicity,
    )
}

NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op5_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(NORM)} AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' ')) END) AS xs FROM w),
        n AS (SELECT doc_id, len(xs) AS n FROM s), u AS (SELECT doc_id, unnest(xs) AS x FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS t FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.t)
        SELECT doc_id, n AS n_shingles, min(t) AS component_id FROM n JOIN r USING (doc_id) GROUP BY doc_id, n""",
    "op6_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        h AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS p, unnest(list_transform(range(1, len(ws) - 48), lambda p: md5(array_to_string(ws[p:p + 49], ' ')))) AS k FROM w),
        m AS (SELECT k, min(doc_id) AS f FROM h GROUP BY k),
        g AS (SELECT DISTINCT h.doc_id, unnest(range(p, p + 50)) AS at FROM h JOIN m USING (k) WHERE f < h.doc_id),
        x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS at, unnest(ws) AS word FROM w),
        t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.at) AS kept, count(*) AS n FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.at = g.at GROUP BY x.doc_id)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON w.doc_id = t.doc_id""",
    "op9_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents),
        g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
              row_number() OVER (PARTITION BY norm, doc_id) AS nth FROM n)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND nth = 1 AS kept, sha256(norm) AS text_sha256 FROM g""",
}
