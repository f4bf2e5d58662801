"""The queries of the corpus operators, over whole tables, with the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, exact_dedup, hard_negatives, language_id, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, token_store, wfst
from .common import documents, embeddings, items, labels


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(documents(spark, sf_dir)))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_language(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode_pieces(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), items(spark, sf_dir)).drop("items")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(embeddings(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = embeddings(spark, sf_dir).select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_quality, op3_exact_dedup, op4_suffix_dedup, op5_token_store, op6_language, op7_packing, op8_pieces, op9_token_counts, op10_rules, op11_decontaminate, op12_centroids, op13_hard_negatives)
}

def _rounds_sql(rounds: int) -> str:
    """CTEs a0.. (vec_id, q, m = [distance, cluster]) and c1.. (j, c) of the rounds; the last one only assigns."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
            SELECT vec_id, any_value(q) AS q, min([d, j]) AS m
            FROM (SELECT vec_id, q, j, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}) GROUP BY vec_id
        )""")
        if r < rounds:
            parts.append(f"""s{r} AS (
            SELECT j, i, (total - ((total % n) + n) % n) // n AS x FROM (
                SELECT m[2] AS j, i, sum(x)::BIGINT AS total, count(*) AS n FROM (SELECT m, unnest(q) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY m[2], i)
        ), c{r + 1} AS MATERIALIZED (
            SELECT o.j, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT j, list(x ORDER BY i) AS c FROM s{r} GROUP BY j) n ON n.j = o.j
        )""")
    return ", ".join(parts)


ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
        )
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
        FROM n JOIN g USING (text_sha256)
    """,
    "op11_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), i AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL
        ), s AS (
            SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS a FROM i WHERE len(w) > 0
        ), win AS (
            SELECT DISTINCT item_id, n, array_to_string(list_slice(w, a, a + n - 1), ' ') AS t FROM s
        ), p AS (
            SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
        ), o AS (
            SELECT r, a, array_to_string(list_slice(w, a, a + n - 1), ' ') AS t FROM p
        ), hit AS (
            SELECT r, a, win.n, item_id FROM o JOIN win ON win.t = o.t
        ), k AS (
            SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS k FROM hit) GROUP BY r
        ), x AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN x ON x.r = d.r
    """,
    "op12_centroids": f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
        ), c0 AS MATERIALIZED (
            SELECT j, c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), q) - 1 AS j, q AS c FROM v) WHERE j < 16
        ), {_rounds_sql(3)}
        SELECT vec_id, m[2]::INTEGER AS cluster, m[1] AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia, (sum(m[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a3 JOIN c3 ON c3.j = m[2]
    """,
    "op13_hard_negatives": """
        WITH v AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        ), s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT * FROM (SELECT anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5
        ), n AS (
            SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS k
            FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        )
        SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10
    """,
}
