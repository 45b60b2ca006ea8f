"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from circdesk.llm import id_files, packing
from circdesk.llm.centroids import CENTROIDS, ROUNDS, SALT, cluster_vectors
from circdesk.llm.embedding_dedup import linked_vectors
from circdesk.llm.exact_dedup import exact_duplicates
from circdesk.llm.hard_negatives import hard_negatives
from circdesk.llm.jaccard_join import similar_documents
from circdesk.llm.language import classify, fit
from circdesk.llm.licenses import scan_licenses
from circdesk.llm.line_dedup import repeated_lines
from circdesk.llm.mixing import mix
from circdesk.llm.substring_dedup import without_repeats
from circdesk.llm.support import table
from circdesk.llm.surrogates import replace_entities

TOKENIZER = "byte_bpe_50k.json"
SURROGATE_KEY = "only for the registered query"  # a deployment passes a secret of its own


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path(TOKENIZER)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return id_files.read_documents(id_files.write_ids(docs, public_tokenizers.path(TOKENIZER)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _centroid_sql() -> str:
    """The rounds written out one after another, over one row per component."""
    steps = [f"""
        WITH w AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding AS v FROM embeddings
            WHERE len(embedding) = 64),
        u AS (SELECT r, vec_id, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) AS i FROM w),
        e AS MATERIALIZED (
            SELECT r, vec_id, i, floor(256 * x)::BIGINT AS x FROM u
            WHERE r IN (SELECT r FROM u GROUP BY r HAVING count(x) FILTER (isfinite(x)) = 64)),
        k AS (SELECT r, row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1 AS c
              FROM (SELECT DISTINCT r, vec_id FROM e) QUALIFY c < {CENTROIDS}),
        c0 AS MATERIALIZED (SELECT c, i, x FROM k JOIN e USING (r))"""]
    for n in range(ROUNDS + 1):
        steps.append(f""",
        d{n} AS (SELECT e.r, c.c, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d
                 FROM e JOIN c{n} c USING (i) GROUP BY ALL),
        a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < ROUNDS:
            steps.append(f""",
        s{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS m FROM a{n} JOIN e USING (r) GROUP BY ALL),
        c{n + 1} AS MATERIALIZED (
            SELECT c, i, coalesce((s - ((s % m) + m) % m) // m, x) AS x FROM c{n} LEFT JOIN s{n} USING (c, i))""")
    return "".join(steps) + f""",
        h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{ROUNDS} JOIN w USING (r) JOIN h USING (c)"""


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_surrogates": op5_surrogates,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_id_files": op8_id_files,
    "op9_language": op9_language,
    "op10_line_dedup": op10_line_dedup,
    "op11_centroids": op11_centroids,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_licenses": op13_licenses,
}

ORACLE = {
    "op3_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM n WINDOW same AS (PARTITION BY t)""",
    "op11_centroids": _centroid_sql(),
    "op12_hard_negatives": """
        WITH u AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, len(embedding) AS n,
                   unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        e AS (
            SELECT vec_id, label, i, floor(256 * x)::BIGINT AS x FROM u
            WHERE vec_id IN (SELECT vec_id FROM u GROUP BY vec_id HAVING count(x) FILTER (isfinite(x)) = any_value(n))),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS score
            FROM e a JOIN e b USING (i) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
               (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
}
