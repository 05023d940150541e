"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, licenses, mixing, negatives, packing, pii, sharding, simhash, token_files, toxicity, vector_codes, vectors
from .common import id_part


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer())
    return token_files.read_token_files(spark, folder)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), **mixing.BY_SOURCE)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = id_part(F.col("doc_id"), 4)
    held_out = F.coalesce(part == 2, F.lit(False))
    got = langid.identify(table(spark, sf_dir, "documents"), part != 2)
    return got.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.switches")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = id_part(F.col("doc_id"), 5)
    held_out = F.coalesce(part == 0, F.lit(False))
    got = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part != 0)
    return got.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.summary(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_personal_data, op3_mixing, op4_packing, op5_language,
        op6_exact_dedup, op7_toxicity, op8_vector_dedup, op9_simhash, op10_sharding,
        op11_licenses, op12_vector_codes, op13_hard_negatives,
    )
}

_INTEGERS = """SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""


def _rounds(n: int) -> str:
    """n rounds of assignment and new entries, and the last assignment."""
    steps = []
    for k in range(n + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
            SELECT vec_id, p, v, e, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS o FROM (
                SELECT vec_id, p, v, e, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM parts JOIN r{k} USING (p)
            )) WHERE o = 1
        )""")
        if k < n:
            steps.append(f"""r{k + 1} AS MATERIALIZED (
            SELECT p, e, coalesce(m, c) AS c FROM r{k} LEFT JOIN (
                SELECT p, e, list(mean ORDER BY i) AS m FROM (SELECT p, e, i, floor(sum(v[i]) / count(*)) AS mean FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e
            ) USING (p, e)
        )""")
    return ", ".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op12_vector_codes": f"""
        WITH w AS MATERIALIZED ({_INTEGERS.format(scale=1024)}),
        parts AS MATERIALIZED (SELECT vec_id, p, q[len(q) // 4 * p + 1 : len(q) // 4 * (p + 1)] AS v FROM w, (VALUES (0), (1), (2), (3)) AS t(p)),
        r0 AS MATERIALIZED (SELECT p, e - 1 AS e, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM parts) WHERE e <= 256),
        {_rounds(4)},
        books AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM r4)),
        coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN w USING (vec_id), books
    """,
    "op13_hard_negatives": f"""
        WITH w AS MATERIALIZED (SELECT vec_id, q, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({_INTEGERS.format(scale=256)}) WHERE label IS NOT NULL),
        s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ),
        positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS o FROM s WHERE same) WHERE o <= 5)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
            SELECT p.*, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
            FROM positives p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        ) WHERE rank <= 5
    """,
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS s
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY s) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS kept,
               sha256(s) AS text_sha256
        FROM d
    """,
    "op8_vector_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ),
        r(vec_id, seen) AS (
            SELECT vec_id, vec_id FROM v
            UNION
            SELECT l.b, r.seen FROM r JOIN l ON l.a = r.vec_id
        ),
        c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)
    """,
}
