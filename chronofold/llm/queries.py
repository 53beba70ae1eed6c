"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import decontamination, exact_dedup, html_extract, license_scan, packing, recompression, simhash, suffix_repeats, toxicity, warc
from chronofold.llm.common import scratch_path, table


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.payload_table(warc.captures(warc.read_archive(spark, path)))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_toxicity_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.repeated_byte_digests(table(spark, sf_dir, "documents"))


def op7_recompression_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeated_word_digests(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    "op1_warc_transactions": op1_warc_transactions,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_wrapper_induction": op3_wrapper_induction,
    "op4_toxicity_instances": op4_toxicity_instances,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_recompression_repeats": op7_recompression_repeats,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_spaced_seed_decontamination": op9_spaced_seed_decontamination,
    "op10_license_templates": op10_license_templates,
}

ORACLE_SQL = {
    "op1_warc_transactions": """
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, url, strlen(payload) AS n, sha1(payload) AS h,
                   max(page_id) OVER (PARTITION BY payload) AS top FROM p
        )
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to, url
        FROM d
    """,
    "op6_suffix_repeats": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, n, unnest(generate_series(1, n)) AS k, x FROM d),
        win AS (SELECT doc_id, k, substr(x, 2 * k - 1, 2) AS b, CASE WHEN k <= n - 49 THEN unhex(substr(x, 2 * k - 1, 100)) END AS s FROM w),
        f AS (SELECT doc_id, k, b, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM win),
        c AS (SELECT doc_id, k, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS opens FROM c),
        g AS (
            SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
                   sha256(unhex(coalesce(string_agg(b, '' ORDER BY k) FILTER (NOT gone), ''))) AS kept_sha256
            FROM e GROUP BY doc_id
        )
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """,
    "op7_recompression_repeats": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, ws, len(ws) AS n FROM d),
        win AS (SELECT doc_id, k, word, n, CASE WHEN k <= n - 19 THEN array_to_string(list_slice(ws, k, k + 19), ' ') END AS s FROM w),
        f AS (SELECT doc_id, k, word, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1 AS again FROM win),
        c AS (SELECT doc_id, k, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
        g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)
    """,
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
}
