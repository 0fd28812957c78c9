"""The registered queries of the text operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, decontaminate, langid, license_scan, line_dedup, lm_score, quality, secrets, simhash, topk
from seqloom.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), langid.held_out_remainder(F.col("doc_id")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), lm_score.held_out_remainder(F.col("doc_id")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_license_scan": op5_license_scan,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_bpe": op8_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_top_k": op10_top_k,
}

ORACLES: dict[str, str] = {
    "op9_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, len(ls) AS n, ls[i + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d, range(0, len(ls)) t(i)
        ), h AS (
            SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l
        ), r AS (
            SELECT *, row_number() OVER d AS p, sum(w) OVER d AS upto, (31 * coalesce(lag(h) OVER d, 0) + h) // 65536 % 2 = 0 AS even FROM h WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)
        ), c AS (
            SELECT doc_id, i AS a, i AS b FROM r WHERE w >= 50
            UNION SELECT x.doc_id, x.i, min(y.i) FROM r x JOIN r y ON x.doc_id = y.doc_id AND y.p BETWEEN x.p + 1 AND x.p + 31 AND y.even AND y.upto - x.upto + x.w >= 10 GROUP BY x.doc_id, x.i
            UNION SELECT y.doc_id, max(x.i), y.i FROM r y JOIN (SELECT doc_id, i, p, upto, w, lead(even) OVER (PARTITION BY doc_id ORDER BY i) AS even FROM r) x ON x.doc_id = y.doc_id AND x.p BETWEEN y.p - 31 AND y.p - 1 AND NOT x.even AND y.upto - x.upto + x.w >= 10 GROUP BY y.doc_id, y.i
        ), u AS (
            SELECT c.doc_id, a, b, string_agg(line, chr(10) ORDER BY i) AS body FROM c JOIN l ON l.doc_id = c.doc_id AND l.i BETWEEN a AND b GROUP BY c.doc_id, a, b
        ), late AS (
            SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS k FROM u
        ), gone AS (
            SELECT DISTINCT doc_id, t.i FROM late, range(a, b + 1) t(i) WHERE k > 1
        )
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.lines_removed, 0) AS lines_removed
        FROM documents d LEFT JOIN (
            SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS text, count(gone.i) AS lines_removed
            FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
        ) k ON d.doc_id = k.doc_id
    """,
    "op10_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
