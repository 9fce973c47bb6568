"""The registered query of each operator: whole tables, production parameters, digest columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comeback.llm import (
    decontaminate,
    fuzzy_lines,
    jaccard,
    languages,
    licenses,
    periodic,
    personal,
    piece_table,
    quality,
    substrings,
    suffix_arrays,
    warc,
    whitening,
)

#: Tokenizer model used by the queries, one of the public vocabulary files of the machine.
MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op1_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_documents(table(spark, folder, "documents"))


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find_personal(table(spark, folder, "documents"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_table.token_digests(table(spark, folder, "documents"), model_file())


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, folder, "pages"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeated_words(table(spark, folder, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_arrays.remove_repeated_bytes(table(spark, folder, "documents"))


def op8_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = fuzzy_lines.without_repeated_lines(table(spark, folder, "documents"), fuzzy_lines.WHOLE)
    return kept.select("doc_id", "lines_in", "lines_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"))


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents, by the CRC-32 of their id, is held out; those without an id teach nothing."""
    docs = table(spark, folder, "documents")

    def part(ids: Column) -> Column:
        return F.crc32(ids.cast("string").cast("binary")) % 4

    model = languages.fit_languages(docs.where(part(F.col("doc_id")) != 2))
    found = languages.label_languages(docs, model, spans=False)
    return found.withColumn("held_out", F.coalesce(part(F.col("doc_id")) == 2, F.lit(False)))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, folder, "embeddings")))


def planted_runs(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document, by the CRC-32 of its id, repeats a stretch from some word to its end."""
    key = zlib.crc32(str(doc_id).encode())
    if doc_id is None or key % 10:
        return None
    g = key // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    places = np.arange(n)
    places[first:] = first + (places[first:] - first) % period
    return places


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.collapse_runs(table(spark, folder, "documents"), source=planted_runs, texts=False)
    return periodic.longest_run(found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_quality_rules": op2_quality_rules,
    "op3_personal_data": op3_personal_data,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_warc": op5_warc,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_language_id": op11_language_id,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
SQL: dict[str, str] = {
    "op1_license_scans": licenses.scan_sql(),
    "op5_warc": WARC_SQL,
}
