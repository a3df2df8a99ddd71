"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table
from . import ball_kmeans, context_mixing, decontaminate, html_text, licenses, packing, permutation_index, phrases, piece_scan, pii, quality, simhash, suffix_dedup


def vocabulary() -> tuple[str, str]:
    """The public byte-level vocabulary that the packing query reads, and the same one as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, table(spark, sf_dir, "labels")).drop("text")


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), *vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


#: The query's key; a user keeps an own secret.
PII_KEY = b"registered query"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each part of each document: its ids, and the text they decode to."""
    path = piece_model()
    parts = piece_scan.decoded(piece_scan.encoded(table(spark, sf_dir, "documents"), path), path)
    return parts.select("doc_id", "part", F.col("numbers").alias("ids"), "text")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.compressed(table(spark, sf_dir, "embeddings"))


def op13_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.marked(docs, table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_text": op2_html_text,
    "op3_context_mixing": op3_context_mixing,
    "op4_line_quality": op4_line_quality,
    "op5_mixture_packing": op5_mixture_packing,
    "op6_license_sentences": op6_license_sentences,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_permutation_index": op8_permutation_index,
    "op10_piece_scan": op10_piece_scan,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_benchmark_windows": op13_benchmark_windows,
}

ORACLE_SQL: dict[str, str] = {
    "op6_license_sentences": licenses.scan_sql(),
    "op11_phrase_collocations": phrases.collocations_sql(),
    "op12_ball_kmeans": ball_kmeans.compressed_sql(),
    "op13_benchmark_windows": decontaminate.digest_sql(),
}
