"""The corpus operators as registered queries: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fill_in_middle, html_extract, line_dedup, manifest, ngram_join, quality, sharding, substring, toxicity, url_filter, warc
from .common import scratch_path, table, whole
from .sql import ORACLES

SITE_RULES = (
    url_filter.Rule.site("allow", "com/"),
    url_filter.Rule.site("block", "example.com/en/"),
    url_filter.Rule.site("allow", "www.example.com/en/"),
    url_filter.Rule.site("block", "net/es/"),
    url_filter.Rule.site("block", "net/fr/"),
)

TOKENIZER = bpe.Tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = TOKENIZER.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    sha = lambda c: F.sha2(F.col(c), 256)
    return docs.select("doc_id", bpe.n_tokens().alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(whole("text").cast("binary"), 256).alias("kept_sha256"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), SITE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.audited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fill_in_middle.restored()).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_sharding": op1_hilbert_sharding,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_extract": op9_html_extract,
    "op10_url_filter": op10_url_filter,
    "op11_warc": op11_warc,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def oracles() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in QUERIES}
