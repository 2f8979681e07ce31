"""From raw documents to token ids: five stages, each on all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents; the last adds the packed ids.

1. quality rules: documents that fail go
2. line dedup: lines that an earlier document holds go, and documents of which nothing is left; n_chars follows
3. n-gram Jaccard join: one document of each group of near copies stays
4. benchmark decontamination: documents that hold a benchmark item go
5. byte-level BPE: doc_id, lang, source, n_tokens, ids (packed little-endian unsigned 32-bit)

What may lie in documents, in every stage:
* Null or empty text fails the first stage; null ids, languages and sources are values like others.
* Repeated rows: the first stage treats them alike; of the rest one stays (line dedup counts rows of one id as one document,
  the near-duplicate stage keeps one row of those that agree in id and text).
* Ties go to the smallest id, a null id before all others, then to the smallest hash of the text.
* Texts of any length are read whole. Further columns pass through the first four stages as they are, whatever they are called.
* An empty table passes through every stage; an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import bpe, decontam, line_dedup, ngram_join, quality
from loomframe.llm.common import fresh, scratch_path, table
from loomframe.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a document that has lost lines and has no word left is the copy of others: it goes
    lines, dropped = fresh(docs.columns, "lines_before", "lines_dropped")
    kept = line_dedup.dedup_lines(docs, lines_col=lines, dropped_col=dropped)
    kept = kept.where((F.col(dropped) == 0) | F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = TOKENIZER.encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", bpe.n_tokens().alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", tokenisation),
]

#: Sketch quantiles, retrieval and BPE can't be put as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
