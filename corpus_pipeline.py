"""A corpus from raw documents to token files, one saved table per stage.

Stages in order: toxic documents go, one document of each group of near copies stays, documents that repeat benchmark
passages go, sources are mixed to target weights, and what is left becomes token files. All but the
last return the columns of ``documents``; the last returns one row per document of the token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitframe.llm import mixing, similar, spaced_seeds, token_files, toxicity
from traitframe.llm.common import save, table
from traitframe.session import new_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the limit of their language; the classifier learns from all labelled documents of the input."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that texts of 0.8 or more equal five-word shingles connect."""
    return similar.keep_one_per_similar_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no passage of the benchmark."""
    return spaced_seeds.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the ends of a shard's run of blocks are parts of documents."""
    return mixing.mixed_documents(docs)


def token_table(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, written and read back: ``(doc_id, start, n_tokens, ids_crc32)``."""
    path = new_path(spark, "corpus-tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("source_mix", mixed),
    ("token_files", token_table),
]

# Training, links and token ids are beyond SQL: each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
