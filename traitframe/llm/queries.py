"""The registered queries of the text operators: each applies one to its whole table and takes the digest columns from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitframe.llm import alignment, host_rules, katz, line_filters, mixing, secret_scan, simhash, spaced_seeds, sql, suffix_levels, token_files, toxicity, transcripts, whitening
from traitframe.llm.common import crc_mod, table
from traitframe.session import new_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge_hosts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=crc_mod("_id", 5) != 0)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score_texts(table(spark, sf_dir, "documents"), learn=crc_mod("id", 7) != 2)
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < len(secret_scan.BASE_RULES))
    counts = [F.size(_of_kind(F.col("spans"), r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in secret_scan.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(_joined_spans(base), 256).alias("base_sha256"), _joined_spans(F.col("spans")).alias("spans"))


def op7_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.remove_repeats(table(spark, sf_dir, "documents"))


def op8_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse_transcripts(table(spark, sf_dir, "conversations"), learn=crc_mod("conv_id", 5) != 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    return white.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), *files)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_filters.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_token_files": op3_token_files,
    "op4_simhash_components": op4_simhash_components,
    "op5_katz_scores": op5_katz_scores,
    "op6_secret_scan": op6_secret_scan,
    "op7_long_repeats": op7_long_repeats,
    "op8_benchmark_overlaps": op8_benchmark_overlaps,
    "op9_source_mix": op9_source_mix,
    "op10_transcripts": op10_transcripts,
    "op11_whitening": op11_whitening,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": sql.QUALITY_RULES,
    "op13_line_dedup": sql.LINE_DEDUP,
}
