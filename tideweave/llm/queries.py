"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, jaccard, licences, lm_score, mixing, pieces, quality, secrets, token_ids, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest_columns(exact_dedup.exact_groups(documents(spark, sf_dir)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(documents(spark, sf_dir)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_ids(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def piece_model() -> bytes:
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(documents(spark, sf_dir), piece_model(), with_ids=False, with_text=False)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(documents(spark, sf_dir))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"op1_exact_dedup": op1_exact_dedup, "op2_quality_rules": op2_quality_rules, "op3_licence_scan": op3_licence_scan, "op4_secret_scan": op4_secret_scan, "op5_source_mix": op5_source_mix, "op6_token_blocks": op6_token_blocks, "op7_lm_score": op7_lm_score, "op8_sentence_pieces": op8_sentence_pieces, "op9_ngram_jaccard": op9_ngram_jaccard, "op10_toxicity": op10_toxicity, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op5_source_mix": mixing.oracle_sql(), "op9_ngram_jaccard": jaccard.oracle_sql()}
