"""One query for each operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm import (
    align,
    decontaminate,
    hmm,
    jaccard_join,
    language,
    licenses,
    line_dedup,
    merkle,
    mixing,
    quality,
    secrets,
    sharding,
    topk,
)
from pipewright.llm.common import read_table
from pipewright.llm.oracles import ORACLES

# Shares of a thousand: the largest source is held down, the others are about even.
WEIGHTS = {"src0": 100, **{f"src{i}": 45 if i <= 10 else 50 for i in range(1, 20)}}
OTHER_WEIGHT = 25


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(
        read_table(spark, sf_dir, "documents"),
        read_table(spark, sf_dir, "labels"),
        ["quality", "toxic"],
    )
    keep = (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)
    return judged.select("doc_id", "quality", "quality_site", "toxic", "toxic_site", keep.alias("keep"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sharding.shuffled_shards(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.license_scan(docs).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), "license", "dice"
    )


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminated(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"),
        read_table(spark, sf_dir, "benchmark"),
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(read_table(spark, sf_dir, "documents")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mixed(docs, WEIGHTS, other=OTHER_WEIGHT).select(
        "doc_id", "mix_source", "block", "slot", "position"
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs, with_text=False).select(
        "doc_id", "held_out", "lang_pred", "score", "entropy", "rejected"
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proved_manifest(read_table(spark, sf_dir, "documents"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(read_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.token_alignment(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_sharding": op2_sharding,
        "op3_license_scan": op3_license_scan,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_decontamination": op5_decontamination,
        "op6_line_dedup": op6_line_dedup,
        "op7_secret_scan": op7_secret_scan,
        "op8_source_mixing": op8_source_mixing,
        "op9_language_id": op9_language_id,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_lm_scoring": op12_lm_scoring,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
