"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm import decontaminate, jaccard, lattice, lm, oracle, pii, quality, rulefit, secrets, substrings, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.listed_urls(spark))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulefit.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_substring_dedup, op4_sentencepiece, op5_quality_classifier, op6_secret_scan, op7_url_filter, op8_jaccard_join, op9_lm_score, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": oracle.DECONTAMINATE,
        "op3_substring_dedup": oracle.SUBSTRINGS,
        "op7_url_filter": oracle.URLS,
        "op8_jaccard_join": oracle.JACCARD,
        "op10_quality_rules": oracle.QUALITY,
    }
