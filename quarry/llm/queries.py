"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import collocations, conversations, decontaminate, gif, language, licenses, maxent, mixing, neardup, quality, repeats, rules, sql, toxicity
from .common import documents


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.report(documents(spark, sf_dir))


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(documents(spark, sf_dir))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(documents(spark, sf_dir))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {
    "op1_gif": op1_gif,
    "op2_maxent": op2_maxent,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_licenses": op7_licenses,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_neardup": op10_neardup,
    "op11_conversations": op11_conversations,
    "op12_rules": op12_rules,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op3_decontamination": sql.OP3,
    "op8_mixing": sql.OP8,
    "op9_suffix_dedup": sql.OP9,
    "op10_neardup": sql.OP10,
    "op13_collocations": sql.OP13,
}
