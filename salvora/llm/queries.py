"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salvora.llm import decontamination, licenses, lm_scoring, mixing, pii, secrets, simhash, topk, toxicity, url_filter
from salvora.session import load


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op1_simhash(load(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op3_licenses(load(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op4_topk(load(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op5_pii(load(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.op6_lm_scoring(load(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op7_url_filter(load(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8_mixing(load(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op9_decontamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op10_secrets(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_licenses, op4_topk, op5_pii, op6_lm_scoring, op7_url_filter, op8_mixing, op9_decontamination, op10_secrets)}
ORACLE_SQL: dict[str, str] = {"op3_licenses": licenses.OP3_SQL, "op4_topk": topk.OP4_SQL, "op6_lm_scoring": lm_scoring.OP6_SQL, "op7_url_filter": url_filter.OP7_SQL, "op8_mixing": mixing.OP8_SQL}
