"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilsim.llm import bpe, ctw, media, mixing, pii, quality_classifier, quality_rules, simhash, substring, toxicity
from tilsim.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize_documents(table(spark, sf_dir, "documents"), key=pii.session_key(spark))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policies(quality_rules.table_ledger(spark, sf_dir))


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(quality_rules.table_ledger(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), details=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"), folds=ctw.FOLDS)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "pages"))


def media_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_media_columns(spark, sf_dir).select("page_id", "digest", "raw_length", "kind", "title")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_bpe, op3_quality_classifier, op4_pii, op5_quality_rules, quality_rule_ablation, op6_mixing, op7_simhash, op8_toxicity, op9_lm_scoring, op10_media_columns, media_digests)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_classifier": quality_classifier.classify_sql(), "op5_quality_rules": quality_rules.ledger_sql(), "quality_rule_ablation": quality_rules.ablation_sql(), "op6_mixing": mixing.MIX_SQL, "media_digests": media.DIGESTS_SQL}
