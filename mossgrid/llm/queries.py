"""Registered queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrid.llm import canonical, mixture, overlap, pairs, quota, related, spans, tokens
from mossgrid.llm.oracle import ORACLE as ORACLE


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_overlaps(_table(spark, d, "questions"))
    return pairs.select(
        F.least("train_id", "eval_id").alias("rec_id_a"), F.greatest("train_id", "eval_id").alias("rec_id_b")
    )


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    questions = _table(spark, d, "questions")
    return overlap.overlap_report(questions, overlap.cross_split_overlaps(questions))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.formatting_duplicates(_table(spark, d, "raw_records"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return canonical.collapsed_records(_table(spark, d, "raw_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota.proportional_sample(_table(spark, d, "questions"), _table(spark, d, "category_targets"))
    return report.where("short > 0").select("Modality", "TaskType")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota.proportional_sample(_table(spark, d, "questions"), _table(spark, d, "category_targets"))[0]


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return quota.proportional_sample(_table(spark, d, "questions"), _table(spark, d, "category_targets"))[1]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return related.related_records(_table(spark, d, "questions"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return related.grouped_splits(_table(spark, d, "questions"), _table(spark, d, "split_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(_table(spark, d, "predictions"), _table(spark, d, "label_terms"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defect_report(_table(spark, d, "predictions"), p6_found(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).where("short").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(_table(spark, d, "documents"), _table(spark, d, "source_targets"))[1]


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(_table(spark, d, "documents"), _table(spark, d, "source_targets"))[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p2_sample, p2_report, p3_found, p3_collapsed, p4_found, p4_splits, p6_found, p6_report, p7_ids, p8_found, p8_report, p8_mixture, p9_found)
}
