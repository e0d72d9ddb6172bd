"""The registered queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sql import ORACLE_SQL  # noqa: F401


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import words_taken

    return words_taken(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxic_documents

    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import languages

    return languages(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_notices

    return license_notices(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import phrases

    return phrases(table(spark, sf_dir, "documents")).drop("cut")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import removed

    return removed(table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {
    "op13_substring_dedup": op13_substring_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op11_collocations": op11_collocations,
    "op7_chat_format": op7_chat_format,
    "op4_license_scan": op4_license_scan,
    "op10_language_id": op10_language_id,
    "op5_toxicity": op5_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op6_near_duplicates": op6_near_duplicates,
    "op1_decontamination": op1_decontamination,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op3_sharding": op3_sharding,
}
