"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrapipe.llm.common import table, written
from terrapipe.llm.decontamination import drop_contaminated
from terrapipe.llm.mixing import mixed_texts
from terrapipe.llm.near_duplicates import keep_one_of_each
from terrapipe.llm.quality_rules import keep_good
from terrapipe.llm.sharding import shard_by_bytes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; repeated rows go or stay together."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of least doc_id; texts without words all stay."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away a benchmark item go; null, empty and token-free texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source are repeated or thinned out to its target; texts without words go."""
    return mixed_texts(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix; a null text has no bytes, a null doc_id sorts first."""
    return shard_by_bytes(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Tiling and mixing have no SQL; tests/llm holds run() against SQL (stages 1, 2) and plain Python (3, 4, 5).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
