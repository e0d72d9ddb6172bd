"""Bounded samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

MASK = (1 << 63) - 1


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """(order, label, text) of about ``max_rows`` labelled documents that are not held out.

    Rows are drawn by a hash of their id, so the expected number is the bound whatever the size
    of the tables, and a rerun draws the same. The whole text of a drawn row is used; where an id
    has several texts, the least.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    n = known.count()
    order = F.xxhash64(F.lit(seed), "doc_id")
    drawn = known.withColumn("order", order)
    if n > max_rows:
        drawn = drawn.where(F.col("order").bitwiseAND(F.lit(MASK)) < int(MASK * (max_rows / n)))
    # About max_rows narrow rows, whatever the input.
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return found.groupBy("order", "label").agg(F.min("text").alias("text"))
