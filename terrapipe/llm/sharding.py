"""Contiguous shards of nearly equal bytes from global prefix sums. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import utf8_bytes, written


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, overhead: int = 8) -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text, ...) to one of ``n_shards`` contiguous shards.

    Rows are ordered by (doc_id, CRC of the text); a range partitioning gives each task one
    stretch of that order. Per-partition byte totals, one row each, become the offsets of the
    partitions, so the global prefix sum needs no task that sees more than one partition. A row
    goes to the shard in which the middle of its bytes falls when the whole is cut at equal
    targets: a shard differs from its target by at most one row at either end.

    Size: UTF-8 bytes of the text plus ``overhead``. Defined cases: a null text has no bytes; a
    null doc_id sorts first; equal rows take neighbouring slots; an empty table gives no rows;
    other columns of the input are ignored. A shard is empty only where one row spans it.
    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (from 0 within the shard, in
    order) and grown_shard (null: under this law a new count moves the cuts).
    """
    rows = docs.select(
        "doc_id",
        (utf8_bytes(F.col("text")) + F.lit(overhead)).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        # Only parts equal rows of one hot id, so that the range partitioning can split them.
        F.monotonically_increasing_id().alias("tie"),
    )
    # Range partitioning reads its input twice: let that be these narrow rows, not the texts.
    ranged = written(rows, "shard-rows").repartitionByRange("doc_id", "text_crc32", "tie")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "shard-ranges")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(W.partitionBy()).alias("all_bytes"),
    )  # one row for each partition, whatever the input

    upto = W.partitionBy("part").orderBy("doc_id", "text_crc32", "tie").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        ranged.select(
            "*", F.sum("size").over(upto).alias("bytes_to"), (F.row_number().over(upto) - 1).alias("rows_to")
        )
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(
                f"least(cast((cast(2 * (bytes_before + bytes_to) - size as decimal(28,0)) * {n_shards})"
                f" div cast(2 * all_bytes as decimal(28,0)) as int), {n_shards - 1})"
            ).alias("shard"),
            (F.col("rows_before") + F.col("rows_to")).alias("position"),
        )
    )
    # One row for each shard: n_shards at most.
    starts = placed.groupBy("shard").agg(F.min("position").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("position") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
