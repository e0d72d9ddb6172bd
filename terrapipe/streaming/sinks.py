"""Sinks that leave each row once, whatever is replayed, and windows over late and unordered rows.

A table of events is laid out by month and epoch. A batch replaces what its own epoch left before, and
leaves out the ids that other epochs hold for the months it brings; so only those months are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import exists, folder


def _kept(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    whole = T.StructType([*schema.fields, T.StructField("month", T.DateType()), T.StructField("epoch", T.LongType())])
    return spark.read.schema(whole).parquet(path) if exists(spark, path) else None


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema`` of what a sink has left; no rows where it has left none, as then no file says what they are."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def record(batch: DataFrame, epoch: int, path: str, key: str, at: str) -> DataFrame:
    """Write the rows of ``batch`` that no other epoch holds, one for each ``key``; return them.

    ``at`` is the timestamp of a row: a key always comes with the same one. Of rows with one key the
    earliest in order of all columns stays.
    """
    spark, columns = batch.sparkSession, batch.columns
    first = F.min(F.struct(at, *[c for c in columns if c not in (key, at)])).alias("row_")
    rows = batch.groupBy(key).agg(first).select(key, "row_.*").select(columns).withColumn("month", F.trunc(F.col(at), "month"))
    kept = _kept(spark, path, batch.schema)
    if kept is not None:
        others = kept.where((F.col("epoch") != epoch) & F.col("month").isin(_months(rows, "month"))).select(key, "month")
        rows = rows.join(others, [key, "month"], "left_anti")
    made = folder(spark, "epoch")  # written aside first: the table that is read here is written below
    rows.write.parquet(made)
    rows = spark.read.schema(rows.schema).parquet(made)
    out = rows.withColumn("epoch", F.lit(epoch).cast("long"))
    out.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "epoch").parquet(path)
    return rows.drop("month")


def _months(batch: DataFrame, at: str) -> list:
    """The months of a batch, which prune the partitions of a table; there are few."""
    return [r.m for r in batch.select(F.trunc(F.col(at), "month").alias("m")).distinct().collect()]


def audit_with_parent(stream: DataFrame, events_path: str, advisories_path: str, checkpoint: str):  # noqa: ANN201
    """Evaluations (event_id, detected_at, state, district, action, reason) audited once each, and an advisory for each that speaks.

    An advisory (event_id, generated_at, action, reason) takes state and district from the event
    that the audit holds, by a join; without an event there is none. Replayed and reordered batches leave the same tables.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        record(batch, epoch, events_path, "event_id", "detected_at")
        said = batch.where("action <> 'abstain'").select("event_id", F.col("detected_at").alias("generated_at"), "action", "reason")
        advise(said, epoch, advisories_path, events_path, batch.schema)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def advise(batch: DataFrame, epoch: int, advisories_path: str, events_path: str, events_schema: T.StructType) -> None:
    """Insert advisories with the state and the district of their event; those without an event go."""
    events = _kept(batch.sparkSession, events_path, events_schema)
    if events is None:
        return
    parents = events.where(F.col("month").isin(_months(batch, "generated_at"))).select("event_id", "state", "district").dropDuplicates(["event_id"])
    record(batch.join(parents, "event_id"), epoch, advisories_path, "event_id", "generated_at")


def sliding(stream: DataFrame, by: list[str], length: str, slide: str, late: str) -> DataFrame:
    """Rows and the sum of ``value`` of (ts, value, ...) in sliding windows; rows whose windows are over are dropped."""
    found = stream.withWatermark("ts", late).groupBy(*by, F.window("ts", length, slide)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(*by, F.col("window.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, by: list[str], gap: str, late: str) -> DataFrame:
    """Rows and the sum of ``value`` of (ts, value, ...) in sessions that a gap ends."""
    found = stream.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(*by, F.col("session_window.start").alias("start"), "n", "total")


def count_late(stream: DataFrame, path: str, checkpoint: str, late: Column):  # noqa: ANN201
    """A row for each epoch: rows, and how many of them lay behind the watermark of the epochs before.

    ``late`` is the interval by which the watermark trails the latest ts. An epoch that runs again replaces its row.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kept = spark.read.schema("rows long, late long, latest timestamp, epoch long").parquet(path) if exists(spark, path) else None
        known = None if kept is None else kept.where(F.col("epoch") < epoch).agg(F.max("latest")).first()[0]  # one row an epoch
        behind = F.lit(0) if known is None else F.count_if(F.col("ts") < F.lit(known) - late)
        found = batch.agg(F.count(F.lit(1)).alias("rows"), behind.cast("long").alias("late"), F.max("ts").alias("latest"))
        found.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def newest_of_source(stream: DataFrame) -> DataFrame:
    """Changes (source, file_id, modified, change) of the newest file of each source, from files in any order.

    The state of a source is its newest file: the one modified last, of equal times the least id. A
    newer one gives 'insert' and takes the older one back by 'delete'; older ones give nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = held
        for pdf in frames:
            order = pdf.sort_values(["modified", "file_id"], ascending=[False, True]).iloc[0]
            found = (int(order["modified"]), int(order["file_id"]))
            if best is None or (-found[0], found[1]) < (-best[0], best[1]):
                best = found
        if best is not None and best != held:
            state.update(best)
            rows = [(key[0], best[1], best[0], "insert")]
            if held is not None:
                rows.append((key[0], held[1], held[0], "delete"))
            yield pd.DataFrame(rows, columns=["source", "file_id", "modified", "change"])

    return stream.groupBy("source").applyInPandasWithState(
        step, "source string, file_id long, modified long, change string", "modified long, file_id long", "update", GroupStateTimeout.NoTimeout
    )


def log_changes(changes: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """The changes of each epoch in a folder of their own, replaced when the epoch runs again."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def standing(log: DataFrame) -> DataFrame:
    """What the changes leave: inserted and not taken back."""
    sign = F.when(F.col("change") == "insert", 1).otherwise(-1)
    return log.groupBy("source", "file_id", "modified").agg(F.sum(sign).alias("left_")).where("left_ > 0").drop("left_")
