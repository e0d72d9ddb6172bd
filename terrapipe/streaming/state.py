"""Stateful versions of the dry-run counter, the soil bucket and the hysteresis of decisions.

The state of a key is a few numbers. Rows of a key are taken in order of date inside a batch;
batches are expected in order of date, as a source of daily files gives them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import AWC_MM, HYSTERESIS_CYCLES, INITIAL_FILL, RAINY_DAY_MM
from ..storage import folder


def _by_date(frames: Iterable[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("date")


def stream_dry_run(readings: DataFrame) -> DataFrame:
    """(block_id, date, consecutive_dry_days) of streamed (block_id, date, rain_mm)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _by_date(frames)
        run = state.get[0] if state.exists else 0
        out = []
        for rain in pdf["rain_mm"]:
            run = run + 1 if pd.notna(rain) and rain < RAINY_DAY_MM else 0
            out.append(run)
        state.update((run,))
        yield pd.DataFrame({"block_id": key[0], "date": pdf["date"], "consecutive_dry_days": out})

    return readings.groupBy("block_id").applyInPandasWithState(
        step, "block_id int, date date, consecutive_dry_days int", "run int", "append", GroupStateTimeout.NoTimeout
    )


def stream_bucket(changes: DataFrame, awc: float = AWC_MM, initial: float = INITIAL_FILL) -> DataFrame:
    """(block_id, date, soil_moisture_mm) of streamed (block_id, date, change)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _by_date(frames)
        mm = state.get[0] if state.exists else initial * awc
        out = []
        for change in pdf["change"]:
            mm = min(awc, max(0.0, mm + change))
            out.append(mm)
        state.update((mm,))
        yield pd.DataFrame({"block_id": key[0], "date": pdf["date"], "soil_moisture_mm": out})

    return changes.groupBy("block_id").applyInPandasWithState(
        step, "block_id int, date date, soil_moisture_mm double", "mm double", "append", GroupStateTimeout.NoTimeout
    )


def stream_hysteresis(decisions: DataFrame, cycles: int = HYSTERESIS_CYCLES) -> DataFrame:
    """(block_id, date, action, stable) of streamed (block_id, date, action)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _by_date(frames)
        last, run, stable = state.get if state.exists else ("", 0, "")
        out = []
        for action in pdf["action"]:
            run = run + 1 if action == last else 1
            last = action
            if not stable or run >= cycles:
                stable = action
            out.append(stable)
        state.update((last, run, stable))
        yield pd.DataFrame({"block_id": key[0], "date": pdf["date"], "action": pdf["action"], "stable": out})

    return decisions.groupBy("block_id").applyInPandasWithState(
        step, "block_id int, date date, action string, stable string", "last string, run int, stable string", "append",
        GroupStateTimeout.NoTimeout,
    )


def daily_rain(readings: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily rain of each block from streamed (block_id, ts, mm); readings later than ``late`` are dropped."""
    days = readings.withWatermark("ts", late).groupBy("block_id", F.window("ts", "1 day"))
    return days.agg(F.sum("mm").alias("rain_mm")).select("block_id", F.to_date("window.start").alias("date"), "rain_mm")


def audit(events: DataFrame, events_path: str, advisories_path: str, checkpoint: str):  # noqa: ANN201
    """Every evaluation in one table and those that are not silent in another, once each.

    A batch is the partition ``epoch`` of both tables and replaces it, so a batch that runs again
    after a failure leaves the rows it left before.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        for rows, path in ((batch, events_path), (batch.where("action <> 'abstain'"), advisories_path)):
            rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def replayed(rows: DataFrame, make, parts: int = 3) -> DataFrame:  # noqa: ANN001
    """Run ``make`` over ``rows`` streamed in ``parts`` stretches in order of date, and read what it made.

    The rows are written once. Each stretch arrives as many files, and one run with the same
    checkpoint takes them all, so the batches are in order of date and none is one task's work.
    """
    spark = rows.sparkSession
    base = folder(spark, "stream")
    w = F.broadcast(rows.agg(F.min("date").alias("first_"), F.max("date").alias("last_")))  # one row
    days = F.datediff("last_", "first_") + 1
    stretch = F.floor(F.datediff("date", "first_") * parts / days).cast("int")
    rows.crossJoin(w).withColumn("stretch_", stretch).select(*rows.columns, "stretch_").write.partitionBy("stretch_").parquet(f"{base}/all")
    whole = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("stretch_", T.IntegerType())])).parquet(f"{base}/all")
    for k in range(parts):
        whole.where(F.col("stretch_") == k).drop("stretch_").write.mode("append").parquet(f"{base}/in")
        query = (
            make(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
            .writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
