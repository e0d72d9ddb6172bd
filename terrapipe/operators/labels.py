"""Dry-spell starts and forward labels, and the size of the labelled sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MIN_SPELL_DAYS
from ..functions.agro import is_dry
from ..functions.windows import by_block, strict


def spell_starts(panel: DataFrame, min_days: int = MIN_SPELL_DAYS) -> DataFrame:
    """spell_start: a dry run of at least ``min_days`` begins here (1/0).

    Null where the days ahead are cut off or one of them is missing. A missing day before counts
    as not dry.
    """
    dry = is_dry(F.col("rain_mm"))
    observed = F.when(F.col("rain_mm").isNotNull(), dry.cast("int"))
    ahead = strict(F.sum, observed, 0, min_days - 1)
    before = F.coalesce(F.lag(dry, 1).over(by_block()), F.lit(False))
    return panel.withColumn(
        "spell_start", F.when(ahead.isNotNull(), ((ahead == min_days) & ~before).cast("double"))
    )


def labelled(panel: DataFrame, lead_days: int, min_days: int = MIN_SPELL_DAYS) -> DataFrame:
    """y: does a spell start on one of the next ``lead_days`` days? Null unless all of them are known."""
    starts = panel if "spell_start" in panel.columns else spell_starts(panel, min_days)
    return starts.withColumn("y", strict(F.max, F.col("spell_start"), 1, lead_days))


def labelled_lengths(panel: DataFrame, lead_days: int, lengths: tuple[int, ...]) -> DataFrame:
    """y<n> for each length of spells, all over the panel's own windows: no joins."""
    out = panel
    for n in lengths:
        out = labelled(spell_starts(out, n), lead_days).withColumnRenamed("y", f"y{n}").drop("spell_start")
    return out


def base_rate(labels: DataFrame) -> DataFrame:
    return labels.agg(F.avg("y").alias("base_rate"))


def effective_sample(labels: DataFrame, lead_days: int, regions: DataFrame | None = None) -> DataFrame:
    """Rows, positives, seasons, blocks, and positives per lead and block: events that are independent.

    With ``regions`` (block_id, region), the events are counted in each region and added; a block
    without a region is one of its own.
    """
    known = labels.where(F.col("y").isNotNull())
    lead = F.lit(float(max(lead_days, 1)))
    events = F.sum("y") / lead / F.greatest(F.count_distinct("block_id"), F.lit(1))
    whole = known.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("y"), F.lit(0.0)).cast("long").alias("positives"),
        F.count_distinct(F.year("date")).alias("seasons"),
        F.count_distinct("block_id").alias("blocks"),
        F.coalesce(events, F.lit(0.0)).alias("independent_events"),
    )
    if regions is None:
        return whole
    region = F.coalesce(F.col("region"), F.col("block_id").cast("string"))
    by_region = (
        known.join(regions.select("block_id", "region"), "block_id", "left").groupBy(region.alias("region")).agg(events.alias("e"))
    )
    return whole.drop("independent_events").crossJoin(by_region.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("independent_events")))
