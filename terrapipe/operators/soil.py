"""Soil-water bucket and dry runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AWC_MM, CROP_COEFFICIENT, FALLBACK_LATITUDE, INITIAL_FILL, RUNOFF_FRACTION
from ..functions.agro import et0, is_dry
from ..functions.windows import dry_run, run_id


def with_latitude(panel: DataFrame, latitudes: DataFrame | None) -> DataFrame:
    """A latitude for each row; a block that ``latitudes`` does not name is an error."""
    if latitudes is None:
        return panel.withColumn("latitude", F.lit(FALLBACK_LATITUDE))
    found = panel.join(latitudes.select("block_id", "latitude"), "block_id", "left")
    message = F.concat(F.lit("no latitude for block "), F.col("block_id").cast("string"))
    return found.withColumn(
        "latitude", F.when(F.col("latitude").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("latitude"))
    )


def bucket(panel: DataFrame, awc: float = AWC_MM, initial: float = INITIAL_FILL) -> DataFrame:
    """``panel`` (block_id, date, change) with soil_moisture_mm: S = clip(S + change, 0, awc), day after day.

    A day maps the storage by x -> min(hi, max(lo, x + c)), and such maps compose to one of their
    kind. The days of each month of a block are gathered and reduced to one map; the maps of the
    months before give the storage at the start of a month, and the days of the month follow. No
    step sees more than a month of days, or a block's months, at a time, and where the panel is
    already partitioned by block, none needs a shuffle.
    """
    others = [c for c in panel.columns if c not in ("block_id", "date")]
    months = panel.groupBy("block_id", F.date_trunc("month", "date").cast("date").alias("month_")).agg(
        F.sort_array(F.collect_list(F.struct("date", *others))).alias("days_")
    )

    def clip(x: Column) -> Column:
        return F.least(F.lit(awc), F.greatest(F.lit(0.0), x))

    def add(acc: Column, day: Column) -> Column:
        c = day["change"]
        return F.struct((acc["c"] + c).alias("c"), clip(acc["lo"] + c).alias("lo"), clip(acc["hi"] + c).alias("hi"))

    # On [0, awc] this map changes nothing.
    same = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("lo"), F.lit(awc).alias("hi"))
    before = W.partitionBy("block_id").orderBy("month_").rowsBetween(W.unboundedPreceding, -1)
    maps = months.withColumn("map_", F.aggregate("days_", same, add)).withColumn("maps_", F.collect_list("map_").over(before))
    start = F.aggregate(
        "maps_", F.lit(initial * awc), lambda x, m: F.least(m["hi"], F.greatest(m["lo"], x + m["c"]))
    )
    run = F.aggregate(
        "days_",
        F.array(start),
        lambda acc, d: F.concat(acc, F.array(clip(F.element_at(acc, -1) + d["change"]))),
    )
    return maps.select(
        "block_id", F.explode(F.arrays_zip("days_", F.slice(run, 2, 31).alias("mm_"))).alias("x_")
    ).select("block_id", "x_.days_.*", F.col("x_.mm_").alias("soil_moisture_mm"))


def balanced(
    panel: DataFrame,
    latitudes: DataFrame | None = None,
    awc: float = AWC_MM,
    runoff: float = RUNOFF_FRACTION,
    kc: float = CROP_COEFFICIENT,
    initial: float = INITIAL_FILL,
) -> DataFrame:
    """The panel with et0_mm, soil_moisture_mm and _fraction, is_dry_day and consecutive_dry_days.

    Missing rain or evapotranspiration counts as 0 inside the recursion only.
    """
    wet = with_latitude(panel, latitudes).withColumn(
        "et0_mm", et0(F.col("tmin_c"), F.col("tmax_c"), F.col("latitude"), F.dayofyear("date"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    change = zero(F.col("rain_mm")) * (1 - runoff) - zero(kc * F.col("et0_mm"))
    out = bucket(wet.withColumn("change", change), awc, initial).drop("change", "latitude")
    out = out.withColumn(
        "soil_moisture_fraction", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("soil_moisture_mm") / awc))
    )
    return with_dry_runs(out.withColumn("is_dry_day", is_dry(F.col("rain_mm"))))


def with_dry_runs(panel: DataFrame) -> DataFrame:
    """consecutive_dry_days: dry days in a row up to this one; a missing day breaks the run."""
    flagged = panel.withColumn("dry", is_dry(F.col("rain_mm"))).withColumn("run_id", run_id())
    return flagged.withColumn("consecutive_dry_days", dry_run()).drop("dry", "run_id")


def with_seq(panel: DataFrame) -> DataFrame:
    """Position of a row in its block: windows of this plane count rows, not days."""
    return panel.withColumn("seq", F.row_number().over(W.partitionBy("block_id").orderBy("date")))
