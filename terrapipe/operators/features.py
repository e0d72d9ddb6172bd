"""The twelve causal features. Each declares how many days it looks back at least."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Season
from ..functions.agro import is_dry, pentad, season_phase
from ..functions.windows import by_block, strict


@dataclass(frozen=True)
class Feature:
    name: str
    min_shift: int
    monotone: int = 0  # sign of the probability's response, 0 where it is free


FEATURES = (
    Feature("sm_frac_lag1", 1, -1),
    Feature("sm_frac_delta_7d", 1),
    Feature("dry_run_lag1", 1, 1),
    Feature("rain_sum_7d", 1, -1),
    Feature("rain_sum_30d", 1, -1),
    Feature("dry_days_15d", 1, 1),
    Feature("rain_anomaly_15d", 1, -1),
    Feature("day_of_season_sin", 0),
    Feature("day_of_season_cos", 0),
    Feature("ens_dry_fraction", 0, 1),
    Feature("oni_lag30", 30),
    Feature("mjo_amplitude_lag10", 10),
)
NAMES = tuple(f.name for f in FEATURES)


def pentad_climatology(panel: DataFrame, training_seasons: list[int] | None = None) -> DataFrame:
    """Mean and sample deviation of daily rain for each block and pentad, training seasons only.

    Where a pentad has no deviation (a single value), the block's takes its place.
    """
    rows = panel.select("block_id", "date", "rain_mm")
    if training_seasons is not None:
        rows = rows.where(F.year("date").isin(training_seasons))
    # Pentads and whole blocks in one pass; a block's row then lends its deviation to its pentads.
    keyed = rows.withColumn("pentad", pentad(F.col("date")))
    both = keyed.groupingSets([["block_id", "pentad"], ["block_id"]], "block_id", "pentad").agg(
        F.avg("rain_mm").alias("clim_mean"), F.stddev_samp("rain_mm").alias("std"), F.grouping("pentad").alias("whole")
    )
    block_std = F.max(F.when(F.col("whole") == 1, F.col("std"))).over(W.partitionBy("block_id"))
    return (
        both.withColumn("block_std", block_std)
        .where("whole = 0")
        .select("block_id", "pentad", "clim_mean", F.coalesce("std", "block_std").alias("clim_std"))
    )


def fold_invariant(panel: DataFrame, season: Season, teleconnections: DataFrame | None = None) -> DataFrame:
    """All features but the anomaly, which depends on the training seasons; and the sum it needs."""
    w = by_block()
    rain = F.col("rain_mm")
    dry = is_dry(rain).cast("int")
    if teleconnections is None:
        joined = panel
        oni = mjo = F.lit(0.0)
    else:
        joined = panel.join(teleconnections.select("date", "oni", "mjo_amplitude"), "date", "left")
        oni, mjo = F.lag("oni", 30).over(w), F.lag("mjo_amplitude", 10).over(w)
    phase = season_phase(F.col("date"), season)
    if "ens_dry_fraction" not in joined.columns:
        joined = joined.withColumn("ens_dry_fraction", F.lit(None).cast("double"))
    return joined.withColumns(
        {
            "sm_frac_lag1": F.lag("soil_moisture_fraction", 1).over(w),
            "sm_frac_delta_7d": F.lag("soil_moisture_fraction", 1).over(w) - F.lag("soil_moisture_fraction", 8).over(w),
            "dry_run_lag1": F.lag("consecutive_dry_days", 1).over(w).cast("double"),
            "rain_sum_7d": strict(F.sum, rain, -7, -1),
            "rain_sum_15d": strict(F.sum, rain, -15, -1),
            "rain_sum_30d": strict(F.sum, rain, -30, -1),
            "dry_days_15d": strict(F.sum, dry, -15, -1).cast("double"),
            "day_of_season_sin": F.sin(phase),
            "day_of_season_cos": F.cos(phase),
            "oni_lag30": oni,
            "mjo_amplitude_lag10": mjo,
        }
    )


def with_anomaly(features: DataFrame, climatology: DataFrame) -> DataFrame:
    """rain_anomaly_15d: the last 15 days' rain against the pentad of today, in deviations.

    ``climatology`` is one row for each block and pentad (and fold, where both have one).
    """
    keys = [c for c in ("fold", "block_id", "pentad") if c in climatology.columns and (c != "fold" or c in features.columns)]
    out = features.withColumn("pentad", pentad(F.col("date"))).join(climatology, keys, "left")
    spread = F.when(F.col("clim_std") > 0, F.col("clim_std")) * math.sqrt(15.0)
    return out.withColumn(
        "rain_anomaly_15d", (F.col("rain_sum_15d") - 15.0 * F.col("clim_mean")) / spread
    ).drop("pentad", "clim_mean", "clim_std")


def build_features(
    panel: DataFrame,
    season: Season,
    training_seasons: list[int] | None = None,
    teleconnections: DataFrame | None = None,
) -> DataFrame:
    out = fold_invariant(panel, season, teleconnections)
    return with_anomaly(out, pentad_climatology(panel, training_seasons))


#: What a day's row brings to the features; a change of it must not show before the declared shift.
SOURCES = ("rain_mm", "tmin_c", "tmax_c", "ens_dry_fraction", "oni", "mjo_amplitude")


def shift_report(before: DataFrame, after: DataFrame, day: Column, features: tuple[Feature, ...] = FEATURES) -> DataFrame:
    """(feature, min_shift, first_change, holds) of all features, from their values with and without a change from ``day`` on.

    ``before`` and ``after`` (block_id, date, features) are built alike from inputs that agree on all days before
    ``day``. first_change counts days from ``day`` to the first value that differs, null where none does.
    A feature holds where that is no earlier than the shift it declares. One join, for all of them.
    """
    names = [f.name for f in features]
    both = before.select("block_id", "date", day.alias("day_"), *names).join(
        after.select("block_id", "date", *[F.col(c).alias(f"{c}_after") for c in names]), ["block_id", "date"]
    )
    moved = [F.min(F.when(~F.col(c).eqNullSafe(F.col(f"{c}_after")), F.datediff("date", "day_"))).alias(c) for c in names]
    listed = F.array(*[F.struct(F.lit(f.name).alias("feature"), F.lit(f.min_shift).alias("min_shift"), F.col(f.name).alias("first_change")) for f in features])
    found = both.agg(*moved).select(F.explode(listed).alias("x")).select("x.*")
    return found.withColumn("holds", F.coalesce(F.col("first_change") >= F.col("min_shift"), F.lit(True)))


def changed_from(rows: DataFrame, day: Column, columns: tuple[str, ...] = SOURCES) -> DataFrame:
    """``rows`` with other values from ``day`` on: of rain and temperature, ensemble and indices, as far as they are there."""
    other = {
        "rain_mm": lambda c: F.coalesce(c, F.lit(0.0)) * 0.5 + 7.25,
        "ens_dry_fraction": lambda c: 1 - F.coalesce(c, F.lit(0.25)) / 2,
    }
    moved = {c: other.get(c, lambda c: F.coalesce(c, F.lit(0.0)) + 1.5)(F.col(c)) for c in columns if c in rows.columns}
    return rows.withColumns({c: F.when(F.col("date") >= day, new).otherwise(F.col(c)) for c, new in moved.items()})


def drop_unlabelable(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=[*NAMES, "y"])


def rain_3d(panel: DataFrame) -> DataFrame:
    """Rain of up to three days that end here; null only where none is known."""
    return panel.withColumn("rain_3d", F.sum("rain_mm").over(by_block().rowsBetween(-2, 0)))
