"""From raw observations to the canonical panel: every block, every day, missing days explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import PHYSICAL_MAX_RAIN_MM, TEMPERATURE_GAP, Season
from ..functions.agro import in_season, nan_to_null
from ..functions.windows import by_block

REQUIRED = ("block_id", "date", "rain_mm", "tmin_c", "tmax_c")


class PanelSchemaError(ValueError):
    """Columns are missing, or a season is empty."""


def validated(obs: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in obs.columns]
    if missing:
        raise PanelSchemaError(f"missing columns: {', '.join(missing)}")
    out = obs if "ens_dry_fraction" in obs.columns else obs.withColumn("ens_dry_fraction", F.lit(None).cast("double"))
    numbers = ("rain_mm", "tmin_c", "tmax_c", "ens_dry_fraction")
    return out.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in numbers})


def first_of_day(obs: DataFrame, ingest: str | None = None) -> DataFrame:
    """One row for each block and day: the first by ``ingest`` (input order where it is not given)."""
    seq = F.col(ingest) if ingest else F.monotonically_increasing_id()
    before = F.lag("date").over(W.partitionBy("block_id").orderBy("date", "ingest_"))
    found = obs.withColumn("ingest_", seq).withColumn("before_", before)
    return found.where(~F.col("before_").eqNullSafe(F.col("date"))).drop("before_", "ingest_")


def capped_rain(obs: DataFrame) -> DataFrame:
    """Rain that cannot be is void; everything else stays."""
    r = F.col("rain_mm")
    return obs.withColumn("rain_mm", F.when((r >= 0) & (r <= PHYSICAL_MAX_RAIN_MM), r))


def regularized(obs: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Every block on every day from the first to the last of all blocks, with what was observed.

    Each row is followed by the days up to the next one of its block, the first also by those
    before it: one window over a block's rows, no calendar to join. The first and last day are one
    row (first, last): ``bounds`` where the caller knows them without running ``obs`` a second time.
    """
    if bounds is None:
        bounds = obs.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    w = by_block()
    edges = bounds.select(F.col("first").alias("first_"), F.col("last").alias("last_"))
    start = F.when(F.lag("date").over(w).isNull(), F.col("first_")).otherwise(F.col("date"))
    stop = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("last_"))
    bounded = obs.crossJoin(F.broadcast(edges)).withColumns({"start_": start, "stop_": stop})  # one row
    days = bounded.withColumn("day_", F.explode(F.sequence("start_", "stop_", F.expr("interval 1 day"))))
    seen = F.col("day_") == F.col("date")
    others = [c for c in obs.columns if c not in ("block_id", "date")]
    return days.select("block_id", F.col("day_").alias("date"), *[F.when(seen, F.col(c)).alias(c) for c in others])


def interpolated(panel: DataFrame, columns: tuple[str, ...] = ("tmin_c", "tmax_c"), limit: int = TEMPERATURE_GAP) -> DataFrame:
    """Fill gaps linearly, up to ``limit`` days from either side; the nearest value at the ends."""
    back = by_block().rowsBetween(W.unboundedPreceding, 0)
    # The other way round: a frame that ends at the last row would be summed up anew for every row.
    ahead = W.partitionBy("block_id").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, 0)
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))

    def known(c: str) -> Column:
        return F.last(F.when(F.col(c).isNotNull(), F.struct(day.alias("d"), F.col(c).alias("v"))), ignorenulls=True)

    def filled(c: str) -> Column:
        d1, d2 = day - F.col(f"before_{c}_.d"), F.col(f"after_{c}_.d") - day
        v1, v2 = F.col(f"before_{c}_.v"), F.col(f"after_{c}_.v")
        return (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(v1.isNotNull() & v2.isNotNull() & ((d1 <= limit) | (d2 <= limit)), v1 + (v2 - v1) * d1 / (d1 + d2))
            .when(v2.isNull() & (d1 <= limit), v1)
            .when(v1.isNull() & (d2 <= limit), v2)
        )

    # All columns share a window each way; the last one leaves the days in order for what follows.
    out = panel.withColumns({f"after_{c}_": known(c).over(ahead) for c in columns})
    out = out.withColumns({f"before_{c}_": known(c).over(back) for c in columns})
    return out.select(*[filled(c).alias(c) if c in columns else F.col(c) for c in panel.columns])


def canonical(
    obs: DataFrame, season: Season | None, ingest: str | None = None, bounds: DataFrame | None = None
) -> DataFrame:
    """Validate, take the first row of a day, regularise, void, flag, interpolate, cut to the season.

    The season keeps its spin-up days; gaps are filled before it is cut, across its borders.
    """
    panel = capped_rain(regularized(first_of_day(validated(obs), ingest), bounds))
    panel = panel.withColumn("rain_is_imputed", F.col("rain_mm").isNull())
    panel = interpolated(panel)
    return panel if season is None else panel.where(in_season(F.col("date"), season, spin_up=True))


def require_rows(panel: DataFrame, season: Season) -> DataFrame:
    if panel.isEmpty():
        raise PanelSchemaError(f"no day of the panel lies in the season {season.start} to {season.end}")
    return panel


def report(obs: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: rows in and out, duplicates, void rain, blocks, seasons and the missing fraction."""
    r = F.col("rain_mm")
    raw = validated(obs).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_distinct("block_id", "date").alias("days_in"),
        F.count_if((r < 0) | (r > PHYSICAL_MAX_RAIN_MM)).alias("implausible_rain"),
    )
    clean = panel.agg(
        F.count(F.lit(1)).alias("rows_out"),
        F.count_if("rain_is_imputed").alias("missing_rain"),
        F.count_distinct("block_id").alias("blocks"),
        F.array_join(F.array_sort(F.collect_set(F.year("date"))), ",").alias("seasons"),
    )
    return raw.crossJoin(clean).select(  # two rows of one
        "rows_in",
        "rows_out",
        (F.col("rows_in") - F.col("days_in")).alias("duplicates_dropped"),
        "missing_rain",
        "implausible_rain",
        "blocks",
        "seasons",
        F.try_divide(F.col("missing_rain"), F.col("rows_out")).alias("imputed_fraction"),
    )
