"""Season folds and the baselines: climatology, persistence, raw ensemble."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MIN_BIN_ROWS, PERSISTENCE_RUN, PHASE_BINS, PROBABILITY_CLIP
from ..functions.agro import clipped, pentad


def fold_seasons(panel: DataFrame, n_holdout: int = 1, min_training: int = 3) -> DataFrame:
    """(fold): the seasons that are tested in turn, each against all the others of this table.

    The last ``n_holdout`` seasons are in neither place; without ``min_training`` others there is none.
    """
    return _testable(panel, n_holdout, min_training).select(F.explode("s").alias("fold"))


def _testable(panel: DataFrame, n_holdout: int, min_training: int) -> DataFrame:
    """One row: the years of the folds."""
    found = panel.agg(F.array_sort(F.collect_set(F.year("date"))).alias("s"))
    n = F.size("s") - n_holdout
    return found.select(F.slice("s", 1, F.when(n > min_training, n).otherwise(0)).alias("s"))


def holdout_seasons(panel: DataFrame, n: int = 1) -> DataFrame:
    """The last ``n`` seasons."""
    found = panel.agg(F.reverse(F.array_sort(F.collect_set(F.year("date")))).alias("s"))
    return found.select(F.explode(F.slice("s", 1, n)).alias("season"))


def season_folds(panel: DataFrame, n_holdout: int = 1, min_training: int = 3) -> DataFrame:
    """(test_season, train_season): leave one season out; held-out seasons are in neither place."""
    pairs = _testable(panel, n_holdout, min_training).select("s", F.explode("s").alias("test_season"))
    return pairs.select("test_season", F.explode("s").alias("train_season")).where("test_season <> train_season")


def season_moments(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """(block_id, pentad, whole, seasons): rain as mergeable moments (fold, n, m, v) of each season of the folds.

    v is the sum of squares about the season's own mean m. Where ``whole`` is 1 the pentad is null and
    the moments are those of the block. One scan, whatever the number of folds.
    """
    rain = F.col("rain_mm")
    return (
        panel.where(rain.isNotNull())
        .select("block_id", pentad(F.col("date")).alias("pentad"), F.year("date").alias("fold"), rain)
        .join(F.broadcast(folds), "fold", "left_semi")  # a row for each year
        .groupingSets([["block_id", "pentad", "fold"], ["block_id", "fold"]], "block_id", "pentad", "fold")
        .agg(
            F.grouping("pentad").alias("whole"),
            F.count(rain).alias("n"),
            F.avg(rain).alias("m"),
            (F.var_pop(rain) * F.count(rain)).alias("v"),
        )
        .groupBy("block_id", "pentad", "whole")
        .agg(F.collect_list(F.struct("fold", "n", "m", "v")).alias("seasons"))
    )


def climatologies(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """The pentad climatology of each ``fold`` (fold): block_id, pentad, clim_mean, clim_std, from all other folds.

    A fold's moments are those of all seasons without its own, taken about the mean of all so that
    nothing cancels. Where a pentad has no deviation (a single value), the block's takes its place.
    """
    sums = lambda f: F.aggregate("seasons", F.lit(0.0), lambda acc, s: acc + f(s))
    total = season_moments(panel, folds).withColumn("n_", sums(lambda s: s["n"])).withColumn("m_", sums(lambda s: s["n"] * s["m"]) / F.col("n_"))
    total = total.withColumn("v_", sums(lambda s: s["v"] + s["n"] * (s["m"] - F.col("m_")) * (s["m"] - F.col("m_"))))
    by_fold = F.map_from_entries(F.transform("seasons", lambda s: F.struct(s["fold"], s)))
    own = F.try_element_at(by_fold, F.col("fold"))
    n = F.coalesce(own["n"], F.lit(0))
    apart = F.coalesce(own["m"] - F.col("m_"), F.lit(0.0))
    left = F.col("n_") - n
    moved = n * apart / left  # how far the mean moves without the fold
    spread = F.col("v_") - F.coalesce(own["v"], F.lit(0.0)) - n * apart * apart - left * moved * moved
    found = (
        total.crossJoin(F.broadcast(folds))  # a row for each year
        .where(left > 0)
        .select(
            "fold",
            "block_id",
            "pentad",
            "whole",
            (F.col("m_") - moved).alias("clim_mean"),
            # What rounding leaves of equal values is no deviation.
            F.when(left > 1, F.sqrt(F.when(spread > 1e-12 * F.col("v_"), spread).otherwise(0.0) / (left - 1))).alias("std"),
        )
    )
    block_std = F.max(F.when(F.col("whole") == 1, F.col("std"))).over(W.partitionBy("block_id", "fold"))
    return (
        found.withColumn("block_std", block_std)
        .where("whole = 0")
        .select("fold", "block_id", "pentad", "clim_mean", F.coalesce("std", "block_std").alias("clim_std"))
    )


def phase_bin(sin: Column, cos: Column, bins: int = PHASE_BINS) -> Column:
    phase = F.pmod(F.atan2(sin, cos), F.lit(2 * math.pi))
    return F.least((phase / (2 * math.pi) * bins).cast("int"), F.lit(bins - 1))


def in_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """The rows of the seasons of ``folds``, with their own season as ``fold``."""
    return rows.withColumn("fold", F.year("date")).join(F.broadcast(folds), "fold", "left_semi")  # a row for each year


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("fold", *by).agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("ones"))


def _others(*by: str) -> tuple[Column, Column]:
    """Rows and ones of all folds but the own, among the rows that agree in ``by``: windows over small tables of counts."""
    all_, own = W.partitionBy(*by), W.partitionBy("fold", *by)
    return tuple(F.sum(c).over(all_) - F.sum(c).over(own) for c in ("n", "ones"))


def _rate(n: Column, ones: Column) -> Column:
    return F.when(n > 0, ones / n)


def climatology(rows: DataFrame, regional: bool = False) -> DataFrame:
    """p: the rate of the row's phase bin in the other folds; thin bins take the overall rate.

    ``regional`` keeps the bins of each region apart, thin ones again at the overall rate; a region
    unseen in the other folds gets the pooled bin. Rows are those of ``in_folds``, with day_of_season_sin and
    _cos, y and region. The rates come from counts by fold and bin.
    """
    out = rows.withColumn("bin", phase_bin(F.col("day_of_season_sin"), F.col("day_of_season_cos")))
    by = ("region", "bin") if regional else ("bin",)
    cells = _counted(out, *by)
    (all_n, all_ones), (bin_n, bin_ones) = _others(), _others("bin")
    found = {"rate": _rate(all_n, all_ones), "bin_n": bin_n, "bin_rate": _rate(bin_n, bin_ones)}
    p = F.when(F.col("bin_n") >= MIN_BIN_ROWS, F.col("bin_rate")).otherwise(F.col("rate"))
    if regional:
        own_n, own_ones = _others("region", "bin")
        found |= {"region_n": _others("region")[0], "own_n": own_n, "own_rate": _rate(own_n, own_ones)}
        p = (
            F.when(F.col("region_n") == 0, p)
            .when(F.col("own_n") >= MIN_BIN_ROWS, F.col("own_rate"))
            .otherwise(F.col("rate"))
        )
    cells = cells.withColumns(found).select("fold", *by, clipped(p, PROBABILITY_CLIP).alias("p"))
    return out.join(cells, ["fold", *by]).drop("bin")


def persistence(rows: DataFrame) -> DataFrame:
    """p: the rate in the other folds, given that a dry run is under way, or not; one half where there is no case."""
    out = rows.withColumn("running", F.col("dry_run_lag1") >= PERSISTENCE_RUN)
    n, ones = _others("running")
    cells = _counted(out, "running").withColumn("p", clipped(F.coalesce(_rate(n, ones), F.lit(0.5)), PROBABILITY_CLIP))
    return out.join(cells.select("fold", "running", "p"), ["fold", "running"]).drop("running")


def raw_ensemble(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", clipped(F.col("ens_dry_fraction"), PROBABILITY_CLIP))


def ladder(rows: DataFrame) -> DataFrame:
    """model, y, p and ref of all three baselines; ref is the climatology.

    One count by fold, bin and running dry run serves both fitted baselines. Its table has a few
    rows for each year.
    """
    out = rows.withColumns(
        {
            "bin": phase_bin(F.col("day_of_season_sin"), F.col("day_of_season_cos")),
            "running": F.col("dry_run_lag1") >= PERSISTENCE_RUN,
        }
    )
    (all_n, all_ones), (bin_n, bin_ones), (run_n, run_ones) = _others(), _others("bin"), _others("running")
    ref = F.when(bin_n >= MIN_BIN_ROWS, _rate(bin_n, bin_ones)).otherwise(_rate(all_n, all_ones))
    cells = _counted(out, "bin", "running").select(
        "fold",
        "bin",
        "running",
        clipped(ref, PROBABILITY_CLIP).alias("ref"),
        clipped(F.coalesce(_rate(run_n, run_ones), F.lit(0.5)), PROBABILITY_CLIP).alias("p_persistence"),
    )
    found = F.array(
        F.struct(F.lit("climatology").alias("model"), F.col("ref").alias("p")),
        F.struct(F.lit("persistence").alias("model"), F.col("p_persistence").alias("p")),
        F.struct(F.lit("raw_ensemble").alias("model"), clipped(F.col("ens_dry_fraction"), PROBABILITY_CLIP).alias("p")),
    )
    keep = [c for c in ("fold", "block_id", "date", "y") if c in rows.columns]
    joined = out.join(F.broadcast(cells), ["fold", "bin", "running"])  # at most 24 rows for each year
    return joined.select(*keep, "ref", F.explode(found).alias("m")).select("m.model", *keep, "ref", "m.p")
