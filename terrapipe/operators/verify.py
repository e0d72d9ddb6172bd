"""Verification of probabilities: rows have y (0/1), p and, where a reference is needed, ref."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lower edges of ten bins as floating-point numbers: .3, .6 and .7 lie under their edges.
EDGES = tuple(float(x) for x in np.linspace(0, 1, 11)[:-1])
SLICES = 1024  # of [0, 1], to rank probabilities in many tasks


def brier(p: str = "p") -> Column:
    return F.avg(F.pow(F.col(p) - F.col("y"), F.lit(2.0)))


def skill(score: Column, reference: Column) -> Column:
    return F.when(reference > 0, 1 - score / reference)


def with_bin(rows: DataFrame, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """bin: the last lower edge that p reaches; p = 1 is in the last bin."""
    reached = sum((F.col("p") >= F.lit(e)).cast("int") for e in edges)
    return rows.withColumn("bin", reached - 1)


def reliability_bins(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean p and mean y of each bin that is not empty."""
    return with_bin(rows).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y")
    )


def murphy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Reliability, resolution and uncertainty of the binned probabilities; and the calibration error."""
    return _murphy(reliability_bins(rows, by), by)


def _murphy(bins: DataFrame, by: tuple[str, ...]) -> DataFrame:
    n, base = F.sum("n"), F.sum(F.col("n") * F.col("mean_y")) / F.sum("n")
    totals = bins.groupBy(*by).agg(n.alias("total"), base.alias("base"))
    joined = bins.join(totals, list(by)) if by else bins.crossJoin(totals)  # one row of totals
    share = F.col("n") / F.col("total")
    return joined.groupBy(*by).agg(
        F.sum(share * F.pow(F.col("mean_p") - F.col("mean_y"), F.lit(2.0))).alias("reliability"),
        F.sum(share * F.pow(F.col("mean_y") - F.col("base"), F.lit(2.0))).alias("resolution"),
        F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
        F.sum(share * F.abs(F.col("mean_p") - F.col("mean_y"))).alias("ece"),
    )


def auc(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve by mid-ranks, from counts of each distinct p; null for one class only.

    The distinct p are ranked inside ``SLICES`` slices of [0, 1], and the totals of the slices
    before are added, so no task orders all of them; only the totals, a row per slice, meet.
    """
    return _auc(rows.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")), by)


def _auc(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    at = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p"))) * SLICES).cast("int")
    counts = counts.withColumn("slice_", F.coalesce(at, F.lit(-1)))  # a missing p ranks first
    upto = (W.unboundedPreceding, -1)
    totals = counts.groupBy(*by, "slice_").agg(F.sum("n").alias("n_"))
    earlier = F.coalesce(F.sum("n_").over(W.partitionBy(*by).orderBy("slice_").rowsBetween(*upto)), F.lit(0))
    totals = totals.select(*by, "slice_", earlier.alias("earlier_"))
    inside = F.sum("n").over(W.partitionBy(*by, "slice_").orderBy("p").rowsBetween(*upto))
    ranked = counts.withColumn("inside_", F.coalesce(inside, F.lit(0))).join(totals, [*by, "slice_"])
    ranked = ranked.withColumn("rank", F.col("earlier_") + F.col("inside_") + (F.col("n") + 1) / 2)
    n1, n0 = F.sum("ones"), F.sum(F.col("n") - F.col("ones"))
    area = (F.sum(F.col("rank") * F.col("ones")) - n1 * (n1 + 1) / 2) / (n1 * n0)
    return ranked.groupBy(*by).agg(F.when((n1 > 0) & (n0 > 0), area).alias("auc"))


def _value(alpha: Column) -> Column:
    """Economic value of acting where p exceeds the cost-loss ratio."""
    act = F.col("p") > alpha
    n = F.count(F.lit(1))
    hits = F.sum((act & (F.col("y") == 1)).cast("int")) / n
    false = F.sum((act & (F.col("y") == 0)).cast("int")) / n
    misses = F.sum((~act & (F.col("y") == 1)).cast("int")) / n
    base = F.avg("y")
    a = F.first(alpha)
    expense = a * (hits + false) + misses
    climate, perfect = F.least(a, base), a * base
    return F.when(F.abs(climate - perfect) > 1e-12, (climate - expense) / (climate - perfect))


def value_curve(rows: DataFrame, points: int = 19, by: tuple[str, ...] = ()) -> DataFrame:
    """Value at ``points`` cost-loss ratios from .05 to .95."""
    alphas = [F.lit(float(x)) for x in np.linspace(0.05, 0.95, points)]
    return (
        rows.withColumn("alpha", F.explode(F.array(*alphas))).groupBy(*by, "alpha").agg(_value(F.col("alpha")).alias("value"))
    )


def counted(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, ones and sums of squared errors for each distinct p: all that ``scores`` reads."""
    return rows.groupBy(*by, "p").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("ones"),
        F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("error"),
        F.sum(F.pow(F.col("ref") - F.col("y"), F.lit(2.0))).alias("ref_error"),
    )


def scores(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row: counts, Brier score and skill, sharpness, Murphy terms, calibration error and AUC.

    All of them derive from one table of counts by distinct p, which is shuffled once.
    """
    counts = counted(rows, by)
    n = F.sum("n")
    plain = counts.groupBy(*by).agg(
        n.alias("n"),
        (F.sum("ones") / n).alias("base_rate"),
        (F.sum("error") / n).alias("brier"),
        (F.sum("ref_error") / n).alias("brier_ref"),
        (F.sum(F.col("n") * F.col("p") * F.col("p")) / n - F.pow(F.sum(F.col("n") * F.col("p")) / n, F.lit(2.0))).alias("sharpness"),
    )
    bins = with_bin(counts).groupBy(*by, "bin").agg(
        n.alias("n"), (F.sum(F.col("n") * F.col("p")) / n).alias("mean_p"), (F.sum("ones") / n).alias("mean_y")
    )
    for part in (_murphy(bins, by), _auc(counts, by)):
        plain = plain.join(part, list(by)) if by else plain.crossJoin(part)  # single rows
    return plain.withColumn("bss", skill(F.col("brier"), F.col("brier_ref")))


def bootstrap(rows: DataFrame, draws: int = 500, level: float = 0.95) -> DataFrame:
    """Interval of the Brier skill by resampling whole seasons."""
    low_high = bootstraps(rows.withColumn("model", F.lit("")), draws, level)
    return low_high.select("draws", F.col("skill_low").alias("low"), F.col("skill_high").alias("high"))


def bootstraps(rows: DataFrame, draws: int = 500, level: float = 0.95) -> DataFrame:
    """For each model, the intervals of the Brier score and of the Brier skill, by resampling whole seasons.

    Seasons are reduced to three sums each, and resamples are drawn over those: the estimates are
    those of resampled rows. The season at a place of a resample follows from a digest of (resample,
    place), so reruns agree, every model of the same number of seasons draws the same, and the draws come
    by a join: rows of ``draws`` times seasons for each model. Quantiles are interpolated linearly.
    No row where there are no rows; a skill without a reference is null.
    """
    sums = rows.groupBy("model", F.year("date").alias("season")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("s"),
        F.sum(F.pow(F.col("ref") - F.col("y"), F.lit(2.0))).alias("r"),
    )
    of_model = W.partitionBy("model")
    numbered = sums.withColumn("place", F.row_number().over(of_model.orderBy("season")) - 1).withColumn("seasons", F.count(F.lit(1)).over(of_model))
    digest = F.md5(F.concat_ws(":", "draw", "place").cast("binary"))
    drawn = (
        numbered.select("model", "place", "seasons", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
        .select("model", "draw", F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("seasons")).cast("int").alias("place"))
        .join(numbered.select("model", "place", "n", "s", "r"), ["model", "place"])
        .groupBy("model", "draw")
        .agg(*[F.sum(c).alias(c) for c in "nsr"])
    )
    tails = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    found = drawn.groupBy("model").agg(
        F.percentile(F.col("s") / F.col("n"), tails).alias("brier"), F.percentile(skill(F.col("s"), F.col("r")), tails).alias("skill")
    )
    ends = [(f"{c}_{end}", F.get(c, k)) for c in ("brier", "skill") for k, end in enumerate(("low", "high"))]
    return found.select("model", F.lit(draws).alias("draws"), *[e.alias(name) for name, e in ends])


def skill_lines(scored: DataFrame, lead_days: int) -> DataFrame:
    """A line of text for each model of ``scores``, with its place: the most skilful first."""
    f = F.format_string
    line = F.concat(
        F.rpad("model", 28, " "), F.lit(f" L={lead_days:>2}d  BS="), f("%.4f", "brier"), F.lit("  BSS="), f("%+.3f", "bss"),
        F.lit("  ECE="), f("%.4f", "ece"), F.lit("  AUC="), f("%.3f", "auc"), F.lit("  sharp="), f("%.4f", "sharpness"),
        F.lit("  n="), F.col("n").cast("string"), F.lit("  base="), f("%.3f", "base_rate"),
    )
    place = F.row_number().over(W.orderBy(F.desc("bss"), "model"))  # a row per model
    return scored.select(place.alias("place"), "model", line.alias("line"))


def report(rows: DataFrame, lead_days: int, points: tuple[float, ...] = (0.2, 0.35, 0.5, 0.65, 0.8)) -> DataFrame:
    """(place, model, line): ``skill_lines`` with the 95 % interval of the skill, and the economic value of the best model last."""
    found = scores(rows, ("model",)).join(bootstraps(rows, 300).select("model", "skill_low", "skill_high"), "model")
    ends = F.concat(F.lit("  ["), F.format_string("%+.3f", "skill_low"), F.lit(","), F.format_string("%+.3f", "skill_high"), F.lit("]"))
    lines = skill_lines(found, lead_days).join(found.select("model", ends.alias("ends")), "model")
    best = found.agg(F.max_by("model", F.coalesce("bss", F.lit(float("-inf")))).alias("model"))  # one row
    act = F.explode(F.array(*[F.lit(a) for a in points])).alias("alpha")
    values = rows.join(F.broadcast(best), "model").select("model", "p", "y", act).groupBy("model", "alpha").agg(_value(F.col("alpha")).alias("value"))
    cell = F.concat(F.lit("("), F.format_string("%.2f", "alpha"), F.lit(", "), F.format_string("%+.2f", "value"), F.lit(")"))
    curve = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alpha", cell.alias("cell")))), lambda x: x["cell"]), " ")
    last = values.groupBy("model").agg(F.concat(F.lit("value of the best: "), curve).alias("line"))
    body = lines.select("place", "model", F.concat("line", "ends").alias("line"))
    return body.unionByName(last.select(F.lit(None).cast("int").alias("place"), "model", "line"))
