"""Queries without an oracle of their own: fitted models. Streams are compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import JJAS
from ..operators import features as feat
from ..operators import labels as lab
from ..operators import fitting, learners, models, soil, verify
from ..sources.adapters import teleconnections
from ..storage import written
from ..streaming import state
from . import rules, weather
from .registry import SQL, query, r, rounded, sql


def folds_of(panel: DataFrame) -> list[int]:
    """The years of the folds: a fit has to know them."""
    return sorted(r.fold for r in models.fold_seasons(panel).collect())


def fold_design(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """The design of all folds, with the labels of all spell lengths, and their years; see ``fitting``.

    A row is in it once, whatever the number of folds. It is written, as every fit reads it many times.
    """
    panel = weather.season_panel(spark, sf_dir)
    rain = written(panel, "fold-panel")
    seasons = folds_of(rain)
    if not seasons:
        raise ValueError("no usable folds")
    folds = models.fold_seasons(rain)
    rows = feat.fold_invariant(soil.balanced(rain), JJAS, teleconnections(spark, sf_dir))
    rows = lab.labelled_lengths(rows, 14, fitting.LENGTHS).withColumn("y", F.col("y5"))
    labels = [f"y{n}" for n in fitting.LENGTHS]
    rows = models.in_folds(rows, folds).select("fold", "block_id", "date", "y", *labels, *fitting.SHARED, "rain_sum_15d")
    made = fitting.design(rows, models.climatologies(rain, folds), seasons)
    return written(fitting.stopping(made, fitting.Boost().stop_share), "fold-design"), seasons


def own_rows(design: DataFrame, seasons: list[int]) -> DataFrame:
    """The design's rows that their own fold can predict: with the anomaly of that fold."""
    years = F.array(*[F.lit(x) for x in seasons]).cast("array<int>")
    anomaly = F.get("anomalies", F.array_position(years, F.col("fold")).cast("int") - 1)
    return design.withColumn("rain_anomaly_15d", anomaly).dropna(subset=["rain_anomaly_15d"]).drop("anomalies")


def _isotonic(rows: DataFrame) -> DataFrame:
    """The raw ensemble recalibrated, each fold from the others: (fold, p, y) is all that is repeated for the folds."""
    known = models.raw_ensemble(rows).select("fold", "block_id", "date", "y", "p")
    years = known.select(F.col("fold").alias("fold_")).distinct()
    train = known.select(F.col("fold").alias("own"), "y", "p").join(F.broadcast(years), F.col("own") != F.col("fold_"))  # a row for each year
    return learners.each_fold(train.withColumnRenamed("fold_", "fold"), known, learners.isotonic)


def _logistic(design: DataFrame, seasons: list[int]) -> DataFrame:
    return fitting.logistic_predictions(design, seasons)


def _boosted(design: DataFrame, seasons: list[int]) -> DataFrame:
    return fitting.boosted_predictions(design, seasons, fitting.boosted(design, seasons))


@query("model_extended_logistic")
def model_extended_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _logistic(*fold_design(spark, sf_dir))
    return rounded(found.select("fold", "block_id", "date", "y", F.col("p5").alias("p"), "coherent"), 4)


@query("model_spell_curve")
def model_spell_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of a spell of 3, 5, 7, 10 and 15 days or more, from the one fit that they share."""
    return rounded(_logistic(*fold_design(spark, sf_dir)).select("fold", "block_id", "date", *[f"p{n}" for n in fitting.LENGTHS]), 4)


@query("model_monotone_boost")
def model_monotone_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_boosted(*fold_design(spark, sf_dir)), 4)


@query("model_isotonic")
def model_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_isotonic(own_rows(*fold_design(spark, sf_dir))), 4)


def all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, fold, block_id, date, y, ref and p of the baselines and of the fitted models, over the same rows of all folds."""
    design, seasons = fold_design(spark, sf_dir)
    rows = own_rows(design, seasons)
    known = written(models.ladder(rows).select("model", "fold", "block_id", "date", "y", "ref", "p"), "ladder")
    ref = known.where("model = 'climatology'").select("block_id", "date", "ref")
    out = known
    for name, fitted in (
        ("extended_logistic", _logistic(design, seasons).withColumnRenamed("p5", "p")),
        ("monotone_boost", _boosted(design, seasons)),
        ("isotonic", _isotonic(rows)),
    ):
        own = fitted.select(F.lit(name).alias("model"), "fold", "block_id", "date", "y", "p").join(ref, ["block_id", "date"])
        out = out.unionByName(own.select(*known.columns))
    return written(out, "ladder-fitted")


@query("verify_fitted")
def verify_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole ladder."""
    return rounded(verify.scores(all_models(spark, sf_dir), ("model",)), 4)


@query("skill_report")
def skill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the whole ladder: a line for each model, the most skilful first, with the interval of its skill, and the value curve of the best."""
    found = all_models(spark, sf_dir)
    return verify.report(found, 14)


@query("stream_dry_run", SQL["dry_runs"])
def stream_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weather.season_panel(spark, sf_dir).select("block_id", "date", "rain_mm")
    return state.replayed(rows, state.stream_dry_run)


@query("stream_bucket", sql(f"SELECT block_id, date, {r('soil_moisture_mm')} FROM bal", "bal"))
def stream_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import FALLBACK_LATITUDE
    from ..functions.agro import et0

    rows = weather.season_panel(spark, sf_dir)
    loss = et0(F.col("tmin_c"), F.col("tmax_c"), F.lit(FALLBACK_LATITUDE), F.dayofyear("date"))
    change = F.coalesce("rain_mm", F.lit(0.0)) * 0.85 - F.coalesce(loss, F.lit(0.0))
    return rounded(state.replayed(rows.select("block_id", "date", change.alias("change")), state.stream_bucket))


@query("stream_hysteresis", SQL["hysteresis"].replace(", h.current <> o.action AS held", ""))
def stream_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.decided(spark, sf_dir).select("block_id", "date", "action")
    return state.replayed(rows, state.stream_hysteresis)
