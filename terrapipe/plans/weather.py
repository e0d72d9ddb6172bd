"""Queries of the weather plane over observations made from the orders."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import JJAS, LEADS, OND, Season
from ..functions.agro import in_season
from ..operators import features as feat
from ..operators import labels as lab
from ..operators import models, panel, soil, verify
from ..sources.adapters import OBSERVATIONS_SQL, TELECONNECTIONS_SQL, bounds, observations, observed, read, teleconnections
from ..storage import written
from .registry import cte, query, r, rounded, sql

PI2 = repr(2 * math.pi)

cte("obs", (), OBSERVATIONS_SQL)
cte("tele", ("obs",), TELECONNECTIONS_SQL)
cte(
    "reg",
    ("obs",),
    """
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT CAST(min(date) AS TIMESTAMP) AS a, CAST(max(date) AS TIMESTAMP) AS b FROM obs)),
reg AS (
  SELECT g.block_id, d.date, o.ens_dry_fraction, o.tmin_c, o.tmax_c,
    CASE WHEN o.rain_mm >= 0 AND o.rain_mm <= 1000 THEN o.rain_mm END AS rain_mm,
    date_diff('day', DATE '1970-01-01', d.date) AS dnum
  FROM (SELECT DISTINCT block_id FROM obs) g CROSS JOIN days d LEFT JOIN obs o ON o.block_id = g.block_id AND o.date = d.date)""",
)


def _fill(v: str) -> str:
    return f"""CASE WHEN {v} IS NOT NULL THEN {v}
      WHEN {v}_v1 IS NOT NULL AND {v}_v2 IS NOT NULL AND (dnum - {v}_d1 <= 3 OR {v}_d2 - dnum <= 3)
        THEN {v}_v1 + ({v}_v2 - {v}_v1) * (dnum - {v}_d1) / ({v}_d2 - {v}_d1)
      WHEN {v}_v2 IS NULL AND dnum - {v}_d1 <= 3 THEN {v}_v1
      WHEN {v}_v1 IS NULL AND {v}_d2 - dnum <= 3 THEN {v}_v2 END"""


def _sides(v: str) -> str:
    known = f"CASE WHEN {v} IS NOT NULL THEN dnum END"
    return f"""last_value({v} IGNORE NULLS) OVER back AS {v}_v1, last_value({known} IGNORE NULLS) OVER back AS {v}_d1,
      first_value({v} IGNORE NULLS) OVER ahead AS {v}_v2, first_value({known} IGNORE NULLS) OVER ahead AS {v}_d2"""


cte(
    "clean",
    ("reg",),
    f"""
clean AS (
  SELECT block_id, date, rain_mm, {_fill('tmin_c')} AS tmin_c, {_fill('tmax_c')} AS tmax_c, ens_dry_fraction,
    rain_mm IS NULL AS rain_is_imputed,
    dayofyear(date) - CASE WHEN month(date) > 2 AND dayofyear(make_date(year(date), 12, 31)) = 366 THEN 1 ELSE 0 END AS sday
  FROM (SELECT *, {_sides('tmin_c')}, {_sides('tmax_c')} FROM reg
    WINDOW back AS (PARTITION BY block_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           ahead AS (PARTITION BY block_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))""",
)
cte("panel", ("clean",), "panel AS (SELECT * FROM clean WHERE sday BETWEEN 122 AND 273)")
cte(
    "et0",
    ("panel",),
    f"""
geo AS (SELECT *, radians(29.5::DOUBLE) AS phi, {PI2}::DOUBLE * dayofyear(date) / 365::DOUBLE AS angle FROM panel),
geo2 AS (SELECT *, 1::DOUBLE + 0.033::DOUBLE * cos(angle) AS near, 0.409::DOUBLE * sin(angle - 1.39::DOUBLE) AS tilt FROM geo),
geo3 AS (SELECT *, acos(least(1::DOUBLE, greatest(-1::DOUBLE, -tan(phi) * tan(tilt)))) AS sunset FROM geo2),
et0 AS MATERIALIZED (
  SELECT block_id, date, rain_mm, tmin_c, tmax_c, ens_dry_fraction, rain_is_imputed,
    15.34::DOUBLE * near * (sunset * sin(phi) * sin(tilt) + cos(phi) * cos(tilt) * sin(sunset)) AS ra_mm,
    CASE WHEN tmin_c IS NOT NULL AND tmax_c IS NOT NULL THEN greatest(0::DOUBLE,
      0.0023::DOUBLE * (15.34::DOUBLE * near * (sunset * sin(phi) * sin(tilt) + cos(phi) * cos(tilt) * sin(sunset)))
      * ((tmin_c + tmax_c) / 2::DOUBLE + 17.8::DOUBLE) * sqrt(greatest(0::DOUBLE, tmax_c - tmin_c))) END AS et0_mm,
    row_number() OVER (PARTITION BY block_id ORDER BY date) AS seq
  FROM geo3)""",
)
cte(
    "runs",
    ("panel",),
    """
runs AS (
  SELECT block_id, date, rain_mm, rain_is_imputed, dry,
    CAST(sum(CASE WHEN dry THEN 1 ELSE 0 END) OVER (PARTITION BY block_id, g ORDER BY date ROWS UNBOUNDED PRECEDING) AS INT) AS consecutive_dry_days
  FROM (SELECT *, sum(CASE WHEN dry THEN 0 ELSE 1 END) OVER (PARTITION BY block_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS g
    FROM (SELECT *, coalesce(rain_mm < 2.5::DOUBLE, FALSE) AS dry FROM panel)))""",
)
cte(
    "bal",
    ("et0", "runs"),
    """
bucket AS (
  SELECT block_id, 0::BIGINT AS seq, 75::DOUBLE AS mm FROM (SELECT DISTINCT block_id FROM et0)
  UNION ALL
  SELECT c.block_id, c.seq, least(150::DOUBLE, greatest(0::DOUBLE,
    b.mm + (coalesce(c.rain_mm, 0::DOUBLE) * 0.85::DOUBLE - coalesce(c.et0_mm, 0::DOUBLE))))
  FROM bucket b JOIN et0 c ON c.block_id = b.block_id AND c.seq = b.seq + 1),
bal AS (
  SELECT e.*, b.mm AS soil_moisture_mm, least(1::DOUBLE, greatest(0::DOUBLE, b.mm / 150::DOUBLE)) AS soil_moisture_fraction,
    u.dry AS is_dry_day, u.consecutive_dry_days
  FROM et0 e JOIN bucket b ON b.block_id = e.block_id AND b.seq = e.seq JOIN runs u ON u.block_id = e.block_id AND u.date = e.date)""",
)
cte(
    "starts",
    ("runs",),
    """
starts AS (
  SELECT *, CASE WHEN n = 5 THEN CASE WHEN k = 5 AND NOT coalesce(before, FALSE) THEN 1::DOUBLE ELSE 0::DOUBLE END END AS spell_start
  FROM (SELECT *, count(rain_mm) OVER f AS n, sum(CASE WHEN dry THEN 1 ELSE 0 END) OVER f AS k,
      lag(dry) OVER (PARTITION BY block_id ORDER BY date) AS before FROM runs
    WINDOW f AS (PARTITION BY block_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)))""",
)
for _lead in LEADS:
    cte(
        f"y{_lead}",
        ("starts",),
        f"""
y{_lead} AS (
  SELECT block_id, date, CASE WHEN count(spell_start) OVER f = {_lead} THEN max(spell_start) OVER f END AS y FROM starts
  WINDOW f AS (PARTITION BY block_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {_lead} FOLLOWING))""",
    )
cte(
    "clim",
    ("panel",),
    """
clim AS (
  SELECT p.block_id, p.pentad, p.clim_mean, coalesce(p.s, b.s) AS clim_std FROM
    (SELECT block_id, (dayofyear(date) - 1) // 5 AS pentad, avg(rain_mm) AS clim_mean, stddev_samp(rain_mm) AS s FROM panel GROUP BY 1, 2) p
    LEFT JOIN (SELECT block_id, stddev_samp(rain_mm) AS s FROM panel GROUP BY 1) b ON b.block_id = p.block_id)""",
)


def _strict(agg: str, col: str, n: int) -> str:
    w = f"OVER (PARTITION BY block_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({col}) {w} = {n} THEN {agg}({col}) {w} END"


cte(
    "feats",
    ("bal", "clim", "tele"),
    f"""
feats0 AS (
  SELECT x.*, {_strict('sum', 'rain_mm', 7)} AS rain_sum_7d, {_strict('sum', 'rain_mm', 15)} AS rain_sum_15d,
    {_strict('sum', 'rain_mm', 30)} AS rain_sum_30d,
    CAST({_strict('sum', 'dry01', 15)} AS DOUBLE) AS dry_days_15d,
    lag(soil_moisture_fraction) OVER w AS sm_frac_lag1,
    lag(soil_moisture_fraction) OVER w - lag(soil_moisture_fraction, 8) OVER w AS sm_frac_delta_7d,
    CAST(lag(consecutive_dry_days) OVER w AS DOUBLE) AS dry_run_lag1,
    sin({PI2}::DOUBLE * date_diff('day', make_date(year(date), 6, 1), date) / 122::DOUBLE) AS day_of_season_sin,
    cos({PI2}::DOUBLE * date_diff('day', make_date(year(date), 6, 1), date) / 122::DOUBLE) AS day_of_season_cos,
    lag(oni, 30) OVER w AS oni_lag30, lag(mjo_amplitude, 10) OVER w AS mjo_amplitude_lag10,
    (dayofyear(date) - 1) // 5 AS pentad
  FROM (SELECT b.*, CASE WHEN is_dry_day THEN 1 ELSE 0 END AS dry01, t.oni, t.mjo_amplitude FROM bal b LEFT JOIN tele t ON t.date = b.date) x
  WINDOW w AS (PARTITION BY block_id ORDER BY date)),
feats AS (
  SELECT f.*, c.clim_mean, c.clim_std, CASE WHEN clim_std > 0 THEN (rain_sum_15d - 15::DOUBLE * clim_mean) / (clim_std * sqrt(15::DOUBLE)) END AS rain_anomaly_15d
  FROM feats0 f LEFT JOIN clim c ON c.block_id = f.block_id AND c.pentad = f.pentad)""",
)


# ---- DataFrames -------------------------------------------------------------------------------


def whole_panel(spark: SparkSession, sf_dir: str, season: Season | None = None) -> DataFrame:
    found, first_last = observed(spark, sf_dir)
    return panel.canonical(found, season, bounds=first_last)


def season_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_panel(spark, sf_dir, JJAS)


def balanced_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soil.balanced(season_panel(spark, sf_dir))


def feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features; the climatology needs the rain only, so it is taken from the panel before the bucket."""
    days = season_panel(spark, sf_dir)
    rows = feat.fold_invariant(soil.balanced(days), JJAS, teleconnections(spark, sf_dir))
    return feat.with_anomaly(rows, feat.pentad_climatology(days))


def label_panel(spark: SparkSession, sf_dir: str, lead: int) -> DataFrame:
    return lab.labelled(season_panel(spark, sf_dir), lead)


@query(
    "panel_regularize",
    sql(f"SELECT block_id, date, {r('rain_mm')}, {r('ens_dry_fraction')}, rain_mm IS NULL AS rain_is_imputed FROM reg", "reg"),
)
def panel_regularize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panel.capped_rain(panel.regularized(panel.first_of_day(panel.validated(observations(spark, sf_dir))), bounds(spark, sf_dir)))
    return rounded(found.select("block_id", "date", "rain_mm", "ens_dry_fraction", F.col("rain_mm").isNull().alias("rain_is_imputed")))


@query(
    "panel_season_window",
    sql(
        """SELECT year(date)::INT AS season, count(*) FILTER (sday BETWEEN 122 AND 273)::BIGINT AS with_spin_up,
        count(*) FILTER (sday BETWEEN 152 AND 273)::BIGINT AS in_season, min(date) FILTER (sday BETWEEN 122 AND 273) AS first_day,
        max(date) FILTER (sday BETWEEN 122 AND 273) AS last_day, count(*) FILTER (sday BETWEEN 274 AND 365)::BIGINT AS post_monsoon
        FROM clean GROUP BY 1 HAVING count(*) FILTER (sday BETWEEN 122 AND 273) > 0""",
        "clean",
    ),
)
def panel_season_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = whole_panel(spark, sf_dir).select("block_id", "date")
    day = F.col("date")
    spin, core, late = in_season(day, JJAS, True), in_season(day, JJAS), in_season(day, OND)
    return (
        whole.groupBy(F.year("date").alias("season"))
        .agg(
            F.count_if(spin).alias("with_spin_up"),
            F.count_if(core).alias("in_season"),
            F.min(F.when(spin, day)).alias("first_day"),
            F.max(F.when(spin, day)).alias("last_day"),
            F.count_if(late).alias("post_monsoon"),
        )
        .where("with_spin_up > 0")
    )


@query("panel_interpolate_temp", sql(f"SELECT block_id, date, {r('tmin_c')}, {r('tmax_c')} FROM clean", "clean"))
def panel_interpolate_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = whole_panel(spark, sf_dir)
    return rounded(whole.select("block_id", "date", "tmin_c", "tmax_c"))


@query(
    "panel_report",
    sql(
        """SELECT (SELECT count(*) FROM obs)::BIGINT AS rows_in, count(*)::BIGINT AS rows_out, 0::BIGINT AS duplicates_dropped,
        count(*) FILTER (rain_is_imputed)::BIGINT AS missing_rain, 0::BIGINT AS implausible_rain, count(DISTINCT block_id)::BIGINT AS blocks,
        (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT CAST(year(date) AS VARCHAR) AS s FROM panel)) AS seasons,
        round(count(*) FILTER (rain_is_imputed) / count(*)::DOUBLE, 6) AS imputed_fraction FROM panel""",
        "panel",
    ),
)
def panel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return rounded(panel.report(obs, season_panel(spark, sf_dir)))


@query("et0_hargreaves", sql(f"SELECT block_id, date, {r('ra_mm')}, {r('et0_mm')} FROM et0", "et0"))
def et0_hargreaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import FALLBACK_LATITUDE
    from ..functions.agro import et0, radiation

    lat, doy = F.lit(FALLBACK_LATITUDE), F.dayofyear("date")
    return rounded(
        season_panel(spark, sf_dir).select(
            "block_id", "date", radiation(lat, doy).alias("ra_mm"), et0(F.col("tmin_c"), F.col("tmax_c"), lat, doy).alias("et0_mm")
        )
    )


@query("soil_bucket", sql(f"SELECT block_id, date, {r('soil_moisture_mm')}, {r('soil_moisture_fraction')}, is_dry_day FROM bal", "bal"))
def soil_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        balanced_panel(spark, sf_dir).select("block_id", "date", "soil_moisture_mm", "soil_moisture_fraction", "is_dry_day")
    )


@query(
    "dry_run_length",
    sql("SELECT block_id, year(date)::INT AS season, max(consecutive_dry_days)::INT AS longest FROM runs GROUP BY 1, 2", "runs"),
)
def dry_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = soil.with_dry_runs(season_panel(spark, sf_dir).select("block_id", "date", "rain_mm"))
    return runs.groupBy("block_id", F.year("date").alias("season")).agg(F.max("consecutive_dry_days").alias("longest"))


@query("dry_runs", sql("SELECT block_id, date, consecutive_dry_days FROM runs", "runs"))
def dry_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = soil.with_dry_runs(season_panel(spark, sf_dir).select("block_id", "date", "rain_mm"))
    return runs.select("block_id", "date", "consecutive_dry_days")


@query("dry_spell_starts", sql("SELECT block_id, date, spell_start FROM starts", "starts"))
def dry_spell_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.spell_starts(season_panel(spark, sf_dir)).select("block_id", "date", "spell_start")


def _labels(lead: int) -> None:
    @query(f"labels_L{lead}", sql(f"SELECT block_id, date, y FROM y{lead}", f"y{lead}"))
    def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
        return label_panel(spark, sf_dir, lead).select("block_id", "date", "y")


for _lead in LEADS:
    _labels(_lead)


@query("label_base_rate", sql(f"SELECT {r('avg(y)', 'base_rate')} FROM y14", "y14"))
def label_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lab.base_rate(label_panel(spark, sf_dir, 14)))


_SAMPLE = """count(*)::BIGINT AS n_rows, sum(y)::BIGINT AS positives, count(DISTINCT year(date))::BIGINT AS seasons, count(DISTINCT block_id)::BIGINT AS blocks"""


@query(
    "effective_sample_size",
    sql(f"SELECT {_SAMPLE}, {r('sum(y) / 14::DOUBLE / count(DISTINCT block_id)', 'independent_events')} FROM y14 WHERE y IS NOT NULL", "y14"),
)
def effective_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lab.effective_sample(label_panel(spark, sf_dir, 14), 14))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by region; every seventh block has none."""
    return (
        read(spark, sf_dir, "nation")
        .where("n_nationkey % 7 <> 6")
        .select(F.col("n_nationkey").alias("block_id"), F.col("n_regionkey").cast("string").alias("region"))
    )


cte("regions", (), "regions AS (SELECT n_nationkey AS block_id, CAST(n_regionkey AS VARCHAR) AS region FROM nation WHERE n_nationkey % 7 <> 6)")


@query(
    "effective_sample_size_regional",
    sql(
        f"""SELECT w.*, round(e, 6) AS independent_events FROM (SELECT {_SAMPLE} FROM y14 WHERE y IS NOT NULL) w,
        (SELECT sum(k) AS e FROM (SELECT sum(y) / 14::DOUBLE / count(DISTINCT l.block_id) AS k FROM y14 l LEFT JOIN regions g ON g.block_id = l.block_id
          WHERE y IS NOT NULL GROUP BY coalesce(region, 'b' || l.block_id)))""",
        "y14",
        "regions",
    ),
)
def effective_sample_size_regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Region names and block ids are told apart by a letter, as both are numbers here.
    named = regions(spark, sf_dir).withColumn("region", F.concat(F.lit("r"), "region"))
    return rounded(lab.effective_sample(label_panel(spark, sf_dir, 14), 14, named))


@query("pentad_climatology", sql(f"SELECT block_id, pentad::INT AS pentad, {r('clim_mean', digits=9)}, {r('clim_std')} FROM clim", "clim"))
def pentad_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The mean of two values of six decimals has seven: at six it would be rounded at a tie.
    found = feat.pentad_climatology(season_panel(spark, sf_dir))
    return rounded(found.withColumn("clim_std", F.round("clim_std", 6)), 9)


_GROUPS = {
    "features_soil": ("sm_frac_lag1", "sm_frac_delta_7d", "dry_run_lag1"),
    "features_rain": ("rain_sum_7d", "rain_sum_30d", "dry_days_15d"),
    "features_anomaly": ("rain_anomaly_15d",),
    "features_season": ("day_of_season_sin", "day_of_season_cos", "ens_dry_fraction"),
    "features_teleconnections": ("oni_lag30", "mjo_amplitude_lag10"),
    "features_all": feat.NAMES,
}


def _features(name: str, columns: tuple[str, ...]) -> None:
    @query(name, sql(f"SELECT block_id, date, {', '.join(r(c) for c in columns)} FROM feats", "feats"))
    def features(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(feature_panel(spark, sf_dir).select("block_id", "date", *columns))


for _name, _columns in _GROUPS.items():
    _features(_name, _columns)

@query("feature_shifts")
def feature_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift of every feature as declared and as found: all inputs change from a day in the middle of the panel's middle season on.

    The climatology is that of the panel as it was: it is fitted, not shifted.
    """
    days = season_panel(spark, sf_dir)
    _, first_last = observed(spark, sf_dir)
    middle = F.make_date(F.expr("cast((year(first) + year(last)) / 2 as int)"), F.lit(8), F.lit(1))
    day = F.broadcast(first_last.select(middle.alias("day_")))  # one row
    tele = teleconnections(spark, sf_dir)
    normals = feat.pentad_climatology(days)

    def built(panel_: DataFrame, tele_: DataFrame) -> DataFrame:
        return feat.with_anomaly(feat.fold_invariant(soil.balanced(panel_), JJAS, tele_), normals)

    moved = [feat.changed_from(d.crossJoin(day), F.col("day_")).drop("day_") for d in (days, tele)]
    return feat.shift_report(built(days, tele).crossJoin(day), built(*moved), F.col("day_"))


cte(
    "rain3",
    ("panel",),
    "rain3 AS (SELECT block_id, date, sum(rain_mm) OVER (PARTITION BY block_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rain_3d FROM panel)",
)


@query("rain_3d", sql(f"SELECT block_id, date, {r('rain_3d')} FROM rain3", "rain3"))
def rain_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feat.rain_3d(season_panel(spark, sf_dir)).select("block_id", "date", "rain_3d"))


# ---- folds, baselines, verification -----------------------------------------------------------

cte(
    "folds",
    ("panel",),
    """
seasons AS (SELECT DISTINCT year(date)::INT AS season FROM panel),
folds AS (
  SELECT a.season AS test_season, b.season AS train_season FROM seasons a JOIN seasons b ON a.season <> b.season
  WHERE a.season < (SELECT max(season) FROM seasons) AND b.season < (SELECT max(season) FROM seasons)
    AND (SELECT count(*) FROM seasons) - 2 >= 3)""",
)


@query("season_folds", sql("SELECT test_season, train_season FROM folds", "folds"))
def season_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.season_folds(season_panel(spark, sf_dir))


@query("season_holdout", sql("SELECT max(season)::INT AS season FROM seasons", "folds"))
def season_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.holdout_seasons(season_panel(spark, sf_dir))


cte(
    "base",
    ("runs", "y14", "folds", "regions"),
    f"""
base AS MATERIALIZED (
  SELECT p.block_id, p.date, year(p.date)::INT AS season, l.y, coalesce(g.region, 'b' || p.block_id) AS region, p.ens_dry_fraction, u.prev AS dry_run_lag1,
    least(11, CAST(trunc((CASE WHEN a < 0 THEN a + {PI2}::DOUBLE ELSE a END) / {PI2}::DOUBLE * 12) AS INT)) AS bin
  FROM (SELECT *, atan2(sin({PI2}::DOUBLE * date_diff('day', make_date(year(date), 6, 1), date) / 122::DOUBLE),
      cos({PI2}::DOUBLE * date_diff('day', make_date(year(date), 6, 1), date) / 122::DOUBLE)) AS a FROM panel) p
  JOIN (SELECT block_id, date, CAST(lag(consecutive_dry_days) OVER (PARTITION BY block_id ORDER BY date) AS DOUBLE) AS prev FROM runs) u
    ON u.block_id = p.block_id AND u.date = p.date
  JOIN y14 l ON l.block_id = p.block_id AND l.date = p.date LEFT JOIN regions g ON g.block_id = p.block_id
  WHERE l.y IS NOT NULL AND u.prev IS NOT NULL AND p.ens_dry_fraction IS NOT NULL),
tests AS (SELECT b.*, season AS fold FROM base b WHERE season IN (SELECT test_season FROM folds)),
trains AS (SELECT b.*, test_season AS fold FROM base b JOIN folds f ON f.train_season = b.season)""",
)


def _clip_sql(p: str) -> str:
    return f"least(1 - 1e-4::DOUBLE, greatest(1e-4::DOUBLE, {p}))"


cte(
    "p_clim",
    ("base",),
    f"""
p_clim AS (
  SELECT t.block_id, t.date, t.y, {_clip_sql('CASE WHEN b.n >= 10 THEN b.rate ELSE o.rate END')} AS p FROM tests t
  LEFT JOIN (SELECT fold, avg(y) AS rate FROM trains GROUP BY 1) o ON o.fold = t.fold
  LEFT JOIN (SELECT fold, bin, avg(y) AS rate, count(*) AS n FROM trains GROUP BY 1, 2) b ON b.fold = t.fold AND b.bin = t.bin)""",
)
cte(
    "p_region",
    ("base",),
    f"""
p_region AS (
  SELECT t.block_id, t.date, t.y, {_clip_sql('''CASE WHEN g.fold IS NULL THEN CASE WHEN b.n >= 10 THEN b.rate ELSE o.rate END
    WHEN s.n >= 10 THEN s.rate ELSE o.rate END''')} AS p FROM tests t
  LEFT JOIN (SELECT fold, avg(y) AS rate FROM trains GROUP BY 1) o ON o.fold = t.fold
  LEFT JOIN (SELECT fold, bin, avg(y) AS rate, count(*) AS n FROM trains GROUP BY 1, 2) b ON b.fold = t.fold AND b.bin = t.bin
  LEFT JOIN (SELECT DISTINCT fold, region FROM trains) g ON g.fold = t.fold AND g.region = t.region
  LEFT JOIN (SELECT fold, region, bin, avg(y) AS rate, count(*) AS n FROM trains GROUP BY 1, 2, 3) s ON s.fold = t.fold AND s.region = t.region AND s.bin = t.bin)""",
)
cte(
    "p_pers",
    ("base",),
    f"""
p_pers AS (
  SELECT t.block_id, t.date, t.y, {_clip_sql('CASE WHEN t.dry_run_lag1 >= 3 THEN r.a ELSE r.b END')} AS p FROM tests t
  LEFT JOIN (SELECT fold, coalesce(avg(CASE WHEN dry_run_lag1 >= 3 THEN y END), 0.5::DOUBLE) AS a,
    coalesce(avg(CASE WHEN dry_run_lag1 < 3 THEN y END), 0.5::DOUBLE) AS b FROM trains GROUP BY 1) r ON r.fold = t.fold)""",
)
cte("p_ens", ("base",), f"p_ens AS (SELECT block_id, date, y, {_clip_sql('ens_dry_fraction')} AS p FROM tests)")


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the SQL baselines, those of all folds; lead 14 days. Builds a plan and runs nothing."""
    from ..functions.agro import season_phase
    from ..functions.windows import by_block

    found, first_last = observed(spark, sf_dir)
    runs = soil.with_dry_runs(panel.canonical(found, JJAS, bounds=first_last))
    phase = season_phase(F.col("date"), JJAS)
    rows = lab.labelled(runs, 14).withColumns(
        {
            "dry_run_lag1": F.lag("consecutive_dry_days", 1).over(by_block()).cast("double"),
            "day_of_season_sin": F.sin(phase),
            "day_of_season_cos": F.cos(phase),
        }
    )
    keep = ("block_id", "date", "y", "dry_run_lag1", "day_of_season_sin", "day_of_season_cos", "ens_dry_fraction")
    rows = rows.dropna(subset=["y", "dry_run_lag1", "ens_dry_fraction"]).select(*keep)
    # A panel holds every day between its bounds, so its seasons are those of the bounds.
    days = first_last.select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date"))
    return models.in_folds(rows, models.fold_seasons(days.where(in_season(F.col("date"), JJAS, spin_up=True))))


def with_regions(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` with their region; a block without one is a region of its own."""
    own = F.concat(F.lit("b"), F.col("block_id").cast("string"))
    return rows.join(regions(spark, sf_dir), "block_id", "left").withColumn("region", F.coalesce("region", own))


def _predictions(kind: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = base_rows(spark, sf_dir)
        found = {
            "model_climatology": lambda: models.climatology(rows),
            "model_climatology_regional": lambda: models.climatology(with_regions(rows, spark, sf_dir), regional=True),
            "model_persistence": lambda: models.persistence(rows),
            "model_raw_ensemble": lambda: models.raw_ensemble(rows),
        }[kind]()
        return found.select("block_id", "date", "y", "p")

    return run


for _kind, _cte in (
    ("model_climatology", "p_clim"),
    ("model_climatology_regional", "p_region"),
    ("model_persistence", "p_pers"),
    ("model_raw_ensemble", "p_ens"),
):

    @query(_kind, sql(f"SELECT block_id, date, y, {r('p')} FROM {_cte}", _cte))
    def _model(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return rounded(_predictions(kind)(spark, sf_dir))


cte(
    "scored",
    ("p_clim", "p_pers", "p_ens"),
    """
scored AS MATERIALIZED (
  SELECT m.model, year(m.date) AS season, m.y, m.p, c.p AS ref FROM (
    SELECT 'climatology' AS model, * FROM p_clim UNION ALL SELECT 'persistence', * FROM p_pers UNION ALL SELECT 'raw_ensemble', * FROM p_ens) m
  JOIN p_clim c ON c.block_id = m.block_id AND c.date = m.date),
edges AS (SELECT [0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.30000000000000004::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE] AS e),
bins AS (
  SELECT model, len(list_filter(e, lambda x: p >= x)) - 1 AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y
  FROM scored, edges GROUP BY 1, 2),
tot AS (SELECT model, sum(n) AS total, sum(n * mean_y) / sum(n) AS base FROM bins GROUP BY 1),
murphy AS (
  SELECT model, sum(n / total * (mean_p - mean_y) ^ 2) AS reliability, sum(n / total * (mean_y - base) ^ 2) AS resolution,
    any_value(base * (1 - base)) AS uncertainty, sum(n / total * abs(mean_p - mean_y)) AS ece
  FROM bins JOIN tot USING (model) GROUP BY 1),
auc AS (
  SELECT model, CASE WHEN sum(k) > 0 AND sum(n - k) > 0 THEN (sum(rk * k) - sum(k) * (sum(k) + 1) / 2) / (sum(k) * sum(n - k)) END AS auc
  FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rk
    FROM (SELECT model, p, count(*) AS n, sum(y) AS k FROM scored GROUP BY 1, 2)) GROUP BY 1),
plain AS (
  SELECT model, count(*)::BIGINT AS n, avg(y) AS base_rate, avg((p - y) ^ 2) AS brier, avg((ref - y) ^ 2) AS brier_ref, var_pop(p) AS sharpness
  FROM scored GROUP BY 1)""",
)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, block_id, date, y, p and the climatology as ref.

    The narrow rows below are written once, as counts, folds and scores all read them; nothing stays cached.
    """
    return models.ladder(written(base_rows(spark, sf_dir), "base-rows"))


def _verify(name: str, oracle: str, make) -> None:  # noqa: ANN001
    @query(name, sql(oracle, "scored"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(make(scored_rows(spark, sf_dir)))


M = ("model",)
_verify("verify_brier", f"SELECT model, {r('brier')} FROM plain", lambda d: d.groupBy("model").agg(verify.brier().alias("brier")))
_verify(
    "verify_bss",
    f"SELECT model, {r('CASE WHEN brier_ref > 0 THEN 1 - brier / brier_ref END', 'bss')} FROM plain",
    lambda d: d.groupBy("model").agg(verify.skill(verify.brier(), verify.brier("ref")).alias("bss")),
)
_verify(
    "verify_reliability",
    f"SELECT model, bin::INT AS bin, n::BIGINT AS n, {r('mean_p')}, {r('mean_y')} FROM bins",
    lambda d: verify.reliability_bins(d, M),
)
_verify(
    "verify_murphy",
    f"SELECT model, {r('reliability')}, {r('resolution')}, {r('uncertainty')} FROM murphy",
    lambda d: verify.murphy(d, M).drop("ece"),
)
_verify("verify_ece", f"SELECT model, {r('ece')} FROM murphy", lambda d: verify.murphy(d, M).select("model", "ece"))
_verify("verify_sharpness", f"SELECT model, {r('sharpness')} FROM plain", lambda d: d.groupBy("model").agg(F.var_pop("p").alias("sharpness")))
_verify("verify_auc", f"SELECT model, {r('auc')} FROM auc", lambda d: verify.auc(d, M))
_verify(
    "verify_value_curve",
    """SELECT model, round(alpha, 6) AS alpha, CASE WHEN abs(least(alpha, base) - alpha * base) > 1e-12 THEN
      round((least(alpha, base) - (alpha * (hits + fa) + miss)) / (least(alpha, base) - alpha * base), 6) + 0::DOUBLE END AS value
    FROM (SELECT model, alpha, avg(y) AS base, avg(CASE WHEN p > alpha AND y = 1 THEN 1 ELSE 0 END) AS hits,
        avg(CASE WHEN p > alpha AND y = 0 THEN 1 ELSE 0 END) AS fa, avg(CASE WHEN p <= alpha AND y = 1 THEN 1 ELSE 0 END) AS miss
      FROM scored, (SELECT unnest(["""
    + ", ".join(f"{float(x)!r}::DOUBLE" for x in np.linspace(0.05, 0.95, 19))
    + """]) AS alpha) GROUP BY 1, 2)""",
    lambda d: verify.value_curve(d, by=M),
)
_verify(
    "verify_all",
    f"""SELECT model, n, {r('base_rate')}, {r('brier')}, {r('brier_ref')}, {r('sharpness')}, {r('reliability')}, {r('resolution')}, {r('uncertainty')}, {r('ece')}, {r('auc')},
    {r('CASE WHEN brier_ref > 0 THEN 1 - brier / brier_ref END', 'bss')} FROM plain JOIN murphy USING (model) JOIN auc USING (model)""",
    lambda d: verify.scores(d, M),
)
_verify(
    "verify_best_model",
    f"SELECT arg_max(model, 1 - brier / brier_ref) AS model, {r('max(1 - brier / brier_ref)', 'bss')} FROM plain",
    lambda d: d.groupBy("model")
    .agg(verify.skill(verify.brier(), verify.brier("ref")).alias("bss"))
    .agg(F.max_by("model", "bss").alias("model"), F.max("bss").alias("bss")),
)


_verify(
    "skill_table",
    """SELECT row_number() OVER (ORDER BY 1 - brier / brier_ref DESC, model)::INT AS place, model,
    rpad(model, 28, ' ') || ' L=14d  BS=' || printf('%.4f', brier) || '  BSS=' || printf('%+.3f', 1 - brier / brier_ref) || '  ECE=' || printf('%.4f', ece)
      || '  AUC=' || printf('%.3f', auc) || '  sharp=' || printf('%.4f', sharpness) || '  n=' || n || '  base=' || printf('%.3f', base_rate) AS line
    FROM plain JOIN murphy USING (model) JOIN auc USING (model)""",
    lambda d: verify.skill_lines(verify.scores(d, M), 14),
)


_SUMS = """
sums AS (
  SELECT model, row_number() OVER (PARTITION BY model ORDER BY season) - 1 AS place, count(*) OVER (PARTITION BY model) AS seasons, n, s, r
  FROM (SELECT model, season, count(*) AS n, sum((p - y) ^ 2) AS s, sum((ref - y) ^ 2) AS r FROM scored GROUP BY 1, 2)),
drawn AS (
  SELECT a.model, a.draw, sum(n) AS n, sum(s) AS s, sum(r) AS r
  FROM (SELECT model, draw, ('0x' || md5(draw || ':' || place)[:12])::BIGINT % seasons AS place FROM sums, range(1, 501) t(draw)) a
  JOIN sums b ON b.model = a.model AND b.place = a.place GROUP BY 1, 2)"""
cte("draws", ("scored",), _SUMS)


def _ends(e: str, name: str) -> str:
    return f"{r(f'quantile_cont({e}, 0.025::DOUBLE)', f'{name}low')}, {r(f'quantile_cont({e}, 0.975::DOUBLE)', f'{name}high')}"


_SKILL = "CASE WHEN r > 0 THEN 1 - s / r END"


@query(
    "verify_bootstraps",
    sql(f"SELECT model, 500 AS draws, {_ends('s / n', 'brier_')}, {_ends(_SKILL, 'skill_')} FROM drawn GROUP BY model", "draws"),
)
def verify_bootstraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(verify.bootstraps(scored_rows(spark, sf_dir)))


@query("verify_bootstrap", sql(f"SELECT 500 AS draws, {_ends(_SKILL, '')} FROM drawn WHERE model = 'persistence'", "draws"))
def verify_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(verify.bootstrap(scored_rows(spark, sf_dir).where("model = 'persistence'")))
