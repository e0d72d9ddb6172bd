"""Claims about single operators of the weather plane, on hand-made panels."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from terrapipe.config import JJAS, Season
from terrapipe.functions.agro import et0, in_season, radiation
from terrapipe.operators import features, labels, panel, soil, verify

OBS = "block_id string, date date, rain_mm double, tmin_c double, tmax_c double"


def days(rain, start=dt.date(2020, 7, 1), block="A"):
    return [(block, start + dt.timedelta(i), None if r is None else float(r), 25.0, 35.0) for i, r in enumerate(rain)]


def frame(spark, rows):
    return spark.createDataFrame(rows, OBS)


def column(df, name):
    return [r[name] for r in df.orderBy("block_id", "date").collect()]


def test_missing_rain_stays_missing(spark):
    out = panel.canonical(frame(spark, days([12.5, 0.0, math.nan, 3.75, math.nan, 0.5])), None)
    assert column(out, "rain_mm") == [12.5, 0.0, None, 3.75, None, 0.5]
    assert column(out, "rain_is_imputed") == [False, False, True, False, True, False]


def test_implausible_rain_is_void(spark):
    out = panel.canonical(frame(spark, days([1000.0, -0.1, 7.5, 1000.1, 999.0])), None)
    assert column(out, "rain_mm") == [1000.0, None, 7.5, None, 999.0]


def test_calendar_gap_becomes_rows(spark):
    rows = [days([6.5])[0], ("A", dt.date(2020, 7, 4), 8.25, 21.0, 33.0)]
    out = panel.canonical(frame(spark, rows), None)
    assert column(out, "rain_mm") == [6.5, None, None, 8.25]


def test_global_range_pads_short_blocks(spark):
    rows = days([4.0, 0.5, 4.0, 0.5]) + days([9.0], block="B") + days([2.0, 2.0], block="C")
    assert panel.canonical(frame(spark, rows), None).count() == 12


def test_first_of_a_day_wins(spark):
    rows = [("A", dt.date(2020, 7, 1), 1.0, 25.0, 35.0, 2), ("A", dt.date(2020, 7, 1), 9.0, 25.0, 35.0, 1)]
    out = panel.first_of_day(spark.createDataFrame(rows, OBS + ", seq int"), "seq")
    assert column(out, "rain_mm") == [9.0]


def test_missing_column_is_named(spark):
    with pytest.raises(panel.PanelSchemaError, match="tmax_c"):
        panel.canonical(frame(spark, days([1.0])).drop("tmax_c"), None)


def test_empty_season_raises(spark):
    obs = frame(spark, days([1.0] * 5))
    with pytest.raises(panel.PanelSchemaError):
        panel.require_rows(panel.canonical(obs, Season((1, 1), (2, 1))), Season((1, 1), (2, 1)))
    with pytest.raises(ValueError):
        Season((11, 1), (2, 1))


def test_interpolation_reaches_three_days_from_either_side(spark):
    temps = [10.0] + [None] * 9 + [20.0, None, None, None, None]
    rows = [("A", dt.date(2020, 7, 1) + dt.timedelta(i), 0.0, t, 30.0) for i, t in enumerate(temps)]
    got = column(panel.canonical(frame(spark, rows), None), "tmin_c")
    assert got == [10.0, 11.0, 12.0, 13.0, None, None, None, 17.0, 18.0, 19.0, 20.0, 20.0, 20.0, 20.0, None]


def test_season_counts_leap_days_out(spark):
    dates = [dt.date(2020, 6, 1), dt.date(2020, 5, 31), dt.date(2020, 9, 30), dt.date(2020, 10, 1), dt.date(2021, 6, 1)]
    df = spark.createDataFrame([(d,) for d in dates], "date date")
    got = {r.date: r.x for r in df.select("date", in_season(F.col("date"), JJAS).alias("x")).collect()}
    assert [got[d] for d in dates] == [True, False, True, False, True]


def test_dry_runs(spark):
    runs = soil.with_dry_runs(frame(spark, days([1.5, 2.4, 2.5, 0.0, 0.3, 60.0, 1.0])))
    assert column(runs, "consecutive_dry_days") == [1, 2, 0, 1, 2, 0, 1]
    assert column(soil.with_dry_runs(frame(spark, days([9.0, 2.0, None, 1.0, 0.0]))), "consecutive_dry_days") == [0, 1, 0, 1, 2]


def test_spell_starts(spark):
    def starts(rain):
        return column(labels.spell_starts(panel.canonical(frame(spark, days(rain)), None), 5), "spell_start")

    assert starts([30.0, 2, 1, 0, 2, 4.5, 1, 1, 1, 1])[1] == 0.0
    got = starts([5.5, 1, 2, 0, 1, 2, 0, 1])
    assert got[1] == 1.0 and got[2] == 0.0 and got[4] is None
    assert starts([5.5, 1, None, 2, 0, 1, 2])[1] is None


def test_bucket_matches_the_recursion(spark):
    rng = random.Random(4)
    rain = [rng.choice([0.0, 0.0, 3.0, 80.0, None]) for _ in range(200)]
    out = soil.balanced(panel.canonical(frame(spark, days(rain)), None))
    rows = out.orderBy("date").collect()
    mm = 75.0
    for r in rows:
        mm = min(150.0, max(0.0, mm + (r.rain_mm or 0.0) * 0.85 - (r.et0_mm or 0.0)))
        assert abs(mm - r.soil_moisture_mm) < 1e-9
        assert 0 <= r.soil_moisture_fraction <= 1


def test_unknown_latitude_is_an_error(spark):
    lat = spark.createDataFrame([("B", 20.0)], "block_id string, latitude double")
    with pytest.raises(Exception, match="no latitude for block"):
        soil.balanced(panel.canonical(frame(spark, days([1.0])), None), lat).collect()


def test_evaporation_rises_with_the_daily_range(spark):
    df = spark.createDataFrame([(25.0, 30.0), (20.0, 35.0), (35.0, 25.0)], "a double, b double")
    got = [r.x for r in df.select(et0(F.col("a"), F.col("b"), F.lit(29.5), F.lit(200)).alias("x")).collect()]
    assert got[0] < got[1] and got[2] == 0
    assert 10 < df.select(radiation(F.lit(29.5), F.lit(172)).alias("r")).first().r < 20


def test_features_do_not_see_the_future(spark):
    rng = random.Random(1)
    rain = [rng.choice([0.0, 0.0, 12.0]) for _ in range(120)]
    cut = 80
    whole = soil.balanced(panel.canonical(frame(spark, days(rain, dt.date(2020, 5, 2))), None))
    part = soil.balanced(panel.canonical(frame(spark, days(rain[:cut], dt.date(2020, 5, 2))), None))
    names = [f.name for f in features.FEATURES if f.min_shift > 0 and f.name != "rain_anomaly_15d"]
    a = features.fold_invariant(whole, JJAS).orderBy("date").limit(cut).select(*names).collect()
    b = features.fold_invariant(part, JJAS).orderBy("date").select(*names).collect()
    assert a == b


def test_climatology_depends_on_its_training_seasons(spark):
    rows = days([5.0] * 20, dt.date(2019, 7, 1)) + days([50.0] * 20, dt.date(2020, 7, 1))
    p = panel.canonical(frame(spark, rows), None)
    one = features.pentad_climatology(p, [2019]).agg(F.avg("clim_mean")).first()[0]
    two = features.pentad_climatology(p, [2020]).agg(F.avg("clim_mean")).first()[0]
    assert (one, two) == (5.0, 50.0)


def scored(spark, y, p, ref=None):
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(y, p, ref or p)]
    return spark.createDataFrame(rows, "y double, p double, ref double")


def test_scores(spark):
    s = verify.scores(scored(spark, [0, 1, 1, 0], [0.3, 0.7, 0.6, 0.2])).first()
    assert s.bss == 0 and s.auc == 1.0
    rng = random.Random(2)
    p = [rng.randrange(10) / 10 + 0.05 for _ in range(3000)]
    y = [float(rng.random() < x) for x in p]
    s = verify.scores(scored(spark, y, p)).first()
    assert abs(s.reliability - s.resolution + s.uncertainty - s.brier) < 1e-9
    pairs = sum((a > b) + 0.5 * (a == b) for a, t in zip(p[:300], y) if t for b, u in zip(p[:300], y) if not u)
    ones = sum(y[:300])
    got = verify.auc(scored(spark, y[:300], p[:300])).first().auc
    assert abs(got - pairs / (ones * (300 - ones))) < 1e-9


def test_bin_edges_are_floats(spark):
    got = {r.p: r.bin for r in verify.with_bin(scored(spark, [0] * 5, [0.3, 0.6, 0.7, 1.0, 0.0])).collect()}
    assert got == {0.3: 2, 0.6: 5, 0.7: 6, 1.0: 9, 0.0: 0}


def test_one_class_has_no_area(spark):
    assert verify.auc(scored(spark, [1, 1], [0.2, 0.4])).first().auc is None


def test_constant_forecast_has_no_value(spark):
    curve = verify.value_curve(scored(spark, [0, 1, 0, 1], [0.5] * 4)).collect()
    assert all(r.value is None or r.value <= 1e-9 for r in curve)
