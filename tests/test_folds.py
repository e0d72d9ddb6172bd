"""Folds from mergeable moments and counts: equal to taking each season out and counting anew."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapipe.config import JJAS
from terrapipe.operators import features, learners, models, verify
from terrapipe.plans import advanced, weather

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folds(spark):
    design, seasons = advanced.fold_design(spark, SF)
    return design, seasons, advanced.own_rows(design, seasons)


def panel(spark, seasons=range(2000, 2006), blocks=3, seed=1):
    rnd = random.Random(seed)
    rows = []
    for year in seasons:
        for b in range(blocks):
            for k in range(0, 60, 1 + b):
                if (b, year) != (2, 2003):  # a block without one of the seasons
                    rain = rnd.choice([None, 0.0, 0.0, 1.5, rnd.uniform(0, 90)])
                    rows.append((b, dt.date(year, 6, 1) + dt.timedelta(days=k), rain))
    rows.append((9, dt.date(2001, 7, 1), 4.0))  # a block of one day
    return spark.createDataFrame(rows, "block_id int, date date, rain_mm double")


def test_seasons_and_holdout(spark):
    p = panel(spark)
    assert sorted(r.fold for r in models.fold_seasons(p).collect()) == [2000, 2001, 2002, 2003, 2004]
    assert [r.season for r in models.holdout_seasons(p, 2).collect()] == [2005, 2004]
    pairs = {(r.test_season, r.train_season) for r in models.season_folds(p, 2).collect()}
    assert pairs == {(a, b) for a in range(2000, 2004) for b in range(2000, 2004) if a != b}
    few = panel(spark, range(2000, 2004))
    assert models.fold_seasons(few).count() == 0 and models.season_folds(few).count() == 0
    assert models.fold_seasons(few, min_training=2).count() == 3
    assert models.fold_seasons(p.limit(0)).count() == 0 and models.holdout_seasons(p.limit(0)).count() == 0


def test_climatologies_equal_one_scan_for_each_fold(spark):
    p = panel(spark)
    folds = models.fold_seasons(p)
    years = [r.fold for r in folds.collect()]
    got = {(r.fold, r.block_id, r.pentad): (r.clim_mean, r.clim_std) for r in models.climatologies(p, folds).collect()}
    want = {}
    for fold in years:
        for r in features.pentad_climatology(p, [y for y in years if y != fold]).collect():
            if r.clim_mean is not None:
                want[fold, r.block_id, r.pentad] = (r.clim_mean, r.clim_std)
    assert set(got) == set(want) and len(got) > 100
    for key, (mean, std) in want.items():
        assert got[key][0] == pytest.approx(mean, abs=1e-9)
        assert (got[key][1] is None) == (std is None) and (std is None or got[key][1] == pytest.approx(std, abs=1e-9))


def test_moments_do_not_cancel(spark):
    rows = [(1, dt.date(2000 + y, 6, 1 + k), 1e7 + (k % 2)) for y in range(6) for k in range(2)]
    p = spark.createDataFrame(rows, "block_id int, date date, rain_mm double")
    got = models.climatologies(p, models.fold_seasons(p)).collect()
    assert len(got) == 5 and all(r.clim_std == pytest.approx(np.std([0, 1] * 4, ddof=1), rel=1e-6) for r in got)


def test_exchanges_do_not_grow_with_the_seasons(spark):
    def exchanges(seasons):
        p = panel(spark, range(2000, 2000 + seasons))
        plan = models.climatologies(p, models.fold_seasons(p))._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange")

    assert exchanges(6) == exchanges(25)


def rows_of(spark, n=900, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        day = dt.date(2000 + i % 6, 6, 1) + dt.timedelta(days=rnd.randint(0, 100))
        phase = 2 * math.pi * (day - dt.date(day.year, 6, 1)).days / 122
        region = "far" if i % 97 == 0 and day.year == 2002 else "ab"[i % 2]
        rows.append((i, day, float(rnd.random() < 0.3), region, float(rnd.randint(0, 6)), math.sin(phase), math.cos(phase), rnd.random()))
    names = "block_id int, date date, y double, region string, dry_run_lag1 double, day_of_season_sin double, day_of_season_cos double, ens_dry_fraction double"
    return spark.createDataFrame(rows, names)


def test_baselines_equal_counting_the_others_anew(spark):
    frame = rows_of(spark)
    folds = models.fold_seasons(frame)
    rows = models.in_folds(frame, folds)
    plain = [r.asDict() for r in rows.withColumn("bin", models.phase_bin(F.col("day_of_season_sin"), F.col("day_of_season_cos"))).collect()]
    assert {r["fold"] for r in plain} == {2000, 2001, 2002, 2003, 2004}

    def rate(own):
        return sum(r["y"] for r in own) / len(own)

    def want(r):
        others = [x for x in plain if x["fold"] != r["fold"]]
        in_bin = [x for x in others if x["bin"] == r["bin"]]
        pooled = rate(in_bin) if len(in_bin) >= 10 else rate(others)
        region = [x for x in others if x["region"] == r["region"]]
        own = [x for x in region if x["bin"] == r["bin"]]
        regional = pooled if not region else rate(own) if len(own) >= 10 else rate(others)
        running = [x for x in others if (x["dry_run_lag1"] >= 3) == (r["dry_run_lag1"] >= 3)]
        return pooled, regional, rate(running)

    expected = {r["block_id"]: want(r) for r in plain}
    found = [models.climatology(rows), models.climatology(rows, regional=True), models.persistence(rows)]
    for j, frame in enumerate(found):
        got = {r.block_id: r.p for r in frame.collect()}
        assert set(got) == set(expected)
        assert all(got[b] == pytest.approx(expected[b][j], abs=1e-12) for b in got)
    ladder = models.ladder(rows).collect()
    assert len(ladder) == 3 * len(plain)
    for r in ladder:
        ref, _, run = expected[r.block_id]
        assert r.ref == pytest.approx(ref) and (r.model == "raw_ensemble" or r.p == pytest.approx(ref if r.model == "climatology" else run))


def test_persistence_without_a_case_is_one_half(spark):
    rows = [(i, dt.date(2000 + i % 5, 6, 1), 1.0, 0.0) for i in range(20)] + [(99, dt.date(2000, 6, 2), 0.0, 5.0)]
    frame = spark.createDataFrame(rows, "block_id int, date date, y double, dry_run_lag1 double")
    got = {r.block_id: r.p for r in models.persistence(models.in_folds(frame, models.fold_seasons(frame))).collect()}
    assert got[99] == 0.5 and got[1] == 1 - 1e-4


def test_scores_from_counts_equal_scores_from_rows(spark):
    rnd = random.Random(5)
    rows = [("ab"[i % 2], dt.date(2000 + i % 4, 6, 1), float(rnd.random() < 0.4), rnd.choice([0.1, 0.3, 0.55, rnd.random(), 1.0]), 0.4) for i in range(400)]
    frame = spark.createDataFrame(rows, "model string, date date, y double, p double, ref double")
    got = {r.model: r for r in verify.scores(frame, ("model",)).collect()}
    murphy = {r.model: r for r in verify.murphy(frame, ("model",)).collect()}
    auc = {r.model: r.auc for r in verify.auc(frame, ("model",)).collect()}
    for m, r in got.items():
        own = [x for x in rows if x[0] == m]
        p, y = np.array([x[3] for x in own]), np.array([x[2] for x in own])
        assert r.n == len(own) and r.brier == pytest.approx(((p - y) ** 2).mean()) and r.sharpness == pytest.approx(p.var())
        assert r.base_rate == pytest.approx(y.mean()) and r.bss == pytest.approx(1 - ((p - y) ** 2).mean() / ((0.4 - y) ** 2).mean())
        assert r.auc == pytest.approx(auc[m]) and r.ece == pytest.approx(murphy[m].ece) and r.resolution == pytest.approx(murphy[m].resolution)


def test_building_the_baselines_runs_nothing(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "")
    try:
        models.ladder(weather.base_rows(spark, SF))
        weather.season_folds(spark, SF)
        jobs = tracker.getJobIdsForGroup("build-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 4  # Spark reads the footers of the files; nothing else


def test_anomaly_is_fitted_on_training_seasons(spark, folds):
    rain = weather.season_panel(spark, SF).where("rain_mm IS NOT NULL").select("block_id", "date", "rain_mm").collect()
    _, seasons, own = folds
    row = own.orderBy("fold", "block_id", "date").first()
    pentad = lambda d: (d.timetuple().tm_yday - 1) // 5
    others = [
        r.rain_mm
        for r in rain
        if r.block_id == row.block_id and pentad(r.date) == pentad(row.date) and r.date.year in set(seasons) - {row.fold}
    ]
    past = sum(r.rain_mm for r in rain if r.block_id == row.block_id and 1 <= (row.date - r.date).days <= 15)
    assert abs(row.rain_anomaly_15d - (past - 15 * np.mean(others)) / (np.std(others, ddof=1) * math.sqrt(15))) < 1e-9


def test_a_design_row_stands_once_for_all_folds(spark, folds):
    design, seasons, own = folds
    assert design.count() == design.select("block_id", "date").distinct().count() >= own.count() > 0
    assert {r.fold for r in design.select("fold").distinct().collect()} == set(seasons) and len(design.first().anomalies) == len(seasons)
    stops = design.groupBy("fold", "y").agg(F.avg(F.col("stops").cast("int")).alias("share"), F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r.share - 0.15) < 0.1 for r in stops if r.n > 100)


def test_every_season_is_predicted(spark, folds):
    _, seasons, own = folds
    asked = {(r.fold, r.block_id, r.date) for r in own.select("fold", "block_id", "date").collect()}
    got = advanced._isotonic(own).collect()
    assert {(r.fold, r.block_id, r.date) for r in got} == asked and len(got) == len(asked)
    assert all(r.fold == r.date.year and 0 < r.p < 1 for r in got)


def test_each_fold_is_fitted_on_its_own_rows(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 2.0), (2, 10.0)], "fold int, y double")
    fit = lambda own, asked: asked.withColumn("p", F.lit(own.agg(F.avg("y")).first()[0]))
    got = learners.each_fold(rows, spark.createDataFrame([(1,), (2,), (3,)], "fold int"), fit)
    assert sorted(map(tuple, got.collect())) == [(1, 1.0), (2, 10.0)]


def test_season_of_the_bounds_is_that_of_the_panel(spark):
    want = {r.fold for r in models.fold_seasons(weather.whole_panel(spark, SF, JJAS)).collect()}
    assert {r.fold for r in weather.base_rows(spark, SF).select("fold").distinct().collect()} == want
