"""Declared shifts against what a change of the inputs moves; rows of older layouts."""

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapipe.operators import features
from terrapipe.plans import weather
from terrapipe.sources import legacy


def test_declared_shifts_hold_on_the_panel(spark):
    got = {r.feature: r for r in weather.feature_shifts(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(features.NAMES) and all(r.holds for r in got.values())
    moved = {c: r.first_change for c, r in got.items() if r.first_change is not None}
    assert {"sm_frac_lag1", "dry_run_lag1", "rain_sum_7d", "ens_dry_fraction", "oni_lag30", "mjo_amplitude_lag10"} <= set(moved)
    assert moved["rain_sum_7d"] == 1 and moved["ens_dry_fraction"] == 0 and moved["mjo_amplitude_lag10"] == 10 and moved["oni_lag30"] == 30


def test_a_planted_leak_is_found(spark):
    rows = [(b, dt.date(2020, 6, 1) + dt.timedelta(days=d), float(d % 5)) for b in range(2) for d in range(40)]
    panel = spark.createDataFrame(rows, "block_id int, date date, rain_mm double")
    day = F.lit("2020-06-20").cast("date")
    own = W.partitionBy("block_id").orderBy("date")
    kinds = (features.Feature("lagged", 1), features.Feature("today", 1), features.Feature("ahead", 0), features.Feature("late", 3), features.Feature("still", 5))

    def built(p):
        return p.withColumns(
            {
                "lagged": F.lag("rain_mm", 1).over(own), "today": F.sum("rain_mm").over(own.rowsBetween(-2, 0)),
                "ahead": F.max("rain_mm").over(own.rowsBetween(0, 4)), "late": F.lag("rain_mm", 3).over(own), "still": F.lit(1.0),
            }
        )

    got = {r.feature: (r.first_change, r.holds) for r in features.shift_report(built(panel), built(features.changed_from(panel, day)), day, kinds).collect()}
    assert got == {"lagged": (1, True), "today": (0, False), "ahead": (-4, False), "late": (3, True), "still": (None, True)}


def test_events_of_older_layouts(spark):
    rows = [
        (1, None, None, '{"reasons":["a","b"],"block_key":"x","k":1}'),
        (2, '["own"]', "b1", '{"reasons":["kept"],"block_key":"kept"}'),
        (3, "[]", "", '{"reasons":["not taken"],"block_key":"y"}'),
        (4, None, None, None),
        (5, None, None, "{broken"),
        (6, None, "", '{"reasons":null,"block_key":null,"n":{"m":2}}'),
        (7, None, None, "[1, 2]"),
    ]
    frame = spark.createDataFrame(rows, "id int, reasons string, block_key string, payload string")
    got = {r.id: (r.reasons, r.block_key, r.payload_keys) for r in legacy.trigger_events(frame).collect()}
    assert got == {
        1: (["a", "b"], "x", ["k"]), 2: (["own"], "b1", ["block_key", "reasons"]), 3: ([], "y", ["reasons"]), 4: ([], "", []), 5: ([], "", []),
        6: ([], "", ["n"]), 7: ([], "", []),
    }
    keys = {r.id: r.k for r in frame.select("id", legacy.has_key(F.col("payload"), "block_key").alias("k")).collect()}
    assert [i for i, k in keys.items() if k] == [1, 2, 3, 6]


def test_advisories_of_older_layouts(spark):
    rows = [(1, None, "wait"), (2, "sow", "sms"), (3, "", "re_sow"), (4, None, None), (5, "sow", "abstain"), (6, "", "")]
    got = {r.id: (r.action, r.channel) for r in legacy.advisories(spark.createDataFrame(rows, "id int, action string, channel string")).collect()}
    assert got == {1: ("wait", "api"), 2: ("sow", "sms"), 3: ("re_sow", "api"), 4: ("abstain", None), 5: ("sow", "api"), 6: ("abstain", "")}
