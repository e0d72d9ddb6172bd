"""Streams against their batch twins, and batches that run twice."""

import datetime as dt
import random

from terrapipe.operators import soil
from terrapipe.streaming import state

DAY = dt.date(2021, 6, 3)


def test_streams_equal_batches(spark):
    rng = random.Random(11)
    rows = [(b, DAY + dt.timedelta(d), rng.choice([0.0, 0.4, 9.0, 70.0, None]), rng.uniform(-30, 40)) for b in range(3) for d in range(25)]
    readings = spark.createDataFrame(rows, "block_id int, date date, rain_mm double, change double")
    asked = readings.select("block_id", "date", "rain_mm")
    batch = soil.with_dry_runs(asked).select("block_id", "date", "consecutive_dry_days")
    assert sorted(state.replayed(asked, state.stream_dry_run).collect()) == sorted(batch.collect())
    streamed = state.replayed(readings.select("block_id", "date", "change"), state.stream_bucket, parts=2)
    want = {(r.block_id, r.date): r.soil_moisture_mm for r in soil.bucket(readings).collect()}
    got = {(r.block_id, r.date): r.soil_moisture_mm for r in streamed.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_an_action_has_to_last_to_be_taken_over(spark):
    actions = ["hold", "sow", "hold", "sow", "sow", "sow", "hold"]
    rows = [(7, DAY + dt.timedelta(d), a) for d, a in enumerate(actions)]
    out = state.replayed(spark.createDataFrame(rows, "block_id int, date date, action string"), lambda s: state.stream_hysteresis(s, 3))
    assert [r.stable for r in out.orderBy("date").collect()] == ["hold"] * 5 + ["sow", "sow"]


def test_a_batch_that_runs_again_is_audited_once(spark, tmp_path):
    events = spark.createDataFrame([(1, "sow"), (2, "abstain"), (3, "hold")], "id int, action string")
    events.write.parquet(f"{tmp_path}/in")
    for turn in range(2):  # a new checkpoint each time: the same batch comes again
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        state.audit(stream, f"{tmp_path}/events", f"{tmp_path}/advisories", f"{tmp_path}/c{turn}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/events").collect()) == [1, 2, 3]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/advisories").collect()) == [1, 3]
