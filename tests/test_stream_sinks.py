"""Sinks under replayed, reordered and late batches; windows and newest files as streams against plain versions."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from terrapipe.plans import streams
from terrapipe.streaming import sinks

T0 = dt.datetime(2024, 3, 30, 12)


def evaluations(spark, n=60):
    rows = [(i, T0 + dt.timedelta(hours=7 * i), f"S{i % 3}", f"D{i % 5}", "abstain" if i % 4 == 0 else "sow", f"r{i}", i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, detected_at timestamp, state string, district string, action string, reason string, part int")


def audited(spark, rows, slices):
    base = streams.fed(rows, slices, lambda s, at: sinks.audit_with_parent(s, f"{at}/events", f"{at}/advisories", f"{at}/checkpoint"))
    return spark.read.parquet(f"{base}/events"), spark.read.parquet(f"{base}/advisories"), base


def test_replayed_and_reordered_batches_leave_each_event_once(spark):
    rows = evaluations(spark)
    part = F.col("part")
    events, advisories, _ = audited(spark, rows, [part == 2, part == 0, part == 2, F.lit(True)])
    want = {r.event_id: r for r in rows.collect()}
    got = events.collect()
    assert len(got) == len(want) and {r.event_id for r in got} == set(want)
    said = advisories.collect()
    assert sorted(r.event_id for r in said) == sorted(k for k, r in want.items() if r.action != "abstain")
    assert all((r.state, r.district, r.reason) == (want[r.event_id].state, want[r.event_id].district, want[r.event_id].reason) for r in said)


def test_evaluations_that_are_all_silent_leave_an_audit_without_advisories(spark):
    rows = evaluations(spark).withColumn("action", F.lit("abstain"))
    part = F.col("part")
    got = streams.audited(rows, [part == 2, part == 0, part == 2, F.lit(True)]).collect()
    assert sorted(r.event_id for r in got) == list(range(60)) and all((r.state, r.district) == (None, None) for r in got)
    assert streams.audited(rows.limit(0), [F.lit(True)]).isEmpty()


def test_an_epoch_that_runs_again_replaces_itself(spark, tmp_path):
    rows = evaluations(spark, 20).drop("part")
    for turn in range(3):
        sinks.record(rows, 5, f"{tmp_path}/t", "event_id", "detected_at")
        assert spark.read.parquet(f"{tmp_path}/t").count() == 20, turn
    sinks.record(rows.unionByName(evaluations(spark, 30).drop("part")), 6, f"{tmp_path}/t", "event_id", "detected_at")
    kept = spark.read.parquet(f"{tmp_path}/t")
    assert kept.count() == 30 and kept.where("epoch = 6").count() == 10


def test_an_advisory_without_an_event_is_not_inserted(spark, tmp_path):
    events = evaluations(spark, 10).drop("part")
    said = events.select("event_id", F.col("detected_at").alias("generated_at"), "action", "reason")
    sinks.advise(said, 0, f"{tmp_path}/advisories", f"{tmp_path}/events", events.schema)  # no table of events yet
    sinks.record(events.where("event_id < 6"), 0, f"{tmp_path}/events", "event_id", "detected_at")
    sinks.advise(said, 1, f"{tmp_path}/advisories", f"{tmp_path}/events", events.schema)
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/advisories").collect()) == list(range(6))


def test_newest_files_in_any_order(spark):
    rnd = random.Random(2)
    files = [(f"s{i % 7}", i, rnd.randint(0, 9)) for i in range(80)]
    want = {}
    for source, file_id, modified in files:
        if source not in want or (-modified, file_id) < (-want[source][1], want[source][0]):
            want[source] = (file_id, modified)
    for seed in range(2):
        rnd.shuffle(files)
        order = {f: rnd.randint(0, 2) for _, f, _ in files}
        rows = spark.createDataFrame([(*f, order[f[1]]) for f in files], "source string, file_id long, modified long, part int")
        start = lambda s, at: sinks.log_changes(sinks.newest_of_source(s.drop("part")), f"{at}/log", f"{at}/c")
        base = streams.fed(rows, [F.col("part") == k for k in (seed, 2 - seed, seed, 1)] + [F.lit(True)], start)
        log = spark.read.parquet(f"{base}/log")
        assert {r.source: (r.file_id, r.modified) for r in sinks.standing(log).collect()} == want
        assert log.where("change = 'delete'").count() == log.where("change = 'insert'").count() - len(want)


def clicks(spark):
    rnd = random.Random(4)
    rows = [(i, T0 + dt.timedelta(minutes=rnd.randint(0, 6000)), i % 4, float(i)) for i in range(150)]
    return rows, spark.createDataFrame([*rows, (-1, dt.datetime(2100, 1, 1), -1, 0.0)], "event_id long, ts timestamp, user_id int, value double")


def appended(make):
    return lambda s, at: make(s).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c")


def test_sessions_of_interleaved_batches(spark):
    rows, frame = clicks(spark)
    want = []
    by_user = defaultdict(list)
    for _, ts, user, value in sorted(rows, key=lambda r: r[1]):
        by_user[user].append((ts, value))
    for user, own in by_user.items():
        start, last, n, total = None, None, 0, 0.0
        for ts, value in own:
            if start is not None and ts > last + dt.timedelta(hours=3):
                want.append((user, start, n, total))
                start, n, total = None, 0, 0.0
            start, last, n, total = start or ts, ts, n + 1, total + value
        want.append((user, start, n, total))
    odd = F.col("event_id") % 2
    base = streams.fed(
        frame, [(odd == 1) & (F.col("user_id") >= 0), odd == 0, F.col("user_id") < 0], appended(lambda s: sinks.sessions(s, ["user_id"], "3 hours", "10 days"))
    )
    got = [tuple(r) for r in spark.read.parquet(f"{base}/out").where("user_id >= 0").collect()]
    assert sorted(got) == sorted(want) and len(want) > 8


def test_late_rows_are_counted_and_their_closed_windows_dropped(spark):
    rows, frame = clicks(spark)
    late = F.col("event_id") % 10 == 0
    slices = [~late & (F.col("user_id") >= 0), late & (F.col("user_id") >= 0), F.col("user_id") < 0]
    mark = max(r[1] for r in rows if r[0] % 10) - dt.timedelta(hours=6)
    base = streams.fed(frame, slices, appended(lambda s: sinks.sliding(s, [], "2 hours", "1 hour", "6 hours")))
    got = {r.start: (r.n, r.total) for r in spark.read.parquet(f"{base}/out").where("start < '2099-01-01'").collect()}
    want = defaultdict(lambda: [0, 0.0])
    for event, ts, _, value in rows:
        hour = ts.replace(minute=0, second=0)
        for start in (hour, hour - dt.timedelta(hours=1)):
            if event % 10 or start + dt.timedelta(hours=2) > mark:
                want[start][0] += 1
                want[start][1] += value
    assert got == {k: tuple(v) for k, v in want.items()}
    base = streams.fed(frame, slices[:2], lambda s, at: sinks.count_late(s, f"{at}/late", f"{at}/c", F.expr("interval 6 hours")))
    counted = {r.epoch: (r.rows, r.late) for r in spark.read.parquet(f"{base}/late").collect()}
    assert counted == {0: (135, 0), 1: (15, sum(r[1] < mark for r in rows if r[0] % 10 == 0))}
