"""Reports and notes against plain versions of our own."""

import numpy as np
from pyspark.sql import functions as F

from terrapipe.functions import decisions
from terrapipe.operators import textgrid as grid
from terrapipe.operators import verify
from terrapipe.plans import text


def test_held_action_says_so(spark):
    actions = ["sow", "wait", "sow", "wait", "re_sow", "re_sow", "sow", "sow"]
    rows = spark.createDataFrame([(1, i, a, f"r{i}") for i, a in enumerate(actions)], "block_id int, n int, action string, reason string")
    found = decisions.hysteresis(rows, "block_id", "n", 2).orderBy("n").collect()
    assert [r.stable for r in found] == ["sow"] * 5 + ["re_sow"] * 2 + ["sow"]
    assert [r.cycle for r in found] == [None, 1, None, 1, 1, None, 1, None]
    assert found[1].reason == "r1 [held at sow: wait seen 1/2 cycles]" and found[5].reason == "r5"


def test_auc_in_slices_is_the_pairwise_one(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    p[:40] = 0.5  # ties
    rows = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(p, y)] + [("one class", 0.2, 1.0)], "model string, p double, y double")
    found = {r.model: r.auc for r in verify.auc(rows, ("model",)).collect()}
    ones, zeros = p[y == 1], p[y == 0]
    pairs = (ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2
    assert abs(found["m"] - pairs) < 1e-9 and found["one class"] is None
    assert abs(verify.auc(rows.where("model = 'm'")).first().auc - pairs) < 1e-9


def test_intervals_of_each_model(spark):
    days = [(m, f"{2000 + i}-06-{d:02d}", s * (i % 3) / 4, float(d % 2), 0.5) for m, s in (("a", 1), ("b", 0.5)) for i in range(8) for d in range(1, 6)]
    rows = spark.createDataFrame(days, "model string, date string, p double, y double, ref double").withColumn("date", F.to_date("date"))
    found = {r.model: r for r in verify.bootstraps(rows).collect()}
    one = verify.bootstrap(rows.where("model = 'b'")).first()
    assert set(found) == {"a", "b"}
    for r in found.values():
        assert r.brier_low <= r.brier_high and r.skill_low <= r.skill_high
    assert (one.low, one.high) == (found["b"].skill_low, found["b"].skill_high)
    assert verify.bootstraps(rows.limit(0)).count() == 0


def test_pages_of_parts_give_the_rules_of_the_page(spark):
    sf = "/root/testdata/sf0.001"
    names = {f"part{r.p_partkey}": r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    page = spark.createDataFrame([("d", 1, text.PAGE)], "document_id string, page int, text string")
    want = [(r.group_no, r.condition_code, r.fields.crop) for r in grid.extracted(page).collect()]
    assert want
    got = {(r.document_id, r.group_no, r.condition_code, r.crop) for r in text.extract_part_rules(spark, sf).collect()}
    assert got == {
        (d, g, c, crop and " ".join(crop.replace("Pearl millet", n[:12].strip()).split())) for d, n in names.items() for g, c, crop in want
    }


def test_district_report_of_a_few_days(spark):
    from terrapipe.operators import report

    days = [
        ("S", "D", f"2020-06-{d:02}", d % 2, ["dry", None, "wet"][d % 3], "sow" if d == 5 else "abstain", ["r1", "r2"] if d % 2 else ["r2"])
        for d in range(1, 8)
    ] + [("S", "Quiet", "2020-06-01", 0, None, "abstain", [])]
    rows = spark.createDataFrame(days, "state string, district string, as_of string, block_id int, detected string, action string, reasons array<string>")
    rules = spark.createDataFrame([("S", "D", "dry", "approved"), ("S", "D", "unmapped", "approved"), ("S", "D", "wet", "pending")], "state string, district string, condition_code string, status string")
    got = {(r.district, r.part, r.place): r.line for r in report.district_reports(rows, rules).collect()}
    assert got == {
        ("D", 1, 1): "2 rules by condition, 1 approved; 7 days scored, 4 conditions, 1 advisories",
        ("D", 2, 1): "actions: abstain=6, sow=1",
        ("D", 3, 1): "conditions: dry=2, wet=2",
        ("D", 4, 1): "     6  r2",
        ("D", 4, 2): "     3  r1",
        ("D", 5, 1): "2020-06-05  block 1  SOW",
        ("Quiet", 1, 1): "0 rules by condition, 0 approved; 1 days scored, 0 conditions, 0 advisories",
        ("Quiet", 2, 1): "actions: abstain=1",
        ("Quiet", 3, 1): "conditions: none",
    }
