"""Claims about conditions, decisions, policies, names and text tables."""

import pytest
from pyspark.sql import functions as F

from terrapipe.functions import conditions as cond
from terrapipe.functions import decisions as dec
from terrapipe.functions import names, policies
from terrapipe.operators import rules, textgrid
from terrapipe.plans.text import PAGE, part_documents

LINES_PAGE = "\n".join(("Weather aberration | Crop | Suggested action", "Heavy rain at flowering | Cotton | Drain the field", "Cold wave | - | N/A", "plain text"))


def pages(spark):
    rows = [("plan", 9, PAGE.strip()), ("lines", 1, LINES_PAGE), ("lines", 2, "Flood | Paddy"), ("prose", 1, "Nothing here.\nNot a table.")]
    return spark.createDataFrame(rows, "document_id string, page int, text string")


STATE = "as_of string, soil_moisture_fraction double, consecutive_dry_days int, days_since_sowing int, onset_delay_days int, rain_3d_mm double, rain_3d_normal_mm double"


@pytest.mark.parametrize(
    ("given", "code"),
    [
        ({}, None),
        ({"run": 10, "sm": 0.9, "dss": 10}, None),
        ({"run": 17, "sm": 0.2, "dss": 10}, "dry_spell_after_sowing"),
        ({"run": 20, "sm": 0.1}, "mid_season_dry_spell"),
        ({"run": 10, "sm": 0.1, "dss": 10}, "mid_season_dry_spell"),
        ({"run": 25, "sm": 0.1, "dss": 10}, "mid_season_dry_spell"),
        ({"run": 9, "sm": 0.1, "day": "2020-09-20"}, "terminal_drought"),
        ({"delay": 22}, "delayed_onset"),
        ({"delay": 21}, None),
        ({"rain": 50.0, "normal": 0.0}, None),
        ({"rain": 31.0}, "unseasonal_rain"),
        ({"rain": 30.0}, None),
    ],
)
def test_conditions(spark, given, code):
    g = {"day": "2020-07-15", "sm": 0.8, "run": 0, "dss": None, "delay": None, "rain": 10.0, "normal": 10.0} | given
    row = (g["day"], g["sm"], g["run"], g["dss"], g["delay"], g["rain"], g["normal"])
    df = spark.createDataFrame([row], STATE).withColumn("as_of", F.to_date("as_of"))
    assert df.select(cond.detected()).first()[0] == code


def test_phrases(spark):
    cases = {
        "Rains set in on time, then 15-20 days of dry spell after sowing of the crop": "dry_spell_after_sowing",
        "Delay by 4 weeks (Aug 1st week)": "delayed_onset",
        "Mid–season drought": "mid_season_dry_spell",
        "Terminal drought (long dry spell)": "terminal_drought",
        "Hail storm": "unseasonal_rain",
        "Frost": "unmapped",
        "": "unmapped",
        None: "unmapped",
    }
    df = spark.createDataFrame([(x,) for x in cases], "t string")
    got = {r.t: r.c for r in df.select("t", cond.normalized(F.col("t")).alias("c")).collect()}
    assert got == cases
    assert set(cond.PHRASES) == set(cond.CODES)


def decided(spark, p, alpha, sown):
    df = spark.createDataFrame([(p, sown)], "p double, sown boolean")
    return df.select(dec.decide(F.col("p"), alpha, F.col("sown"), F.lit(11)).alias("d")).first().d


def test_decisions(spark):
    assert decided(spark, 0.3, 0.15, False).action == "wait"
    assert decided(spark, 0.3, 0.60, False).action == "sow"
    assert decided(spark, 0.9, 0.3, True).action == "re_sow"
    assert decided(spark, 0.3, 0.3, True).action == "abstain"
    assert decided(spark, float("nan"), 0.3, False).action == "abstain"
    assert decided(spark, None, 0.3, False).action == "abstain"
    with pytest.raises(ValueError):
        dec.optimal_threshold(1.0)


@pytest.mark.parametrize(
    ("given", "want"), [("WSW", "WWW"), ("WSSS", "WWSS"), ("WSRSS", "WWWWS"), ("", ""), ("WSWSS", "WWWWS")]
)
def test_hysteresis(spark, given, want):
    df = spark.createDataFrame([("k", i, a) for i, a in enumerate(given)], "k string, n int, action string")
    got = [r.stable for r in dec.hysteresis(df, "k", "n").orderBy("n").collect()]
    assert "".join(got) == want


def test_seed_rate_must_be_positive(spark):
    df = spark.createDataFrame([(10.0, 0.5, 0.0)], "ha double, p double, rate double")
    with pytest.raises(Exception, match="seed rate"):
        df.select(dec.seed_demand(F.col("ha"), F.col("p"), F.col("rate"))).collect()


def test_citations(spark):
    rows = [("doc", 3, 31), ("doc", 0, 31), (" ", 3, 31), ("doc", 44, 31), ("doc", 44, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "cite_document string, cite_page int, page_count int")
    got = [r[0] for r in df.select(policies.valid_citation(F.col("page_count"))).collect()]
    assert got == [True, False, False, False, True, False]


def test_snippets(spark):
    rows = [
        ("Sow pearlHmillet", "we sow Pearl then the Millet", True),
        ("millet pearl", "pearl millet", False),
        (None, "x", True),
        ("pearl", None, True),
        ("a an it", "none of it", True),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "s string, p string")
    assert [r[0] for r in df.select(policies.on_page(F.col("s"), F.col("p"))).collect()] == [r[2] for r in rows]


def test_folding(spark):
    df = spark.createDataFrame([("  1North Goa",), ("Jammu & Kashmir",), (None,)], "n string")
    assert [r[0] for r in df.select(names.fold(F.col("n"))).collect()] == ["northgoa", "jammukashmir", None]
    assert len(names.STATES) == 36 and len(names.ALIASES) == 7


def test_same_district_name_in_two_states_stays_apart(spark):
    rule = "rule_id int, state string, district string, condition_code string, status string, cite_document string, cite_page int"
    table = spark.createDataFrame(
        [(1, "Bihar", "Aurangabad", "delayed_onset", "approved", "d", 1), (2, "Maharashtra", "Aurangabad", "delayed_onset", "rejected", "d", 1),
         (3, "Maharashtra", "Aurangabad", "unmapped", "approved", "d", 1)], rule,
    )
    asked = spark.createDataFrame([(7, "maharashtra", "AURANGABAD", "delayed_onset")], "k int, state string, district string, detected string")
    assert rules.first_match(asked, table, "k", "rule_id").first().rule.rule_id == 2
    assert rules.first_match(asked, table, "k", "rule_id", approved_only=True).first().rule is None


def test_table_page(spark):
    lines = textgrid.regions(pages(spark))
    cut = textgrid.cells_of(lines, textgrid.bands(lines))
    rows = textgrid.rows_of(cut).orderBy("row_no").collect()
    assert rows[0].cells[0] == "Early season drought"
    assert rows[3].cells[0] == "Terminal drought (early withdrawal)"
    assert not any("Condition" in c for r in rows for c in r.cells)
    codes = [r.code for r in textgrid.merged_by_condition(textgrid.rows_of(cut)).orderBy("group_no").collect()]
    assert codes == ["delayed_onset", "mid_season_dry_spell", "terminal_drought"]


def test_two_columns_are_no_table(spark):
    df = spark.createDataFrame([("d", 1, "Condition\nabc\ndef")], "document_id string, page int, text string")
    assert textgrid.bands(textgrid.regions(df)).count() == 0


def test_line_path_waits_for_a_header(spark):
    text = "Land use | 5 ha\nWeather aberration | Crop\nHeavy rain | Rice"
    df = spark.createDataFrame([("d", 1, text)], "document_id string, page int, text string")
    got = textgrid.extracted(df).collect()
    assert [r.fields.condition for r in got] == ["Heavy rain"] and got[0].condition_code == "unseasonal_rain"


def test_layout_of_a_document_decides_the_path(spark, tmp_path):
    """Sizes 0 to 19 meet every layout; the expected path, rows and crops are written out from the layouts alone."""
    rows = [(k, f"name {k}", "LARGE BRUSHED TIN", k) for k in range(20)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    docs = part_documents(spark, str(tmp_path)).cache()
    assert {(r.document_id, r.page) for r in docs.select("document_id", "page").collect()} == {(f"part{k}", 1) for k in range(20)} | {(f"part{k}", 2) for k in range(0, 20, 5)}
    found = textgrid.extracted(docs).select("document_id", "path", "page", "fields.crop", "fields.action", "condition_code").collect()
    path = {r.document_id: r.path for r in found}
    assert not any(f"part{k}" in path for k in range(1, 20, 5))  # prose
    for k in range(20):
        own = [r for r in found if r.document_id == f"part{k}"]
        if k % 5 == 0:  # the second page has no header of its own, and counts as the document has had one
            assert path[f"part{k}"] == "line" and {r.page for r in own} == {1, 2}
            assert [r.crop for r in own if r.action == "Drain the field"] == [f"name {k}"]
        elif k % 5 >= 2 and k % 4 < 2:
            assert path[f"part{k}"] == "table" and len({r.condition_code for r in own}) >= 3
            assert any(f"name {k}" in (r.crop or "") for r in own) and any("LARGE BRUSHED TIN" in (r.action or "") for r in own)
    docs.unpersist()


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tables_are_read_inside_their_rows(spark):
    """Nothing between a page and its rows is joined or dealt out, so that no task and no driver holds many pages."""
    cut = textgrid.cut(textgrid.columned(textgrid.regions(pages(spark))))
    for df in (textgrid.bands(textgrid.regions(pages(spark))), textgrid.titles(cut), textgrid.rows_of(cut), textgrid.groups_of(cut), textgrid.table_drafts(pages(spark))):
        assert not any(x in planned(df) for x in ("Join", "Aggregate", "Window"))
    assert "strategy=merge" in planned(textgrid.extracted(pages(spark)))


def test_a_condition_is_made_plain_once(spark):
    df = spark.createDataFrame([("Mid-season  drought",)], "t string")
    for f, want in ((cond.normalized, "mid_season_dry_spell"), (cond.deciding_phrase, "mid ?season")):
        found = df.select(f(F.col("t")).alias("x"))
        assert found.first().x == want and planned(found).count("lower(") == 1
