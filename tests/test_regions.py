"""Rules and pages are worked out for the regions and citations asked for, and are the same as among all."""

import pytest
from pyspark.sql import functions as F

from terrapipe.functions.names import fold
from terrapipe.operators import rules as ops
from terrapipe.plans import QUERIES, rules

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


def test_regions_by_their_folded_names(spark):
    known = spark.createDataFrame([(1, "Goa", "North Goa"), (2, "Goa", "South Goa"), (3, "Kerala", "North Goa"), (4, None, "North Goa")], "n int, state string, district string")
    asked = spark.createDataFrame([("GOA", "7north-goa", 1), ("goa", "North Goa", 2), (None, "North Goa", 3)], "state string, district string, k int")
    kept = ops.of_regions(known, asked)
    assert kept.columns == known.columns and [r.n for r in kept.collect()] == [1]


def test_rules_of_regions_are_those_among_all(spark):
    whole = rules.rule_rows(spark, SF)
    asked = whole.where("district in ('Circle 3', 'Nation 1')").select(F.lower("state").alias("state"), F.concat(F.lit("12 "), "district").alias("district"))
    wanted = {(r.s, r.d) for r in asked.select(fold(F.col("state")).alias("s"), fold(F.col("district")).alias("d")).collect()}
    kept = rules.rule_rows(spark, SF, asked)
    plain = lambda name: "".join(c for c in name.lower() if c.isalnum())
    assert rows(kept) == sorted(repr(r) for r in whole.collect() if (plain(r.state), plain(r.district)) in wanted)
    assert kept.count() > 6
    steps = [line for line in planned(rules.rule_rows(spark, SF, asked.localCheckpoint())).splitlines() if "LeftSemi" in line or "Generate explode" in line]
    assert "Generate explode" in steps[0] and "LeftSemi" in steps[1]  # a region is looked up before its rules are made


def test_cited_pages_are_those_among_all(spark):
    """The blank document is cited by rules of many regions, and its text comes from all of them."""
    whole = rules.page_texts(spark, SF).collect()
    cited = [(r.document_id, r.page) for r in whole if r.document_id == " " or r.page % 7 == 0] * 2 + [(None, None), ("none", 1)]
    found = rules.page_texts(spark, SF, spark.createDataFrame(cited, "cite_document string, cite_page int"))
    assert any(d == " " for d, _ in cited)
    assert rows(found) == sorted(repr(r) for r in whole if (r.document_id, r.page) in cited)


@pytest.mark.parametrize("name", ["list_trigger_events", "district_totals", *rules.REQUESTED])
def test_requests_are_made_once(spark, name):
    """The orders behind the requests stand in no plan that is left, so they are read once however often requests are looked at."""
    assert "o_orderdate" not in planned(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["list_trigger_events", "district_totals", "advisories_by_state"])
def test_evaluations_are_made_once(spark, name):
    """What is read twice, or asked for its regions, is a table by then: no page is looked up in the plan that is left."""
    assert "page_text" not in planned(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["rule_first_match", "rule_candidates"])
def test_rules_are_looked_up_by_region(spark, name):
    assert "LeftSemi" in planned(QUERIES[name](spark, SF))
