"""Requests of all seasons: whole, with ids of their own, and equal to their SQL."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from terrapipe.plans import rules, weather

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def test_requests_hold_every_day_of_the_panel_once(spark):
    days = weather.season_panel(spark, SF).select("block_id", "date").collect()
    asked = rules.requests(spark, SF).select("block_id", "as_of", "request_id").collect()
    assert len({d.date.year for d in days}) > 1
    assert {(a.block_id, a.as_of) for a in asked} == {(d.block_id, d.date) for d in days}
    assert len({a.request_id for a in asked}) == len(asked) == len(days)


@pytest.mark.parametrize("name", ["emit_advisory", "rule_first_match", "audit_events_all_seasons", "can_emit", "rule_candidates"])
def test_all_seasons_equal_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
