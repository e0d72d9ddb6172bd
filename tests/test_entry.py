"""The driver's contract at the smallest scale, and that queries equal their SQL twins."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHEAP = (
    "review_latest", "review_queue", "rule_violations", "rules_envelope", "run_totals",
    "panel_season_window", "pentad_climatology", "panel_interpolate_temp", "soil_bucket", "features_all", "et0_hargreaves",
    "dry_run_length", "labels_L14", "panel_report", "coverage_totals", "can_approve", "hysteresis", "chunk_lines", "upsert_latest",
    "district_resolve", "table_regions", "column_bands", "header_labels", "assembled_rows", "rows_by_condition", "rule_citation",
)


def test_names_agree():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) >= 80


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHEAP)
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
