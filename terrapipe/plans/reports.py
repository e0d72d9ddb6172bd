"""Reports of districts, listings of events, approvals for demonstration, the quality of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policies
from ..operators import report
from ..operators.review import with_total
from ..storage import written
from . import rules, weather
from .registry import cte, query, r, rounded, sql
from .review import with_pages

cte(
    "placed",
    ("emitted",),
    "placed AS MATERIALIZED (SELECT e.request_id, e.action, e.reasons, q.state, q.district, q.as_of, q.block_id, q.detected FROM emitted e JOIN requests q ON q.request_id = e.request_id)",
)


@query(
    "district_report",
    sql(
        """SELECT state, district, 1 AS part, 1 AS place, format('{} rules by condition, {} approved; {} days scored, {} conditions, {} advisories',
        coalesce(any_value(candidates), 0), coalesce(any_value(approved), 0), count(*), count(detected), count(*) FILTER (action <> 'abstain')) AS line
      FROM placed LEFT JOIN (SELECT state AS s, district AS d, count(*) FILTER (condition_code <> 'unmapped') AS candidates,
        count(*) FILTER (condition_code <> 'unmapped' AND status = 'approved') AS approved FROM rules GROUP BY 1, 2) ON s = state AND d = district GROUP BY 1, 2
    UNION ALL SELECT state, district, 2, 1, 'actions: ' || string_agg(action || '=' || n, ', ' ORDER BY action || '=' || n)
      FROM (SELECT state, district, action, count(*) AS n FROM placed GROUP BY ALL) GROUP BY 1, 2
    UNION ALL SELECT state, district, 3, 1, 'conditions: ' || coalesce(string_agg(detected || '=' || n, ', ' ORDER BY detected || '=' || n), 'none')
      FROM (SELECT state, district, detected, count(*) AS n FROM placed GROUP BY ALL) GROUP BY 1, 2
    UNION ALL SELECT state, district, 4, place::INT, printf('%6d  %s', n, reason) FROM (
      SELECT state, district, reason, count(*) AS n, row_number() OVER (PARTITION BY state, district ORDER BY count(*) DESC, reason) AS place
      FROM (SELECT state, district, unnest(reasons) AS reason FROM placed WHERE action = 'abstain') GROUP BY 1, 2, 3) WHERE place <= 8
    UNION ALL SELECT state, district, 5, place::INT, as_of::DATE || '  block ' || block_id || '  ' || upper(action) FROM (
      SELECT *, row_number() OVER (PARTITION BY state, district ORDER BY as_of, block_id) AS place FROM placed WHERE action <> 'abstain') WHERE place <= 5""",
        "placed",
    ),
)
def district_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.emitted(spark, sf_dir).select("state", "district", F.col("as_of").cast("date").alias("as_of"), "block_id", "detected", "action", "reasons")
    found = written(found, "emissions")
    return report.district_reports(found, rules.rule_rows(spark, sf_dir, found))


@query(
    "list_trigger_events",
    sql("SELECT request_id, state, action, count(*) OVER ()::BIGINT AS total FROM placed WHERE state ILIKE 'europe' ORDER BY as_of DESC, request_id LIMIT 50 OFFSET 100", "placed"),
)
def list_trigger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the audited events of a state, newest first, with their number in all."""
    found = rules.emitted(spark, sf_dir).where(F.lower("state") == "europe").select("request_id", "state", "action", "as_of")
    return with_total(written(found, "audited"), [F.desc("as_of"), F.col("request_id")], 50, 100).drop("as_of")


@query(
    "approved_for_demo",
    sql("SELECT rule_id, state, district, 'approved' AS status, 'simulation' AS reviewed_by FROM vetted WHERE cited_in AND on_page", "vetted"),
)
def approved_for_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that a reviewer who approves all that may be approved would let through, as approved copies."""
    kept = with_pages(spark, sf_dir).where(policies.approval_veto().isNull())
    return kept.select("rule_id", "state", "district", F.lit("approved").alias("status"), F.lit("simulation").alias("reviewed_by"))


@query(
    "panel_quality",
    sql(
        f"""SELECT year(date)::INT AS season, {r('count(*) FILTER (rain_is_imputed) / count(*)::DOUBLE', 'imputed_fraction')},
      CASE WHEN count(*) FILTER (rain_is_imputed) / count(*)::DOUBLE > 0.1::DOUBLE THEN 'provisional' ELSE 'sound' END AS verdict FROM panel GROUP BY 1""",
        "panel",
    ),
)
def panel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of days without rain observed in each season; above a tenth, skill of that season is provisional."""
    share = F.count_if("rain_is_imputed") / F.count(F.lit(1))
    found = weather.season_panel(spark, sf_dir).groupBy(F.year("date").alias("season")).agg(share.alias("imputed_fraction"))
    return rounded(found.withColumn("verdict", F.when(F.col("imputed_fraction") > 0.1, "provisional").otherwise("sound")))
