"""Events and advisories of older layouts, made from the events of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import legacy
from ..sources.adapters import read
from .registry import cte, query, sql

#: In turn: all in the payload; in their own columns; an empty key and a broken payload; a null payload.
cte(
    "old_events",
    (),
    """
old_events AS (
  SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN '["' || event_type || '","own"]' END AS reasons,
    CASE event_id % 4 WHEN 1 THEN 'k' || user_id WHEN 2 THEN '' END AS block_key,
    CASE event_id % 4 WHEN 0 THEN '{"reasons":["' || event_type || '"],"block_key":"b' || user_id || '","k":1}'
      WHEN 1 THEN '{"reasons":["kept"],"z":{"a":null}}' WHEN 2 THEN '{"block_key":"from","x":[1,2]}' END AS payload,
    CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'sow' WHEN 2 THEN '' END AS action,
    CASE event_id % 3 WHEN 0 THEN 'wait' WHEN 1 THEN 'sms' END AS channel
  FROM events)""",
)


def old_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 4
    user = F.col("user_id").cast("string")
    first = F.concat(F.lit('{"reasons":["'), F.col("event_type"), F.lit('"],"block_key":"b'), user, F.lit('","k":1}'))
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.when(turn.isin(1, 2), F.concat(F.lit('["'), F.col("event_type"), F.lit('","own"]'))).alias("reasons"),
        F.when(turn == 1, F.concat(F.lit("k"), user)).when(turn == 2, "").alias("block_key"),
        F.when(turn == 0, first).when(turn == 1, '{"reasons":["kept"],"z":{"a":null}}').when(turn == 2, '{"block_key":"from","x":[1,2]}').alias("payload"),
        F.when(turn == 1, "sow").when(turn == 2, "").alias("action"),
        F.when(F.col("event_id") % 3 == 0, "wait").when(F.col("event_id") % 3 == 1, "sms").alias("channel"),
    )


@query(
    "legacy_events",
    sql(
        """SELECT event_id, array_to_string(coalesce(CAST(reasons::JSON AS VARCHAR[]), CAST(payload::JSON->'reasons' AS VARCHAR[]), []), '; ') AS reasons,
      coalesce(nullif(block_key, ''), payload::JSON->>'block_key', '') AS block_key,
      array_to_string(list_sort(list_filter(coalesce(json_keys(payload::JSON), []), lambda k: NOT (k = 'reasons' AND reasons IS NULL)
        AND NOT (k = 'block_key' AND nullif(block_key, '') IS NULL))), ',') AS payload_keys,
      coalesce(list_contains(json_keys(payload::JSON), 'block_key'), FALSE) AS had_key
    FROM old_events""",
        "old_events",
    ),
)
def legacy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = legacy.trigger_events(old_events(spark, sf_dir))
    return found.select(
        "event_id",
        F.array_join("reasons", "; ").alias("reasons"),
        "block_key",
        F.array_join("payload_keys", ",").alias("payload_keys"),
        legacy.has_key(F.col("payload"), "block_key").alias("had_key"),
    )


@query(
    "legacy_advisories",
    sql(
        """SELECT event_id, coalesce(nullif(coalesce(nullif(action, ''), channel), ''), 'abstain') AS action,
      CASE WHEN channel IN ('wait', 'sow', 're_sow', 'abstain') THEN 'api' ELSE channel END AS channel FROM old_events""",
        "old_events",
    ),
)
def legacy_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.advisories(old_events(spark, sf_dir)).select("event_id", "action", "channel")
