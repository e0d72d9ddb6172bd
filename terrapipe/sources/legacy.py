"""Rows of older layouts read as of today: fields that have moved out of a JSON payload, or out of another column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Actions, which older advisories hold as their channel.
ACTIONS = ("wait", "sow", "re_sow", "abstain")


def _given(text: Column) -> Column:
    """Null where a text is null or empty."""
    return F.when(text != "", text)


def trigger_events(rows: DataFrame) -> DataFrame:
    """Events (..., reasons, block_key, payload: JSON text) with reasons and block_key taken from the payload where their own columns have none.

    ``reasons`` becomes an array: of its own column, a JSON list as text, then of the payload, then
    empty. ``block_key`` is the own one unless null or empty, then that of the payload, then ''. A key
    that was taken from the payload is left out of ``payload_keys``, the sorted names of what remains there. A
    payload that is no JSON counts as empty.
    """
    body = F.try_parse_json(F.coalesce("payload", F.lit("{}")))
    listed = F.variant_get(F.try_parse_json("reasons"), "$", "array<string>")
    moved = F.try_variant_get("body", "$.reasons", "array<string>")
    own_key = _given(F.col("block_key"))
    taken = F.array_compact(
        F.array(F.when(F.col("reasons").isNull(), F.lit("reasons")), F.when(own_key.isNull(), F.lit("block_key")))
    )
    names = F.coalesce(F.map_keys(F.try_variant_get("body", "$", "map<string, variant>")), F.array().cast("array<string>"))
    return rows.withColumn("body", body).withColumns(
        {
            "reasons": F.coalesce(listed, F.when(F.col("reasons").isNull(), moved), F.array().cast("array<string>")),
            "block_key": F.coalesce(own_key, F.try_variant_get("body", "$.block_key", "string"), F.lit("")),
            "payload_keys": F.array_sort(F.array_except(names, taken)),
        }
    ).drop("body")


def has_key(payload: Column, key: str) -> Column:
    """Whether a JSON text is an object with this key, also where its value is null."""
    names = F.map_keys(F.try_variant_get(F.try_parse_json(payload), "$", "map<string, variant>"))
    return F.coalesce(F.array_contains(names, key), F.lit(False))


def advisories(rows: DataFrame) -> DataFrame:
    """Advisories (..., action, channel): the action from the channel where there is none, and 'abstain' where there is neither.

    A channel that is the name of an action was never one: such rows came by 'api'.
    """
    action = F.coalesce(_given(F.col("action")), F.col("channel"))
    return rows.withColumns(
        {
            "action": F.coalesce(_given(action), F.lit("abstain")),
            "channel": F.when(F.col("channel").isin(*ACTIONS), "api").otherwise(F.col("channel")),
        }
    )
