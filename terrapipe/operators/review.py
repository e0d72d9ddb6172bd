"""Review of extracted rules: events folded to the latest state, listings, and rows that break the data rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import policies

#: The closed vocabulary of review.
STATUSES = ("pending", "needs_review", "approved", "rejected")


def drafted(drafts: DataFrame) -> DataFrame:
    """Drafts as rules: the status they start with, and the reasons for a review behind their notes."""
    reasons = F.array_join(policies.review_reasons(), "; ")
    notes = F.concat_ws("; ", F.when(~policies.blank(F.col("notes")), F.col("notes")), F.when(reasons != "", reasons))
    return drafts.withColumns({"status": policies.initial_status(), "notes": notes})


def reviewed(rules: DataFrame, events: DataFrame) -> DataFrame:
    """``rules`` (rule_id, status, ...) after ``events`` (rule_id, at, verb, by, reason), in order of ``at``.

    An approval takes effect only where ``policies.approval_veto`` finds nothing; a rejection always
    does, and leaves 'rejected: <reason>' in the notes. Only review columns change; rules without
    an event stay as they are. One aggregate per rule: partial ones meet before the shuffle, no
    history is gathered beyond the reasons that the notes keep.
    """
    vetoes = rules.select("rule_id", policies.approval_veto().isNull().alias("approvable"))
    counts = (F.col("verb") == "reject") | ((F.col("verb") == "approve") & F.col("approvable"))
    rejected = F.col("verb") == "reject"
    last = (
        events.join(vetoes, "rule_id")
        .where(counts)
        .groupBy("rule_id")
        .agg(
            F.max_by(F.when(rejected, "rejected").otherwise("approved"), "at").alias("new_status"),
            F.max_by("by", "at").alias("reviewed_by"),
            F.sort_array(F.collect_list(F.when(rejected, F.struct("at", "reason")))).alias("rejections"),
        )
    )
    said = F.array_join(F.transform("rejections", lambda x: F.concat(F.lit("rejected: "), x["reason"])), "; ")
    return (
        rules.join(last, "rule_id", "left")
        .withColumns(
            {
                "status": F.coalesce("new_status", "status"),
                "notes": F.concat_ws("; ", F.when(~policies.blank(F.col("notes")), F.col("notes")), F.when(said != "", said)),
            }
        )
        .drop("new_status", "rejections")
    )


def with_total(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of ``rows`` and, on each of its rows, how many there are in all."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def violations(rules: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each of the data rules, 0 included."""
    checks = {
        "status outside the vocabulary": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "approved without a document": (F.col("status") == "approved") & policies.blank(F.col("cite_document")),
        "page below 1": F.col("cite_page") < 1,
        "confidence outside 0 to 1": ~F.col("confidence").between(0, 1),
    }
    counted = rules.agg(*[F.count_if(c).alias(f"n{k}") for k, c in enumerate(checks.values())])
    listed = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"n{k}").alias("n")) for k, name in enumerate(checks)])
    return counted.select(F.explode(listed).alias("x")).select("x.*")


def last_rows(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The last ``k`` rows of each key."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("place_", place).where(F.col("place_") <= k).drop("place_")
