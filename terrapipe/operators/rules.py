"""Rules: newest of a document, retrieval by region and code, approval, emission, audit, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import policies
from ..functions.conditions import CODES, PROBABILITY_DRIVEN, UNMAPPED
from ..functions.decisions import ABSTAIN, decide
from ..functions.names import fold


def newest(rows: DataFrame, key: str, modified: str, tie: str) -> DataFrame:
    """The newest row of each ``key``; of equal times the least ``tie``."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(modified), tie))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and the rows whose key it does not have yet; of new ones with one key, any one."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the one with the highest ``version`` of each key."""
    both = table.unionByName(rows)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), version).alias("row_")).select("row_.*")


def region_keys() -> dict[str, Column]:
    """The folded keys of a region (state, district)."""
    return {"state_key": fold(F.col("state")), "district_key": fold(F.col("district"))}


def of_regions(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows (state, district, ...) of regions that ``asked`` (state, district, ...) names, by their folded keys.

    To be taken before rows become rules, so that only rules that can be retrieved are worked out. ``asked`` is
    read for its regions alone; a table that is written is read cheaply a second time.
    """
    keys = region_keys()
    regions = asked.select(*[c.alias(k) for k, c in keys.items()]).distinct()
    return rows.withColumns(keys).join(regions, list(keys), "left_semi").drop(*keys)


def indexed(rules: DataFrame) -> DataFrame:
    """Rules that can ever be retrieved, with folded keys."""
    return rules.where(F.col("condition_code").isin(*CODES)).withColumns(region_keys())


def candidates(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests (state, district, detected, ...) with each rule of just that region and code."""
    keyed = indexed(rules).select(
        "state_key", "district_key", F.col("condition_code"), F.struct(*[c for c in rules.columns]).alias("rule")
    )
    asked = requests.withColumns(region_keys())
    return asked.join(keyed.withColumnRenamed("condition_code", "detected"), ["state_key", "district_key", "detected"]).drop(
        "state_key", "district_key"
    )


def first_match(requests: DataFrame, rules: DataFrame, key: str, order: str, approved_only: bool = False) -> DataFrame:
    """Each request with the first rule of its region and code, null where there is none.

    ``approved_only`` leaves out rules that are not eligible before the first is taken; without it
    an unapproved first rule is the match, and silences the request.
    """
    usable = rules.where(policies.eligible()) if approved_only else rules
    found = candidates(requests, usable).groupBy(key).agg(F.min_by("rule", f"rule.{order}").alias("rule"))
    return requests.join(found, key, "left")


def emissions(matched: DataFrame, pages: DataFrame | None, alpha: float, sown: Column) -> DataFrame:
    """The final gate for matched requests (detected, p, days_since_sowing, rule).

    Adds action, reasons, and the decision where one is made. Silence is the default: every
    reason is listed; codes without a probabilistic rule of their own stay silent too.
    """
    fields = ("status", "condition_code", "confidence", "cite_document", "cite_page", "source_text", "page_count")
    flat = matched.withColumn("has_rule", F.col("rule").isNotNull()).withColumns({c: F.col("rule")[c] for c in fields})
    if pages is None:
        flat = flat.withColumn("page_text", F.lit(None).cast("string"))
    else:
        known = pages.select(F.col("document_id").alias("cite_document"), F.col("page").alias("cite_page"), F.col("text").alias("page_text"))
        flat = flat.join(known, ["cite_document", "cite_page"], "left")
    veto = policies.emission_reasons(F.col("detected"), F.col("has_rule"))
    uncovered = F.concat(
        F.lit("condition '"), F.col("detected"), F.lit("' has an approved cited rule, but no probabilistic decision rule covers it yet")
    )
    out = flat.withColumn("veto", veto)
    clear = F.size("veto") == 0
    covered = F.col("detected").isin(*PROBABILITY_DRIVEN)
    decision = decide(F.col("p"), alpha, sown, F.col("days_since_sowing"))
    return (
        out.withColumn("decision", F.when(clear & covered, decision))
        .withColumn("reasons", F.when(clear & ~covered, F.array(uncovered)).otherwise(F.col("veto")))
        .withColumn("action", F.coalesce(F.col("decision.action"), F.lit(ABSTAIN)))
        .drop(*fields, "page_text", "veto", "has_rule")
    )


def coverage(rules: DataFrame) -> DataFrame:
    """One row: rules, approved, unmapped, districts, colliding names, and counts by code and status."""
    code = F.coalesce(F.col("condition_code"), F.lit(UNMAPPED))
    keyed = rules.select(code.alias("code"), "status", fold(F.col("district")).alias("d"), fold(F.col("state")).alias("s"))
    counts = keyed.groupBy("code", "status").agg(F.count(F.lit(1)).alias("n"))  # a handful of rows
    pick = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    by_code = counts.groupBy("code").agg(F.sum("n").alias("n")).agg(pick("code").alias("by_code"))
    by_status = counts.groupBy("status").agg(F.sum("n").alias("n")).agg(pick("status").alias("by_status"))
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rules"),
        F.coalesce(F.sum(F.when(F.col("status") == "approved", F.col("n"))), F.lit(0)).alias("approved"),
        F.coalesce(F.sum(F.when(F.col("code") == UNMAPPED, F.col("n"))), F.lit(0)).alias("unmapped"),
    )
    names = keyed.groupBy("d").agg(F.count_distinct("s").alias("states")).agg(
        F.count(F.lit(1)).alias("districts"), F.count_if(F.col("states") > 1).alias("collisions")
    )
    return totals.crossJoin(names).crossJoin(by_code).crossJoin(by_status)  # single rows


def page_of(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a listing. The order must be total."""
    return rows.orderBy(*order).offset(offset).limit(limit)
