"""Text reports of emissions, a line a row, for every district at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLACE = ("state", "district")


def _tally(rows: DataFrame, what: str, label: str) -> DataFrame:
    """'label: a=1, b=2' of the values of a column, 'label: none' where all are null."""
    counts = rows.groupBy(*PLACE, what).agg(F.count(F.lit(1)).alias("n"))
    one = F.when(F.col(what).isNotNull(), F.concat(F.col(what), F.lit("="), F.col("n").cast("string")))
    listed = F.array_join(F.array_sort(F.collect_list(one)), ", ")
    line = F.concat(F.lit(f"{label}: "), F.when(listed == "", "none").otherwise(listed))
    return counts.groupBy(*PLACE).agg(line.alias("line"))


def _first(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*PLACE).orderBy(*order))).where(F.col("place") <= most)


def district_reports(emissions: DataFrame, rules: DataFrame, reasons: int = 8, examples: int = 5) -> DataFrame:
    """(state, district, part, place, line) of every district with evaluations (state, district, as_of, block_id, detected, action, reasons).

    Part 1 sums up rules and days, 2 and 3 count actions and conditions, 4 lists the commonest reasons of silence, 5
    the first advisories. Silence has as much room as what was said. Counts of a district are aggregated before the shuffle.
    """
    mapped = F.col("condition_code") != "unmapped"
    known = rules.groupBy(*PLACE).agg(F.count_if(mapped).alias("candidates"), F.count_if(mapped & (F.col("status") == "approved")).alias("approved"))
    days = emissions.groupBy(*PLACE).agg(
        F.count(F.lit(1)).alias("scored"), F.count("detected").alias("detections"), F.count_if(F.col("action") != "abstain").alias("advisories")
    )
    text = F.format_string(
        "%d rules by condition, %d approved; %d days scored, %d conditions, %d advisories",
        F.coalesce("candidates", F.lit(0)), F.coalesce("approved", F.lit(0)), "scored", "detections", "advisories",
    )
    parts = [days.join(known, list(PLACE), "left").select(*PLACE, text.alias("line")), _tally(emissions, "action", "actions"), _tally(emissions, "detected", "conditions")]
    numbered = [p.select(*PLACE, F.lit(k).alias("part"), F.lit(1).alias("place"), "line") for k, p in enumerate(parts, 1)]
    silent = emissions.where("action = 'abstain'").select(*PLACE, F.explode("reasons").alias("reason")).groupBy(*PLACE, "reason").agg(F.count(F.lit(1)).alias("n"))
    why = _first(silent, reasons, F.desc("n"), F.col("reason"))
    said = _first(emissions.where("action <> 'abstain'"), examples, F.col("as_of"), F.col("block_id"))
    numbered.append(why.select(*PLACE, F.lit(4).alias("part"), "place", F.format_string("%6d  %s", "n", "reason").alias("line")))
    numbered.append(
        said.select(
            *PLACE, F.lit(5).alias("part"), "place",
            F.concat_ws("  ", F.col("as_of").cast("string"), F.concat(F.lit("block "), F.col("block_id").cast("string")), F.upper("action")).alias("line"),
        )
    )
    out = numbered[0]
    for part in numbered[1:]:
        out = out.unionByName(part)
    return out
