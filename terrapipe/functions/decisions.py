"""Cost-loss decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import HYSTERESIS_CYCLES, SEED_SAFETY

ABSTAIN, SOW, WAIT, RE_SOW = "abstain", "sow", "wait", "re_sow"


def optimal_threshold(alpha: float) -> float:
    """Act beyond the cost-loss ratio itself."""
    if not 0 < alpha < 1:
        raise ValueError("a cost-loss ratio lies between 0 and 1")
    return alpha


def decide(p: Column, alpha: float, sown: Column, days_since_sowing: Column) -> Column:
    """struct(action, probability, threshold, reason). A probability outside [0, 1] abstains."""
    threshold = optimal_threshold(alpha)
    usable = p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)
    over = p > threshold
    action = (
        F.when(~usable | p.isNull(), ABSTAIN)
        .when(over, F.when(sown, RE_SOW).otherwise(WAIT))
        .otherwise(F.when(sown, ABSTAIN).otherwise(SOW))
    )
    shown = F.format_string("%.3f", p)
    cut = f"{threshold:.3f}"
    reason = (
        F.when(~usable | p.isNull(), F.concat(F.lit("probability "), F.coalesce(p.cast("string"), F.lit("null")), F.lit(" outside [0, 1]")))
        .when(~over, F.concat(F.lit("p="), shown, F.lit(f" at or below threshold {cut}; no contingency action indicated")))
        .when(
            sown,
            F.concat(
                F.lit("p="), shown, F.lit(f" exceeds threshold {cut} with crop sown "),
                F.coalesce(days_since_sowing.cast("string"), F.lit("None")), F.lit(" days ago"),
            ),
        )
        .otherwise(F.concat(F.lit("p="), shown, F.lit(f" exceeds threshold {cut} before sowing")))
    )
    return F.struct(
        action.alias("action"),
        p.alias("probability"),
        F.when(usable, F.lit(threshold)).otherwise(F.lit(float("nan"))).alias("threshold"),
        reason.alias("reason"),
    )


def hysteresis(decisions: DataFrame, key: str, order: str, cycles: int = HYSTERESIS_CYCLES) -> DataFrame:
    """``stable``: the action in force after each decision (key, order, action, ...).

    A new action takes over once it was decided ``cycles`` times in a row; until then the one
    before holds. A run of equal actions of that length takes over from its ``cycles``-th decision
    on, whatever held before it, so the action in force is that of the last such decision: two
    windows over the rows of a key, and no state.

    ``cycle``: of a decision that is held, how often its action was seen in a row; null elsewhere.
    Where there is a column ``reason``, a held one says so at its end.
    """
    w = W.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    changes = F.sum(F.coalesce((F.col("action") != F.lag("action").over(w)).cast("int"), F.lit(0))).over(upto)
    out = decisions.withColumn("run_", changes)
    nth = F.row_number().over(W.partitionBy(key, "run_").orderBy(order))
    first = F.first("action").over(upto)
    firm = F.when(F.col("nth_") >= cycles, F.col("action"))
    out = out.withColumn("nth_", nth)
    out = out.withColumn("stable", F.coalesce(F.last(firm, ignorenulls=True).over(upto), first))
    held = F.col("stable") != F.col("action")
    out = out.withColumns({"held": held, "cycle": F.when(held, F.col("nth_"))})
    if "reason" in out.columns:
        note = F.concat(
            F.lit(" [held at "), F.col("stable"), F.lit(": "), F.col("action"), F.lit(" seen "),
            F.col("cycle").cast("string"), F.lit(f"/{cycles} cycles]"),
        )
        out = out.withColumn("reason", F.when(held, F.concat(F.col("reason"), note)).otherwise(F.col("reason")))
    return out.drop("run_", "nth_")


def days_since_sowing(as_of: Column, month: int, day: int) -> Column:
    """From the anchor of the same year; 29 February is taken as the 28th."""
    if (month, day) == (2, 29):
        day = 28
    return F.datediff(as_of, F.make_date(F.year(as_of), F.lit(month), F.lit(day)))


def seed_demand(hectares: Column, p: Column, rate: Column, safety: float = SEED_SAFETY) -> Column:
    """Quintals of seed; a rate that is not positive is an error."""
    checked = F.when(rate <= 0, F.raise_error(F.lit("the seed rate must be positive")).cast("double")).otherwise(rate)
    return hectares * p * checked * safety / 100
