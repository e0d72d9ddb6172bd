"""Windows over the rows of a block. Frames are always ROWS and always stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_block(order: str = "date") -> WindowSpec:
    return W.partitionBy("block_id").orderBy(order)


def strict(agg: Callable[[Column], Column], col: Column, first: int, last: int) -> Column:
    """``agg`` over the rows ``first``..``last`` around this one; null unless all of them have a value."""
    frame = by_block().rowsBetween(first, last)
    return F.when(F.count(col).over(frame) == last - first + 1, agg(col).over(frame))


def dry_run() -> Column:
    """Length of the dry run that ends at each row, from columns block_id, date, dry and run_id."""
    frame = W.partitionBy("block_id", "run_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return F.sum(F.col("dry").cast("int")).over(frame).cast("int")


def run_id() -> Column:
    """Number of days up to this one that are not dry: constant inside a dry run."""
    frame = by_block().rowsBetween(W.unboundedPreceding, 0)
    return F.sum((~F.col("dry")).cast("int")).over(frame)
