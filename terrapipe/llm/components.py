"""Connected components of an edge table: hooking in a new random order each round, and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, name: str = "components", finish: int = 10_000) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b: long); component is its least node.

    Each round orders the nodes by a hash that is drawn anew. Every node hooks to the neighbour
    that comes first in that order, if it comes before the node itself, and then to the node that
    one has hooked to; the edges are replaced by those between what is left. Hooking always goes
    down the order, so there are no cycles, and as the order is random a constant share of the
    nodes goes in each round: a chain takes a logarithmic number of rounds, whatever its ids.

    Neighbours are aggregated before the shuffle, hot ends stand on the long side of joins, which
    can be split, and each round is written to the shared folder. Only the count of what is left
    reaches the driver. No more than ``finish`` edges are settled in one task instead.
    """
    left = written(_pairs(edges.select("a", "b")), f"{name}-edges")
    assigned, turn = None, 0
    while True:
        if last := left.count() <= finish:
            labels = written(left.repartition(1).mapInArrow(_settled, "node long, label long"), f"{name}-labels")
        else:
            labels = _hooked(left, turn, name)
        if assigned is None:
            assigned = labels.select("node", F.col("label").alias("component"))
        else:
            step = labels.withColumnsRenamed({"node": "from", "label": "to"})
            assigned = written(
                assigned.join(step, F.col("component") == F.col("from"), "left").select(
                    "node", F.coalesce("to", "component").alias("component")
                ),
                name,
            )
        if last:
            least = assigned.groupBy("component").agg(F.min("node").alias("least"))
            return assigned.join(least, "component").select("node", F.col("least").alias("component"))
        of_a = labels.withColumnsRenamed({"node": "a", "label": "la"})
        of_b = labels.withColumnsRenamed({"node": "b", "label": "lb"})
        left = written(
            _pairs(left.join(of_a, "a").join(of_b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))),
            f"{name}-edges",
        )
        turn += 1


def _hooked(left: DataFrame, turn: int, name: str) -> DataFrame:
    """(node, label) after one round."""
    rank = lambda c: F.xxhash64(F.lit(turn), c)
    hooked = (
        left.select(F.col("a").alias("node"), F.col("b").alias("near"))
        .unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        .groupBy("node")
        .agg(F.min_by("near", rank("near")).alias("near"))
        .select("node", F.when(rank("near") < rank("node"), F.col("near")).otherwise(F.col("node")).alias("label"))
    )
    hooked = written(hooked, f"{name}-hooked")
    up = hooked.select(F.col("node").alias("up"), F.col("label").alias("above"))
    return written(hooked.join(up, F.col("label") == F.col("up")).select("node", F.col("above").alias("label")), f"{name}-labels")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all ends of a bounded number of edges: the least node that each reaches."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_pydict(
        {"node": list(above), "label": [top(x) for x in above]}, schema=pa.schema([("node", pa.int64()), ("label", pa.int64())])
    )


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
