"""Mix sources to target weights: blocks of words, multinomial counts, permuted indices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, small_batches, written

WEIGHT_CYCLE = (5, 2, 1)
_SLOT_CHUNK = 50_000
_MOST_TASKS = 10_000


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix."""

    block_words: int = 32
    max_repeat: int = 3
    out_shards: int = 64
    group: int = 4_096  # sources whose counts one task draws
    seed: int = 17


def with_targets(sources: DataFrame, max_repeat: int) -> DataFrame:
    """``sources`` (n, weight) with their target: shares of the total by weight, none above ``max_repeat`` times n.

    What the capped ones leave is shared again by weight among the rest until none is above. Each
    round is one aggregate of one row; a source once capped stays so, as the level only rises.
    """
    cap = F.col("n") * max_repeat
    total, weights, capped = sources.agg(F.sum("n"), F.sum("weight"), F.lit(0)).first()
    level, left = 0.0, float(total or 0)
    while weights:
        level = left / weights
        full = cap <= F.lit(level) * F.col("weight")
        taken, weights, now = sources.agg(
            F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if now == capped:
            break
        left, capped = float(total - taken), now
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def draw_counts(blocks: list[int], out_shards: int, seed: int | list[int], wanted: list[int] | None = None) -> np.ndarray:
    """Multinomial counts of each source in each output shard; column sums equal ``blocks``.

    Every shard draws with probabilities in proportion to what remains of each source. Draws
    beyond what remains are drawn again among the others, so the errors of early shards are made
    good by later ones and the totals end exact. ``wanted``: row sums, nearly equal if not given.
    """
    rng = np.random.default_rng(seed)
    remaining = np.array(blocks, np.int64)
    out = np.zeros((out_shards, len(blocks)), np.int64)
    for k in range(out_shards):
        want = int(-(-remaining.sum() // (out_shards - k))) if wanted is None else int(wanted[k])
        while want > 0:
            left = remaining - out[k]
            took = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += took
            want -= int(took.sum())
        remaining -= out[k]
    return out


def permuted(key: np.ndarray, index: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each ``key``, evaluated at ``index``.

    Four Feistel rounds over the least a*a >= size; results outside the range go round again.
    Every step is a bijection, so distinct indices of one key have distinct results.
    """
    side = np.ceil(np.sqrt(size.astype(np.float64))).astype(np.int64)
    side += side * side < size
    out = index.astype(np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        a = side[todo]
        left, right = out[todo] // a, out[todo] % a
        for r in range(4):
            mixed = key[todo].astype(np.uint64) + right.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed += np.uint64((r + 1) * 0xD1B54A32D192ED03 % 2**64)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
            mixed ^= mixed >> np.uint64(31)
            left, right = right, (left + (mixed % a.astype(np.uint64)).astype(np.int64)) % a
        out[todo] = left * a + right
        todo = todo[out[todo] >= size[todo]]
    return out


def _permuted(key: pd.Series, index: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series(permuted(key.to_numpy(), index.to_numpy(), size.to_numpy()))


class MixedDocuments:
    """The plan of one mix over ``docs`` (doc_id, text, source): see ``mix_documents``."""

    def __init__(self, rows: DataFrame, sources: DataFrame, drawn: DataFrame) -> None:
        self.rows = rows  # one row per document: part, tie, doc_id, size, source_size, target
        self.sources = sources
        self.drawn = drawn  # out_shard, slot, source_id, pass, block, part, tie, lo, hi


def _ranked(totals: DataFrame, mix: Mix) -> DataFrame:
    """One row for each source: of, source_id (by code point, null last), source_size, target, n_blocks, wanted."""
    order = F.asc_nulls_last("source")
    ranged = written(
        totals.groupBy("source").agg(F.sum("part_words").alias("n")).repartitionByRange(order).withColumn("at", F.spark_partition_id()),
        "mix-source-ranges",
    )
    before = W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    ahead = ranged.groupBy("at").count().select("at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    own = F.row_number().over(W.partitionBy("at").orderBy(order)) - 1
    named = ranged.withColumn("own", own).join(F.broadcast(ahead), "at").withColumn("source_id", F.col("own") + F.col("ahead"))
    weights = F.array(*map(F.lit, WEIGHT_CYCLE))
    weighed = written(
        named.select("source", "n", "source_id", F.get(weights, F.col("source_id") % len(WEIGHT_CYCLE)).alias("weight")),
        "mix-source-weights",
    )
    n_blocks = F.ceil(F.col("n") / mix.block_words)
    return written(
        with_targets(weighed, mix.max_repeat).select(
            F.col("source").alias("of"), "source_id", F.col("n").alias("source_size"), "target", n_blocks.alias("n_blocks"),
            F.coalesce(F.round(F.try_divide(F.col("target") * n_blocks, F.col("n"))).cast("long"), F.lit(0)).alias("wanted"),
        ),
        "mix-sources",
    )


def _planned(sources: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """Runs of slots: out_shard, source_id, n, first (place in the source), slot0, n_blocks; and the slots in all.

    Counts are drawn in two steps: of each group of sources in every shard, then, in a task for
    each group, of its sources. The driver holds one row for each group.
    """
    grouped = sources.where("wanted > 0").withColumn("group", F.expr(f"source_id div {mix.group}"))
    totals = sorted(map(tuple, grouped.groupBy("group").agg(F.sum("wanted")).collect()))
    counts = draw_counts([n for _, n in totals], mix.out_shards, mix.seed) if totals else np.zeros((mix.out_shards, 0), np.int64)
    across = np.cumsum(counts, axis=1) - counts
    groups = sources.sparkSession.createDataFrame(
        [(g, counts[:, k].tolist(), across[:, k].tolist()) for k, (g, _) in enumerate(totals)],
        "group long, shard_blocks array<long>, shard_slots array<long>",
    )

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source_id")
        shares, slots = np.array(pdf["shard_blocks"].iloc[0]), np.array(pdf["shard_slots"].iloc[0])
        own = draw_counts(pdf["wanted"].tolist(), mix.out_shards, [mix.seed, int(pdf["group"].iloc[0])], shares.tolist())
        shard, at = np.nonzero(own)
        first, before = np.cumsum(own, axis=0) - own, np.cumsum(own, axis=1) - own
        return pd.DataFrame(
            {
                "out_shard": shard,
                "source_id": pdf["source_id"].to_numpy()[at],
                "n": own[shard, at],
                "first": first[shard, at],
                "slot0": slots[shard] + before[shard, at],
                "n_blocks": pdf["n_blocks"].to_numpy()[at],
            }
        )

    plan = grouped.join(groups, "group").groupBy("group").applyInPandas(
        draw, "out_shard int, source_id long, n long, first long, slot0 long, n_blocks long"
    )
    return plan, sum(n for _, n in totals)


def mix_documents(docs: DataFrame, mix: Mix | None = None, row_id: str | None = None) -> MixedDocuments:
    """Mix the words of ``docs`` so that each source holds its target share.

    Sources, by code point and null last, weigh 5, 2, 1 and so on in turn. The words of a source,
    its documents in order of doc_id, are packed into as many blocks as ``block_words`` asks for, all of
    one size but for a word, so every source ends within half a block of its target; each output shard
    draws multinomial source counts; the n-th slot of a source reads the block at the n-th place
    of a pseudorandom permutation of its blocks, a new permutation in every pass. Slots and blocks
    meet in a join on (source, block). A block is read at most once in a pass, and no source has
    more than ``max_repeat`` passes, so no document is taken more often than that.

    Skew: offsets inside a source come from totals of range partitions of (source, doc_id), so a
    source may hold any part of the rows, and there may be any number of sources. The driver gets
    one row for each group of ``group`` sources.
    Defined cases: null and empty texts have size 0 and nothing of them is taken; a source without
    words has the target 0; an empty table gives no rows; equal rows are separate documents, and
    documents with one doc_id stand in order of their texts' hash, so the layout of the input
    plays no part; other columns are ignored. The seed fixes the result. ``row_id`` names a column
    that is unique to each row, where the caller has one.
    """
    mix = mix or Mix()
    narrow = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("mark"),
        (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("tie"),
    )
    place = ("doc_id", "mark", "tie")
    # Range partitioning reads its input twice: let that be these narrow rows, not the texts.
    narrow = written(narrow, "mix-rows")
    ranged = written(
        narrow.repartitionByRange("source", *place).withColumn("part", F.spark_partition_id()), "mix-ranges"
    )
    totals = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_words"))
    sources = _ranked(totals, mix)
    plan, n_slots = _planned(sources, mix)

    # Long runs are cut, and dealt out by number: the rows of the plan say nothing of what they become.
    tasks = min(_MOST_TASKS, max(1, -(-n_slots // _SLOT_CHUNK)))
    chunks = plan.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {_SLOT_CHUNK}L)"))).repartition(
        tasks, "out_shard", "source_id", "at"
    )
    permute = F.pandas_udf(_permuted, "long")
    slots = (
        chunks.withColumn("j", F.explode(F.expr(f"sequence(at, least(at + {_SLOT_CHUNK}, n) - 1)")))
        .withColumn("place", F.col("first") + F.col("j"))
        .withColumn("pass", F.expr("place div n_blocks"))
        .withColumn(
            "block",
            permute(
                F.xxhash64(F.lit(mix.seed), "source_id", "pass"), F.expr("place % n_blocks"), F.col("n_blocks")
            ),
        )
        .select("out_shard", (F.col("slot0") + F.col("j")).alias("slot"), "source_id", "pass", "block")
    )

    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "source", "part", F.coalesce(F.sum("part_words").over(before), F.lit(0)).alias("words_before")
    )
    upto = W.partitionBy("part", "source").orderBy(*place).rowsBetween(W.unboundedPreceding, 0)
    known = offsets.join(sources, F.col("source").eqNullSafe(F.col("of"))).select(
        "of", F.col("part").alias("at_part"), "words_before", "source_id", "source_size", "n_blocks"
    )
    placed = (
        ranged.withColumn("to", F.sum("size").over(upto))
        .join(known, (F.col("part") == F.col("at_part")) & F.col("source").eqNullSafe(F.col("of")))
        .where(F.col("size") > 0)
        .withColumn("start", F.col("words_before") + F.col("to") - F.col("size"))
    )
    # The blocks of a source are even: the first ``more`` of them hold a word more than the others.
    block = lambda w: f"if({w} < more * (base + 1), {w} div (base + 1), more + ({w} - more * (base + 1)) div base)"
    begin = lambda k: f"({k}) * base + least({k}, more)"
    pieces = (
        placed.withColumns({"base": F.expr("source_size div n_blocks"), "more": F.expr("source_size % n_blocks")})
        .withColumn("block", F.explode(F.expr(f"sequence({block('start')}, {block('(start + size - 1)')})")))
        .select(
            "part", "tie", "doc_id", "source_id", "block",
            F.greatest(F.expr(begin("block")) - F.col("start"), F.lit(0)).alias("lo"),
            F.least(F.expr(begin("block + 1")) - F.col("start"), F.col("size")).alias("hi"),
        )
    )
    # The slots come from a few plan rows, so their size is underrated: both sides are to be shuffled.
    drawn = slots.hint("merge").join(pieces.hint("merge"), ["source_id", "block"])
    rows = ranged.join(sources, F.col("source").eqNullSafe(F.col("of"))).select(
        "part", "tie", "doc_id", "size", "source_size", "target"
    )
    return MixedDocuments(rows, sources, drawn)


def words_taken(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words in the mix, repeats counted)."""
    mixed = mix_documents(docs, mix)
    taken = mixed.drawn.groupBy("part", "tie").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return mixed.rows.join(taken.hint("merge"), ["part", "tie"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_texts(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The mix as documents: one row for each document and pass, with the words taken in it.

    A document of which a pass takes every word keeps its text as it is; otherwise the words taken
    are joined by blanks. All columns of ``docs`` (doc_id, text, lang, source, n_chars, ...) are
    kept, whatever their names; n_chars counts the characters of the new text. Documents without
    words are not in a mix: null and empty texts go. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    columns = docs.columns
    numbered = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-docs")
    mixed = mix_documents(
        numbered.select(*[F.col("doc")[c].alias(c) for c in ("doc_id", "text", "source")], F.col("row").alias("row_of_mix")),
        mix,
        row_id="row_of_mix",
    )
    pieces = mixed.drawn.groupBy(F.col("tie").alias("of_row"), "pass").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("pieces"),
        F.sum(F.col("hi") - F.col("lo")).alias("taken"),
    )
    sized = pieces.hint("merge").join(
        mixed.rows.select(F.col("tie").alias("tie_"), "size"), F.col("of_row") == F.col("tie_")
    ).select("of_row", F.when(F.col("taken") < F.col("size"), F.col("pieces")).alias("pieces"))

    def cut(text: pd.Series, pieces: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(text, pieces, strict=True):
            if p is not None:
                words = t.encode("utf-8", "surrogatepass").split()
                t = b" ".join(b" ".join(words[x["lo"] : x["hi"]]) for x in p).decode("utf-8", "surrogatepass")
            out.append(t)
        return pd.Series(out, dtype=object)

    text = F.pandas_udf(cut, "string")(F.col("doc.text"), F.col("pieces"))
    found = numbered.join(sized.hint("merge"), F.col("row") == F.col("of_row")).withColumn("new_text", text)
    out = {c: F.col("doc")[c] for c in columns} | {"text": F.col("new_text")}
    if "n_chars" in columns:
        out["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[out[c].alias(c) for c in columns])
