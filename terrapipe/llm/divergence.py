"""Source divergence audit: how far the sources of a language lie apart, and by which terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .sieve import Tokens, mixed, raw, strings

#: Bytes of terms: A to Z lower-cased, a to z, and all of UTF-8 beyond ASCII; all others part terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CELLS = 1 << 16  # of a slice of the sketch


@dataclass(frozen=True)
class Audit:
    """Parameters of the audit."""

    least_docs: int = 10  # documents of a language that a kept term occurs in
    top: int = 10  # terms reported for each group
    rows: int = 4  # of the count-min sketch
    width: int = 1 << 22  # cells of a row: a power of 2, 65,536 at least; rows * width / 8 bytes are broadcast
    tokens: int = 4_000_000  # held by a task before it counts and passes on
    vocabulary: int = 1_000_000  # distinct terms known to a task before it starts anew


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split(b" ")


def _buffers(batches: Iterator[pa.RecordBatch], by: list[str], how: Audit) -> Iterator[tuple[list, Tokens, np.ndarray]]:
    """(groups, tokens, counted) of bounded stretches of documents: columns group, id, n, documents."""
    tokens = Tokens(b"")
    groups: dict[tuple, int] = {}
    ids: list[np.ndarray] = []
    of: list[int] = []
    size = 0

    def counted() -> tuple[list, Tokens, np.ndarray]:
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids)
        doc = np.repeat(np.arange(len(ids)), lengths)[flat > 0]
        code, n = np.unique((doc << 32) | flat[flat > 0], return_counts=True)
        key = (np.array(of, np.int64)[code >> 32] << 32) | (code & 0xFFFFFFFF)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        docs = np.diff(np.r_[starts, len(key)])
        sums = np.add.reduceat(n, starts) if len(key) else n
        return list(groups), tokens, np.vstack([key[starts] >> 32, key[starts] & 0xFFFFFFFF, sums, docs])

    for batch in batches:
        for text, *group in zip(raw(batch.column("text")), *(raw(batch.column(c)) for c in by), strict=True):
            own = tokens.ids(terms(text))
            ids.append(own)
            of.append(groups.setdefault(tuple(group), len(groups)))
            size += len(own) + 1
            if size >= how.tokens:
                yield counted()
                ids, of, groups, size = [], [], {}, 0
                if len(tokens.names) > how.vocabulary:
                    tokens = Tokens(b"")
    if ids:
        yield counted()


def _cells(groups: list[tuple], group: np.ndarray, hashes: np.ndarray, how: Audit) -> Iterator[np.ndarray]:
    """The cell of each (language, term) in each row of the sketch."""
    key = hashes ^ np.fromiter((xxhash.xxh3_64_intdigest(g[0]) for g in groups), np.uint64, len(groups))[group]
    for r in range(how.rows):
        yield (mixed(key, r + 1) & np.uint64(how.width - 1)).astype(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch], how: Audit) -> Iterator[pa.RecordBatch]:
    """(row, slice, cells, counts) of the task's count-min sketch of document frequencies.

    A count stops at ``least_docs``: whether sums reach that is all that is asked of them.
    """
    sketch = np.zeros((how.rows, how.width), np.uint32)
    for groups, tokens, (group, term, _, docs) in _buffers(batches, ["lang"], how):
        for row, cells in zip(sketch, _cells(groups, group, tokens.hashes()[term], how), strict=True):
            np.add.at(row, cells, np.minimum(docs, how.least_docs).astype(np.uint32))
    out: list[tuple] = []
    for r, row in enumerate(sketch):
        for k in range(how.width // _CELLS):
            own = row[k * _CELLS : (k + 1) * _CELLS]
            if len(there := np.flatnonzero(own)):
                counts = np.minimum(own[there], how.least_docs).astype(np.uint32)
                out.append((r, k, there.astype(np.uint16).tobytes(), counts.tobytes()))
    names = ["row", "slice", "cells", "counts"]
    yield pa.RecordBatch.from_pydict(
        dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {c: [] for c in names},
        schema=pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]),
    )


def _merged(batches: Iterator[pa.RecordBatch], how: Audit) -> Iterator[pa.RecordBatch]:
    """(row, slice, bits): which cells of the merged sketch reach ``least_docs``."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for r, k, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("row", "slice", "cells", "counts")), strict=True):
            own = sums.setdefault((r, k), np.zeros(_CELLS, np.int64))
            own[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint32)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([r for r, _ in sums], pa.int32()),
            pa.array([k for _, k in sums], pa.int32()),
            pa.array([np.packbits(x >= how.least_docs).tobytes() for x in sums.values()], pa.binary()),
        ],
        names=["row", "slice", "bits"],
    )


def _survivors(batches: Iterator[pa.RecordBatch], bits: np.ndarray, how: Audit) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the terms whose cells all reach ``least_docs``."""
    for groups, tokens, counted in _buffers(batches, ["lang", "source"], how):
        alive = np.ones(counted.shape[1], bool)
        for r, cells in enumerate(_cells(groups, counted[0], tokens.hashes()[counted[1]], how)):
            alive &= (bits[r, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
        for at in np.array_split(np.flatnonzero(alive), alive.sum() // 100_000 + 1):
            group, term, n, docs = counted[:, at]
            of = [groups[g] for g in group.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    strings([x[0] for x in of]),
                    strings([x[1] for x in of]),
                    strings([tokens.names[i] for i in term.tolist()]),
                    pa.array(n),
                    pa.array(docs),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def possible_terms(texts: DataFrame, how: Audit) -> np.ndarray:
    """One bit for each cell of the merged count-min sketch of (lang, text): ``rows * width / 8`` bytes at the driver."""
    sketch = texts.select("lang", "text").mapInArrow(lambda it: _sketched(it, how), "row int, slice int, cells binary, counts binary")
    merged = sketch.repartition("row", "slice").mapInArrow(lambda it: _merged(it, how), "row int, slice int, bits binary")
    bits = np.zeros((how.rows, how.width // 8), np.uint8)
    for row in merged.toLocalIterator():
        at = row["slice"] * _CELLS // 8
        bits[row["row"], at : at + _CELLS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def divergence(docs: DataFrame, how: Audit | None = None) -> DataFrame:
    """The audit of (text, lang, source): lang, source, part, item, value, rank.

    1. Tasks sketch the document frequency of every (language, term); the merged count-min sketch
       never underestimates, so a term with a cell below ``least_docs`` cannot be kept.
    2. Only the terms that may be kept are counted exactly for each (lang, source) and shuffled; the
       exact document frequency then decides. A small sketch lets more terms pass, and changes no row.
    3. The value of a pair of sources is a sum over all kept terms of their language. Terms that
       neither has add the same each, terms that one has depend on its count alone, so these sums
       come from histograms of counts; only terms that both have are joined.

    Part ``pair``: every other source of the language. Part ``term``: the first ``top`` terms by which
    the group exceeds its language. Decimals of 38 digits and 64-bit numbers hold all values exactly.
    Defined cases: null text, lang and source are read as ''; a group without terms has pairs, and no
    terms; a language without kept terms has pairs of value 0; very long texts are read whole;
    repeated rows count once each; ties end with the item in UTF-8 byte order; an empty table gives
    no rows; other columns are ignored.
    """
    how = how or Audit()
    small_batches(docs.sparkSession)
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    bits = docs.sparkSession.sparkContext.broadcast(possible_terms(texts, how))
    counts = written(
        texts.mapInArrow(lambda it: _survivors(it, bits.value, how), "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "audit-counts",
    )
    kept = (
        counts.groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= how.least_docs)
        .drop("docs")
    )
    cells = written(counts.drop("docs").join(kept, ["lang", "term"]), "audit-cells")
    sizes = cells.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(
        texts.select("lang", "source")
        .distinct()
        .join(own, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .fillna(0, ["total", "v", "lang_total"])
        .withColumn("p0", F.when(F.col("v") > 0, F.expr(_share("0", "total")))),
        "audit-groups",
    )
    cells = written(
        cells.join(groups, ["lang", "source"])
        .withColumns({"p": F.expr(_share("n", "total")), "q": F.expr(_share("lang_n", "lang_total"))})
        .select("lang", "source", "term", "p", "q", "p0"),
        "audit-shares",
    )
    return _pairs(cells, groups).unionByName(_terms(cells, how.top))


def _share(count: str, total: str) -> str:
    """1 + floor(10^9 (count + 2) / (total + 2 v))."""
    return f"1 + (1000000000 * cast({count} + 2 as decimal(38, 0))) div (cast({total} as decimal(38, 0)) + 2 * v)"


def _far(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))


def _terms(cells: DataFrame, top: int) -> DataFrame:
    found = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_far("p", "q")).alias("value"))
    return _ranked(found, "term").where(F.col("rank") <= top)


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The sums over all kept terms for each two sources of a language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    one = (
        cells.groupBy("lang", "source", "p", "p0")
        .agg(F.count(F.lit(1)).alias("terms"))
        .join(other, "lang")
        .where("source <> item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(F.expr(f"terms * ({_far('p', 'q0')} - {_far('p0', 'q0')})")).alias("value"))
    )
    back = one.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), "value")
    right = cells.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = (
        cells.drop("q")
        .join(right, ["lang", "term"])
        .where("source < item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(F.expr(f"{_far('p', 'q')} - {_far('p', 'q0')} - {_far('p0', 'q')} + {_far('p0', 'q0')}")).alias("value"))
    )
    turned = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    neither = (
        groups.select("lang", "source", "p0", "v")
        .join(other, "lang")
        .where("source <> item")
        .select("lang", "source", "item", F.coalesce(F.expr(f"v * ({_far('p0', 'q0')})"), F.lit(0)).alias("value"))
    )
    summed = neither
    for part in (one, back, both, turned):
        summed = summed.unionByName(part)
    return _ranked(summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")
