"""Benchmark decontamination by greedy string tiling (Karp-Rabin matching)."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, utf8_bytes

_TOKEN = re.compile(r"\w+")
_BASE = 0xD1342543DE82EF95  # odd
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Tiling:
    """Parameters: tokens of a seed and of the shortest tile, and the coverage that counts."""

    min_match: int = 4
    coverage: float = 0.5
    block_bytes: int = 8_000_000  # benchmark text that a task holds at once; more goes in blocks


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


class _Rolling:
    """Karp-Rabin hashes of the runs of unmarked tokens of a sequence, of any length at once."""

    def __init__(self, seq: list[int], powers: tuple[np.ndarray, np.ndarray]) -> None:
        self.seq = np.array(seq, np.int64)
        self.free = self.seq >= 0
        self.down, self.up = powers
        with np.errstate(over="ignore"):
            x = (self.seq.astype(np.uint64) + np.uint64(1)) * _MIX
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.sums = np.r_[np.uint64(0), np.cumsum((x ^ (x >> np.uint64(32))) * self.down[: len(x)])]

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the runs of ``length`` unmarked tokens."""
        n = len(self.seq) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        closed = np.r_[0, np.cumsum(~self.free)]
        at = np.flatnonzero(closed[length:] == closed[:n])
        with np.errstate(over="ignore"):
            return at, (self.sums[at + length] - self.sums[at]) * self.up[at]

    def mark(self, at: int, length: int) -> None:
        self.free[at : at + length] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        ones = np.ones(1, np.uint64)
        down = np.cumprod(np.r_[ones, np.full(max(0, n - 1), np.uint64(pow(_BASE, -1, 1 << 64)))])
        return down, np.cumprod(np.r_[ones, np.full(max(0, n - 1), np.uint64(_BASE))])


def greedy_tiles(item: list[int], doc: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, doc position, length): the longest unmarked matches first.

    Negative tokens match nothing. Of equal lengths, the first in the item, then in the document,
    is marked first, so the result is determined. The longest length is found by halving: both
    sequences are hashed by running Karp-Rabin at each length tried, and a match of a length holds
    matches of all shorter ones. So a tile costs a few passes over both sequences, whatever they repeat.
    """
    powers = _powers(max(len(item), len(doc), 1))
    a, b = _Rolling(item, powers), _Rolling(doc, powers)
    tiles: list[tuple[int, int, int]] = []

    def first(length: int) -> tuple[int, int] | None:
        at, own = a.of(length)
        places, others = b.of(length)
        order = np.argsort(others, kind="stable")
        spot = np.searchsorted(others, own, sorter=order)
        hit = np.flatnonzero(spot < len(others))
        hit = hit[others[order[spot[hit]]] == own[hit]]
        for k in hit.tolist():  # the first, unless two hashes agree by chance
            i, d = int(at[k]), int(places[order[spot[k]]])
            if (a.seq[i : i + length] == b.seq[d : d + length]).all():
                return i, d
        return None

    longest = min(len(item), len(doc))
    while longest >= min_match:
        if (found := first(longest)) is None:
            low, high = min_match - 1, longest  # a match of ``low`` is there, or not worth a tile; none of ``high``
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if first(middle) else (low, middle)
            longest = low
            continue
        i, d = found
        a.mark(i, longest)
        b.mark(d, longest)
        tiles.append((i, d, longest))
    return tiles


def _seed_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k ids; 0 where one is unknown (id 0)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for j in range(k):
            x = ids[j : j + n]
            h = (h ^ x) * _MIX
            h ^= h >> np.uint64(29)
            known &= x > 0
    return np.where(known, h | np.uint64(1), np.uint64(0))


def _matcher(items: list[tuple[int, str]], how: Tiling) -> Callable[[str | None], list[tuple]]:
    """A function from a text to (item_id, coverage, matched, item tokens, tiles) of each hit."""
    vocabulary: dict[str, int] = {}
    known = [(item_id, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens(text)]) for item_id, text in items]
    seeds: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for n, (_, ids) in enumerate(known):
        if k := min(how.min_match, len(ids)):
            for h in {int(x) for x in _seed_hashes(np.array(ids, np.uint64), k)}:
                seeds[k][h].append(n)
    sorted_seeds = {k: np.array(sorted(x), np.uint64) for k, x in seeds.items()}
    get = vocabulary.get

    def match(text: str | None) -> list[tuple]:
        ids = np.array([get(w, 0) for w in tokens(text)], np.uint64)
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for k, own in sorted_seeds.items():
            h = _seed_hashes(ids, k)
            if not len(h):
                continue
            place = np.minimum(np.searchsorted(own, h), len(own) - 1)
            at = np.flatnonzero(own[place] == h)
            at = at[np.argsort(h[at], kind="stable")]
            for places in np.split(at, np.flatnonzero(np.diff(h[at])) + 1) if len(at) else ():
                for n in seeds[k][int(h[places[0]])]:
                    found[n].append(places)
        out = []
        for n, of_seeds in sorted(found.items()):
            item_id, item = known[n]
            k = min(how.min_match, len(item))
            at = np.sort(np.concatenate(of_seeds)).tolist()
            if k * len(at) < how.coverage * len(item):  # too few even where no two overlap
                continue
            # Only stretches that hold a seed can match: the rest is cut out of the document.
            doc, where, last = [], [], -1
            for p in at:
                if p > last and doc:
                    doc.append(-1)
                    where.append(-1)
                for q in range(max(p, last), p + k):
                    doc.append(int(ids[q]))
                    where.append(q)
                last = p + k
            tiles = greedy_tiles(item, doc, k)
            matched = sum(x[2] for x in tiles)
            if matched >= how.coverage * len(item):
                spans = [{"item_at": i, "doc_at": where[d], "length": n_} for i, d, n_ in sorted(tiles)]
                out.append((item_id, matched / len(item), matched, len(item), spans))
        return out

    return match


def _blocks(benchmark: DataFrame, how: Tiling) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``block_bytes``, each small enough to send to every task."""
    texts = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    size = texts.agg(F.sum(utf8_bytes(F.col("text")))).first()[0] or 0
    n = -(-size // how.block_bytes)
    for b in range(n):
        block = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted(((r.item_id, r.text) for r in block.collect()), key=lambda x: (x[0] is None, x))


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Tiling | None = None) -> DataFrame:
    """Pairs of documents (doc_id, text) and benchmark items (item_id, text) they give away.

    Texts are compared as lower-case word tokens. Tokens shared in runs of ``min_match`` seed the
    pairs; in each, greedy string tiling marks the longest non-overlapping matches first, found by
    running Karp-Rabin with falling lengths; the pair is returned when the tiles cover at least
    ``coverage`` of the item, in whatever order they stand in the document. One row per pair:
    doc_id, item_id, coverage, matched, item_tokens, tiles (token positions).

    Every document meets each block of the benchmark in its own task, so nothing is shuffled and
    no common passage makes a hot key. A tile costs a few passes over both texts, so very long and
    repetitive ones end as well. Defined cases: null, empty and token-free texts match
    nothing; items of fewer tokens than ``min_match`` match as a whole; repeated rows are returned
    as often as they stand; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    how = how or Tiling()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    arrow_item = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
        f"item_id {item_type}, coverage double, matched int, "
        "item_tokens int, tiles array<struct<item_at: int, doc_at: int, length: int>>"
    )
    arrow_tiles = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())]))
    out = None
    for items in _blocks(benchmark, how):

        def pairs(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            match = _matcher(items, how)
            for batch in batches:
                ids, rows, at = batch.column("doc_id"), [], []
                for n, text in enumerate(batch.column("text")):
                    hits = match(text.as_py())
                    rows += hits
                    at += [n] * len(hits)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at, pa.int64())),
                        pa.array([r[0] for r in rows], arrow_item),
                        pa.array([r[1] for r in rows], pa.float64()),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([r[3] for r in rows], pa.int32()),
                        pa.array([r[4] for r in rows], arrow_tiles),
                    ],
                    names=["doc_id", "item_id", "coverage", "matched", "item_tokens", "tiles"],
                )

        part = docs.select("doc_id", "text").mapInArrow(pairs, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, how: Tiling | None = None) -> DataFrame:
    """``docs`` without the documents that ``contaminated`` returns; all columns stay as they are.

    Null, empty and token-free texts stay; of repeated rows all stay or go; items without tokens
    match nothing; an empty table of items leaves all documents.
    """
    small_batches(docs.sparkSession)
    how = how or Tiling()
    for items in _blocks(benchmark, how):

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            match = _matcher(items, how)
            for batch in batches:
                yield batch.filter(pa.array([not match(x.as_py()) for x in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
