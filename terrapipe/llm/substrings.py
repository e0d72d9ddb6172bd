"""Substring dedup: passages of many words that stand in a document with a smaller id are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .sieve import Tokens, mixed, passes, raw, sieve

_TWICE, _USED = 0x5851F42D4C957F2D, 0x14057B7EF767814F  # keys of blocks in two documents, and of probed ones


@dataclass(frozen=True)
class Repeats:
    """Parameters of the removal."""

    window: int = 50  # words of a repeat, at least
    sieve_bytes: int = 64 << 20  # most that is broadcast of the index of blocks
    words: int = 500_000  # of the documents that a task works on at a time
    vocabulary: int = 1_000_000  # distinct words known to a task before it starts anew

    @property
    def block(self) -> int:
        """Words of a reference block: each window holds a whole one, wherever it starts."""
        return (self.window + 1) // 2


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _uid(doc_id: int, digest: bytes) -> int:
    """64 bits that stand for (doc_id, words): rows that agree in both get the same result."""
    return xxhash.xxh3_64_intdigest(digest, doc_id & 0xFFFFFFFFFFFFFFFF)


def _signed(uids: list[int]) -> pa.Array:
    return pa.array(np.array(uids, np.uint64).view(np.int64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, digests, uids = batch.column("doc_id"), [], [], []
        for doc_id, text in zip(ids.to_pylist(), raw(batch.column("text")), strict=True):
            words = (text or b"").split()
            sizes.append(len(words))
            digests.append(_digest(words))
            uids.append(_uid(doc_id or 0, digests[-1]))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _signed(uids)],
            names=["doc_id", "n_words", "digest", "uid"],
        )


class _Windows:
    """Rolling polynomial hashes of the runs of words of several documents, one after another."""

    def __init__(self, hashes: np.ndarray, lengths: list[int]) -> None:
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(lengths)), self.lengths)
        self.pos = np.arange(len(hashes)) - self.starts[self.doc]
        self.hashes = hashes

    def whole(self, k: int) -> np.ndarray:
        """Where runs of ``k`` words start that end in the same document."""
        return np.flatnonzero(self.pos + k <= self.lengths[self.doc])

    def rolled(self, k: int, salt: int = 0) -> np.ndarray:
        """The hash of the run of ``k`` words at each place: the sums so far, k apart, times a power."""
        n = len(self.hashes)
        with np.errstate(over="ignore"):
            base = np.uint64(0xD1342543DE82EF95 + 8 * salt)  # odd, so that it has an inverse
            x, inverse = int(base), 1
            for _ in range(6):  # Newton's steps double the bits that are right
                inverse = inverse * (2 - x * inverse) % (1 << 64)
            down = np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), np.uint64(inverse))])
            up = np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base)])
            sums = np.r_[np.uint64(0), np.cumsum(mixed(self.hashes, salt) * down[:n])]
            ends = np.minimum(np.arange(n) + k, n)
            return mixed((sums[ends] - sums[:n]) * up[:n], salt)


def _worked(
    batches: Iterator[pa.RecordBatch], first: np.ndarray, how: Repeats, work: Callable[[_Windows, list, list], pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """``work`` on stretches of documents of ``window`` words at least that pass the sieve of first copies."""
    tokens = Tokens()
    ids: list[np.ndarray] = []
    docs: list[int] = []
    uids: list[int] = []
    size = 0

    def done() -> pa.RecordBatch:
        return work(_Windows(tokens.hashes()[np.concatenate(ids)], [len(x) for x in ids]), docs, uids)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), strict=True):
            words = text.split()
            if len(words) < how.window:
                continue
            uid = _uid(doc_id, _digest(words))
            if passes(first, mixed(np.array([uid], np.uint64))).all():
                ids.append(tokens.ids(words))
                docs.append(doc_id)
                uids.append(uid)
                size += len(words)
                if size >= how.words:
                    yield done()
                    ids, docs, uids, size = [], [], [], 0
                    if len(tokens.names) > how.vocabulary:
                        tokens = Tokens()
    if ids:
        yield done()


def _keys(keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])


def _blocks(seen: _Windows, how: Repeats) -> pa.RecordBatch:
    """The hashes of the reference blocks, once for each document."""
    at = seen.whole(how.block)
    at = at[seen.pos[at] % how.block == 0]
    keys, doc = seen.rolled(how.block)[at], seen.doc[at]
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    return _keys(keys[np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]])


def _hits(seen: _Windows, bits: np.ndarray, how: Repeats, used: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where rolling windows of a block's length may hit a block of another document, and their hashes.

    A reference block itself counts where two documents have it as a block; with ``used``, also
    where it was probed by a window elsewhere.
    """
    at = seen.whole(how.block)
    keys = seen.rolled(how.block)[at]
    own = seen.pos[at] % how.block == 0
    hit = passes(bits, keys) & ~own
    hit[own] = passes(bits, keys[own] ^ np.uint64(_TWICE))
    if used:
        hit[own] |= passes(bits, keys[own] ^ np.uint64(_USED))
    else:
        hit &= ~own
    return at[hit], keys[hit]


def _candidates(seen: _Windows, docs: list, uids: list, bits: np.ndarray, how: Repeats) -> pa.RecordBatch:
    """The hits extended: every window around one, by a digest of 128 bits."""
    marks = np.zeros(len(seen.hashes) + 1, np.int64)
    marks[_hits(seen, bits, how, True)[0] + 1] = 1
    sums = np.cumsum(marks)
    at = seen.whole(how.window)
    at = at[sums[at + how.window - how.block + 1] > sums[at]]
    doc = seen.doc[at]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(seen.rolled(how.window, 1)[at].view(np.int64)),
            pa.array(seen.rolled(how.window, 2)[at].view(np.int64)),
            pa.array(np.array(docs, np.int64)[doc]),
            pa.array(np.array(uids, np.uint64).view(np.int64)[doc]),
            pa.array(seen.pos[at].astype(np.int32)),
        ],
        names=["high", "low", "doc_id", "uid", "at"],
    )


def _affected(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents that may have lost words: uid and text."""
    for batch in batches:
        uids = [_uid(d, _digest(t.split())) for d, t in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), strict=True)]
        keys = np.array(uids, np.uint64)
        keep = pa.array(passes(bits, mixed(keys)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)).filter(keep), batch.column("text").filter(keep)], names=["uid", "text"]
        )


def covered(n: int, runs: list[int], window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts in one of the runs (first, last, first, last, ...)."""
    marks = np.zeros(n + 1, np.int64)
    pairs = np.array(runs, np.int64).reshape(-1, 2)
    np.add.at(marks, pairs[:, 0], 1)
    np.add.at(marks, np.minimum(pairs[:, 1] + window, n), -1)
    return np.cumsum(marks[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch], how: Repeats) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lost, kept = [], [], []
        for text, runs in zip(raw(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
            words = text.split()
            gone = covered(len(words), [x for run in runs for x in (run["from"], run["to"])], how.window)
            rest = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            texts.append(b" ".join(rest))
            lost.append(len(words) - len(rest))
            kept.append(hashlib.sha256(texts[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), pa.array(lost, pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["uid", "lost", "kept", "rest"],
        )


def repeats(docs: DataFrame, how: Repeats | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, n_words, digest, uid, first_id: of all copies), and (uid, runs) of the repeats.

    A run holds the first and the last of adjacent window starts, in a document that is no copy, each
    of which stands in a document with a smaller id: extended to both sides as far as that holds.
    """
    how = how or Repeats()
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(texts.mapInArrow(_rows, "doc_id long, n_words long, digest binary, uid long"), "repeat-rows")
    first = rows.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= how.window)).groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    rows = written(rows.join(first, "digest", "left"), "repeat-copies")
    mix = lambda it: (_keys(mixed(b.column("uid").to_numpy().view(np.uint64))) for b in it)
    firsts = spark.sparkContext.broadcast(
        sieve(rows.where("doc_id = first_id").select("uid").mapInArrow(mix, "key long"), how.sieve_bytes)
    )
    whole = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    index = written(
        whole.mapInArrow(lambda it: _worked(it, firsts.value, how, lambda w, d, u: _blocks(w, how)), "key long")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("docs")),
        "repeat-index",
    )
    both = index.select("key").union(index.where("docs > 1").select(F.col("key").bitwiseXOR(_TWICE).alias("key")))
    bits = spark.sparkContext.broadcast(sieve(both, how.sieve_bytes))

    probed = (
        whole.mapInArrow(
            lambda it: _worked(it, firsts.value, how, lambda w, d, u: _keys(np.unique(_hits(w, bits.value, how, False)[1]))), "key long"
        )
        .distinct()
        .join(index.select("key"), "key", "left_semi")
    )
    used = written(probed.select(F.col("key").bitwiseXOR(_USED).alias("key")), "repeat-used")
    bits = spark.sparkContext.broadcast(sieve(both.union(used), how.sieve_bytes))

    found = written(
        whole.mapInArrow(
            lambda it: _worked(it, firsts.value, how, lambda w, d, u: _candidates(w, d, u, bits.value, how)),
            "high long, low long, doc_id long, uid long, at int",
        ),
        "repeat-windows",
    )
    least = found.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # Written, so that the join shuffles both sides anew and Spark can split a digest that very many documents share.
    least = written(least.drop("most"), "repeat-least")
    gone = found.join(least, ["high", "low"]).where("doc_id > least")
    runs = gone.groupBy("uid").agg(F.array_sort(F.collect_set("at")).alias("at")).select("uid", _runs().alias("runs"))
    return rows, written(runs, "repeat-runs")


def removed(docs: DataFrame, how: Repeats | None = None) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and ``kept_text`` where words were removed.

    A word is removed when a window of ``window`` words that covers it also starts, word for word, in
    a document with a smaller doc_id; windows are judged on the input.

    1. Copies of the same words are settled first: all but those with the least id lose every word,
       and take no further part, as what they hold stands in the one that stays.
    2. Index: non-overlapping reference blocks of half a window; each window holds one of them whole.
    3. Probe: every rolling window of a block's length, first against a sieve of the index of bounded
       size, which lets through all hits and, once it is overfull, more than these.
    4. Extend: all windows around a hit are looked up by their digest of 128 bits; a window that has
       a smaller id goes. Runs of such windows are the maximal repeats. No pairs of documents are made,
       so a passage of many documents costs a row for each of its words and documents.

    Defined cases: null and empty texts have no words, the digest of '' and lose nothing; texts of fewer
    words than a window lose nothing; documents without doc_id neither lose words nor count as smaller;
    equal ids never count as smaller, so repeated rows get equal results; very long texts are read
    whole; an empty table gives no rows; other columns are ignored. doc_id is an integer.
    """
    how = how or Repeats()
    spark = docs.sparkSession
    rows, runs = repeats(docs, how)
    mix = lambda it: (_keys(mixed(b.column("uid").to_numpy().view(np.uint64))) for b in it)
    bits = spark.sparkContext.broadcast(sieve(runs.select("uid").mapInArrow(mix, "key long"), how.sieve_bytes))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    cut = (
        texts.mapInArrow(lambda it: _affected(it, bits.value), "uid long, text string")
        .join(runs, "uid")
        .dropDuplicates(["uid"])
        .mapInArrow(lambda it: _cut(it, how), "uid long, lost long, kept string, rest string")
    )
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.join(cut, "uid", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(copy, "").otherwise(F.col("rest")).alias("kept_text"),
    )


def _runs() -> Column:
    """Ascending starts as runs of adjacent ones: the first and the last of each."""
    at = F.col("at")
    firsts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    lasts = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) != x + 1, F.lit(True)))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("from"), b.alias("to")))
