"""Phrase collocation mining: Apriori level by level, then the weakest cut of every frequent phrase."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .sieve import Tokens, mixed, passes, raw, sieve, strings

#: Only A to Z are lower-cased; ends of pieces become line feeds, tabs become blanks.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_END, _NOTHING = 0, 1  # ids of the end of a piece and of what stands between two blanks


@dataclass(frozen=True)
class Phrases:
    """Parameters of the mining."""

    longest: int = 5  # words of a phrase
    least: int = 100  # occurrences of a candidate
    top: int = 2000  # phrases reported for each language
    tokens: int = 4_000_000  # held by a task before it counts and passes on
    vocabulary: int = 1_000_000  # distinct tokens known to a task before it starts anew
    sieve_bytes: int = 32 << 20  # most that is broadcast of a level


def pieces(text: bytes) -> list[bytes]:
    """The words of a text, with a line feed at every end of a piece and empty tokens between blanks."""
    return text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def gram_hashes(words: np.ndarray, k: int, lang: bytes) -> np.ndarray:
    """A hash of each run of ``k`` word hashes, another one for each language."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
    out = np.full(max(0, len(words) - k + 1), seed)
    for j in range(k):
        out = mixed(out ^ words[j : j + len(out)], j + 1)
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each phrase (lang, phrase), as ``gram_hashes`` has it."""
    for batch in batches:
        out = []
        for lang, phrase in zip(raw(batch.column("lang")), raw(batch.column("phrase")), strict=True):
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, phrase.split(b" ")), np.uint64)
            out.append(gram_hashes(words, len(words), lang))
        flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["key"])


def _counted(ids: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A start and the count of each distinct run of ``k`` ids among the runs at ``starts``: exact, no hashes."""
    code = ids[starts]
    for j in range(1, k):
        if j > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = (code << 32) | ids[starts + j]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return starts[first], n


def _grams(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray | None, how: Phrases) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n): runs of ``k`` words whose two subgrams of ``k - 1`` words both pass the sieve.

    At ``k`` = 1 all words count, and a row without phrase holds their number.
    """
    tokens = Tokens(b"\n", b"")
    held: dict[bytes, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            ids = np.concatenate(parts)
            ids = ids[ids != _NOTHING]
            word = ids != _END
            if k == 1:
                starts = np.flatnonzero(word)
            else:
                short = k - 1
                inside = np.convolve(word, np.ones(short, np.int64))[short - 1 : len(word)] == short
                inside = inside if len(word) >= short else np.zeros(0, bool)
                frequent = inside.copy()
                frequent[inside] = passes(bits, gram_hashes(tokens.hashes()[ids], short, lang)[inside])
                starts = np.flatnonzero(frequent[:-1] & frequent[1:])
            first, n = _counted(ids, starts, k)
            names, rows = tokens.names, ids[first[:, None] + np.arange(k)].tolist()
            phrases = [b" ".join([names[i] for i in row]) for row in rows]
            for at in range(0, len(phrases), 50_000):
                part = phrases[at : at + 50_000]
                yield _table([lang] * len(part), strings(part), n[at : at + 50_000])
            if k == 1:
                yield _table([lang], pa.nulls(1, pa.string()), np.array([len(starts)]))
        held.clear()

    for batch in batches:
        for lang, text in zip(raw(batch.column("lang")), raw(batch.column("text")), strict=True):
            own = tokens.ids([*pieces(text), b"\n"])
            held.setdefault(lang, []).append(own)
            size += len(own)
            if size >= how.tokens:
                yield from flush()
                size = 0
                if len(tokens.names) > how.vocabulary:
                    tokens = Tokens(b"\n", b"")
    yield from flush()


def _runs(batches: Iterator[pa.RecordBatch], bits: np.ndarray, how: Phrases) -> Iterator[pa.RecordBatch]:
    """(lang, text): the runs of three words and more whose pairs of adjacent words all pass the sieve of level 2.

    Every longer phrase with frequent subgrams lies in such a run wherever it occurs, so the levels from
    3 on find the same counts in these texts as in the whole ones. A line feed ends each run.
    """
    tokens = Tokens(b"\n", b"")
    for batch in batches:
        out: tuple[list[bytes], list[bytes]] = [], []
        for lang, text in zip(raw(batch.column("lang")), raw(batch.column("text")), strict=True):
            ids = tokens.ids(pieces(text))
            ids = ids[ids != _NOTHING]
            word = ids != _END
            pair = word[:-1] & word[1:]
            pair[pair] = passes(bits, gram_hashes(tokens.hashes()[ids], 2, lang)[pair])
            chained = pair[:-1] & pair[1:]  # three words from here on
            keep = np.zeros(len(ids), bool)
            for j in range(3):
                keep[j : len(ids) - 2 + j] |= chained
            if keep.any():
                at = np.flatnonzero(keep)
                own = np.insert(ids[at], np.flatnonzero(~pair[at[:-1]] | (np.diff(at) > 1)) + 1, _END)
                out[0].append(lang)
                out[1].append(b" ".join([tokens.names[i] for i in own.tolist()]))
            if len(tokens.names) > how.vocabulary:
                tokens = Tokens(b"\n", b"")
        yield pa.RecordBatch.from_arrays([strings(out[0]), strings(out[1])], names=["lang", "text"])


def _table(lang: list[bytes], phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([strings(lang), phrase, pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])


def levels(docs: DataFrame, how: Phrases) -> tuple[list[DataFrame], DataFrame]:
    """The tables (lang, phrase, f) of frequent phrases of 1, 2, ... words, and (lang, n) of all words.

    Every level is written to the shared folder. It ends early at a level without phrases.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found: list[DataFrame] = []
    totals, bits = None, None
    for k in range(1, how.longest + 1):
        sent = None if bits is None else spark.sparkContext.broadcast(bits)
        counted = (
            texts.mapInArrow(
                lambda it, k=k, sent=sent: _grams(it, k, sent and sent.value, how), "lang string, phrase string, n long"
            )
            .groupBy("lang", "phrase")
            .agg(F.sum("n").alias("f"))
            .where((F.col("f") >= how.least) | F.col("phrase").isNull())
        )
        level = written(counted, f"phrases-{k}")
        if k == 1:
            totals = level.where("phrase is null").select("lang", F.col("f").alias("n"))
            level = level.where("phrase is not null")
        found.append(level)
        if k < how.longest:
            keys = written(level.mapInArrow(_keys, "key long"), f"phrase-keys-{k}")
            if keys.isEmpty():
                break
            bits = sieve(keys, how.sieve_bytes)
        if k == 2 < how.longest - 1:
            sent = spark.sparkContext.broadcast(bits)
            texts = written(texts.mapInArrow(lambda it, sent=sent: _runs(it, sent.value, how), "lang string, text string"), "phrase-runs")
    return found, totals


def _words(phrase: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def phrases(docs: DataFrame, how: Phrases | None = None) -> DataFrame:
    """The collocations of each language (lang, text): lang, rank, phrase, a, l, r, n, score, cut.

    1. Level k counts the runs of k words inside pieces. Hashes of the frequent (k - 1)-grams go to the
       tasks as a sieve of at most ``sieve_bytes``; a run is emitted only when both its overlapping
       subgrams pass. What passes by chance is emitted too and falls to the exact count, so the
       sieve loses nothing and adds nothing. Tasks count by token ids before the shuffle. From level 3
       on, texts are trimmed to the runs in which all pairs of words are frequent: nothing else can count.
    2. Every cut of a frequent phrase is scored from the level tables: floor(1000 a n / (l r)); the
       lowest counts, of equal ones the first.
    3. A phrase inside a longer frequent one that occurs as often is dropped. Such a longer one
       exists if one of just one word more does, as counts never rise with the length.

    Products are decimals of 38 digits: exact up to 10^16 words in a language.
    Defined cases: a null text is empty, a null lang is 'und' (with those that are called so); empty
    texts and texts of separators have no words; very long texts are read whole; repeated rows count
    once each; ties end with the phrase in UTF-8 byte order; no documents or no frequent phrase give
    no rows; other columns are ignored.
    """
    how = how or Phrases()
    found, totals = levels(docs, how)
    parts = found[0]
    for level in found[1:]:
        parts = parts.unionByName(level)
    parts = parts.withColumn("k", F.size(F.split("phrase", " ")))
    candidates = parts.where("k > 1").withColumnRenamed("f", "a")
    inside = (
        candidates.where("k > 2")
        .select(
            "lang",
            "a",
            F.explode(F.array(_words(F.col("phrase"), 1, F.col("k") - 1), _words(F.col("phrase"), 2, F.col("k") - 1))).alias("phrase"),
        )
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(~(F.coalesce("longer", F.lit(0)) >= F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns(
        {
            "first": _words(F.col("phrase"), 1, F.col("cut")),
            "rest": _words(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")),
        }
    )
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = lambda name: f"cast({name} as decimal(38, 0))"
    scored = (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .join(totals, "lang")
        .withColumn("score", F.expr(f"(1000 * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')})"))
    )
    best = (
        scored.groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
        .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "best.cut")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= how.top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut"))
    )
