"""Quality rules: counts that reject a text outright, then its distance from language references.

Two passes over the whole texts. The first sums, for each language, the character classes of all
its documents and the counts of all its words; the second measures each document against the
references with the Jensen-Shannon distance.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8
CLASSES = ("lower", "upper", "other_letter", "digit", "space", "sentence", "symbol")

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class DivergenceRule:
    """Thresholds of the verdict. Distances are square roots of base-2 divergences, 0 to 1."""

    max_class_distance: float = 0.30
    max_word_distance: float = 0.45
    min_chars: int = 100  # shorter texts are not measured by character class
    min_words: int = 50  # texts of fewer words are not measured by common words
    common_words: int = 50  # of each language


def _class_table() -> np.ndarray:
    """Class of every code point up to U+FFFF; those above count as letters."""
    out = np.full(0x10000, 2, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if "a" <= ch <= "z":
            out[c] = 0
        elif ch.isupper():
            out[c] = 1
        elif ch.isdigit():
            out[c] = 3
        elif ch.isspace():
            out[c] = 4
        elif ch in ".,;:'\"?-":
            out[c] = 5
        elif not ch.isalpha() and c < 0x2100:
            out[c] = 6
    return out


_TABLE: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_TABLE[0][np.minimum(codes, 0xFFFF)], minlength=len(CLASSES))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur at least twice in the text, the first included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    p = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        two = h[:-1] * p + h[1:]
        p = p * p
        four = two[:-2] * p + two[2:]
        p = p * p
        eight = four[:-4] * p + four[4:]
    order = np.argsort(eight, kind="stable")
    same = eight[order][1:] == eight[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(eight), bool)
    left, right = order[:-1][same], order[1:][same]
    if all(words[i : i + WINDOW] == words[j : j + WINDOW] for i, j in zip(left.tolist(), right.tolist(), strict=True)):
        twice[left] = twice[right] = True
    else:  # two windows have one hash: count the windows themselves
        found = Counter(tuple(words[i : i + WINDOW]) for i in range(len(eight)))
        twice[:] = [found[tuple(words[i : i + WINDOW])] > 1 for i in range(len(eight))]
    at = np.flatnonzero(twice)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def language_references(docs: DataFrame, rule: DivergenceRule) -> dict[str, tuple[np.ndarray, dict[bytes, float]]]:
    """Class shares and common-word shares of each non-null lang, over all its documents.

    Tasks pre-aggregate before the shuffle and hold at most about 200,000 words at a time. What
    reaches the driver is one row for each class and common word of a language.
    """
    small_batches(docs.sparkSession)
    n_classes = len(CLASSES)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes: dict = defaultdict(lambda: np.zeros(n_classes, np.int64))
        words: dict = defaultdict(Counter)

        def flush() -> pd.DataFrame:
            rows = [(k, f"c{i}", int(v)) for k, x in classes.items() for i, v in enumerate(x)]
            rows += [(k, b"w" + w, n) for k, x in words.items() for w, n in x.items()]
            classes.clear()
            words.clear()
            # Undecodable pieces cannot occur: words are cut from valid UTF-8 at ASCII bytes.
            rows = [(k, w.decode("utf-8", "replace") if isinstance(w, bytes) else w, n) for k, w, n in rows]
            return pd.DataFrame(rows, columns=["lang", "item", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                classes[lang] += class_counts(text)
                found = text.lower().encode("utf-8", "surrogatepass").split()
                words[lang].update(found)
                words[lang][b""] += len(found)
                if len(words[lang]) > 200_000:
                    yield flush()
        yield flush()

    counts = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "text")
        .mapInPandas(count, "lang string, item string, n long")
        .groupBy("lang", "item")
        .agg(F.sum("n").alias("n"))
    )
    # The total of words ranks first among the words of a language.
    kind = F.substring("item", 1, 1)
    top = W.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    kept = (
        counts.withColumn("kind", kind)
        .withColumn("rank", F.row_number().over(top))
        .where(F.col("rank") <= max(rule.common_words + 1, n_classes))
    )
    rows = kept.collect()  # one row for each class and common word of a language
    own_rows = defaultdict(dict)
    for r in rows:
        own_rows[r.lang][r["item"]] = r.n
    out: dict = {}
    for lang, own in sorted(own_rows.items()):
        shares = np.array([own.get(f"c{i}", 0) for i in range(n_classes)], float)
        total = own.pop("w", 0)
        words = {k[1:].encode(): n / total for k, n in own.items() if k[0] == "w"} if total else {}
        if shares.sum():
            out[lang] = (shares / shares.sum(), words)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of ``p`` from the vector ``q``, logarithms to base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


class _Judge:
    """Counts and verdicts of texts against the references; sent to the tasks."""

    def __init__(self, refs: dict[str, tuple[np.ndarray, dict[bytes, float]]], rule: DivergenceRule) -> None:
        self.rule = rule
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in refs.values() for w in words}))}
        self.refs = [
            (
                shares,
                np.array([self.vocabulary[w] for w in words], int),
                np.array([*words.values(), max(0.0, 1 - sum(words.values()))]),
            )
            for shares, words in refs.values()
        ]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Counts, base_failed, kept, class distance and word distance (NaN: not measured)."""
        step = max(1, 2_000_000 // (len(self.vocabulary) + 1))  # bounds the table of texts by words
        parts = [self._judged(texts[at : at + step]) for at in range(0, max(1, len(texts)), step)]
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def _judged(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        n, outside, rule = len(texts), len(self.vocabulary), self.rule
        get = self.vocabulary.get
        counts = np.array([base_counts(x) for x in texts], np.int64).reshape(-1, 5)
        classes = np.zeros((n, len(CLASSES)))
        words = np.zeros((n, outside + 1))
        for i, x in enumerate(texts):
            if x:
                classes[i] = class_counts(x)
                found = x.lower().encode("utf-8", "surrogatepass").split()
                words[i] = np.bincount(np.array([get(w, outside) for w in found], int), minlength=outside + 1)
        chars = classes.sum(1)
        by_class, by_word = np.full(n, np.inf), np.full(n, np.inf)
        p = classes / np.maximum(chars, 1)[:, None]
        w = words / np.maximum(words.sum(1), 1)[:, None]
        for shares, at, common in self.refs:
            by_class = np.minimum(by_class, js_distance(p, shares))
            own = w[:, at]
            by_word = np.minimum(by_word, js_distance(np.c_[own, np.maximum(0, 1 - own.sum(1))], common))
        by_class = np.where((chars >= rule.min_chars) & np.isfinite(by_class), by_class, np.nan)
        by_word = np.where((counts[:, 0] >= rule.min_words) & np.isfinite(by_word), by_word, np.nan)
        failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
        far = (by_class > rule.max_class_distance) | (by_word > rule.max_word_distance)
        return counts, failed, ~failed & ~far, by_class, by_word


def quality_rules(docs: DataFrame, rule: DivergenceRule | None = None) -> DataFrame:
    """Base counts and the verdict for every document (doc_id, text, lang).

    A document fails the base rules with fewer than 20 words, or with over 30 % of its words in
    repeated 8-word windows. Beyond these, it is rejected when its character classes, or its
    common words, lie farther from every language reference than the rule allows; texts under the
    minimum lengths are not measured by that part. Its own lang is not used, so a wrong label
    does no harm. Defined cases: null and empty texts have counts of 0 and fail the base rules;
    a table without any non-null lang has no references, and then only the base rules decide;
    repeated rows are judged one by one; an empty table gives no rows; other columns are ignored.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, class_distance and word_distance (null where not measured).
    """
    rule = rule or DivergenceRule()
    judge = _Judge(language_references(docs, rule), rule)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, kept, by_class, by_word = judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(counts[:, k]) for k in range(5)],
                    pa.array(failed),
                    pa.array(kept),
                    *[pa.array(x, mask=np.isnan(x)) for x in (by_class, by_word)],
                ],
                names=[
                    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "class_distance", "word_distance",
                ],
            )

    head = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    return docs.select("doc_id", "text").mapInArrow(
        judged, f"{head}, {COUNTS}, base_failed boolean, kept boolean, class_distance double, word_distance double"
    )


def keep_good(docs: DataFrame, rule: DivergenceRule | None = None) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns as they are.

    Null and empty texts, and all of fewer than 20 words, go; of repeated rows all stay or go; other
    columns may have any name; an empty table gives no rows.
    """
    rule = rule or DivergenceRule()
    judge = _Judge(language_references(docs, rule), rule)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column("text").to_pylist())[2]))

    return docs.mapInArrow(good, docs.schema)
