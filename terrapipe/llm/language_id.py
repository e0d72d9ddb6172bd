"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .training import MASK

_RARE = 255  # a letter that is not in an automaton's alphabet
_PHRASES = np.uint32(30)  # the two bits from here up count the phrases that a transition ends
_STATE = np.uint32((1 << 30) - 1)


@dataclass(frozen=True)
class CrossParse:
    """Bounds of the training text, and the length of the pieces that are parsed side by side."""

    max_chars: int = 40_000  # of text in an automaton
    max_rows: int = 400  # labelled documents drawn for a language
    all_chars: int = 400_000  # of text in all automata: beyond 10 languages each gets its share; bounds the tables to 2 * all_chars * (alphabet + 2) * 4 bytes
    alphabet: int = 254  # letters of an automaton, the most frequent; others are one symbol
    piece: int = 1_024
    seed: int = 3


_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case letters; each run of other characters as one 0."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _LETTERS[0][np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        those, at = np.unique(points[high], return_inverse=True)
        known[high] = np.array([chr(c).isalpha() for c in those.tolist()])[at]
    keep = np.ones(len(points), bool)
    keep[1:] = known[1:] | known[:-1]
    return np.where(known, points, np.uint32(0))[keep]


class Alphabet:
    """Numbers 1 to 254 for the most frequent letters of a language, 0 for what separates them."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.table = np.full(0x10000, _RARE, np.uint8)
        self.table[0] = 0
        low = points < 0x10000
        self.numbers = np.arange(1, len(points) + 1, dtype=np.uint8)
        self.table[points[low]] = self.numbers[low]
        self.high = dict(zip(points[~low].tolist(), self.numbers[~low].tolist(), strict=True))

    @classmethod
    def of(cls, found: np.ndarray, most: int) -> Alphabet:
        points, n = np.unique(found[found > 0], return_counts=True)
        return cls(np.sort(points[np.lexsort((points, -n))[:most]]))

    def __call__(self, found: np.ndarray) -> np.ndarray:
        out = self.table[np.minimum(found, 0xFFFF)]
        high = found > 0xFFFF
        if high.any():
            those, at = np.unique(found[high], return_inverse=True)
            out[high] = np.array([self.high.get(c, _RARE) for c in those.tolist()], np.uint8)[at]
        return out


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton of all substrings of ``text``; state 0 is the start."""
    goes: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for c in text:
        new = len(goes)
        goes.append({})
        link.append(0)
        depth.append(depth[last] + 1)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = new
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            if depth[q] == depth[p] + 1:
                link[new] = q
            else:
                split = len(goes)
                goes.append(dict(goes[q]))
                link.append(link[q])
                depth.append(depth[p] + 1)
                link[q] = link[new] = split
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = split
                    p = link[p]
        last = new
    return goes


def dense(states: int, edges: np.ndarray, width: int) -> np.ndarray:
    """Rows of successors for every state and symbol under ``width``; the last column is any other symbol.

    A symbol that cannot prolong the match ends the phrase and begins the next one at the start:
    its entry is the successor of the start, with a count of 1 in the top bits. A symbol that the
    text does not hold at all is a phrase of its own as well.
    """
    table = np.zeros((states, width), np.uint32)
    table[edges[:, 0], np.minimum(edges[:, 1], width - 1)] = edges[:, 2]
    ends = table == 0
    counts = np.where(ends, 1 + ends[0][None, :], 0).astype(np.uint32)
    table = np.where(ends, table[0][None, :], table) | (counts << _PHRASES)
    table[0] = (table[0] & _STATE) | (ends[0].astype(np.uint32) << _PHRASES)  # no phrase is open there
    return table


def parse(table: np.ndarray, texts: list[np.ndarray], piece: int) -> np.ndarray:
    """Number of phrases of each text: greedy longest matches with the automaton's text.

    Pieces of the texts are parsed side by side, each from the start. What comes next depends on
    the state alone, so where a parse carried over from the piece before reaches the state of the
    fresh one, they are one from there on, and only the phrases up to there have to be corrected.
    A text with a piece in which they never meet is parsed again from end to end.
    """
    width, flat = np.uint32(table.shape[1]), table.ravel()
    lengths = np.array([len(x) for x in texts])
    n_pieces = -(-lengths // piece)
    owner = np.repeat(np.arange(len(texts)), n_pieces)
    out = np.zeros(len(texts), np.int64)
    if not len(owner):
        return out
    first = np.cumsum(n_pieces) - n_pieces
    at = (np.arange(len(owner)) - first[owner]) * piece
    size = np.minimum(lengths[owner] - at, piece)
    laid = np.zeros((size.max(), len(owner)), np.uint8)
    for k, (i, a, n) in enumerate(zip(owner.tolist(), at.tolist(), size.tolist(), strict=True)):
        laid[:n, k] = texts[i][a : a + n]

    order = np.argsort(-size, kind="stable")
    active = len(size) - np.searchsorted(size[order][::-1], np.arange(len(laid)), side="right")
    by_size = laid[:, order]
    state, done = np.zeros(len(order), np.uint32), np.zeros(len(order), np.int64)
    for t, n in enumerate(active):
        step = flat[state[:n] * width + by_size[t, :n]]
        done[:n] += step >> _PHRASES
        state[:n] = step & _STATE
    end = np.zeros_like(state)
    end[order] = state
    np.add.at(out, owner[order], done)

    # Carried over into the pieces after the first, beside a fresh start, until both are in one state.
    now = np.flatnonzero(at > 0)
    carried, fresh = end[now - 1], np.zeros(len(now), np.uint32)
    last = end.copy()
    apart: set[int] = set()
    for t in range(len(laid) + 1):
        differ = carried != fresh
        now, carried, fresh = now[differ], carried[differ], fresh[differ]
        over = size[now] <= t
        if over.any():  # the piece is over: right where it ends the text, else what follows is unknown
            last[now[over]] = carried[over]
            apart.update(owner[k] for k in now[over].tolist() if k + 1 < first[owner[k]] + n_pieces[owner[k]])
            now, carried, fresh = now[~over], carried[~over], fresh[~over]
        if not len(now):
            break
        x = laid[t, now]
        step, plain = flat[carried * width + x], flat[fresh * width + x]
        np.add.at(out, owner[now], (step >> _PHRASES).astype(np.int64) - (plain >> _PHRASES).astype(np.int64))
        carried, fresh = step & _STATE, plain & _STATE
    has = np.flatnonzero(n_pieces)
    out[has] += last[first[has] + n_pieces[has] - 1] > 0  # the open phrase
    for i in apart:
        s, n, rows = 0, 0, table
        for x in texts[i].tolist():
            step = int(rows[s, x])
            n += step >> 30
            s = step & int(_STATE)
        out[i] = n + (s > 0)
    return out


class Automata:
    """The languages and their automata; goes to the tasks as compressed edge lists."""

    def __init__(self, trained: list[tuple[str, int, int, np.ndarray, np.ndarray]]) -> None:
        self.names = [t[0] for t in trained]
        self.sizes = np.array([t[1] for t in trained], float)
        self.alphabets = [Alphabet(t[3]) for t in trained]
        self.tables = [dense(t[2], t[4], len(t[3]) + 2) for t in trained]

    def phrases(self, found: list[np.ndarray], piece: int) -> np.ndarray:
        """Phrases of every text, as ``letters``, under every language."""
        out = np.zeros((len(found), len(self.names)))
        for j, (table, alphabet) in enumerate(zip(self.tables, self.alphabets, strict=True)):
            out[:, j] = parse(table, [np.minimum(alphabet(x), table.shape[1] - 1) for x in found], piece)
        return out


def train(docs: DataFrame, how: CrossParse) -> list[tuple[str, int, int, np.ndarray, np.ndarray]]:
    """(language, training symbols, states, alphabet, edges) of each language.

    For each language about ``max_rows`` documents are drawn by a hash of id and text; repeated
    rows count once. One task for each language takes texts in hash order, the last one in part, up to
    ``max_chars`` symbols and builds the automaton. The driver gets one automaton for each language, ``all_chars`` in all.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count().collect()  # one row for each language
    if not sizes:
        return []
    shares = docs.sparkSession.createDataFrame(
        [(r.lang, MASK if r["count"] <= how.max_rows else int(MASK * (how.max_rows / r["count"]))) for r in sizes],
        "lang_ string, share long",
    )
    drawn = (
        known.select("lang", F.xxhash64(F.lit(how.seed), "doc_id", "text").alias("order"), "text")
        .join(F.broadcast(shares), F.col("lang") == F.col("lang_"))
        .where(F.col("order").bitwiseAND(F.lit(MASK)) <= F.col("share"))
        .select("lang", "order", "text")
        .distinct()
    )
    most = max(1, min(how.max_chars, how.all_chars // len(sizes)))

    def build(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(["order", "text"])
        taken, size = [], 0
        for order, x in dict(zip(pdf["order"], pdf["text"], strict=True)).items():
            own, left = letters(x), most - size - 1
            if left <= 0:
                break
            if own.any():
                if len(own) > left:  # a stretch that the hash of the text chooses
                    at = (order & MASK) % (len(own) - left + 1)
                    own = own[at : at + left]
                taken += [np.zeros(1, np.uint32), own]
                size += len(own) + 1
        text = np.concatenate(taken) if taken else np.zeros(0, np.uint32)
        alphabet = Alphabet.of(text, how.alphabet)
        goes = suffix_automaton(np.minimum(alphabet(text), len(alphabet.points) + 1).tolist())
        edges = np.array([(p, c, q) for p, own in enumerate(goes) for c, q in own.items()], np.int32).reshape(-1, 3)
        packed = io.BytesIO()
        np.savez_compressed(packed, edges=edges, alphabet=alphabet.points)
        return type(pdf)({"lang": [pdf["lang"].iloc[0]], "size": [size], "states": [len(goes)], "packed": [packed.getvalue()]})

    found = drawn.groupBy("lang").applyInPandas(build, "lang string, size long, states long, packed binary").collect()
    return [
        (r.lang, r.size, r.states, (own := np.load(io.BytesIO(r.packed)))["alphabet"], own["edges"])
        for r in sorted(found, key=lambda r: r.lang)
        if r.size
    ]


def languages(docs: DataFrame, how: CrossParse | None = None) -> DataFrame:
    """Predict the language of every document (doc_id, text) from documents with a lang.

    The suffix automaton of a language's training text yields the longest match from any place of
    a new text, so greedy parsing into longest matches needs one pass. The language that needs the
    fewest phrases, each weighed by log2 of its training length and divided by the text's length,
    wins; ties go to the first name. Texts are parsed whole. Held-out documents are never learned
    from. Defined cases: null texts and texts without a letter are 'und' with score 0, as is
    everything when no language is known; letters that a language's training text does not hold
    are phrases of their own; repeated rows are judged one by one; other columns are ignored. The
    score is the softmax of the entropies per symbol.
    Returns doc_id, held_out, lang_pred and score.
    """
    small_batches(docs.sparkSession)
    how = how or CrossParse()
    trained = train(docs, how)
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    cache: list[Automata] = []

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Automata(shared.value))
        own = cache[0]
        names = np.array([*own.names, "und"], dtype=object)
        for batch in batches:
            found = [letters(x or "") for x in batch.column("text").to_pylist()]
            best = np.full(len(found), len(own.names))
            score = np.zeros(len(found))
            if own.names and found:
                n = np.array([len(x) for x in found])
                entropy = own.phrases(found, how.piece) * np.log2(own.sizes + 2) / np.maximum(n, 1)[:, None]
                some = np.array([x.any() for x in found], bool)
                best = np.where(some, entropy.argmin(1), len(own.names))
                gain = np.exp(np.clip((entropy.min(1)[:, None] - entropy) * 8, -50, 0))
                score = np.where(some, 1 / gain.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    head = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    return (
        docs.select("doc_id", "text")
        .mapInArrow(predicted, f"{head}, lang_pred string, score double")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
    )
