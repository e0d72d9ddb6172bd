"""Toxic spans by a linear-chain conditional random field over hashed word features."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .training import training_sample

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_PREFIXES = (3, 4, 5)


@dataclass(frozen=True)
class Crf:
    """Parameters of the labelling of tokens, the fit and the verdicts."""

    bits: int = 18
    max_rows: int = 6_000  # labelled documents that the model is fitted on
    max_tokens: int = 3_000_000  # and their tokens; documents beyond, in hash order, are left out
    min_contexts: int = 6  # words before a feature in toxic documents, before it can mark a token
    min_share: float = 0.6  # smoothed share of toxic ones among all words before the feature
    chain: int = 512  # tokens of a chain in fitting, and of the pieces that scoring runs side by side
    rounds: int = 60
    rate: float = 0.5
    l2: float = 1e-4
    span: float = 0.5  # marginal from which a token belongs to a span
    threshold: float = 0.3
    seed: int = 13


class Chains:
    """Several token sequences laid out by position, the longest first, for passes over all at once."""

    def __init__(self, lengths: np.ndarray, starts: np.ndarray | None = None) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        sorted_ = lengths[self.order]
        steps = int(sorted_[0]) if len(sorted_) else 0
        # active[t]: how many sequences are longer than t.
        self.active = len(lengths) - np.searchsorted(sorted_[::-1], np.arange(steps), side="right")
        self.offsets = np.r_[0, np.cumsum(self.active)]
        starts = np.cumsum(lengths) - lengths if starts is None else starts
        where = np.empty(int(lengths.sum()), np.int64)
        for t, n in enumerate(self.active):
            where[self.offsets[t] : self.offsets[t] + n] = starts[self.order[:n]] + t
        self.where = where  # place of each laid-out token in the plain concatenation
        lanes = np.arange(int((sorted_ > 0).sum()))
        self.lanes = lanes
        self.last = self.offsets[sorted_[lanes] - 1] + lanes  # laid-out place of each sequence's last token


def forward_backward(
    chains: Chains, e: np.ndarray, trans: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic tag for laid-out tokens.

    With two tags only the ratios of the forward and backward scores matter, and each step maps
    one ratio by (a + b r) / (c + d r), for all sequences at once. ``e``: exp of the emission
    score; ``trans``: exp of the transitions [[OO, OT], [TO, TT]]; ``before``: the forward ratio
    ahead of each sequence, NaN where it begins a text; ``after``: the backward ratio at its last
    token. Also returns both ratios.
    """
    (oo, ot), (to, tt) = trans
    r, s = np.empty_like(e), np.ones_like(e)
    off, active = chains.offsets, chains.active
    if after is not None:
        s[chains.last] = after[chains.order[chains.lanes]]
    for t, n in enumerate(active):
        a = off[t]
        if t:
            q = r[off[t - 1] : off[t - 1] + n]
            r[a : a + n] = e[a : a + n] * (ot + tt * q) / (oo + to * q)
        elif before is None:
            r[:n] = e[:n]
        else:
            q = before[chains.order[:n]]
            r[:n] = np.where(np.isnan(q), e[:n], e[:n] * (ot + tt * q) / (oo + to * q))
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        v = e[off[t + 1] : off[t + 1] + n] * s[off[t + 1] : off[t + 1] + n]
        s[off[t] : off[t] + n] = (to + tt * v) / (oo + ot * v)
    both = r * s
    return both / (1 + both), r, s


def _products(chains: Chains, e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Product over each sequence of the 2 x 2 step matrices, up to scale: columns OO, OT, TO, TT."""
    (oo, ot), (to, tt) = trans
    m = np.zeros((4, len(chains.lanes)))
    m[0] = m[3] = 1
    for t, n in enumerate(chains.active):
        x = e[chains.offsets[t] : chains.offsets[t] + n]
        a, b, c, d = m[:, :n]
        step = np.array([a * oo + b * to, (a * ot + b * tt) * x, c * oo + d * to, (c * ot + d * tt) * x])
        m[:, :n] = step / step.sum(0)
    out = np.empty_like(m)
    out[:, chains.order[chains.lanes]] = m
    return out


def marginals(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, piece: int) -> np.ndarray:
    """Marginals of the toxic tag for concatenated texts, each of them one whole chain.

    Long texts are run in pieces side by side. The steps of a piece multiply to one 2 x 2 matrix;
    the matrices of a text, taken in order, give the ratios at the ends of its pieces, so the
    result is that of the whole chain.
    """
    if not len(e):
        return np.zeros(0)
    n = -(-lengths // piece)
    doc = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(lengths[doc] - nth * piece, piece)
    starts = (np.cumsum(lengths) - lengths)[doc] + nth * piece
    before, after = np.full(len(doc), np.nan), np.ones(len(doc))
    later = np.flatnonzero(nth > 0)
    if len(later):
        sub = Chains(size[later], starts[later])
        m = np.zeros((4, len(doc)))
        m[:, later] = _products(sub, e[sub.where], trans)
        heads = np.flatnonzero((nth == 0) & (n[doc] > 1))
        first = Chains(size[heads], starts[heads])
        r = np.empty(len(doc))
        r[heads[first.order[first.lanes]]] = forward_backward(first, e[first.where], trans)[1][first.last]
        for k in range(1, int(n.max())):
            i = np.flatnonzero(nth == k)
            q = before[i] = r[i - 1]
            r[i] = (m[1, i] + m[3, i] * q) / (m[0, i] + m[2, i] * q)
        for k in range(int(n.max()) - 1, 0, -1):
            i = np.flatnonzero(nth == k)
            q = after[i]
            after[i - 1] = (m[2, i] + m[3, i] * q) / (m[0, i] + m[1, i] * q)
    chains = Chains(size, starts)
    out = np.empty(len(e))
    out[chains.where] = forward_backward(chains, e[chains.where], trans, before, after)[0]
    return out


class Words(dict):
    """Distinct tokens of a task: token -> its number; ``table`` has its feature indices.

    Features are hashes of the lower-case token and of its prefixes of 3, 4 and 5 characters.
    """

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.rows: list[list[int]] = []
        self.made = np.zeros((0, 1 + len(_PREFIXES)), np.int64)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        keys = [f"w{low}", *(f"{n}{low[:n]}" for n in _PREFIXES)]
        self.rows.append([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> (64 - self.bits) for x in keys])
        self[token] = len(self)
        return len(self) - 1

    @property
    def table(self) -> np.ndarray:
        if self.rows:
            self.made = np.concatenate([self.made, np.array(self.rows, np.int64)])
            self.rows = []
        return self.made

    def numbers(self, text: str | None) -> np.ndarray:
        found = _TOKEN.findall(text) if text else []
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


class Model:
    """Weights of the field and of the document score; goes to the tasks as bytes."""

    def __init__(self, words: np.ndarray, before: np.ndarray, after: np.ndarray, bias: float, trans: np.ndarray, score: np.ndarray) -> None:
        self.words, self.before, self.after, self.bias, self.trans, self.score = words, before, after, bias, trans, score

    def emissions(self, n: np.ndarray, table: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """exp of the emission scores of concatenated tokens ``n``; ``first``/``last`` mark the ends."""
        x = (self.words[table].sum(1) + self.bias)[n]
        x[1:] += np.where(first[1:], 0, self.before[table[:, 0]][n[:-1]])
        x[:-1] += np.where(last[:-1], 0, self.after[table[:, 0]][n[1:]])
        return np.exp(np.clip(x, -30, 30))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, words=self.words, before=self.before, after=self.after, bias=self.bias, trans=self.trans, score=self.score)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        return cls(x["words"], x["before"], x["after"], float(x["bias"]), x["trans"], x["score"])

    def documents(self, per: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of documents from the token marginals, in plain order."""
        x = _aggregates(per, lengths) @ self.score
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _aggregates(per: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: 1, log-odds that any token is toxic, log of the expected toxic tokens."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    ends = np.cumsum(lengths)
    some = lengths > 0
    none = np.zeros(len(lengths))
    total = np.zeros(len(lengths))
    if some.any():
        starts = (ends - lengths)[some]
        none[some] = np.add.reduceat(np.log1p(-np.minimum(per, 1 - 1e-9)), starts)
        total[some] = np.add.reduceat(per, starts)
    any_ = np.clip(-np.expm1(none), 1e-6, 1 - 1e-6)
    out[:, 1] = np.log(any_ / (1 - any_))
    out[:, 2] = np.log(total + 1e-3)
    return out


def _ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = int(lengths.sum())
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    ends = np.cumsum(lengths)
    some = lengths > 0
    first[(ends - lengths)[some]] = True
    last[ends[some] - 1] = True
    return first, last


def _marked(n: np.ndarray, table: np.ndarray, toxic: np.ndarray, first: np.ndarray, rate: float, how: Crf) -> np.ndarray:
    """Which tokens have a feature that stands mostly in toxic documents.

    A feature is counted once for each word before it, so that copies of a document, which repeat
    its words in the same places, count once.
    """
    size = 1 << how.bits
    word = table[n, 0]
    before = np.where(first, 0, np.r_[0, word[:-1]] + 1)
    marked = np.zeros(len(n), bool)
    for k in range(table.shape[1]):
        f = table[n, k]
        pairs = np.unique(f * (2 * size) + before)
        bad = np.unique((f * (2 * size) + before)[toxic])
        seen, hit = np.bincount(pairs // (2 * size), minlength=size), np.bincount(bad // (2 * size), minlength=size)
        speaks = (hit >= how.min_contexts) & ((hit + 2 * rate) / (seen + 2) >= how.min_share)
        marked |= speaks[f]
    return marked & toxic


def fit(rows: list[tuple[int, np.ndarray]], table: np.ndarray, how: Crf) -> Model:
    """Fit the field on (label, word numbers) of documents, whole, by AdaGrad on the log-likelihood.

    Labels are of documents; tokens get theirs from them (see ``_marked``). The field then learns
    how far the words, their prefixes and their neighbours speak for a span, and how spans run.
    """
    size = 1 << how.bits
    labels = np.array([y for y, _ in rows], float)
    rate = float(labels.mean()) if rows else 0.0
    lengths = np.array([len(x) for _, x in rows], np.int64)
    n = np.concatenate([x for _, x in rows]) if rows else np.zeros(0, np.int64)
    gold = _marked(n, table, np.repeat(labels, lengths) > 0, _ends(lengths)[0], rate, how) if len(n) else np.zeros(0, bool)
    cut = np.array([min(how.chain, k - at) for k in lengths for at in range(0, k, how.chain)], np.int64)
    first, last = _ends(cut)
    chains = Chains(cut)
    model = Model(*(np.zeros(size) for _ in range(3)), -3.0, np.ones((2, 2)), np.array([0.0, 1.0, 0.0]))
    if gold.any():
        _ascend(model, n, table, gold, first, last, chains, how)
        per = np.empty(len(n))
        per[chains.where] = forward_backward(chains, model.emissions(n, table, first, last)[chains.where], model.trans)[0]
        model.score = _logistic(_aggregates(per, lengths), labels)
    else:
        model.score = np.array([np.log((rate + 1e-3) / (1 - rate + 1e-3)), 0.0, 0.0])
    return model


def _ascend(model: Model, n: np.ndarray, table: np.ndarray, gold: np.ndarray, first: np.ndarray, last: np.ndarray, chains: Chains, how: Crf) -> None:
    size, distinct = len(model.words), len(table)
    inner = ~first[1:]  # tokens with one before them
    a, b = gold[:-1][inner], gold[1:][inner]
    pair_gold = np.array([[(~a & ~b).sum(), (~a & b).sum()], [(a & ~b).sum(), (a & b).sum()]], float)
    log_trans, bias = np.zeros((2, 2)), np.array([model.bias])
    params = [model.words, model.before, model.after, bias, log_trans]
    squares = [np.full_like(p, 1e-6) for p in params]
    scale = 1.0 / max(int(gold.sum()), 1)
    for _ in range(how.rounds):
        model.bias, model.trans = float(bias[0]), np.exp(log_trans)
        laid = model.emissions(n, table, first, last)[chains.where]
        p, r, s = forward_backward(chains, laid, model.trans)
        per = np.empty(len(n))
        per[chains.where] = p
        error = (gold - per) * scale
        (oo, ot), (to, tt) = model.trans
        pairs = np.zeros((2, 2))
        for t in range(1, len(chains.active)):
            k, at, to_ = chains.active[t], chains.offsets[t - 1], chains.offsets[t]
            q, v = r[at : at + k], laid[to_ : to_ + k] * s[to_ : to_ + k]
            z = oo + ot * v + to * q + tt * q * v
            pairs += [[(oo / z).sum(), (ot * v / z).sum()], [(to * q / z).sum(), (tt * q * v / z).sum()]]

        own = np.bincount(n, error, distinct)
        ahead = np.bincount(n[:-1], np.where(first[1:], 0, error[1:]), distinct)
        behind = np.bincount(n[1:], np.where(last[:-1], 0, error[:-1]), distinct)
        gradients = [
            sum(np.bincount(table[:, k], own, size) for k in range(table.shape[1])),
            np.bincount(table[:, 0], ahead, size),
            np.bincount(table[:, 0], behind, size),
            np.array([error.sum()]),
            (pair_gold - pairs) * scale,
        ]
        gradients[4][0, 0] = 0.0  # the reference transition
        for x, g, q in zip(params, gradients, squares, strict=True):
            g = g - how.l2 * x
            q += g * g
            x += how.rate * g / np.sqrt(q)
    model.bias, model.trans = float(bias[0]), np.exp(log_trans)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Newton's method on a few columns."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, how: Crf) -> Model | None:
    """The model, fitted in one task on a bounded sample; None where nothing is labelled.

    Bounds of the fit: about ``max_rows`` labelled documents, of these in hash order as many as hold
    ``max_tokens`` tokens, cut into chains of ``chain`` tokens. Scoring has none of them.
    """
    sample = training_sample(docs, labels, "toxic", how.max_rows, how.seed)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words = [], Words(how.bits)
        for b in batches:
            for order, label, text in zip(*(b.column(c).to_pylist() for c in ("order", "label", "text")), strict=True):
                rows.append((order, label, words.numbers(text)))
        rows.sort(key=lambda r: (r[0], len(r[2])))
        kept, total = [], 0
        for _, label, ids in rows:
            if total + len(ids) <= how.max_tokens:
                kept.append((label, ids))
                total += len(ids)
        if rows:
            yield pa.RecordBatch.from_pydict({"model": [fit(kept, words.table, how).dumps()]})

    found = sample.repartition(1).mapInArrow(fitted, "model binary").collect()
    return Model.loads(found[0].model) if found else None


def toxic_documents(docs: DataFrame, labels: DataFrame, how: Crf | None = None) -> DataFrame:
    """Score every document (doc_id, text) by a field fitted to ``labels`` (doc_id, toxic 0/1).

    Forward-backward marginals of all tokens of the whole text give the document score, through
    the chance that any token is toxic and the expected number of toxic tokens, and the offending
    spans: runs of tokens whose marginal reaches ``span``, with character offsets. Scoring needs
    no shuffle. Defined cases: null, empty and token-free texts get the score of a document
    without toxic tokens and no spans; without any label every score is 0; a document labelled
    twice counts with the higher label; repeated rows are scored one by one; other columns are
    ignored. Returns doc_id, held_out, score, predicted (score >= ``threshold``) and spans.
    """
    small_batches(docs.sparkSession)
    how = how or Crf()
    model = train(docs, labels, how)
    shared = docs.sparkSession.sparkContext.broadcast(model.dumps() if model else None)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.loads(shared.value) if shared.value else None
        words = Words(how.bits)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column("text").to_pylist()
                found: list[list[dict]] = [[] for _ in texts]
                scores = np.zeros(len(texts))
                if own:
                    if len(words) > 500_000:  # bounds the memory of a task
                        words = Words(how.bits)
                    parts = [words.numbers(x) for x in texts]
                    lengths = np.array([len(x) for x in parts], np.int64)
                    n = np.concatenate(parts)
                    e = own.emissions(n, words.table, *_ends(lengths)) if len(n) else np.zeros(0)
                    per = marginals(e, lengths, own.trans, how.chain)
                    scores = own.documents(per, lengths)
                    starts = np.cumsum(lengths) - lengths
                    hit = np.flatnonzero(per >= how.span)
                    for d in np.unique(np.searchsorted(starts, hit, side="right") - 1) if len(hit) else ():
                        while not lengths[d]:  # empty documents share their start with the next
                            d -= 1
                        found[d] = _runs(per[starts[d] : starts[d] + lengths[d]], [m.span() for m in _TOKEN.finditer(texts[d])], how.span)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, _SPANS)],
                    names=["doc_id", "score", "spans"],
                )

    head = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    return (
        docs.select("doc_id", "text")
        .mapInArrow(tagged, f"{head}, score double, spans array<struct<start: int, end: int, marginal: double>>")
        .select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "score",
            (F.col("score") >= how.threshold).cast("int").alias("predicted"),
            "spans",
        )
    )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))


def _runs(per: np.ndarray, offsets: list[tuple[int, int]], least: float) -> list[dict]:
    out: list[dict] = []
    last = -2
    for t in np.flatnonzero(per >= least).tolist():
        if t == last + 1:
            out[-1]["end"] = offsets[t][1]
            out[-1]["marginal"] = max(out[-1]["marginal"], float(per[t]))
        else:
            out.append({"start": offsets[t][0], "end": offsets[t][1], "marginal": float(per[t])})
        last = t
    return out
