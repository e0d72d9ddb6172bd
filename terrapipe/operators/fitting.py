"""Models fitted for every fold at once: each job reads the rows once and returns sums for each fold.

A design row holds what all folds share, and the rain anomaly once for each fold, as that depends on the
training seasons. So rows are never repeated for the folds, and jobs do not multiply with them; what
reaches the driver is a table of sums whose size depends on folds, features and bins, not on rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PROBABILITY_CLIP
from ..functions.agro import pentad
from ..storage import removed, written
from .features import FEATURES, NAMES

ANOMALY = NAMES.index("rain_anomaly_15d")
SHARED = tuple(c for c in NAMES if c != "rain_anomaly_15d")
LENGTHS = (3, 5, 7, 10, 15)  # of dry spells
_SIGNS = np.array([f.monotone for f in FEATURES])
_STOP_SEED = 7


def design(rows: DataFrame, normals: DataFrame, seasons: list[int]) -> DataFrame:
    """Rows of the folds with ``anomalies``: the rain anomaly under the climatology of each fold, in order of ``seasons``.

    ``normals`` is the table of ``models.climatologies``. An anomaly without a climatology, or where it
    has no deviation, is null. Rows without any other feature are left out.
    """
    by_fold = normals.groupBy("block_id", "pentad").agg(
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("clim_mean", "clim_std").alias("c")))).alias("by_fold")
    )
    years = F.array(*[F.lit(x) for x in seasons]).cast("array<int>")

    def anomaly(year):  # noqa: ANN001, ANN202
        c = F.try_element_at("by_fold", year)
        return F.when(c["clim_std"] > 0, (F.col("rain_sum_15d") - 15.0 * c["clim_mean"]) / (c["clim_std"] * 15.0**0.5))

    return (
        rows.dropna(subset=[*SHARED, "y"])
        .withColumn("pentad", pentad(F.col("date")))
        .join(by_fold, ["block_id", "pentad"])
        .withColumn("anomalies", F.transform(years, anomaly))
        .drop("pentad", "by_fold", "rain_sum_15d")
    )


@dataclass
class _Batch:
    """The rows of an Arrow batch as arrays: ``x`` with a hole at the anomaly, which ``of`` fills for a fold."""

    x: np.ndarray
    anomalies: np.ndarray
    fold: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, seasons: list[int]) -> _Batch:
        x = np.stack([np.zeros(batch.num_rows) if c not in batch.schema.names else _doubles(batch.column(c)) for c in NAMES], 1)
        flat = _doubles(batch.column("anomalies").flatten())
        return cls(x, flat.reshape(-1, len(seasons)), np.searchsorted(seasons, batch.column("fold").to_numpy(zero_copy_only=False)))

    def of(self, k: int) -> np.ndarray:
        self.x[:, ANOMALY] = self.anomalies[:, k]
        return self.x


def _doubles(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _sums(table: DataFrame, work: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]], width: int) -> dict:
    """{(fold, slot): values}: what ``work`` gives for each batch, (fold, slots, values by slot), added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, slots, values in work(batch):
                cols = [pa.array(np.full(len(slots), k, np.int32)), pa.array(slots.astype(np.int64))]
                cols += [pa.array(values[:, j].astype(float)) for j in range(width)]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "slot", *[f"v{j}" for j in range(width)]])

    schema = "k int, slot long, " + ", ".join(f"v{j} double" for j in range(width))
    out = table.mapInArrow(run, schema).groupBy("k", "slot").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(width)]).toArrow()
    of, slot = out["k"].to_numpy(), out["slot"].to_numpy()
    values = np.stack([out[f"v{j}"].to_numpy() for j in range(width)], 1)
    return {k: (slot[of == k], values[of == k]) for k in np.unique(of).tolist()}


# ---- extended logistic regression ---------------------------------------------------------------


def logistic(
    table: DataFrame, seasons: list[int], lengths: tuple[int, ...] = LENGTHS, most_steps: int = 40
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, means and scales of each fold: scaled features, the root of the spell length, the intercept.

    One penalised fit for each fold, shared by all ``lengths`` (label columns y<length>); the penalty
    is half the sum of squares, without the intercept. Newton's steps of all folds come from one
    job each; a step that raises the loss is halved. A fold without rows keeps NaN.
    """
    n = len(seasons)
    roots = np.sqrt(np.array(lengths, float))
    d = len(NAMES) + 2

    def moments(batch: pa.RecordBatch) -> Iterator:
        rows = _Batch.read(batch, seasons)
        for k in range(n):
            x = rows.of(k)[(rows.fold != k) & np.isfinite(rows.anomalies[:, k])]
            yield k, np.arange(2 * len(NAMES) + 1), np.r_[len(x), x.sum(0), (x**2).sum(0)][:, None]

    means, scales = np.full((n, len(NAMES)), np.nan), np.ones((n, len(NAMES)))
    for k, (slots, values) in _sums(table, moments, 1).items():
        found = np.zeros(2 * len(NAMES) + 1)
        found[slots] = values[:, 0]
        if found[0]:
            means[k] = found[1 : len(NAMES) + 1] / found[0]
            spread = np.sqrt(np.maximum(found[len(NAMES) + 1 :] / found[0] - means[k] ** 2, 0))
            scales[k] = np.where(spread > 1e-12, spread, 1.0)

    def derivatives(beta: np.ndarray, active: list[int]) -> Callable:
        def work(batch: pa.RecordBatch) -> Iterator:
            rows = _Batch.read(batch, seasons)
            labels = np.stack([_doubles(batch.column(f"y{g}")) for g in lengths], 1)
            for k in active:
                own = (rows.fold != k) & np.isfinite(rows.anomalies[:, k])
                z = np.c_[(rows.of(k)[own] - means[k]) / scales[k], np.zeros(own.sum()), np.ones(own.sum())]
                out = np.zeros(d * d + d + 1)
                for j, root in enumerate(roots):
                    y = labels[own, j]
                    zj, y = z[np.isfinite(y)], y[np.isfinite(y)]
                    zj[:, -2] = root
                    t = zj @ beta[k]
                    p = 1 / (1 + np.exp(-t))
                    out[: d * d] += (zj.T @ (zj * (p * (1 - p))[:, None])).ravel()
                    out[d * d : -1] += zj.T @ (p - y)
                    out[-1] += (np.logaddexp(0, t) - y * t).sum()
                yield k, np.arange(len(out)), out[:, None]

        return work

    beta = np.where(np.isfinite(means[:, :1]), 0.0, np.nan) * np.ones(d)
    ridge = np.r_[np.ones(d - 1), 0.0]
    step, loss = np.zeros((n, d)), np.full(n, np.inf)
    active = [k for k in range(n) if np.isfinite(means[k]).all()]
    for _ in range(most_steps):
        if not active:
            break
        for k, (slots, values) in _sums(table, derivatives(beta, active), 1).items():
            found = np.zeros(d * d + d + 1)
            found[slots] = values[:, 0]
            now = found[-1] + 0.5 * (ridge * beta[k] ** 2).sum()
            if now > loss[k] + 1e-9 * abs(loss[k]):
                step[k] /= 2
                beta[k] -= step[k]
            else:
                loss[k] = now
                hessian = found[: d * d].reshape(d, d) + np.diag(ridge + 1e-10)
                step[k] = -np.linalg.solve(hessian, found[d * d : -1] + ridge * beta[k])
                beta[k] += step[k]
        active = [k for k in active if np.abs(step[k]).max() > 1e-8]
    return beta, means, scales


def logistic_predictions(table: DataFrame, seasons: list[int], lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """fold, block_id, date, y, p<length> for each length, and whether the fold's fit is coherent: longer spells not likelier.

    Every row is predicted by the fit of its own fold, which has not seen its season.
    """
    beta, means, scales = logistic(table, seasons, lengths)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Batch.read(batch, seasons)
            rows.x[:, ANOMALY] = rows.anomalies[np.arange(len(rows.fold)), rows.fold]
            own = beta[rows.fold]
            t = ((rows.x - means[rows.fold]) / scales[rows.fold] * own[:, :-2]).sum(1) + own[:, -1]
            at = [1 / (1 + np.exp(-(t + own[:, -2] * g**0.5))) for g in lengths]
            clip = [pa.array(np.clip(p, PROBABILITY_CLIP, 1 - PROBABILITY_CLIP), mask=~np.isfinite(p)) for p in at]
            keep = [batch.column(c) for c in ("fold", "block_id", "date", "y")]
            names = ["fold", "block_id", "date", "y", *[f"p{g}" for g in lengths], "coherent"]
            yield pa.RecordBatch.from_arrays([*keep, *clip, pa.array(own[:, -2] <= 0)], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("fold", "block_id", "date", "y")] + [f"p{g} double" for g in lengths] + ["coherent boolean"])
    return table.mapInArrow(score, schema).dropna(subset=[f"p{lengths[0]}"])


# ---- boosting ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Boost:
    """Parameters of the boosted trees."""

    rounds: int = 200
    depth: int = 3
    rate: float = 0.05
    bins: int = 32
    least_rows: int = 20  # of a leaf
    penalty: float = 1.0
    stop_share: float = 0.15  # of the rows of each season and class, which only decide when to stop
    patience: int = 20
    saved: int = 10  # rounds after which the margins of all rows are written
    task_rows: int = 100_000  # of a task, so that hundreds of short jobs do not start more tasks than the rows fill


def grid(table: DataFrame, bins: int) -> list[np.ndarray]:
    """Inner edges of the bins of each feature: quantiles over all rows, of the anomaly over all folds."""
    at = np.linspace(0, 1, bins + 1)[1:-1].tolist()
    shared = table.approxQuantile(list(SHARED), at, 0.001)
    anomalies = table.select(F.explode("anomalies").alias("a")).approxQuantile("a", at, 0.001)
    shared.insert(ANOMALY, anomalies)
    return [np.unique(x) for x in shared]


def stopping(table: DataFrame, share: float) -> DataFrame:
    """``stops``: the rows of least hash in each season and class, about ``share`` of them; so every fold stops on both classes alike."""
    hashed = table.withColumn("hash_", F.xxhash64(F.lit(_STOP_SEED), "block_id", "date"))
    below = hashed.groupBy("fold", "y").agg(F.percentile_approx("hash_", F.lit(share), F.lit(10_000)).alias("below_"))
    below = below.withColumnRenamed("y", "y_").withColumnRenamed("fold", "fold_")
    marked = hashed.join(F.broadcast(below), (F.col("fold") == F.col("fold_")) & (F.col("y") == F.col("y_")))  # two rows for each year
    return marked.withColumn("stops", F.col("hash_") < F.col("below_")).drop("hash_", "below_", "y_", "fold_")


class _Tree:
    """A tree of bounded depth in arrays: the feature of each node (-1 for a leaf), its cut, its value."""

    def __init__(self, depth: int) -> None:
        size = (2 << depth) - 1
        self.feature = np.full(size, -1)
        self.cut = np.zeros(size, np.int64)
        self.value = np.zeros(size)
        self.low, self.high = np.full(size, -np.inf), np.full(size, np.inf)

    def nodes(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after ``depth`` levels; rows stay in a leaf."""
        at = np.zeros(len(codes), np.int64)
        for _ in range(depth):
            f = self.feature[at]
            right = codes[np.arange(len(codes)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


def best_split(hist: np.ndarray, tree: _Tree, node: int, how: Boost) -> bool:
    """Split ``node`` by its histogram (feature, bin, [g, h, n]) where that gains, within its bounds; set its children.

    The bounds of the parents hold for all that lies below them: where a feature has a sign, the values
    on its two sides stay on either side of the middle.
    """
    low, high = tree.low[node], tree.high[node]
    value = lambda g, h: np.clip(g / (h + how.penalty), low, high)
    gt, ht, nt = hist[0].sum(0)
    leaf = value(gt, ht)
    tree.value[node] = leaf * how.rate
    if nt < 2 * how.least_rows:
        return False
    g, h, n = (hist[:, :, j].cumsum(1)[:, :-1] for j in range(3))
    left, right = value(g, h), value(gt - g, ht - h)
    gain = g * left + (gt - g) * right - 0.5 * (left**2 * (h + how.penalty) + right**2 * (ht - h + how.penalty))
    gain -= gt * leaf - 0.5 * leaf**2 * (ht + how.penalty)
    ok = (n >= how.least_rows) & (nt - n >= how.least_rows) & (_SIGNS[:, None] * (right - left) >= 0)
    gain = np.where(ok, gain, -np.inf)
    j, k = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[j, k] > 1e-6:
        return False
    tree.feature[node], tree.cut[node] = j, k
    middle = (left[j, k] + right[j, k]) / 2
    for child, gc, hc, lower in ((2 * node + 1, g[j, k], h[j, k], True), (2 * node + 2, gt - g[j, k], ht - h[j, k], False)):
        tree.low[child], tree.high[child] = low, high
        if _SIGNS[j]:
            if (_SIGNS[j] > 0) == lower:
                tree.high[child] = min(high, middle)
            else:
                tree.low[child] = max(low, middle)
        tree.value[child] = np.clip(gc / (hc + how.penalty), tree.low[child], tree.high[child]) * how.rate
    return True


def _coded(table: DataFrame, seasons: list[int], edges: list[np.ndarray]) -> DataFrame:
    """fold, y, stops, codes (a byte for each feature), anomalies (a byte for each fold, 255 for none), margins (none yet)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Batch.read(batch, seasons)
            codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.x.T, strict=True)], 1).astype(np.uint8)
            own = np.searchsorted(edges[ANOMALY], rows.anomalies, side="left").astype(np.uint8)
            own[~np.isfinite(rows.anomalies)] = 255
            cols = [
                pa.array(rows.fold.astype(np.int32)), batch.column("y"), batch.column("stops"), _packed(codes), _packed(own),
                pa.array([b""] * len(codes), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "y", "stops", "codes", "anomalies", "margins"])

    return table.mapInArrow(code, "k int, y double, stops boolean, codes binary, anomalies binary, margins binary")


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(rows)], pa.binary())


def _unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _margins(batch: pa.RecordBatch, codes: np.ndarray, own: np.ndarray, ks: list[int], start: np.ndarray, trees: dict, depth: int) -> np.ndarray:
    """The margin of each row in each fold: what was written, or the start, and the trees grown since."""
    there = batch.column("margins")
    n = own.shape[1]
    out = _unpacked(there, np.float64, n).copy() if batch.num_rows and len(there[0].as_py()) else np.tile(start, (batch.num_rows, 1))
    for k in ks:
        codes[:, ANOMALY] = own[:, k]
        for tree in trees.get(k, ()):
            out[:, k] += tree.value[tree.nodes(codes, depth)]
    return out


def boosted(table: DataFrame, seasons: list[int], how: Boost | None = None, edges: list[np.ndarray] | None = None) -> dict:
    """{"edges", "start", "trees"}: boosted trees of each fold, fitted on all rows of all its training seasons.

    ``table`` is a design with ``stops``. A level of the trees of all folds takes one job: tasks add
    gradients into (fold, node, feature, bin) cells, Spark adds the cells up, and the driver chooses
    the splits from that table, whose size is folds x nodes x features x bins. Margins are written every ``saved``
    rounds, so that a job walks few trees. A fold ends when ``patience`` rounds do not lower the loss of
    its stopping rows; at the latest after ``rounds``.
    """
    how = how or Boost()
    edges = edges or grid(table, how.bins)
    n, cells = len(seasons), len(NAMES) * how.bins
    coded = _dealt(written(_coded(table, seasons, edges), "boost-rows"), how)
    start = np.zeros(n)
    trees: dict[int, list[_Tree]] = {k: [] for k in range(n)}
    recent: dict[int, list[_Tree]] = {k: [] for k in range(n)}

    def read(batch: pa.RecordBatch, ks: list[int]) -> tuple:
        codes = _unpacked(batch.column("codes"), np.uint8, len(NAMES)).astype(np.int64)
        own = _unpacked(batch.column("anomalies"), np.uint8, n).astype(np.int64)
        y, stops, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "stops", "k"))
        return codes, own, y, stops.astype(bool), fold

    def begin(batch: pa.RecordBatch) -> Iterator:
        _, own, y, stops, fold = read(batch, [])
        for k in range(n):
            used = (fold != k) & (own[:, k] < 255) & ~stops
            yield k, np.array([0]), np.array([[y[used].sum(), 0.0, used.sum()]])

    def level(ks: list[int], growing: dict[int, _Tree], at: int) -> Callable:
        first = (1 << at) - 1

        def work(batch: pa.RecordBatch) -> Iterator:
            codes, own, y, stops, fold = read(batch, ks)
            margins = _margins(batch, codes, own, ks, start, recent, how.depth)
            for k in ks:
                codes[:, ANOMALY] = own[:, k]
                known = (fold != k) & (own[:, k] < 255)
                f = margins[:, k]
                if at == 0:
                    held = known & stops
                    loss = (np.logaddexp(0, f[held]) - y[held] * f[held]).sum()
                    yield k, np.array([-1]), np.array([[loss, 0.0, held.sum()]])
                learn = known & ~stops
                p = 1 / (1 + np.exp(-f[learn]))
                node = growing[k].nodes(codes[learn], at) - first
                inside = node >= 0  # others rest in leaves above
                node, own_codes = node[inside], codes[learn][inside]
                g, h = (y[learn] - p)[inside], (p * (1 - p))[inside]
                slots = node[:, None] * cells + np.arange(len(NAMES)) * how.bins + own_codes
                size = (1 << at) * cells
                sums = [np.bincount(slots.ravel(), np.repeat(v, len(NAMES)), size) for v in (g, h, np.ones(len(g)))]
                there = np.flatnonzero(sums[2])
                yield k, there, np.stack(sums, 1)[there]

        return work

    for k, (_, values) in _sums(coded, begin, 3).items():
        share = np.clip(values[0, 0] / max(values[0, 2], 1), 1e-3, 1 - 1e-3)
        start[k] = np.log(share / (1 - share))
    active, least, since = list(range(n)), np.full(n, np.inf), np.zeros(n, int)
    for turn in range(how.rounds):
        growing = {k: _Tree(how.depth) for k in active}
        open_ = {k: {0} for k in active}
        for at in range(how.depth):
            ks = [k for k in active if open_[k]]
            if not ks:
                break
            found = _sums(coded, level(ks, growing, at), 3)
            for k in ks:
                slots, values = found.get(k, (np.zeros(0, int), np.zeros((0, 3))))
                if at == 0 and (slots < 0).any():
                    loss = values[slots < 0][0]
                    if loss[2]:
                        lower = loss[0] / loss[2] < least[k] - 1e-7
                        least[k], since[k] = (loss[0] / loss[2], 0) if lower else (least[k], since[k] + 1)
                hist = np.zeros(((1 << at) * cells, 3))
                hist[slots[slots >= 0]] = values[slots >= 0]
                hist = hist.reshape(1 << at, len(NAMES), how.bins, 3)
                split = [x for x in open_[k] if best_split(hist[x - (1 << at) + 1], growing[k], x, how)]
                open_[k] = {c for x in split for c in (2 * x + 1, 2 * x + 2)}
            active = [k for k in active if since[k] < how.patience]
        for k in active:
            trees[k].append(growing[k])
            recent[k].append(growing[k])
        if not active:
            break
        if (turn + 1) % how.saved == 0 and turn + 1 < how.rounds:
            old, coded = coded, _dealt(written(_saved(coded, n, active, start, recent, how.depth), "boost-rows"), how)
            removed(old)
            recent = {k: [] for k in range(n)}
    removed(coded)
    return {"edges": edges, "start": start, "trees": trees, "depth": how.depth}


def _dealt(coded: DataFrame, how: Boost) -> DataFrame:
    return coded.coalesce(-(-coded.count() // how.task_rows) or 1)


def _saved(coded: DataFrame, n: int, ks: list[int], start: np.ndarray, recent: dict, depth: int) -> DataFrame:
    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _unpacked(batch.column("codes"), np.uint8, len(NAMES)).astype(np.int64)
            own = _unpacked(batch.column("anomalies"), np.uint8, n).astype(np.int64)
            margins = _packed(_margins(batch, codes, own, ks, start, recent, depth))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], margins], names=batch.schema.names)

    return coded.mapInArrow(save, coded.schema)


def boosted_predictions(table: DataFrame, seasons: list[int], model: dict) -> DataFrame:
    """fold, block_id, date, y, p: every row by the trees of its own fold."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Batch.read(batch, seasons)
            rows.x[:, ANOMALY] = rows.anomalies[np.arange(len(rows.fold)), rows.fold]
            p = predicted(model, rows.x, rows.fold)
            p[~np.isfinite(rows.x[:, ANOMALY])] = np.nan
            found = pa.array(np.clip(p, PROBABILITY_CLIP, 1 - PROBABILITY_CLIP), mask=np.isnan(p))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("fold", "block_id", "date", "y")), found], names=["fold", "block_id", "date", "y", "p"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("fold", "block_id", "date", "y")) + ", p double"
    return table.mapInArrow(score, schema).dropna(subset=["p"])


def predicted(model: dict, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Probabilities of rows of all twelve features, by the trees of the given place in the list of folds."""
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(model["edges"], x.T, strict=True)], 1)
    margin = model["start"][fold].copy()
    for k in np.unique(fold).tolist():
        own = codes[fold == k]
        for tree in model["trees"][k]:
            margin[fold == k] += tree.value[tree.nodes(own, model["depth"])]
    return 1 / (1 + np.exp(-margin))
