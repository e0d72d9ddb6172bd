"""Fits of all folds at once against single fits by other means."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from terrapipe.operators import fitting
from terrapipe.operators.features import FEATURES, NAMES

SEASONS = [2000, 2001, 2002, 2003]
SIGNS = np.array([f.monotone for f in FEATURES])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 900
    x = rng.normal(size=(n, len(NAMES)))
    x[:, NAMES.index("ens_dry_fraction")] = rng.random(n)
    fold = rng.choice(SEASONS, n)
    anomalies = x[:, [fitting.ANOMALY]] + 0.2 * rng.normal(size=(n, len(SEASONS)))
    anomalies[5, 2] = np.nan  # no climatology in one fold
    truth = 0.9 * x[:, NAMES.index("dry_run_lag1")] - 0.7 * x[:, 0] + 1.5 * x[:, NAMES.index("ens_dry_fraction")]
    labels = {g: (truth + rng.logistic(size=n) > 0.5 + 0.4 * g**0.5).astype(float) for g in fitting.LENGTHS}
    rows = []
    for i in range(n):
        rows.append(
            (int(fold[i]), i, dt.date(int(fold[i]), 6, 1), float(labels[5][i]), *[None if g == 15 and i % 50 == 0 else float(labels[g][i]) for g in fitting.LENGTHS],
             *[float(v) for v in np.delete(x[i], fitting.ANOMALY)], [None if np.isnan(v) else float(v) for v in anomalies[i]], i % 7 == 0)
        )
    schema = (
        "fold int, block_id int, date date, y double, " + ", ".join(f"y{g} double" for g in fitting.LENGTHS) + ", "
        + ", ".join(f"{c} double" for c in fitting.SHARED) + ", anomalies array<double>, stops boolean"
    )
    return spark.createDataFrame(rows, schema).repartition(3).cache(), x, anomalies, fold, labels


def arrays(data, k):
    """The rows of training of the k-th fold."""
    _, x, anomalies, fold, labels = data
    own = (fold != SEASONS[k]) & np.isfinite(anomalies[:, k])
    x = x.copy()
    x[:, fitting.ANOMALY] = anomalies[:, k]
    return x[own], {g: y[own] for g, y in labels.items()}, np.flatnonzero(own)


def test_logistic_equals_single_fits(spark, data):
    beta, means, scales = fitting.logistic(data[0], SEASONS)
    for k in (0, 2):
        x, labels, at = arrays(data, k)
        assert means[k] == pytest.approx(x.mean(0)) and scales[k] == pytest.approx(x.std(0))
        z = (x - x.mean(0)) / x.std(0)
        rows = [
            (Vectors.dense([*z[i], g**0.5]), float(labels[g][i]))
            for g in fitting.LENGTHS
            for i in range(len(z))
            if not (g == 15 and at[i] % 50 == 0)
        ]
        frame = spark.createDataFrame(rows, ["features", "label"])
        model = LogisticRegression(regParam=1 / len(rows), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(frame)
        assert beta[k][:-1] == pytest.approx(model.coefficients.toArray(), abs=1e-4)
        assert beta[k][-1] == pytest.approx(model.intercept, abs=1e-4)


def test_longer_spells_are_not_likelier_in_any_fold(data):
    got = fitting.logistic_predictions(data[0], SEASONS).collect()
    assert {r.fold for r in got} == set(SEASONS)
    assert len(got) == 900 - (data[3][5] == SEASONS[2])
    assert all(r.coherent and r.p3 >= r.p5 >= r.p7 >= r.p10 >= r.p15 > 0 for r in got)


def plain_boost(x, y, stops, edges, how):
    """One fold by recursion over rows, without histograms: the rows' own sums at every cut."""
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    learn = ~stops
    share = y[learn].mean()
    start = np.log(share / (1 - share))
    f, trees, least, since = np.full(len(y), start), [], np.inf, 0

    def grow(rows, g, h, depth, low, high):
        value = lambda s: float(np.clip(g[s].sum() / (h[s].sum() + how.penalty), low, high))
        own = value(rows)
        best = (1e-6, None)
        if depth and len(rows) >= 2 * how.least_rows:
            for j in range(x.shape[1]):
                for cut in range(how.bins - 1):
                    left, right = rows[codes[rows, j] <= cut], rows[codes[rows, j] > cut]
                    if min(len(left), len(right)) < how.least_rows:
                        continue
                    a, b = value(left), value(right)
                    if SIGNS[j] * (b - a) < 0:
                        continue
                    score = lambda s, v: g[s].sum() * v - 0.5 * v**2 * (h[s].sum() + how.penalty)
                    gain = score(left, a) + score(right, b) - score(rows, own)
                    if gain > best[0] + 1e-12:
                        best = (gain, (j, cut, left, right, (a + b) / 2))
        if best[1] is None:
            return own * how.rate
        j, cut, left, right, middle = best[1]
        up = (low, middle) if SIGNS[j] > 0 else (middle, high) if SIGNS[j] < 0 else (low, high)
        down = (middle, high) if SIGNS[j] > 0 else (low, middle) if SIGNS[j] < 0 else (low, high)
        return j, cut, grow(left, g, h, depth - 1, *up), grow(right, g, h, depth - 1, *down)

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if codes[row, tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(how.rounds):
        loss = np.mean(np.logaddexp(0, f[stops]) - y[stops] * f[stops])
        least, since = (loss, 0) if loss < least - 1e-7 else (least, since + 1)
        if since >= how.patience:
            break
        p = 1 / (1 + np.exp(-f))
        trees.append(grow(np.flatnonzero(learn), y - p, p * (1 - p), how.depth, -np.inf, np.inf))
        f = f + np.array([walk(trees[-1], i) for i in range(len(y))])
    return 1 / (1 + np.exp(-f)), len(trees)


def test_boosting_equals_a_plain_booster(data):
    how = fitting.Boost(rounds=8, depth=2, rate=0.3, bins=6, saved=3, patience=3)
    edges = fitting.grid(data[0], how.bins)
    model = fitting.boosted(data[0], SEASONS, how, edges)
    for k in (1, 2):
        x, labels, at = arrays(data, k)
        want, n = plain_boost(x, labels[5], at % 7 == 0, edges, how)
        assert len(model["trees"][k]) == n
        assert fitting.predicted(model, x, np.full(len(x), k)) == pytest.approx(want, abs=1e-9)


def test_boosting_keeps_the_declared_signs(data):
    how = fitting.Boost(rounds=25, rate=0.3, bins=16)
    model = fitting.boosted(data[0], SEASONS, how)
    rng = np.random.default_rng(4)
    for k in range(len(SEASONS)):
        assert model["trees"][k]
        for j in np.flatnonzero(SIGNS):
            rows = np.repeat(rng.normal(size=(20, len(NAMES))), 30, axis=0)
            rows[:, j] = np.tile(np.linspace(-3, 3, 30), 20)
            p = fitting.predicted(model, rows, np.full(len(rows), k)).reshape(20, 30)
            assert (SIGNS[j] * np.diff(p, axis=1) >= -1e-12).all()
    got = fitting.boosted_predictions(data[0], SEASONS, model).collect()
    assert len(got) == 900 - (data[3][5] == SEASONS[2])
    y, p = np.array([r.y for r in got]), np.array([r.p for r in got])
    assert ((p - y) ** 2).mean() < 0.9 * ((y.mean() - y) ** 2).mean()  # rows of seasons that the trees have not seen


def test_boosting_stops_on_noise(spark, data):
    noise = data[0].selectExpr(*[c for c in data[0].columns if c != "y"], "cast(pmod(xxhash64(block_id), 2) as double) as y")
    model = fitting.boosted(noise, SEASONS, fitting.Boost(rounds=60, depth=1, rate=0.5, patience=4))
    assert all(4 <= len(t) < 60 for t in model["trees"].values())


def test_stopping_rows_are_drawn_within_each_class(spark):
    rows = [(2000 + i % 2, i, dt.date(2000, 6, 1), float(i % 10 == 0)) for i in range(4000)]
    frame = fitting.stopping(spark.createDataFrame(rows, "fold int, block_id int, date date, y double"), 0.15)
    shares = {(r.fold, r.y): r.share for r in frame.groupBy("fold", "y").agg(F.avg(F.col("stops").cast("int")).alias("share")).collect()}
    assert len(shares) == 3 and all(abs(s - 0.15) < 0.02 for s in shares.values())
