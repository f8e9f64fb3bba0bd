"""Forecasts from grouped sums against plain least squares, series by series and fold by fold."""

import pickle
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from palmares.models import sums
from palmares.models.forecast import Autoregression, TrendAndSeason, boosted_trees, pooled_forecast
from palmares.operators.series import history_with_future, horizon

RNG = np.random.default_rng(3)


def plain_autoregression(values, steps, lags, d):
    """(forecast, fitted) by lstsq over the rows that have all lags; a series without lags repeats its last value."""
    n = len(values)
    p = max(min(lags, (n - d - 1) // 2), 0)
    if p < 1:
        return [values[-1]] * steps, [None] * n
    x = np.diff(values) if d else np.array(values, float)
    design = np.column_stack([x[p - i - 1:len(x) - i - 1] for i in range(p)])
    weights = np.linalg.lstsq(design, x[p:], rcond=1e-6)[0]
    path, level, ahead = list(x), values[-1], []
    for _ in range(steps):
        path.append(float(np.dot(weights, path[:-p - 1:-1])))
        level = level + path[-1] if d else path[-1]
        ahead.append(level)
    fitted = [None] * (p + d) + [(values[p + d + i - 1] if d else 0) + float(design[i] @ weights) for i in range(len(design))]
    return ahead, fitted


def plain_trend(times, values, train, ahead, bends, waves, ridge):
    """Penalised least squares on the first ``train`` rows, with bends at quantiles of all times."""
    t = np.array(times, float)
    low, span, k = t.min(), max(np.ptp(t), 1.0), min(bends, len(t) - 1)
    knots = np.quantile(t, 0.8 * np.arange(1, k + 1) / k) if k else []
    design = lambda u: np.column_stack(
        [np.ones_like(u), (u - low) / span] + [np.maximum(u - c, 0) / span for c in knots] + [f(2 * np.pi * w * u) for w in range(1, waves + 1) for f in (np.sin, np.cos)])
    x = design(t)[:train]
    penalty = np.diag([0.0, 0.0] + [ridge] * (x.shape[1] - 2))
    weights = np.linalg.lstsq(x.T @ x + penalty, x.T @ np.array(values, float)[:train], rcond=None)[0]
    return design(np.array(ahead, float)) @ weights


def walks():
    series = {"a": np.cumsum(RNG.normal(1, 3, 60)), "b": 5 * np.sin(np.arange(44) / 3) + RNG.normal(0, 1, 44), "c": RNG.normal(9, 2, 13), "d": RNG.normal(0, 1, 7)}
    series |= {"line": 10.0 * np.arange(20), "flat": np.full(15, 4.0), "two": np.array([5.0, 7.0]), "one": np.array([5.0]), None: np.cumsum(RNG.normal(0, 1, 25))}
    return {k: [float(x) for x in v] for k, v in series.items()}


WALKS = walks()


@pytest.fixture(scope="module")
def series(spark):
    rows = [(g, 1900 + 2 * i, x) for g, v in WALKS.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "g string, year int, v double").repartition(3)


@pytest.mark.parametrize("lags, d", [(1, 1), (2, 1), (5, 1), (3, 0)])
def test_autoregression_equals_plain_least_squares(spark, series, lags, d):
    future = history_with_future(series, horizon(series, "year", 4, 2, ["g"])).unionByName(
        spark.createDataFrame([("none", 1900, None, "forecast")], "g string, year int, v double, kind string"))
    found = {(r["g"], r["year"]): (r["yhat"], r["status"]) for r in Autoregression(lags, d).forecast(future, ["g"], "year", "v", fitted=True).collect()}
    assert found.pop(("none", 1900)) == (None, "no history")
    want = {}
    for g, v in WALKS.items():
        ahead, fitted = plain_autoregression(v, 4, lags, d)
        p = max(min(lags, (len(v) - d - 1) // 2), 0)
        status = "ok" if p == lags else f"lags={p}" if p else "repeats last value"
        want |= {(g, 1900 + 2 * i): (x, status) for i, x in enumerate([*fitted, *ahead])}
    assert {k: s for k, (_, s) in found.items()} == {k: s for k, (_, s) in want.items()}
    assert {k: x is None for k, (x, _) in found.items()} == {k: x is None for k, (x, _) in want.items()}
    assert {k: x for k, (x, _) in found.items() if x is not None} == pytest.approx({k: x for k, (x, _) in want.items() if x is not None}, rel=1e-5, abs=1e-5)


def fold_starts(n, folds=5):
    size = n // (folds + 1)
    return size, [n - (folds + 1 - k) * size for k in range(1, folds + 1)] if size else []


@pytest.mark.parametrize("lags", [1, 5])
def test_all_folds_of_an_autoregression_equal_refitting(series, lags):
    found = {(r["g"], r["fold"]): (r["mae"], r["status"]) for r in Autoregression(lags).validate(series, ["g"], "year", "v").collect()}
    want = {}
    for g, v in WALKS.items():
        size, starts = fold_starts(len(v))
        for k, start in enumerate(starts, 1):
            ahead, _ = plain_autoregression(v[:start], size, lags, 1)
            want[g, k] = float(np.mean(np.abs(np.array(v[start:start + size]) - ahead)))
        if not starts:
            want[g, None] = None
    assert found.keys() == want.keys()
    assert {k: m for k, (m, _) in found.items() if m is not None} == pytest.approx({k: m for k, m in want.items() if m is not None}, rel=1e-5, abs=1e-5)
    assert {s for (_, k), (_, s) in found.items() if k is None} == {"too_short"}


@pytest.mark.parametrize("bends, waves", [(25, 10), (3, 0), (0, 1)])
def test_trend_equals_plain_least_squares(series, bends, waves):
    model = TrendAndSeason(bends, waves, 0.5)
    rows = history_with_future(series, horizon(series, "year", 3, 2, ["g"]))
    found = {(r["g"], r["year"]): r["yhat"] for r in model.forecast(rows, ["g"], "year", "v", fitted=True).collect()}
    folds = {(r["g"], r["fold"]): r["mae"] for r in model.validate(series, ["g"], "year", "v").collect()}
    want, errors = {}, {}
    for g, v in WALKS.items():
        times = [1900 + 2 * i for i in range(len(v))]
        every = [1900 + 2 * i for i in range(len(v) + 3)]
        want |= {(g, t): float(x) for t, x in zip(every, plain_trend(times, v, len(v), every, bends, waves, 0.5))}
        size, starts = fold_starts(len(v))
        for k, start in enumerate(starts, 1):
            ahead = plain_trend(times, v, start, times[start:start + size], bends, waves, 0.5)
            errors[g, k] = float(np.mean(np.abs(np.array(v[start:start + size]) - ahead)))
    # A single point leaves the line undetermined.
    drop = lambda d: {k: x for k, x in d.items() if k[0] != "one" and x is not None}
    assert drop(found) == pytest.approx(drop(want), rel=1e-4, abs=1e-4)
    assert drop(folds) == pytest.approx(drop(errors), rel=1e-4, abs=1e-4)


def test_weights_of_singular_systems_are_the_shortest():
    z = np.array([[1.0, 1.0, 2.0], [2.0, 2.0, 4.0]])
    assert sums.solved((z.T @ z).reshape(1, -1), np.zeros(2))[0] == pytest.approx([1.0, 1.0])
    assert sums.solved(np.zeros((1, 9)), np.zeros(2))[0].tolist() == [0.0, 0.0]


def test_solver_reaches_workers_without_the_package(tmp_path):
    (tmp_path / "solver").write_bytes(cloudpickle.dumps(sums.solved))
    code = "import pickle, numpy as np; f = pickle.load(open('solver', 'rb')); print(f(np.array([[4., 8., 8., 16.]]), np.zeros(1)))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "[[2.]]", done.stderr
    assert pickle.loads((tmp_path / "solver").read_bytes())


def test_boosted_trees_of_all_series_are_one_fit(spark):
    rows = [(g, float(x), (9.0 if x > 4 else 1.0) + (100 if g == "b" else 0)) for g in ("a", "b", None) for x in range(10)]
    history = spark.createDataFrame(rows + [("a", None, 5.0), ("a", 3.0, None)], "g string, x double, y double")
    future = spark.createDataFrame([("a", 0.0, 1), ("b", 9.0, 2), (None, 9.0, 3), ("new", 0.0, 4)], "g string, x double, n int")
    out = pooled_forecast(history, future, ["g"], ["x"], "y", boosted_trees(20, rate=0.5))
    found = {r["n"]: r["yhat"] for r in out.collect()}
    assert out.columns == ["g", "x", "n", "yhat"]
    assert found[1] == pytest.approx(1, abs=0.5) and found[2] == pytest.approx(109, abs=0.5) and found[3] == pytest.approx(9, abs=0.5) and found[4] is not None
