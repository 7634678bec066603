"""The fit of the toxicity classifier on the driver: the weights of a plain dense one, without writing its rows out."""

import tracemalloc

import numpy as np

from paceline.llm import toxicity


def _rows(n, k, seed=1):
    draw = np.random.default_rng(seed)
    rows = [sorted(draw.choice(k, draw.integers(0, min(k, 100)), replace=False).tolist()) for _ in range(n)]
    weights = draw.normal(size=k)
    y = np.array([float(weights[r].sum() + draw.normal() > 3) for r in rows])
    differences = np.zeros((5, k), np.float32)
    for d in differences:
        d[draw.choice(k, 2)] = 1, -1
    return rows, y, differences


def _dense(rows, y, differences, penalty, ridge, rounds=400):
    n, k = len(rows), differences.shape[1]
    x = np.zeros((n, k + 1))
    for at, own in enumerate(rows):
        x[at, [*own, k]] = 1
    curve = penalty * differences.T.astype(float) @ differences + ridge * np.eye(k)
    scale = 0.25 * np.linalg.norm(x, 2) ** 2 + np.linalg.norm(curve, 2)
    w = v = np.r_[np.zeros(k), np.log((y.sum() + 1) / (n - y.sum() + 1))]
    t = 1.0
    for _ in range(rounds):
        gradient = x.T @ (1 / (1 + np.exp(-np.clip(x @ v, -60, 60))) - y)
        gradient[:k] += curve @ v[:k]
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        new = v - gradient / scale
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:k], w[k]


def test_weights_are_those_of_written_out_rows():
    # more rows than a block, and rows without any feature
    rows, y, differences = _rows(toxicity.GRAM_ROWS + 300, 60)
    assert [] in rows
    found, wanted = toxicity.fit_weights(rows, y, differences, 10.0, 0.05), _dense(rows, y, differences, 10.0, 0.05)
    assert np.allclose(found[0], wanted[0], rtol=0, atol=1e-10) and abs(found[1] - wanted[1]) < 1e-10


def test_without_differences():
    rows, y, differences = _rows(200, 30)
    found, wanted = (fit(rows, y, differences[:0], 10.0, 0.05) for fit in (toxicity.fit_weights, _dense))
    assert np.allclose(found[0], wanted[0], rtol=0, atol=1e-10)


def test_most_rows_and_features_stay_small():
    rows, y, differences = _rows(toxicity.MAX_ROWS, toxicity.MAX_FEATURES + 250)
    tracemalloc.start()
    toxicity.fit_weights(rows, y, differences, 10.0, 0.05, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # written out once, these rows are 102 MB
    assert peak < 80e6
