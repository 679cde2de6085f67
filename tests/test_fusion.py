import numpy as np
import pytest

from airloom.operators import fusion as f


def test_weights_sum_to_one_and_prefer_precise_stations():
    w = f.weights(np.array([1.0, 4.0, 1.0]), np.array([2.0, 2.0, 2.0]), np.array([False, False, True]))
    assert w.sum() == pytest.approx(1) and w[0] > w[2] > w[1]


def test_penalties_isolate_an_outlier():
    cost, state = f.penalties(np.array([1.0, 1.0, 1.0, 1.0, 1.0, 900.0]), np.full(6, 1 / 6), -1.2)
    assert state[5] >= 4 and (state[:5] == 0).all()


def plain_penalties(e2, w, exponent):
    """The same search with every cost worked out anew."""
    price, state = f.PENALTY**exponent, [0] * len(e2)
    cost = lambda s: sum(w[k] * f.PENALTY[c] * e2[k] for k, c in enumerate(s)) * np.mean([price[c] for c in s])
    best = cost(state)
    while True:
        moves = [state[:k] + [state[k] + d] + state[k + 1 :] for size in (1, 2) for k in range(len(e2)) for d in (-size, size) if 0 <= state[k] + d < len(f.PENALTY)]
        top = min(moves, key=cost)
        if cost(top) >= best - 1e-12:
            return best, state
        best, state = cost(top), top


def test_penalties_and_descent_match_plain_versions():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9):
        e2, w = rng.random(n) ** 3 * 100, rng.random(n)
        got, want = f.penalties(e2, w / w.sum(), -1.2), plain_penalties(e2, w / w.sum(), -1.2)
        assert got[0] == pytest.approx(want[0]) and got[1].tolist() == want[1]
        parts, additive = rng.random((n, 3)) * 20, np.array([True, False, False])
        observed, spaces = parts.sum(axis=1) * 1.3 + 2, [f.search_space(0, 4, 1), f.search_space(0.4, 2, 0.1), np.array([1.0])]
        factors, cost, _ = f.descent([(observed, parts, w / w.sum(), spaces)], additive, -1.2)[0]
        model = parts[:, 0] + factors[0] + parts[:, 1:] @ factors[1:]
        assert cost == pytest.approx(plain_penalties((observed - model) ** 2, w / w.sum(), -1.2)[0])
        assert factors[2] == 1.0


def test_descent_finds_the_factors():
    rng = np.random.default_rng(1)
    parts = rng.random((8, 3)) * 20 + 1
    observed = parts @ np.array([1, 1.3, 0.8]) + 2
    spaces = [f.search_space(0, 6, 1), f.search_space(0.4, 2, 0.1), f.search_space(0.4, 2, 0.1)]
    factors, cost, _ = f.descent([(observed, parts, np.full(8, 1 / 8), spaces)], np.array([True, False, False]), -1.0)[0]
    assert cost < 1.5 and abs(factors[1] - 1.3) < 0.35


def test_learning_clamps_and_counts_an_hour_once():
    s = f.Learned()
    for h in range(2000):
        s.update(h, 3.0)
        s.update(h, 0.1)
    assert f.LOW <= s.master <= f.HIGH and s.table.max() == f.HIGH and s.last == 1999
    b = f.Learned(additive=True)
    b.update(0, 10.0)
    assert b.master == pytest.approx(0.01) and b.table[f.day_type(0), 0] == pytest.approx(0.15)


def test_left_out_predictions(spark):
    rows = [("NO2", 1, f"S{k}", 20.0 + k, [15.0, 4.0 + k, 1.0, 0.1], 1.0, 2.0, False) for k in range(5)]
    df = spark.createDataFrame(rows, "var string, sys_hour long, source_id string, value double, parts array<double>, imprecision double, covar double, previous boolean")
    got = f.left_out(df, 4).collect()
    assert len(got) == 5 and all(abs(r["value"] - r.predicted) < 6 for r in got)
    fit = f.fitted(df, 4).first()
    assert sum(fit.permille) == pytest.approx(1000) and len(fit.factors) == 4


def test_fits_made_at_once_match_single_ones():
    rng, problems = np.random.default_rng(6), []
    for n in (1, 2, 3, 7, 12, 12, 5):
        parts = rng.random((n, 4)) * np.array([20, 9, 6, 0.01])
        observed = np.abs(parts.sum(axis=1) * rng.uniform(0.5, 2, n) + rng.normal(0, 3, n))
        problems.append(f.problem(observed, parts, rng.random(n) * 3, rng.random(n), rng.random(n) < 0.4))
    additive = np.arange(4) == 0
    for p, (factors, cost, state) in zip(problems, f.descent(problems, additive, -1.2)):
        (single,) = f.descent([p], additive, -1.2)
        assert factors == pytest.approx(single[0]) and cost == pytest.approx(single[1]) and state.tolist() == single[2].tolist()
        model = p[1][:, 0] + factors[0] + p[1][:, 1:] @ factors[1:]
        assert cost == pytest.approx(plain_penalties((p[0] - np.maximum(model, 0)) ** 2, p[2], -1.2)[0])
