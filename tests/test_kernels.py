"""Pure numpy kernels against direct definitions."""

import numpy as np
import pytest

from tidemark.operators.portfolio import inversions, solve_risk_parity
from tidemark.operators.search import Axis, acquisition, grid_size, posterior
from tidemark.operators.smooth import cosine_gain, low_pass


def direct_low_pass(x, cutoff):
    n, pad = len(x), int(len(x) * 0.2)
    wide = np.pad(x, pad, mode="reflect") if pad else x
    m = len(wide)
    basis = np.cos(np.pi * np.outer(np.arange(m), 2 * np.arange(m) + 1) / (2 * m)) * np.sqrt(2 / m)
    basis[0] /= np.sqrt(2)
    return ((cosine_gain(m, cutoff) * (basis @ wide)) @ basis)[pad : pad + n]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 101, 500])
@pytest.mark.parametrize("cutoff", [0.05, 0.3, 0.97, 1.0])
def test_low_pass_is_a_damped_cosine_transform(n, cutoff):
    x = np.random.default_rng(n).normal(100, 5, n)
    assert np.allclose(low_pass(x, cutoff), direct_low_pass(x, cutoff), atol=1e-9)


def test_low_pass_reduces_noise_and_keeps_constants():
    t = np.arange(400)
    noisy = np.sin(t / 40) + np.random.default_rng(0).normal(0, 0.3, 400)
    assert np.abs(low_pass(noisy, 2 / 48) - np.sin(t / 40)).mean() < 0.15
    assert np.allclose(low_pass(np.full(50, 3.0), 0.1), 3.0)


def test_risk_parity_damped_equalises_contributions():
    a = np.random.default_rng(1).normal(0, [0.1, 0.2, 0.3], (500, 3))
    cov = np.cov(a, rowvar=False)
    w = solve_risk_parity(cov, 0.0, 1.0)
    assert w.sum() == pytest.approx(1)
    assert np.allclose(w * (cov @ w), w @ cov @ w / 3, rtol=1e-3)


def test_risk_parity_undamped_does_not_settle_on_a_diagonal():
    cov = np.diag([0.01, 0.04])
    w = solve_risk_parity(cov, 0.0, 1.0, damped=False)
    first, second = w * (cov @ w)
    assert w.sum() == pytest.approx(1) and abs(first / second - 1) > 0.5


def test_inversions_match_brute_force():
    v = np.random.default_rng(2).integers(0, 30, 200).astype(float)
    assert inversions(v) == sum(v[i] > v[j] for i in range(200) for j in range(i + 1, 200))


def test_posterior_interpolates_observations():
    x, y = np.array([[0.1], [0.5], [0.9]]), np.array([1.0, -1.0, 2.0])
    mean, deviation = posterior(x, y, np.array([[0.5], [0.3]]))
    assert mean[0] == pytest.approx(-1.0, abs=1e-3) and deviation[0] < 0.01 < deviation[1]
    for kind in ("ei", "poi", "ucb", "mean"):
        assert np.isfinite(acquisition(mean, deviation, 2.0, kind)).all()


def test_axis_points_and_validation():
    assert Axis("int", 1, 3).points(3) == [1, 2, 3]
    assert grid_size({"a": Axis("int", 1, 3), "b": Axis("float", 0.0, 1.0)}, 3) == 9
    assert Axis("float", 0.01, 1.0, log=True).points(3) == pytest.approx([0.01, 0.1, 1.0])
    for bad in (("int", 3, 1), ("float", 0, 1, True), ("choice",), ("other", 0, 1)):
        with pytest.raises(ValueError):
            Axis(*bad)
