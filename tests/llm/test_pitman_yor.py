import math

import numpy as np
import pytest

from tallyloom.llm import pitman_yor as P


def law(c, a, d):
    """P(tables) of a dish with c customers: a^t times the generalised Stirling number, by its recursion."""
    weight = {1: 1.0}
    for j in range(1, c):
        then = {}
        for k, x in weight.items():
            then[k] = then.get(k, 0) + x * (j - d * k)
            then[k + 1] = then.get(k + 1, 0) + x * a
        most = max(then.values())
        weight = {k: x / most for k, x in then.items()}
    total = sum(weight.values())
    return {k: x / total for k, x in weight.items()}


@pytest.mark.parametrize("c, a, d", [(2, 0.3, 0.7), (3, 1.0, 0.7), (6, 2.0, 0.5), (40, 1.5, 0.7), (300, 20.0, 0.7), (300, 0.2, 0.05)])
def test_sweeps_keep_the_exact_law(c, a, d):
    n = 3000
    dish = before = np.zeros(0, np.int64)
    every = []
    for s in range(16):
        dish, before = P.sweep(np.full(n, c), np.full(n, a), d, dish, before, P.keys(np.arange(n), np.full(n, 5), s))
        assert (before >= 1).all() and (before < c).all()
        if s >= 6:
            every.append(1 + np.bincount(dish, minlength=n))
    got = np.bincount(np.concatenate(every)) / (10 * n)
    want = law(c, a, d)
    assert sum(abs((got[k] if k < len(got) else 0) - x) for k, x in want.items()) < 0.06
    assert np.mean(every) == pytest.approx(sum(k * x for k, x in want.items()), rel=0.02)


def test_weights_are_products_over_customers():
    c, a, d = np.array([5, 12, 2]), np.array([0.4, 3.0, 1.0]), 0.6
    dish, before = np.array([0, 0, 1, 1, 1]), np.array([1, 3, 2, 8, 11])
    plain = []
    for k in range(3):
        opens = before[dish == k].tolist()
        tables, log_w, log_q = 1, 0.0, 0.0
        for j in range(1, c[k]):
            odds = P.near_odds(c[k], a[k], d, j) if j < P.NEAR else math.expm1(P.far_rate(c[k], a[k], d, j))
            if j in opens:
                log_w += math.log(a[k])
                log_q += math.log(odds)
                tables += 1
            else:
                log_w += math.log(j - d * tables)
        plain.append(log_w - log_q)
    assert P.log_ratios(c, a, d, dish, before) == pytest.approx(plain)


def test_draws():
    x = np.array([0.05, 0.3, 1, 2.5, 10, 1e3, 1e7])
    assert P.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
    g = P.gamma(np.full(100_000, 2.5), P.keys(np.arange(100_000), np.ones(100_000), 1))
    assert g.mean() == pytest.approx(2.5, rel=0.02) and g.var() == pytest.approx(2.5, rel=0.05)
    u = P.uniform(P.keys(np.arange(100_000), np.zeros(100_000), 2), 3)
    assert u.mean() == pytest.approx(0.5, abs=0.01) and 0 < u.min() and u.max() < 1
    assert len(np.unique(u)) == len(u)
