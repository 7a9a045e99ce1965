import math
import random

import numpy as np
import pytest

from tiewise.operators import meta
from tiewise.operators.inference import normal_tail


def rows():
    r = random.Random(4)
    return [(k, e, round(r.gauss(m, 0.5), 3), round(r.uniform(0.1, 0.6), 3)) for e, m in (("a", 0.6), ("b", 0.0)) for k in range(12)] + [(99, "a", 1.0, 50.0), (98, "a", None, 0.1), (97, "a", 2.0, 0.0)]


def test_combination(spark):
    fits = spark.createDataFrame(rows(), "study int, effect string, theta double, se double")
    got = {r.effect: r for r in meta.combine(fits).collect()}
    for e in "ab":
        used = [(t, s) for k, x, t, s in rows() if x == e and k < 50]
        ts = [t / s for t, s in used]
        a, b = sum(t / s**2 for t, s in used), sum(1 / s**2 for _, s in used)
        g = got[e]
        assert g.studies == 12 and g.t2 == pytest.approx(sum(t * t for t in ts), abs=1e-5) and g["mean"] == pytest.approx(a / b, abs=1e-6) and g.se == pytest.approx(b**-0.5, abs=1e-6)
        assert g.q == pytest.approx(sum(t * t for t in ts) - a * a / b, abs=1e-5)
        assert g.right == pytest.approx(sum(-2 * math.log(normal_tail(t)) for t in ts), rel=1e-4) and g.left == pytest.approx(sum(-2 * math.log(normal_tail(-t)) for t in ts), rel=1e-4)
        rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
        assert g.spearman == pytest.approx(np.corrcoef(rank([t for t, _ in used]), rank([s for _, s in used]))[0, 1], abs=1e-6)
    points = meta.funnel(fits).collect()
    assert len(points) == 24 and sum(p.inside for p in points) > 12


def test_likelihood(spark):
    fits = spark.createDataFrame(rows(), "study int, effect string, theta double, se double")
    for r in meta.likelihood(fits).collect():
        used = [(t, s) for k, x, t, s in rows() if x == r.effect and k < 50]
        t, s = (np.array(c) for c in zip(*used, strict=True))
        dev = lambda m, g: ((t - m) ** 2 / (g**2 + s**2) + np.log(g**2 + s**2)).sum()
        grid = min((dev(m, g), m, g) for m in np.linspace(-1, 2, 301) for g in np.linspace(0, 1.5, 151))
        assert dev(r.mu, r.sigma) <= grid[0] + 1e-6 and r.mu == pytest.approx(grid[1], abs=0.02)
        assert r.mu_low < r.mu < r.mu_high and r.sigma_low <= r.sigma <= r.sigma_high
        # At an interval's end the best spread leaves the deviance 3.84 above its least value.
        assert min(dev(r.mu_high, g) for g in np.linspace(0, 3, 3001)) == pytest.approx(dev(r.mu, r.sigma) + 3.841459, abs=1e-3)


def test_regression():
    r = np.random.default_rng(2)
    x, se = r.normal(size=60), r.uniform(0.1, 0.3, 60)
    y = 1 + 2 * x + se * r.normal(size=60)
    y[0] += 30
    got = meta.weighted_regression(y, x[:, None], se)
    assert got["beta"] == pytest.approx([1, 2], abs=0.3) and got["weights"][0] < got["weights"][1:].min()


def test_draws(spark):
    draws = spark.createDataFrame([(k, "a", float(k)) for k in range(101)], "draw int, effect string, value double")
    r = meta.draws_summary(draws).first()
    assert (r["mean"], r.low, r.high) == pytest.approx((50.0, 2.5, 97.5))
