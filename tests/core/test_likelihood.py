"""Chains between observed waves: against all chains of a tiny panel, and on a panel made from known parameters."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from tiewise.operators import kernel, likelihood
from tiewise.operators.kernel import Rules, State, Term
from tiewise.operators.simulation import PeriodData


def pair_of(x0, x1, n):
    make = lambda x: State(np.array(x, float), np.ones(n, int), np.zeros((n, n)), np.zeros((n, n)), np.zeros(n), np.zeros(n, int))
    return PeriodData(1, make(x0), make(x1), Rules())


def test_moves_keep_the_distribution_of_chains():
    p = pair_of([[0, 0], [1, 0]], [[0, 1], [1, 0]], 2)
    terms = [Term("density", -0.5), Term("recip", 0.8)]
    weight = Counter()
    for size in range(1, 9):
        for steps in itertools.product([(0, 0), (0, 1), (1, 0), (1, 1)], repeat=size):
            if sum(s == (0, 1) for s in steps) % 2 == 1 and sum(s == (1, 0) for s in steps) % 2 == 0:
                if size <= 7:
                    weight[size] += math.exp(likelihood.log_likelihood(p.start, list(steps), terms, 1.0, Rules()))
    total = sum(weight.values())
    sampler = likelihood.Sampler(p, terms, 1.0, np.random.default_rng(4), likelihood.minimal_chain(p, np.random.default_rng(1)))
    seen = Counter()
    for k in range(30000):
        sampler.move()
        if k > 500:
            seen[len(sampler.steps)] += 1
            assert k % 500 or sampler.now == pytest.approx(likelihood.log_likelihood(p.start, sampler.steps, terms, 1.0, Rules()))
    n = sum(v for s, v in seen.items() if s <= 7)
    for size in range(1, 6):
        assert seen[size] / n == pytest.approx(weight[size] / total, abs=0.025), size
    assert all(sampler.accepted[m] > 0 for m in ("insert diagonal", "cancel diagonal", "permute", "insert pair", "delete pair"))


def test_chains_lead_from_start_to_end():
    r = np.random.default_rng(3)
    off = 1 - np.eye(8)
    p = pair_of((r.random((8, 8)) < 0.3) * off, (r.random((8, 8)) < 0.3) * off, 8)
    s = likelihood.Sampler(p, [Term("density", -0.5)], 3.0, r, likelihood.minimal_chain(p, r))
    for _ in range(300):
        s.move()
    x = p.start.x.copy()
    for i, j in s.steps:
        if i != j:
            x[i, j] = 1 - x[i, j]
    assert (x == p.end.x).all() and len(s.steps) >= p.distance
    first, second = s.scores()
    at = lambda d: likelihood.log_likelihood(p.start, s.steps, [Term("density", d)], 3.0, Rules())
    assert first[1] == pytest.approx((at(-0.5 + 1e-5) - at(-0.5 - 1e-5)) / 2e-5, rel=1e-4) and second[1, 1] == pytest.approx(-(at(-0.5 + 1e-4) - 2 * at(-0.5) + at(-0.5 - 1e-4)) / 1e-8, rel=1e-3)


def test_known_parameters_are_recovered(spark):
    r = np.random.default_rng(11)
    n, terms = 16, [Term("density", -1.2), Term("recip", 1.4)]
    start = pair_of(np.zeros((n, n)), np.zeros((n, n)), n).start
    start = kernel.simulate(start, terms, {"x": 20.0}, Rules(), r).end
    p = PeriodData(1, start, kernel.simulate(start, terms, {"x": 4.0}, Rules(), r).end, Rules())
    fit = likelihood.maximise(spark, p, [Term("density", -0.5), Term("recip", 0.5)], rounds=14, moves=80, burn=300)
    assert abs(fit.rate - 4.0) < 2.5 * fit.se[0] and (np.abs(fit.theta - [-1.2, 1.4]) < 2.5 * fit.se[1:]).all() and (fit.se < 1.5).all()
