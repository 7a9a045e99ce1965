"""Every effect of the catalogue against dense matrices, and the catalogue's own rules."""

import itertools
import os
import random
import sys

import numpy as np
import pytest

from tiewise.operators import effects
from tiewise.plans.features import SparkFeatures, mean_similarity
from tiewise.sources.panel import Panel

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

N, WAVES = 7, 4


def constants(x, w, z, v, d):
    wave = [np.array([[(t, a, b) in x for b in range(N)] for a in range(N)], float) for t in range(1, WAVES + 1)]
    pairs = N * (N - 1)
    zs = np.array(z, float)
    gap = lambda a: np.mean([abs(p - q) for k, p in enumerate(a) for m, q in enumerate(a) if k != m])
    zrange = zs.max() - zs.min()
    b0 = [sum(2 * k * (N - 1 - k) for m in wave[:-1] for k in m.sum(axis)) / ((WAVES - 1) * N * (N - 1) * (N - 2)) for axis in (0, 1)]
    return {
        "adx": len(x) / N / WAVES, "adw": len(w) / N / WAVES, "adr": sum((t, b, a) in x for t, a, b in x) / N / WAVES,
        "zmean": zs.mean(axis=1).mean(), "zrange": zrange, "zvar": zs.var(), "zsim": np.mean([1 - gap(row) / zrange for row in zs]),
        "vrange": max(v) - min(v), "vsim": 1 - gap(v) / (max(v) - min(v)), "dmean": sum(d.values()) / pairs, "b0": b0[0], "b0in": b0[1],
    }


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(5)
    draw = lambda p, n: {(t, a, b) for t in range(1, WAVES + 1) for a, b in itertools.permutations(range(n), 2) if r.random() < p}
    x, w = draw(0.45, N - 1), draw(0.35, N)  # actor N - 1 has no tie in x
    z = [[r.randint(1, 5) for _ in range(N)] for _ in range(WAVES)]
    v = [r.choice([-2.5, 0.0, 1.0, 3.25, 4.0]) for _ in range(N)]
    c = [r.randint(0, 2) for _ in range(N)]
    d = {(a, b): float(r.randint(1, 6)) for a, b in itertools.permutations(range(N), 2) if r.random() < 0.5}
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    panel = Panel(
        frame([(a,) for a in range(N)], "id int"), frame(sorted(x), "wave int, i int, j int"), frame(sorted(w), "wave int, i int, j int"),
        frame([(t + 1, a, z[t][a]) for t in range(WAVES) for a in range(N)], "wave int, id int, value int"), frame(list(enumerate(v)), "id int, value double"),
        frame(list(enumerate(c)), "id int, value int"), frame([(a, b, u) for (a, b), u in d.items()], "i int, j int, value double"), WAVES,
    )
    k = constants(x, w, z, v, d)
    matrix = lambda ties, t: np.array([[(t, a, b) in ties for b in range(N)] for a in range(N)], float)
    D = np.array([[d.get((a, b), 0.0) for b in range(N)] for a in range(N)])
    vc = np.array(v) - np.mean(v)
    periods = {
        t: lambda start=False, t=t: brute.Period(matrix(x, t), matrix(x, t if start else t + 1), matrix(w, t), D, vc, np.array(c), np.array(z[t - 1], float), np.array(z[t], float), k)
        for t in range(1, WAVES)
    }
    return panel, periods


@pytest.mark.parametrize("family", list(effects.FAMILIES))
def test_family_against_matrices(made, family):
    panel, periods = made
    got = {(r.period, r.effect): r.value for r in SparkFeatures(panel).sums(effects.FAMILIES[family]).collect()}
    assert len(got) == 3 * len(effects.FAMILIES[family])
    for t, period in periods.items():
        ties, actors = brute.network_effects(period()), brute.actor_effects(period())
        for e in effects.FAMILIES[family]:
            want = (ties if e.frame == "ties" else actors)[e.short]
            assert got[t, e.short] == pytest.approx(want, abs=2e-5, rel=1e-7), (t, e.short)


@pytest.mark.parametrize("family", effects.BY_TYPE)
def test_endowment_and_creation(made, family):
    panel, periods = made
    for kind in ("endow", "creation"):
        wanted, dependent = effects.of_type(effects.FAMILIES[family], kind)
        got = {(r.period, r.effect): r.value for r in SparkFeatures(panel, dependent).sums(wanted).collect()}
        for t, period in periods.items():
            start, end = period().S, period().X
            p = period(start=kind == "endow")
            ties = brute.network_effects(p, np.maximum(start - end, 0) if kind == "endow" else np.maximum(end - start, 0))
            for e in wanted:
                assert got[t, e.short] == pytest.approx(ties[e.short], abs=2e-5, rel=1e-7), (kind, t, e.short)


def test_catalogue_names():
    names = [e.short for f in effects.FAMILIES.values() for e in f]
    assert len(names) == len(set(names)) and effects.effect("totAltDist2").short == "totAltDist2"
    with pytest.raises(ValueError):
        effects.of_type(effects.FAMILIES["activity"], "endow")
    for name in effects.REFUSED:
        with pytest.raises(ValueError):
            effects.effect(name)


def test_mean_similarity(spark):
    r = random.Random(3)
    rows = [(k, r.choice([0.0, 1.5, r.random() * 10])) for k in (1, 2) for _ in range(300)]
    got = mean_similarity(spark.createDataFrame(rows, "wave int, value double"), ["wave"]).first()
    span = max(v for _, v in rows) - min(v for _, v in rows)
    pairs = [abs(a - b) for k in (1, 2) for x, a in enumerate([v for w, v in rows if w == k]) for y, b in enumerate([v for w, v in rows if w == k]) if x != y]
    assert got.range == pytest.approx(span) and got.sim == pytest.approx(1 - np.mean(pairs) / span)
    flat = mean_similarity(spark.createDataFrame([(2.0,), (2.0,)], "value double"), []).first()
    assert (flat.range, flat.sim) == (0.0, 0.0)
