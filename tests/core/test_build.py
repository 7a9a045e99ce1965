import numpy as np
import pytest

from tiewise.operators import effects
from tiewise.plans.features import SparkFeatures
from tiewise.sources import build

N = 6


def test_statistics_of_a_panel_with_missing_and_fixed_cells(spark):
    r = np.random.default_rng(5)
    waves = [r.choice([0, 0, 0, 1, 1, np.nan, 10, 11], size=(N, N)) for _ in range(3)]
    net = build.network(spark, waves)
    z = np.array([[1, 2, np.nan], [3, np.nan, 3], [2, 2, 4], [1, 1, 1], [4, 3, 2], [2, 1, 2]])
    v = [0.5, 2.0, np.nan, 1.0, 3.5, 2.0]
    panel = build.panel_of(net, values=build.behaviour(spark, z), covariate=build.covariate(spark, v), category=build.covariate(spark, [0, 1, 1, 0, 2, 2]), dyadic=build.dyadic(spark, r.random((N, N))))
    off = ~np.eye(N, dtype=bool)

    def ends(m):
        a, b = waves[m - 1], waves[m]
        x = np.where(np.isnan(a) | np.isnan(b), 0, b % 10)
        x = np.where(np.isin(b, (10, 11)), b % 10, x)
        x = np.where(np.isin(a, (10, 11)), a % 10, x)
        s = np.where(np.isnan(a) | np.isnan(b), 0, a % 10)
        return s * off, x * off

    want = {}
    centred = np.where(np.isnan(v), 0, np.array(v) - np.nanmean(v))
    for m in (1, 2):
        s, x = ends(m)
        want |= {(m, "density"): x.sum(), (m, "recip"): (x * x.T).sum(), (m, "newrecip"): (x * x.T * ((s + s.T) == 0)).sum(), (m, "egoX"): (x.sum(1) * centred).sum(), (m, "transTrip"): ((x @ x) * x * off).sum(), (m, "Rate"): abs(x - s).sum()}
    features = SparkFeatures(panel)
    got = {}
    for family in ("DEGREE", "CLOSURE", "COVARIATE", "RATE"):
        got |= {(q.period, q.effect): q.value for q in features.sums([e for e in getattr(effects, family) if (1, e.short) in want]).collect()}
    assert got == pytest.approx(want)
    assert features.sums([effects.effect("linear"), effects.effect("avAlt")]).count() == 4


def test_what_is_refused(spark):
    with pytest.raises(ValueError):
        build.network(spark, [[[0, 2], [0, 0]]])
    with pytest.raises(ValueError):
        build.network(spark, [np.zeros((2, 2)), np.zeros((3, 3))])
    two = build.network(spark, [np.eye(2, 3), np.zeros((2, 3))])
    two.check()
    assert two.receivers.count() == 3 and two.possible().first().pairs == 6
    with pytest.raises(ValueError):
        build.panel_of(two)
    bare = build.panel_of(build.network(spark, [np.zeros((3, 3)), 1 - np.eye(3)]))
    assert {r.effect: r.value for r in SparkFeatures(bare).sums([effects.effect("density")]).collect()} == {"density": 6.0}


def test_the_names_of_the_package():
    from tiewise import api

    assert {"network", "panel_of", "offered", "estimate", "wald", "combine", "selection_table", "as_latex"} <= set(api.__all__) and all(hasattr(api, n) for n in api.__all__)
