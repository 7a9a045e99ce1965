"""Choices, simulation and estimation: brute force for what is exact, known parameters for what is random."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiewise.operators import choices, inference, kernel, reports
from tiewise.operators.estimation import Algorithm, Fit, derivative, estimate, gmom_covariance, rules_of, simulate_only, starting_density, starting_flow, starting_rates, starting_tendency
from tiewise.operators.kernel import Rules, State, Term
from tiewise.operators.simulation import PeriodData, chain_likelihood, chains, model_periods, simulated_behaviour, simulated_ties, simulations, targets
from tiewise.sources.panel import Panel

N = 9


def state(seed=1, n=N):
    r = np.random.default_rng(seed)
    x = (r.random((n, n)) < 0.35) * (1.0 - np.eye(n))
    w = (r.random((n, n)) < 0.3) * (1.0 - np.eye(n))
    v = r.normal(size=n)
    return State(x, r.integers(1, 6, n), w, r.normal(size=(n, n)) * (1 - np.eye(n)), v - v.mean(), r.integers(0, 3, n), 2.9, 1, 5, float(np.ptp(v)), 0.4, 0.55)


def test_contributions_are_differences_of_the_statistic():
    s = state()
    for short in kernel.NETWORK:
        term = Term(short)
        for i in (0, 4):
            got = kernel.tie_contributions(s, i, [term])[0]
            for j in range(N):
                t = s.copy()
                if i != j:
                    t.x[i, j] = 1 - t.x[i, j]
                mine = lambda a: kernel.NETWORK[short](a, i, a.x[i : i + 1])[0]  # noqa: E731, B023
                assert got[j] == pytest.approx(mine(t) - mine(s)), short
    for short in kernel.BEHAVIOUR:
        got = kernel.behaviour_contributions(s, 3, [Term(short, of="z")])[0]
        assert got[1] == 0 and np.isfinite(got).all()


def test_statistics_by_loops():
    s, e = state(1), state(2)
    e.w, e.d, e.v, e.c = s.w, s.d, s.v, s.c
    x, z = e.x, e.z
    two = sum(x[i, h] * x[h, j] * x[i, j] for i, h, j in itertools.product(range(N), repeat=3))
    names = ["density", "recip", "transTrip", "inPop", "altZ", "cycle3"]
    got = kernel.statistics(s, e, [*map(Term, names), Term("avAlt", of="z"), Term("Rate", kind="rate"), Term("outRate", kind="rate"), Term("density", kind="creation"), Term("density", kind="endow")])
    mean = lambda i: (s.x[i] @ (z - s.zmean)) / s.x[i].sum() if s.x[i].sum() else 0
    want = [
        x.sum(), sum(x[i, j] * x[j, i] for i in range(N) for j in range(N)), two, sum(x[i, j] * x[:, j].sum() for i in range(N) for j in range(N)), sum(x[i, j] * (s.z[j] - s.zmean) for i in range(N) for j in range(N)),
        sum(x[i, j] * x[j, h] * x[h, i] for i, h, j in itertools.product(range(N), repeat=3)) / 3, sum((z[i] - s.zmean) * mean(i) for i in range(N)), abs(x - s.x).sum(), (abs(x - s.x).sum(1) * s.x.sum(1)).sum(), ((x - s.x) > 0).sum(), ((s.x - x) > 0).sum(),
    ]
    assert got == pytest.approx(want)


def test_permitted_changes():
    s = state()
    allowed = lambda **k: kernel.permitted(s, 2, Rules(**k))
    has, w = s.x[2] > 0, s.w[2] > 0
    self_ = np.arange(N) == 2
    assert (allowed(up_only=True) == (~has | self_)).all() and (allowed(down_only=True) == (has | self_)).all()
    assert (allowed(higher=True) == (~(has & w) | self_)).all() and (allowed(disjoint=True) == (has | ~w | self_)).all()
    assert (allowed(at_least_one=True) == (~has | w | self_)).all() and (allowed(most_out=1) == (has | self_)).all()
    fixed = np.zeros((N, N), bool)
    fixed[2, 5] = True
    assert not allowed(fixed=fixed)[5]
    p, c = kernel.tie_probabilities(s, 2, [Term("density", -1.0), Term("recip", 2.0)], Rules(up_only=True))
    u = np.where(~has, -1.0 + 2 * s.x[:, 2], -np.inf)
    u[2] = 0
    assert p == pytest.approx(np.exp(u) / np.exp(u).sum())
    low = s.copy()
    low.z[0] = 1
    q, _ = kernel.behaviour_probabilities(low, 0, [Term("linear", 1.0, of="z")], Rules())
    assert q[0] == 0 and q[2] / q[1] == pytest.approx(math.e)


def test_scores_are_derivatives_of_the_chains_likelihood():
    s = state(3, 6)
    terms = [Term("Rate", 4.0, "rate"), Term("density", -0.4), Term("recip", 0.6)]
    run = kernel.simulate(s, terms, {"x": 4.0}, Rules(), np.random.default_rng(5), keep_chain=True)

    def log_likelihood(density):
        at, total = s.copy(), 0.0
        for _, _, i, j, _, _, diagonal in run.chain:
            p, _ = kernel.tie_probabilities(at, i, [Term("density", density), Term("recip", 0.6)], Rules())
            total += math.log(p[j])
            if not diagonal:
                at.x[i, j] = 1 - at.x[i, j]
        return total

    assert run.steps == len(run.chain) and run.scores[1] == pytest.approx((log_likelihood(-0.4 + 1e-5) - log_likelihood(-0.4 - 1e-5)) / 2e-5, rel=1e-4)
    assert run.scores[0] == pytest.approx(run.steps / 4.0 - 6 * run.time)


def test_stops_presence_and_symmetric_steps():
    s = state(4)
    run = kernel.simulate(s, [Term("density", -0.5)], {"x": 3.0}, Rules(), np.random.default_rng(1), distance=7)
    assert abs(run.end.x - s.x).sum() == 7
    present = np.tile([0.0, 1.0], (N, 1))
    present[0] = [0.0, 0.0]
    run = kernel.simulate(s, [Term("density", 0.5)], {"x": 6.0}, Rules(present=present), np.random.default_rng(1))
    assert (run.end.x[0] == s.x[0]).all() and (run.end.x[:, 0] == s.x[:, 0]).all() and run.time == 1.0
    sym = s.copy()
    sym.x = np.maximum(s.x, s.x.T)
    for model in ("forcing", "initiative"):
        run = kernel.simulate(sym, [Term("density", -0.3)], {"x": 4.0}, Rules(model=model), np.random.default_rng(2))
        assert (run.end.x == run.end.x.T).all() and (run.end.x != sym.x).any()
    with pytest.raises(ValueError):
        Term("unheardOf")


def periods_of(theta, rate, n=30, seed=3, waves=2):
    """A network grown from nothing under known parameters, then one more period of it."""
    r = np.random.default_rng(seed)
    s = state(seed, n)
    s.x[:] = 0
    terms = [Term("density", theta[0]), Term("recip", theta[1])]
    s = kernel.simulate(s, terms, {"x": 25.0}, Rules(), r).end
    out = []
    for k in range(1, waves):
        e = kernel.simulate(s, terms, {"x": rate}, Rules(), r).end
        out.append(PeriodData(k, s, e, Rules()))
        s = e
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    periods = periods_of((-1.3, 1.5), 4.0, waves=4)
    terms = [Term("density", starting_density(periods)), Term("recip", 0.0), Term("transTrip", 0.0)]
    rates = starting_rates(periods)
    return periods, terms, estimate(spark, periods, terms, algorithm=Algorithm(n3=300, nsub=2, conditional=True), rates=rates, fixed=(2,))


def test_estimates_recover_known_parameters(fitted):
    periods, terms, fit = fitted
    assert np.abs(fit.t_ratios[:2]).max() < 0.3 and fit.theta[2] == 0
    for got, want, se in zip(fit.theta, (-1.3, 1.5), fit.se, strict=False):
        assert 0.02 < se < 0.6 and abs(got - want) < 2 * se
    assert fit.coef()["x.eval.recip"] == fit.theta[1] and fit.vcov().shape == (3, 3)


def test_hypothesis_tests(fitted):
    _, _, fit = fitted
    wald = inference.wald(fit, np.eye(3)[[1]])
    assert wald["chi2"] == pytest.approx((fit.theta[1] / fit.se[1]) ** 2) and wald["p"] < 0.01
    assert inference.several(fit, [0, 1])["df"] == 2 and inference.same(fit, [0], [1])["p"] < 0.01
    score = inference.score_test(fit, [2])
    assert score["df"] == 1 and score["p"] > 0.001 and len(score["one_step"]) == 1
    time = inference.time_test(fit, [0, 1])
    assert time["joint"]["df"] == 4 and 0 <= time["joint"]["p"] <= 1 and set(time["by_effect"]) == {0, 1} and set(time["by_period"]) == {1, 2}


def test_tails():
    assert inference.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and inference.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert inference.chi2_tail(0, 3) == 1 and inference.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert inference.chi2_tail(7.0, 1) == pytest.approx(2 * inference.normal_tail(math.sqrt(7)), rel=1e-9)


def test_simulations_do_not_depend_on_partitions(spark):
    periods = periods_of((-1.0, 1.0), 2.0, n=10, waves=3)
    terms = [Term("density", -1.0), Term("recip", 1.0), Term("linear", 0.2, of="z"), Term("avSim", 0.5, of="z")]
    rates = starting_rates(periods, ("x", "z"))
    one, many = (sorted((r.sim, r.period, tuple(r.stats), tuple(r.ties), tuple(r.z)) for r in simulations(spark, periods, terms, rates, 6, partitions=p).collect()) for p in (1, 5))
    assert one == many and len(one) == 12 and len({s for _, _, s, _, _ in one}) > 6
    sims = simulations(spark, periods, terms, rates, 3)
    row = sims.where("sim = 0 and period = 1").first()
    assert {(r.i, r.j) for r in simulated_ties(sims, 10).where("sim = 0 and period = 1").collect()} == {divmod(c, 10) for c in row.ties}
    assert simulated_behaviour(sims).count() == 60
    chain = chains(spark, periods, terms, rates, 2).persist()
    ll = {(r.sim, r.period): r.log_likelihood for r in chain_likelihood(chain).collect()}
    first = chain.where("sim = 0 and period = 1").collect()
    assert ll[0, 1] == pytest.approx(sum(math.log(r.rate_share) + math.log(r.choice_p) for r in first))
    grid = simulate_only(spark, periods, terms[:2], [[-2.0, 0.0], [0.0, 0.0]], 4)
    mean = {r.point: r.m for r in grid.groupBy("point").agg(F.avg(F.col("stats")[0]).alias("m")).collect()}
    assert mean[0] < mean[1]


def test_derivatives_and_generalised_moments():
    r = np.random.default_rng(1)
    scores = r.normal(size=(4000, 1, 2))
    stats = scores @ np.array([[2.0, 0.5], [0.0, 3.0]]) + 0.1 * r.normal(size=(4000, 1, 2))
    assert derivative(stats, scores) == pytest.approx(np.array([[2.0, 0.0], [0.5, 3.0]]), abs=0.2)
    weights, cov = gmom_covariance(np.array([[1.0], [1.0]]), np.diag([1.0, 4.0]))
    assert weights[0] == pytest.approx([0.8, 0.2]) and cov[0, 0] == pytest.approx(0.8)


def small_panel(spark, n=6, waves=3):
    r = random.Random(2)
    draw = lambda p: [(w, i, j) for w in range(1, waves + 1) for i, j in itertools.permutations(range(n), 2) if r.random() < p]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    x, w = draw(0.4), draw(0.3)
    z = [(t, i, r.randint(1, 4)) for t in range(1, waves + 1) for i in range(n)]
    v, c = [(i, float(r.randint(0, 9))) for i in range(n)], [(i, i % 2) for i in range(n)]
    return Panel(frame([(i,) for i in range(n)], "id int"), frame(x, "wave int, i int, j int"), frame(w, "wave int, i int, j int"), frame(z, "wave int, id int, value int"), frame(v, "id int, value double"), frame(c, "id int, value int"), frame([(0, 1, 2.0)], "i int, j int, value double"), waves)


def test_choice_frames_against_the_kernel(spark):
    panel = small_panel(spark)
    periods = model_periods(panel)
    names = ["density", "recip", "transTrip", "transMedTrip", "cycle3", "inPop", "outPop", "altX", "egoX", "egoXaltX", "diffSqX", "simX", "sameX", "crprod"]
    got = {(r.period, r.i, r.j): r for r in choices.contributions(panel, names).collect()}
    theta = {"density": -0.7, "recip": 0.8, "transTrip": 0.3, "simX": 0.5}
    p = {(r.period, r.i, r.j): r.p for r in choices.probabilities(panel, theta).collect()}
    moved = {(r.period, r.effect): r for r in choices.importance(panel, theta).collect()}
    terms = [Term(k, t) for k, t in theta.items()]
    for q in periods:
        shares = []
        for i in range(6):
            want = kernel.tie_contributions(q.start, i, [Term(n) for n in names])
            full, _ = kernel.tie_probabilities(q.start, i, terms, Rules())
            shares.append(inference.importance_of(q, terms, list(range(4)), i))
            for j in range(6):
                assert [got[q.period, i, j][n] for n in names] == pytest.approx(want[:, j].tolist(), abs=1e-9), (i, j)
                assert p[q.period, i, j] == pytest.approx(full[j], abs=1e-6)
        for k, name in enumerate(theta):
            assert moved[q.period, name].importance == pytest.approx(np.mean([s[k][3] for s in shares]), abs=1e-6)
    steps = {(r.period, r.id, r.step): r.p for r in choices.behaviour_choices(panel, 0.2, -0.1, 0.6).collect()}
    for q in periods:
        for i in range(6):
            want, _ = kernel.behaviour_probabilities(q.start, i, [Term("linear", 0.2, of="z"), Term("quad", -0.1, of="z"), Term("avSim", 0.6, of="z")], Rules())
            assert [steps.get((q.period, i, d), 0.0) for d in (-1, 0, 1)] == pytest.approx(want.tolist(), abs=1e-6)
    some = inference.relative_importance(spark, periods, terms).collect()
    assert len(some) == 2 * 6 * 4


def test_goodness_of_fit_over_simulations(spark):
    periods = periods_of((-1.2, 1.2), 3.0, n=12, waves=2)
    terms = [Term("density", -1.2), Term("recip", 1.2)]
    sims = simulations(spark, periods, terms, [{"x": 3.0}], 40)
    ties = simulated_ties(sims, 12)
    counts = inference.degree_counts(ties, 12, "out")
    first = periods[0].end.x
    seen = spark.createDataFrame([(0, 1, int(i), int(j)) for i, j in zip(*np.nonzero(first), strict=True)], "sim long, period int, i int, j int")
    observed = inference.degree_counts(seen, 12, "out").drop("sim")
    assert {r.key: r.value for r in observed.collect()} == {k: float((first.sum(1) <= k).sum()) for k in range(9)}
    found = inference.fit_of(counts, observed)
    assert 0 <= found["p"] <= 1 and found["distance"] >= 0
    odd = observed.withColumn("value", F.col("value") * 0)
    assert inference.fit_of(counts, odd)["p"] <= found["p"]
    q = {r.key: r for r in inference.quantiles(counts).collect()}
    assert q[8].min <= q[8].q50 <= q[8].max
    along = inference.importance_along(spark, periods, terms, [{"x": 3.0}], 3, intervals=2).collect()
    assert {r.interval for r in along} == {0, 1} and all(0 <= r.importance <= 1 for r in along)


def test_one_step_distance():
    r = np.random.default_rng(3)
    scores = r.normal(size=(500, 2))
    stats = scores @ np.array([[1.0, 0.3], [0.0, 1.0]]) + 0.05 * r.normal(size=(500, 2))
    fit = Fit([Term("density"), Term("recip")], np.zeros(2), np.eye(2), np.array([[1.0, 0.0], [0.3, 1.0]]), np.array([0.0, 0.4]), stats, scores, [], 0)
    aux = stats[:, [1]] * 2 + 0.1 * r.normal(size=(500, 1))
    got = inference.one_step_distance(fit, aux, np.array([0.8]), 1)
    assert got["step"] > 0 and got["expected"] < got["distance"]


def test_mixed_triads(spark):
    r = random.Random(6)
    ties = {(i, j) for i, j in itertools.permutations(range(7), 2) if r.random() < 0.3}
    events = {(i, h) for i in range(7) for h in range(5) if r.random() < 0.4}
    got = {x.triad: x.n for x in inference.mixed_triad_census(spark.createDataFrame(sorted(ties), "i int, j int"), spark.createDataFrame(sorted(events), "i int, h int"), spark.createDataFrame([(i,) for i in range(7)], "id int")).collect()}
    want = {f"{a}{b}": 0 for a in range(3) for b in range(3)}
    receivers = {h for _, h in events}
    for p, q in itertools.combinations(range(7), 2):
        for h in receivers:
            want[f"{((p, q) in ties) + ((q, p) in ties)}{((p, h) in events) + ((q, h) in events)}"] += 1
    assert got == want


def test_tables(spark):
    values = spark.createDataFrame([(1,), (2,), (4,)], "value int")
    numbers = {"mean": 2.0, "range": 3.0, "sim": 0.4}
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    table = inference.selection_table(spark, values, {"altX": 0.5, "simX": 1.0}, numbers, cov)
    row = {(r.ego, r.alter): r for r in table.collect()}
    c = [4 - 2.0, 1 - 3 / 3 - 0.4]
    assert row[1.0, 4.0].contribution == pytest.approx(0.5 * c[0] + c[1]) and row[1.0, 4.0].se == pytest.approx(math.sqrt(np.array(c) @ cov @ np.array(c)))
    best = {r.ego: r.alter for r in inference.table_maximum(table).collect()}
    assert best == {e: max((1.0, 2.0, 4.0), key=lambda a: row[e, a].contribution) for e in (1.0, 2.0, 4.0)}
    got = {(r.ego, r.alter): r.contribution for r in inference.influence_table(spark, values, {"linear": 0.3, "avAlt": 0.2}, numbers).collect()}
    assert got[4.0, 1.0] == pytest.approx(0.3 * 2 + 0.2 * 2 * -1)
    with pytest.raises(ValueError):
        inference.selection_table(spark, values, {"nothing": 1.0}, numbers)


def test_settings_second_steps_and_pairs():
    s = state(4)
    mask = np.zeros((N, N), bool)
    mask[:, :3] = True
    run = kernel.simulate(s, [Term("density", 0.0)], {"x": 6.0}, Rules(settings=((1.0, mask),)), np.random.default_rng(1))
    assert (run.end.x[:, 3:] == s.x[:, 3:]).all() and (run.end.x != s.x).any()
    run = kernel.simulate(s, [Term("density", 0.0)], {"x": 6.0}, Rules(settings=((0.5, "universal"), (0.5, "primary"))), np.random.default_rng(1), keep_chain=True)
    assert run.steps == len(run.chain)
    run = kernel.simulate(s, [Term("density", 0.0)], {"x": 6.0}, Rules(again=1.0), np.random.default_rng(1), keep_chain=True)
    assert len(run.chain) == 2 * run.steps and all(a[2] == b[2] for a, b in zip(run.chain[::2], run.chain[1::2], strict=True))
    sym = s.copy()
    sym.x = np.maximum(s.x, s.x.T)
    for model in ("pairwise forcing", "pairwise mutual", "pairwise joint"):
        run = kernel.simulate(sym, [Term("Rate", 1.0, "rate"), Term("density", -0.3)], {"x": 1.0}, Rules(model=model), np.random.default_rng(2))
        assert (run.end.x == run.end.x.T).all() and run.steps > 20 and run.scores[0] == pytest.approx(2 * run.steps - 2 * 81 * run.time)
        terms = lambda d: [Term("density", d), Term("transTrip", 0.2)]
        p, slope = kernel.pair_probability(sym, 0, 5, terms(-0.3), model)
        up, down = (kernel.pair_probability(sym, 0, 5, terms(-0.3 + e), model)[0] for e in (1e-6, -1e-6))
        assert slope[0][0] == pytest.approx((math.log(up) - math.log(down)) / 2e-6, rel=1e-4) and slope[1][0] == pytest.approx((math.log(1 - up) - math.log(1 - down)) / 2e-6, rel=1e-4)
    for bad in (dict(model="none"), dict(again=2.0), dict(settings=((0.4, "primary"),))):
        with pytest.raises(ValueError):
            Rules(**bad)
    low = s.copy()
    low.z[0] = 1
    q, _ = kernel.behaviour_probabilities(low, 0, [Term("linear", 1.0, of="z")], Rules(absorbing=True))
    assert q[0] == 0 and q[2] / q[1] == pytest.approx(math.e / 2)


def test_information_is_the_second_derivative():
    s, terms = state(6), lambda d: [Term("density", d), Term("recip", 0.4)]
    p, c = kernel.tie_probabilities(s, 1, terms(-0.5), Rules())
    score = lambda d: (lambda q: q[1][:, 3] - q[1] @ q[0])(kernel.tie_probabilities(s, 1, terms(d), Rules()))
    assert -(score(-0.5 + 1e-5) - score(-0.5 - 1e-5)) / 2e-5 == pytest.approx(kernel.information(c, p)[0], rel=1e-4)


def test_flow_of_a_continuous_variable():
    s = state(1)
    flow = kernel.Flow(-0.7, np.array([0.5, 0.3]), 0.4, lambda s, y: np.c_[np.ones(s.n), s.v])
    y0 = np.linspace(-1, 1, N)
    one, y = flow.step(s, y0, 1.0, None), y0
    for _ in range(1000):
        y = y + (-0.7 * y + 0.5 + 0.3 * s.v) / 1000
    assert np.abs(one - y).max() < 1e-3 and flow.step(s, flow.step(s, y0, 0.4, None), 0.6, None) == pytest.approx(one)
    ends = np.array([kernel.simulate(s, [Term("density", -0.5)], {"x": 2.0}, Rules(), np.random.default_rng(k), flow=flow, y=y0).y for k in range(300)])
    assert np.abs(ends.mean(0) - one).max() < 0.1 and ends.std(0).mean() == pytest.approx(0.4 * math.sqrt((1 - math.exp(-1.4)) / 1.4), rel=0.1)
    r, waves = np.random.default_rng(1), [np.full(4000, 0.5)]
    still = kernel.Flow(-0.7, np.array([0.5]), 0.4, lambda s, y: np.ones((len(y), 1)))
    for _ in range(3):
        waves.append(still.step(None, waves[-1], 1.0, r))
    got = starting_flow(np.array(waves[1:]))
    assert (got["a"], got["b"], got["g"]) == pytest.approx((-0.7, 0.5, 0.4), abs=0.1)


def test_likelihood_ratios_of_chains():
    s, old, new = state(3, 6), [Term("density", -0.4), Term("recip", 0.6)], [Term("density", -0.3), Term("recip", 0.6)]
    runs = [kernel.simulate(s, old, {"x": 3.0}, Rules(), np.random.default_rng(k), keep_chain=True) for k in range(200)]
    before = np.array([kernel.replay(s, r.chain, old, {"x": 3.0}, Rules()) for r in runs])
    assert before == pytest.approx([sum(math.log(c[4]) + math.log(c[5]) for c in r.chain) for r in runs])
    after = np.array([kernel.replay(s, r.chain, new, {"x": 3.0}, Rules()) for r in runs])
    found = inference.likelihood_ratio(before, after)
    # Averaged over what the old parameters make, a likelihood ratio is one.
    assert abs(found["log_ratio"]) < 4 * found["se"] + 1e-9 and 50 < found["effective"] <= 200
    assert inference.path_ratio(np.array([[0.0], [1.0], [3.0]]), np.array([[2.0], [4.0], [6.0]])) == 3.0 + 10.0


def test_rules_and_starting_values_of_data():
    s = state(2)
    e = s.copy()
    e.x = np.maximum(e.x, (np.random.default_rng(1).random((N, N)) < 0.2) * (1 - np.eye(N)))
    e.z = np.maximum(s.z - 1, 1)
    s.w = e.w = s.x * (np.random.default_rng(2).random((N, N)) < 0.5)
    periods = [PeriodData(1, s, e, Rules())]
    found = rules_of(periods)
    assert found.higher and found.up_only and found.z_down_only and not found.disjoint and not found.down_only
    assert not rules_of(periods, override={"up_only": False}).up_only and starting_tendency(periods) < 0


def test_reports(spark, fitted, tmp_path):
    _, _, fit = fitted
    assert "recip" in reports.as_text(fit) and reports.as_text(fit).count("fixed") == 1
    assert reports.as_latex(fit).count("&") == 5 * 4 and reports.as_html(fit).count("<tr>") == 4
    for kind in ("csv", "json"):
        reports.write(fit.table(spark), f"{tmp_path}/{kind}", kind)
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 3
    with pytest.raises(ValueError):
        reports.write(fit.table(spark), f"{tmp_path}/x", "xls")
