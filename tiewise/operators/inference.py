"""Tests about fitted parameters, goodness of fit over simulations, and interpretation of a fit."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewise.operators.estimation import Fit
from tiewise.operators.kernel import Term, behaviour_probabilities, softmax, tie_probabilities, permitted
from tiewise.operators.simulation import PeriodData, _seeded


def normal_tail(z: float) -> float:
    """P(N > z)"""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees of freedom > x), by the series or the continued fraction of the incomplete gamma function."""
    if x <= 0 or df <= 0:
        return 1.0
    a, y = df / 2, x / 2
    scale = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = y + 1 - a, 1e300
    d = h = 1 / b
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def wald(fit: Fit, a: np.ndarray, value: np.ndarray | float = 0.0) -> dict[str, float]:
    """Test of A theta = value: statistic, degrees of freedom, p."""
    a = np.atleast_2d(np.asarray(a, float))
    gap = a @ fit.theta - value
    chi = float(gap @ np.linalg.pinv(a @ fit.covariance @ a.T) @ gap)
    df = int(np.linalg.matrix_rank(a))
    return {"chi2": chi, "df": df, "p": chi2_tail(chi, df)}


def several(fit: Fit, places: list[int]) -> dict[str, float]:
    """Test that the parameters at some places are all 0."""
    return wald(fit, np.eye(len(fit.theta))[places])


def same(fit: Fit, left: list[int], right: list[int]) -> dict[str, float]:
    """Test that parameters at `left` equal those at `right`, one by one."""
    unit = np.eye(len(fit.theta))
    return wald(fit, unit[left] - unit[right])


def score_test(fit: Fit, tested: list[int]) -> dict:
    """Score test of parameters that were fixed in the fit, jointly and one by one, with one-step estimates.

    The tested statistics' deviations are made orthogonal to those of the estimated parameters.
    """
    k = len(fit.theta)
    rest = [i for i in range(k) if i not in tested]
    d, s = fit.derivative, np.atleast_2d(np.cov(fit.simulated, rowvar=False))
    gap = fit.simulated.mean(0) - fit.target
    b = d[np.ix_(tested, rest)] @ np.linalg.pinv(d[np.ix_(rest, rest)]) if rest else np.zeros((len(tested), 0))
    turn = np.zeros((len(tested), k))
    turn[:, tested], turn[:, rest] = np.eye(len(tested)), -b
    g, v = turn @ gap, turn @ s @ turn.T
    joint = float(g @ np.linalg.pinv(v) @ g)
    step = -np.linalg.pinv(turn @ d[:, tested]) @ g
    one = [{"chi2": float(x * x / y) if y > 0 else 0.0, "z": float(-x / math.sqrt(y)) if y > 0 else 0.0} for x, y in zip(g, np.diag(v), strict=True)]
    for o in one:
        o["p"] = chi2_tail(o["chi2"], 1)
    return {"chi2": joint, "df": len(tested), "p": chi2_tail(joint, len(tested)), "each": one, "one_step": (fit.theta[tested] + step).tolist()}


def time_test(fit: Fit, places: list[int]) -> dict:
    """Time heterogeneity: score tests of a period dummy for each period but the first times each effect at `places`.

    Moments are the statistics of the periods apart; a dummy's parameter moves its own period only.
    """
    stats, scores = fit.by_period, None
    n, periods, k = stats.shape
    if periods < 2:
        raise ValueError("one period only: nothing to compare")
    dummies = [(m, e) for m in range(1, periods) for e in places]
    every = np.concatenate([stats.sum(1), *(stats[:, m, [e]] for m, e in dummies)], axis=1)
    target = np.concatenate([fit.target, [fit.targets[m, e] for m, e in dummies]])
    # The response to a dummy is that of its period, which a regression on the period's statistics' spread scales.
    spread = np.cov(every, rowvar=False)
    share = [np.cov(stats[:, m], rowvar=False) for m in range(periods)]
    whole = np.sum(share, axis=0)
    part = [np.linalg.pinv(np.atleast_2d(whole)) @ np.atleast_2d(x) for x in share]
    d = np.zeros((len(target), len(target)))
    d[:k, :k] = fit.derivative
    for a, (m, e) in enumerate(dummies, k):
        own = fit.derivative @ part[m]
        d[:k, a], d[a, :k] = own[:, e], own[e]
        for b, (m2, e2) in enumerate(dummies, k):
            d[a, b] = own[e, e2] if m == m2 else 0.0
    wide = Fit([*fit.terms, *(fit.terms[e] for _, e in dummies)], np.concatenate([fit.theta, np.zeros(len(dummies))]), spread, d, target, every, np.empty(0), fit.rates, fit.iterations)
    at = list(range(k, k + len(dummies)))
    joint = score_test(wide, at)
    by_effect = {e: score_test(wide, [k + i for i, (_, f) in enumerate(dummies) if f == e]) for e in places}
    by_period = {m: score_test(wide, [k + i for i, (q, _) in enumerate(dummies) if q == m]) for m in range(1, periods)}
    return {"joint": joint, "by_effect": by_effect, "by_period": by_period, "dummies": dummies}


def likelihood_ratio(old: np.ndarray, new: np.ndarray) -> dict[str, float]:
    """Log of the mean of exp(new - old) over chains drawn under the old parameters, its standard error, and how many chains it rests on."""
    gap = np.asarray(new, float) - np.asarray(old, float)
    top = gap.max()
    w = np.exp(gap - top)
    mean = w.mean()
    return {"log_ratio": float(np.log(mean) + top), "se": float(w.std(ddof=1) / mean / math.sqrt(len(w))), "effective": float(w.sum() ** 2 / (w**2).sum())}


def path_ratio(points: np.ndarray, scores: np.ndarray) -> float:
    """Log-likelihood ratio between the ends of a path of parameter vectors, from mean scores at its points (points by terms), by the trapezoid rule."""
    step = np.diff(np.asarray(points, float), axis=0)
    return float(((scores[:-1] + scores[1:]) / 2 * step).sum())


def fit_of(statistics: DataFrame, observed: DataFrame, *, two_sided: bool = False) -> dict[str, float]:
    """Monte-Carlo test over simulations: statistics (sim, key, value) against observed (key, value).

    Keys that a simulation lacks count 0. One row a simulation and key comes to the driver, some hundreds of keys.
    """
    from tiewise.operators.goodness import monte_carlo_test

    keys = sorted({r.key for r in observed.select("key").distinct().collect()} | {r.key for r in statistics.select("key").distinct().collect()})
    at = {k: i for i, k in enumerate(keys)}
    rows = statistics.groupBy("sim", "key").agg(F.sum("value").alias("value")).collect()
    sims = {s: i for i, s in enumerate(sorted({r.sim for r in rows}))}
    matrix = np.zeros((len(sims), len(keys)))
    for r in rows:
        matrix[sims[r.sim], at[r.key]] = r.value
    seen = np.zeros(len(keys))
    for r in observed.groupBy("key").agg(F.sum("value").alias("value")).collect():
        seen[at[r.key]] = r.value
    return monte_carlo_test(matrix, seen, two_sided=two_sided)


def quantiles(statistics: DataFrame, shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(key, min, max, mean, sd and a column for each share) of a statistic over simulations."""
    q = F.percentile("value", F.array(*map(F.lit, shares)))
    out = statistics.groupBy("key").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"))
    return out.select("key", "min", "max", "mean", "sd", *(F.col("q")[i].alias(f"q{round(100 * s)}") for i, s in enumerate(shares)))


def degree_counts(ties: DataFrame, actors: int, direction: str, levels: tuple[int, ...] = tuple(range(9))) -> DataFrame:
    """(sim, key, value): actors with at most `key` ties out or in, of simulated ties (sim, period, i, j), all periods added."""
    end = {"out": "i", "in": "j"}[direction]
    degree = ties.groupBy("sim", "period", end).agg(F.count(F.lit(1)).alias("k"))
    counts = degree.groupBy("sim", "period").agg(F.count(F.lit(1)).alias("any"), *(F.count_if(F.col("k") <= q).alias(f"c{q}") for q in levels))
    rows = F.explode(F.array(*(F.struct(F.lit(q).alias("key"), (F.col(f"c{q}") + F.lit(actors) - F.col("any")).cast("double").alias("value")) for q in levels)))
    return counts.select("sim", "period", rows.alias("r")).groupBy("sim", F.col("r.key").alias("key")).agg(F.sum("r.value").alias("value"))


def one_step_distance(fit: Fit, statistics: np.ndarray, observed: np.ndarray, tested: int) -> dict[str, float]:
    """Distance of auxiliary statistics (simulations by keys) now, and as expected if the fixed effect at `tested` got its one-step estimate."""
    from tiewise.operators.goodness import monte_carlo_test

    delta = score_test(fit, [tested])["one_step"][0] - fit.theta[tested]
    g = fit.scores[:, tested] - fit.scores[:, tested].mean()
    shift = (statistics - statistics.mean(0)).T @ g / (len(g) - 1) * delta
    now = monte_carlo_test(statistics, observed)["distance"]
    return {"distance": now, "expected": monte_carlo_test(statistics + shift, observed)["distance"], "step": float(delta)}


def mixed_triad_census(ties: DataFrame, affiliations: DataFrame, actors: DataFrame) -> DataFrame:
    """(triad, n): pairs of actors by their tie (0 none, 1 one way, 2 mutual) and, for every shared receiver in a
    two-mode network, how many of both are tied to it (0, 1, 2), of all pairs and receivers: names such as "21".

    ties (i, j) among actors (id); affiliations (i, h) with receivers numbered apart. Pairs without any
    affiliation follow from the totals, so the work grows with the ties.
    """
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    dyads = ties.where("i <> j").groupBy(lo.alias("p"), hi.alias("q")).agg(F.count(F.lit(1)).alias("k"))
    size = actors.count()
    receivers = affiliations.select("h").distinct().count()
    degree = affiliations.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("a"))
    shared = affiliations.alias("a").join(affiliations.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.i") < F.col("b.i"))).groupBy(F.col("a.i").alias("p"), F.col("b.i").alias("q")).agg(F.count(F.lit(1)).alias("both"))
    linked = (
        dyads.join(shared, ["p", "q"], "left").fillna(0, ["both"])
        .join(degree.select(F.col("id").alias("p"), F.col("a").alias("ap")), "p", "left").join(degree.select(F.col("id").alias("q"), F.col("a").alias("aq")), "q", "left").fillna(0, ["ap", "aq"])
        .groupBy("k").agg(F.count(F.lit(1)).alias("pairs"), F.sum("both").alias("two"), F.sum(F.col("ap") + F.col("aq") - 2 * F.col("both")).alias("one"))
    )
    totals = shared.agg(F.coalesce(F.sum("both"), F.lit(0)).alias("two")).first().two, (degree.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("s")).first().s)
    every_two, every_one = int(totals[0]), int(totals[1]) * (size - 1) - 2 * int(totals[0])
    found = {r.k: (r.pairs, r.two, r.one) for r in linked.collect()}  # two rows at most
    rows, left = [], [size * (size - 1) // 2, every_two, every_one]
    for k in (1, 2):
        pairs, two, one = found.get(k, (0, 0, 0))
        rows += [(f"{k}2", int(two)), (f"{k}1", int(one)), (f"{k}0", int(pairs * receivers - two - one))]
        left = [left[0] - pairs, left[1] - two, left[2] - one]
    rows += [("02", int(left[1])), ("01", int(left[2])), ("00", int(left[0] * receivers - left[1] - left[2]))]
    return ties.sparkSession.createDataFrame(rows, "triad string, n long")


def relative_importance(spark: SparkSession, periods: list[PeriodData], terms: list[Term]) -> DataFrame:
    """(period, ego, effect, importance, entropy, sd): how far each actor's choice distribution moves when one effect is left out.

    The observed state at the start of each period; distances are sums of absolute differences, shared out to
    add up to one. Entropy is that of the full distribution, over its largest value; sd that of the effect's
    contributions over permitted choices. One row a period, actor and effect.
    """
    places = [k for k, t in enumerate(terms) if t.kind != "rate"]
    schema = "period int, ego int, effect string, importance double, entropy double, sd double"

    def rows(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for m, ego in zip(frame["m"], frame["ego"], strict=True):
                out += importance_of(periods[m], terms, places, int(ego))
            yield pd.DataFrame(out, columns=["period", "ego", "effect", "importance", "entropy", "sd"])

    egos = [(m, i) for m, p in enumerate(periods) for i in range(p.start.n)]
    return spark.createDataFrame(egos, "m int, ego int").repartition(spark.sparkContext.defaultParallelism).mapInPandas(rows, schema)


def importance_of(p: PeriodData, terms: list[Term], places: list[int], ego: int) -> list[tuple]:
    theta = np.array([t.theta for t in terms])
    out = []
    for of in ("x", "z"):
        own = [k for k in places if terms[k].of == of]
        if not own:
            continue
        if of == "x":
            full, c = tie_probabilities(p.start, ego, terms, p.rules)
            ok = permitted(p.start, ego, p.rules)
        else:
            full, c = behaviour_probabilities(p.start, ego, terms, p.rules)
            ok = full > 0
        moved = np.array([np.abs(full - softmax((theta * (np.arange(len(theta)) != k)) @ c, ok)).sum() for k in own])
        entropy = float(-(full[full > 0] * np.log(full[full > 0])).sum() / np.log(ok.sum())) if ok.sum() > 1 else 0.0
        shares = moved / moved.sum() if moved.sum() > 0 else np.zeros(len(own))
        for k, s in zip(own, shares, strict=True):
            out.append((p.period, ego, f"{of}.{terms[k].kind}.{terms[k].short}", float(s), entropy, float(c[k][ok].std(ddof=1)) if ok.sum() > 1 else 0.0))
    return out


def importance_along(spark: SparkSession, periods: list[PeriodData], terms: list[Term], rates: list[dict[str, float]], n_sims: int, intervals: int = 10, *, seed: int = 1) -> DataFrame:
    """(period, interval, effect, importance): the acting actors' relative importances along simulated chains, averaged by interval of the steps."""
    from tiewise.operators import kernel

    places = [k for k, t in enumerate(terms) if t.kind != "rate"]
    schema = "sim long, period int, step int, steps int, effect string, importance double"

    def rows(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for sim in frame["id"]:
                for p, rate in zip(periods, rates, strict=True):
                    run = kernel.simulate(p.start, terms, rate, p.rules, _seeded(seed, int(sim), p.period), keep_chain=True)
                    state = p.start.copy()
                    for step, var, ego, alter, _, _, diagonal in run.chain:
                        at = PeriodData(p.period, state, p.end, p.rules)
                        out += [(int(sim), p.period, step, len(run.chain), e, s) for _, _, e, s, _, _ in importance_of(at, terms, [k for k in places if terms[k].of == var], ego)]
                        if not diagonal:
                            if var == "x":
                                state.x[ego, alter] = 1 - state.x[ego, alter]
                            else:
                                state.z[ego] += alter
            yield pd.DataFrame(out, columns=["sim", "period", "step", "steps", "effect", "importance"])

    steps = spark.range(0, n_sims, 1, min(n_sims, spark.sparkContext.defaultParallelism)).mapInPandas(rows, schema)
    interval = F.least(F.floor((F.col("step") - 1) * intervals / F.col("steps")), F.lit(intervals - 1)).cast("int")
    return steps.groupBy("period", interval.alias("interval"), "effect").agg(F.avg("importance").alias("importance"))


#: How an effect of an actor covariate or behaviour counts a tie from ego's value to alter's, by short name.
_SELECTION = {
    "egoX": lambda e, a, q: e - q["mean"], "altX": lambda e, a, q: a - q["mean"], "altSqX": lambda e, a, q: (a - q["mean"]) * (a - q["mean"]), "egoSqX": lambda e, a, q: (e - q["mean"]) * (e - q["mean"]),
    "egoXaltX": lambda e, a, q: (e - q["mean"]) * (a - q["mean"]), "diffX": lambda e, a, q: a - e, "absDiffX": lambda e, a, q: F.abs(a - e), "diffSqX": lambda e, a, q: (a - e) * (a - e),
    "simX": lambda e, a, q: 1 - F.abs(a - e) / q["range"] - q["sim"], "sameX": lambda e, a, q: (a == e).cast("double"), "higher": lambda e, a, q: F.when(e > a, 1.0).when(e == a, 0.5).otherwise(0.0),
}
#: The same of influence: what ego's value counts with alters' mean value a.
_INFLUENCE = {
    "linear": lambda e, a, q: e - q["mean"], "quad": lambda e, a, q: (e - q["mean"]) * (e - q["mean"]), "avAlt": lambda e, a, q: (e - q["mean"]) * (a - q["mean"]), "totAlt": lambda e, a, q: (e - q["mean"]) * (a - q["mean"]) * q["alters"],
    "avSim": lambda e, a, q: 1 - F.abs(a - e) / q["range"] - q["sim"], "totSim": lambda e, a, q: (1 - F.abs(a - e) / q["range"] - q["sim"]) * q["alters"],
}


def _table(spark: SparkSession, values: DataFrame, counts: dict, theta: dict[str, float], numbers: dict[str, float], covariance: np.ndarray | None) -> DataFrame:
    unknown = set(theta) - set(counts)
    if unknown:
        raise ValueError(f"no table for {sorted(unknown)}")
    e, a = F.col("ego"), F.col("alter")
    q = {k: F.lit(float(v)) for k, v in numbers.items()}
    terms: list[Column] = [counts[k](e, a, q).cast("double") for k in theta]
    total = sum((F.lit(float(t)) * c for t, c in zip(theta.values(), terms, strict=True)), F.lit(0.0))
    grid = values.select(F.col("value").cast("double").alias("ego")).crossJoin(F.broadcast(values.select(F.col("value").cast("double").alias("alter"))))
    out = grid.withColumn("contribution", total)
    if covariance is not None:
        square = sum((F.lit(float(covariance[i][j])) * terms[i] * terms[j] for i in range(len(terms)) for j in range(len(terms))), F.lit(0.0))
        out = out.withColumn("se", F.sqrt(F.greatest(square, F.lit(0.0))))
    return out


def selection_table(spark: SparkSession, values: DataFrame, theta: dict[str, float], numbers: dict[str, float], covariance: np.ndarray | None = None) -> DataFrame:
    """(ego, alter, contribution[, se]): what a tie counts by ego's and alter's value, over all pairs of `values` (value), a covariate's distinct levels.

    numbers are the covariate's mean, range and sim. covariance is that of the parameters, in their order.
    """
    return _table(spark, values, _SELECTION, theta, numbers, covariance)


def influence_table(spark: SparkSession, values: DataFrame, theta: dict[str, float], numbers: dict[str, float], covariance: np.ndarray | None = None) -> DataFrame:
    """(ego, alter, contribution[, se]): what a behaviour value counts for an actor whose `alters` alters all have another value."""
    return _table(spark, values, _INFLUENCE, theta, numbers | {"alters": numbers.get("alters", 1.0)}, covariance)


def table_maximum(table: DataFrame) -> DataFrame:
    """(ego, alter, contribution): for each value of ego the alter's value that counts most; of ties the smaller one."""
    return table.groupBy("ego").agg(F.max(F.struct("contribution", (-F.col("alter")).alias("m"))).alias("b")).select("ego", (-F.col("b.m")).alias("alter"), F.col("b.contribution").alias("contribution"))
