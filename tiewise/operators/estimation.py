"""Method-of-moments estimation by stochastic approximation, and what its result can be asked.

Phase 1 estimates how statistics respond to parameters, phase 2 moves the parameters against the
deviations in subphases of falling gain, phase 3 measures covariance, convergence and standard errors at
the final values. Every batch of simulations is one Spark job; only its statistics and scores, some dozens of
numbers a simulation, come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tiewise.operators.kernel import Rules, Term
from tiewise.operators.simulation import PeriodData, simulations, targets


@dataclass(frozen=True)
class Algorithm:
    """n3 simulations in phase 3, nsub subphases of phase 2, their first gain and its reduction, the largest step
    in standardised deviations, how far the derivative is pulled to its diagonal, simulations averaged in a step,
    and Dolby variance reduction by the scores."""

    n3: int = 1000
    nsub: int = 4
    firstg: float = 0.2
    reduceg: float = 0.5
    truncation: float = 5.0
    diagonalize: float = 0.2
    batch: int = 8
    dolby: bool = True
    conditional: bool = False
    seed: int = 1

    def __post_init__(self):
        if self.n3 < 2 or self.nsub < 0 or not 0 < self.firstg or not 0 <= self.diagonalize <= 1 or self.batch < 1:
            raise ValueError("algorithm options out of range")


@dataclass(frozen=True)
class Fit:
    """Estimates, in the order of `terms`: parameters, standard errors, covariance, convergence."""

    terms: list[Term]
    theta: np.ndarray
    covariance: np.ndarray
    derivative: np.ndarray
    target: np.ndarray
    simulated: np.ndarray  # phase 3: simulations by terms, summed over periods
    scores: np.ndarray
    rates: list[dict[str, float]]
    iterations: int
    by_period: np.ndarray = field(default=None)  # phase 3: simulations by periods by terms
    targets: np.ndarray = field(default=None)  # periods by terms

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.covariance), 0, None))

    @property
    def t_ratios(self) -> np.ndarray:
        """Mean deviation of simulated statistics from the targets, over their standard deviation."""
        sd = self.simulated.std(axis=0, ddof=1)
        return np.divide(self.simulated.mean(0) - self.target, sd, out=np.zeros_like(sd), where=sd > 0)

    @property
    def overall_ratio(self) -> float:
        """The largest t-ratio of any linear combination of the statistics."""
        mean = self.simulated.mean(0) - self.target
        return float(np.sqrt(max(0.0, mean @ np.linalg.pinv(np.atleast_2d(np.cov(self.simulated, rowvar=False))) @ mean)))

    def coef(self) -> dict[str, float]:
        return {f"{t.of}.{t.kind}.{t.short}": float(v) for t, v in zip(self.terms, self.theta, strict=True)}

    def vcov(self) -> np.ndarray:
        return self.covariance

    def table(self, spark: SparkSession) -> DataFrame:
        """(variable, type, effect, estimate, se, t_ratio)"""
        rows = [(t.of, t.kind, t.short, float(a), float(b), float(c)) for t, a, b, c in zip(self.terms, self.theta, self.se, self.t_ratios, strict=True)]
        return spark.createDataFrame(rows, "variable string, type string, effect string, estimate double, se double, t_ratio double")


def _with(terms: list[Term], theta: np.ndarray) -> list[Term]:
    return [replace(t, theta=float(v)) for t, v in zip(terms, theta, strict=True)]


class _Sampler:
    """Batches of simulations, with numbers that no other batch has."""

    def __init__(self, spark: SparkSession, periods: list[PeriodData], rates: list[dict[str, float]], terms: list[Term], algorithm: Algorithm):
        self.spark, self.periods, self.rates, self.terms, self.algorithm = spark, periods, rates, terms, algorithm
        self.used = 0

    def __call__(self, theta: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(statistics, scores), each simulations by periods by terms."""
        a = self.algorithm
        terms = _with(self.terms, theta)
        rates = [dict(r) for r in self.rates]
        for k, t in enumerate(terms):
            if t.kind == "rate" and t.short == "Rate":
                for r in rates:
                    r[t.of] = max(0.1, float(theta[k]))
        rows = simulations(self.spark, self.periods, terms, rates, n, seed=a.seed, conditional=a.conditional, first=self.used, outcomes=False).select("sim", "period", "stats", "scores").collect()
        self.used += n
        rows.sort(key=lambda r: (r.sim, r.period))
        shape = (n, len(self.periods), len(terms))
        return np.array([r.stats for r in rows]).reshape(shape), np.array([r.scores for r in rows]).reshape(shape)


def derivative(stats: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """How mean statistics respond to parameters: covariance of statistics and scores, period by period (simulations, periods, terms)."""
    n, periods, k = stats.shape
    out = np.zeros((k, k))
    for m in range(periods):
        s, g = stats[:, m] - stats[:, m].mean(0), scores[:, m] - scores[:, m].mean(0)
        out += s.T @ g / (n - 1)
    return out


def _reduced(stats: np.ndarray, scores: np.ndarray, coefficients: np.ndarray | None) -> np.ndarray:
    return stats if coefficients is None else stats - coefficients * scores


def starting_rates(periods: list[PeriodData], of: tuple[str, ...] = ("x",)) -> list[dict[str, float]]:
    """Basic rates from observed changes; few changes are undone within a period, so a little above the average."""
    out = []
    for p in periods:
        n = p.start.n
        rate = {"x": 0.2 + 2 * p.distance / n} if "x" in of else {}
        if "z" in of:
            rate["z"] = 0.2 + 1.5 * float(abs(p.end.z - p.start.z).sum()) / n
        out.append(rate)
    return out


def starting_density(periods: list[PeriodData]) -> float:
    """Half the log odds of gaining against losing ties, each period weighted by its precision, within -3 and 3."""
    top = bottom = 0.0
    for p in periods:
        off = 1 - np.eye(p.start.n)
        n01, n00 = ((1 - p.start.x) * p.end.x * off).sum(), ((1 - p.start.x) * (1 - p.end.x) * off).sum()
        n10, n11 = (p.start.x * (1 - p.end.x)).sum(), (p.start.x * p.end.x).sum()
        b01, b10 = (n01 + 0.5) / (n01 + n00 + 1), (n10 + 0.5) / (n10 + n11 + 1)
        variance = (1 - b01) / (b01 * (n01 + n00 + 1)) + (1 - b10) / (b10 * (n10 + n11 + 1))
        top += 0.5 * np.log(b01 / b10) / variance
        bottom += 1 / variance
    return float(np.clip(top / bottom, -3, 3)) if bottom else 0.0


def starting_tendency(periods: list[PeriodData]) -> float:
    """Half the log odds of upward against downward steps of the behaviour, within -3 and 3; 0 where the values can't move."""
    up = sum(float(np.maximum(p.end.z - p.start.z, 0).sum()) for p in periods)
    down = sum(float(np.maximum(p.start.z - p.end.z, 0).sum()) for p in periods)
    return float(np.clip(0.5 * np.log((up + 1) / (down + 1)), -3, 3))


def starting_flow(values: np.ndarray) -> dict[str, float]:
    """Feedback a, intercept b and scale g of a continuous variable (waves by actors), by regression of each wave on the one before."""
    before, after = np.concatenate(values[:-1]), np.concatenate(values[1:])
    spread = before.var()
    slope = float(np.clip(((before - before.mean()) * (after - after.mean())).mean() / spread, 0.05, 0.98)) if spread > 0 else 0.5
    a = float(np.log(slope))
    level = float(after.mean() - slope * before.mean())
    rest = float((after - slope * before - level).var())
    return {"a": a, "b": level * a / (slope - 1), "g": float(np.sqrt(rest * 2 * a / (slope**2 - 1)))}


def rules_of(periods: list[PeriodData], *, override: dict | None = None) -> Rules:
    """What the data suggest that changes must obey: constraints between x and w, ties or values that only rise or only fall; `override` has the last word."""
    states = [periods[0].start, *(p.end for p in periods)]
    off = 1 - np.eye(states[0].n)
    found = {
        "higher": all((s.x >= s.w).all() for s in states), "disjoint": all((s.x * s.w == 0).all() for s in states), "at_least_one": all(((s.x + s.w + 1 - off) > 0).all() for s in states),
        "up_only": all((p.end.x >= p.start.x).all() for p in periods), "down_only": all((p.end.x <= p.start.x).all() for p in periods),
        "z_up_only": all((p.end.z >= p.start.z).all() for p in periods), "z_down_only": all((p.end.z <= p.start.z).all() for p in periods),
    }
    return Rules(**(found | (override or {})))


def estimate(spark: SparkSession, periods: list[PeriodData], terms: list[Term], *, algorithm: Algorithm = Algorithm(), rates: list[dict[str, float]] | None = None, fixed: tuple[int, ...] = ()) -> Fit:
    """Parameters at which simulated statistics equal the observed ones on average; terms at `fixed` places keep theirs.

    Unconditional estimation takes basic rates as further terms ("Rate"); without them they stay as given, or
    as observed changes suggest. Conditional estimation simulates up to the observed distance.
    """
    observed = targets(periods, terms)
    target = observed.sum(0)
    k = len(terms)
    theta = np.array([t.theta for t in terms])
    free = np.array([i not in fixed for i in range(k)])
    rates = rates or starting_rates(periods, tuple(sorted({t.of for t in terms})))
    draw = _Sampler(spark, periods, rates, terms, algorithm)
    n1 = max(7 + 3 * k, 50 if algorithm.dolby else 0)
    stats, scores = draw(theta, n1)
    d = derivative(stats, scores)
    total, grade = stats.sum(1), scores.sum(1)
    coefficients = None
    if algorithm.dolby:
        g = grade - grade.mean(0)
        coefficients = ((total - total.mean(0)) * g).sum(0) / np.maximum((g**2).sum(0), 1e-12)
    iterations = n1

    def inverse(matrix: np.ndarray) -> np.ndarray:
        m = (1 - algorithm.diagonalize) * matrix + algorithm.diagonalize * np.diag(np.diag(matrix))
        m[~free, :], m[:, ~free] = 0, 0
        m[~free, ~free] = 1
        return np.linalg.pinv(m)

    def bounded(step: np.ndarray) -> np.ndarray:
        sd = np.maximum(total.std(0, ddof=1), 1e-9)
        size = np.abs(np.where(free, deviation / sd, 0)).max()
        return step * (algorithm.truncation / size if size > algorithm.truncation else 1)

    positive = np.array([t.kind == "rate" and t.short == "Rate" for t in terms])
    back = inverse(d)
    deviation = total.mean(0) - target
    theta = _moved(theta, bounded(algorithm.firstg * back @ deviation), positive, free)
    gain = algorithm.firstg
    least = int(np.ceil((7 + k) / np.sqrt(algorithm.batch)))
    for _ in range(algorithm.nsub):
        most = least + 200 // algorithm.batch
        path, before, turned = [], None, 0.0
        products: list[np.ndarray] = []
        while len(path) < most:
            s, g = draw(theta, algorithm.batch)
            iterations += algorithm.batch
            deviation = _reduced(s.sum(1), g.sum(1), coefficients).mean(0) - target
            theta = _moved(theta, bounded(gain * np.sqrt(algorithm.batch) * back @ deviation), positive, free)
            path.append(theta)
            if before is not None:
                products.append(before * deviation)
            before = deviation
            # Successive deviations that go together mean that theta is still on its way.
            turned = max([0.0, *(np.sum(products, axis=0) / np.maximum(1e-9, np.sum(np.square(total - total.mean(0)).mean(0)))).tolist()]) if products else 1.0
            if len(path) >= least and turned <= 0.0:
                break
        theta = np.mean(path, axis=0)
        gain *= algorithm.reduceg
        least = int(np.ceil(least * 2.52))
    stats, scores = draw(theta, algorithm.n3)
    iterations += algorithm.n3
    d = derivative(stats, scores)
    total, grade = stats.sum(1), scores.sum(1)
    keep = np.ix_(free, free)
    spread = np.atleast_2d(np.cov(total, rowvar=False))
    covariance = np.zeros((k, k))
    inner = np.linalg.pinv(d[keep])
    covariance[keep] = inner @ spread[keep] @ inner.T
    final = [{v: (max(0.1, float(theta[next(i for i, t in enumerate(terms) if t.of == v and t.short == "Rate")])) if any(t.of == v and t.short == "Rate" for t in terms) else r) for v, r in rate.items()} for rate in rates]
    return Fit(_with(terms, theta), theta, covariance, d, target, total, grade, final, iterations, stats, observed)


def _moved(theta: np.ndarray, step: np.ndarray, positive: np.ndarray, free: np.ndarray) -> np.ndarray:
    """theta - step; parameters that must stay positive are halved instead of crossing 0."""
    new = np.where(free, theta - step, theta)
    return np.where(positive & (new <= 0), theta / 2, new)


def gmom_covariance(d: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, covariance) of the generalised method of moments: more statistics than parameters (statistics by parameters).

    Statistics are combined into as many equations as there are parameters, by their inverse covariance.
    """
    weights = d.T @ np.linalg.pinv(spread)
    weights = weights / np.maximum(np.abs(weights).sum(axis=1, keepdims=True), 1e-300)
    inner = np.linalg.pinv(weights @ d)
    return weights, inner @ weights @ spread @ weights.T @ inner.T


def simulate_only(spark: SparkSession, periods: list[PeriodData], terms: list[Term], grid: list[list[float]], n_sims: int, *, rates: list[dict[str, float]] | None = None, seed: int = 1) -> DataFrame:
    """Simulations at each parameter vector of a grid, no estimation: simulations() with a column `point`, the vector's place."""
    from pyspark.sql import functions as F

    rates = rates or starting_rates(periods, tuple(sorted({t.of for t in terms})))
    out = None
    for at, theta in enumerate(grid):
        sims = simulations(spark, periods, _with(terms, np.array(theta, float)), rates, n_sims, seed=seed + at).withColumn("point", F.lit(at))
        out = sims if out is None else out.unionByName(sims)
    return out
