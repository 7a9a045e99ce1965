"""Maximum likelihood of a network's rate and evaluation parameters by simulated chains between observed waves.

A period's unobserved micro-steps are a chain that leads from its start to its end. Metropolis-Hastings moves
change a chain without changing its ends; the scores of many chains, averaged, move the parameters. Every chain
is one row: chains are what Spark spreads, and a row's random numbers follow from (seed, chain, round).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from tiewise.operators.kernel import Rules, State, Term, information, tie_probabilities
from tiewise.operators.simulation import PeriodData

Steps = list[tuple[int, int]]


def minimal_chain(p: PeriodData, rng: np.random.Generator) -> Steps:
    """One step (actor, alter) for each tie that differs, in random order."""
    steps = [(int(i), int(j)) for i, j in zip(*np.nonzero(p.start.x != p.end.x), strict=True)]
    return [steps[k] for k in rng.permutation(len(steps))]


def choice_logs(start: State, steps: Steps, terms: list[Term], rules: Rules) -> np.ndarray:
    """Log-probability of every step's choice, given its actor; a step back to the actor itself changes nothing."""
    s = start.copy()
    out = np.empty(len(steps))
    for k, (i, j) in enumerate(steps):
        p, _ = tie_probabilities(s, i, terms, rules)
        out[k] = np.log(p[j]) if p[j] > 0 else -np.inf
        if i != j:
            s.x[i, j] = 1 - s.x[i, j]
    return out


def log_likelihood(start: State, steps: Steps, terms: list[Term], rate: float, rules: Rules) -> float:
    """Of the number of steps, of who makes them (all actors alike) and of their choices."""
    n, k = start.n, len(steps)
    return float(k * np.log(rate * n) - n * rate - np.log(np.arange(1, k + 1)).sum() - k * np.log(n) + choice_logs(start, steps, terms, rules).sum())


@dataclass
class Sampler:
    """The present chain of one period, changed by moves that leave its distribution as it is."""

    p: PeriodData
    terms: list[Term]
    rate: float
    rng: np.random.Generator
    steps: Steps

    def __post_init__(self):
        self.now = log_likelihood(self.p.start, self.steps, self.terms, self.rate, self.p.rules)
        self.accepted = Counter()
        self.tried = Counter()

    def _try(self, name: str, steps: Steps, log_proposal: float) -> None:
        """Accept other steps with the ratio of likelihoods times that of proposals back and forth."""
        self.tried[name] += 1
        then = log_likelihood(self.p.start, steps, self.terms, self.rate, self.p.rules)
        if np.log(self.rng.random()) < then - self.now + log_proposal:
            self.steps, self.now = steps, then
            self.accepted[name] += 1

    def insert_diagonal(self) -> None:
        i, at = int(self.rng.integers(self.p.start.n)), int(self.rng.integers(len(self.steps) + 1))
        steps = [*self.steps[:at], (i, i), *self.steps[at:]]
        idle = sum(a == b for a, b in steps)
        self._try("insert diagonal", steps, np.log(self.p.start.n) + np.log(len(steps)) - np.log(idle))

    def cancel_diagonal(self) -> None:
        idle = [k for k, (a, b) in enumerate(self.steps) if a == b]
        if idle:
            at = idle[int(self.rng.integers(len(idle)))]
            self._try("cancel diagonal", [*self.steps[:at], *self.steps[at + 1 :]], np.log(len(idle)) - np.log(self.p.start.n) - np.log(len(self.steps)))

    def permute(self, most: int = 8) -> None:
        size = min(len(self.steps), int(self.rng.integers(2, most + 1)))
        if size >= 2:
            at = int(self.rng.integers(len(self.steps) - size + 1))
            part = [self.steps[at + k] for k in self.rng.permutation(size)]
            self._try("permute", [*self.steps[:at], *part, *self.steps[at + size :]], 0.0)

    def insert_pair(self) -> None:
        """Two more steps on one tie, at any two places."""
        n = self.p.start.n
        i, j = (int(a) for a in self.rng.choice(n, 2, replace=False))
        one, two = sorted(int(a) for a in self.rng.integers(len(self.steps) + 1, size=2))
        steps = [*self.steps[:one], (i, j), *self.steps[one:two], (i, j), *self.steps[two:]]
        pairs = self._pairs(steps)
        # Two places, in either order unless they are one.
        places = (len(self.steps) + 1) ** 2
        ways = 2 if one != two else 1
        self._try("insert pair", steps, np.log(n * (n - 1)) + np.log(places / ways) - np.log(len(pairs)))

    def delete_pair(self) -> None:
        pairs = self._pairs(self.steps)
        if pairs:
            one, two = pairs[int(self.rng.integers(len(pairs)))]
            steps = [s for k, s in enumerate(self.steps) if k not in (one, two)]
            n, places, ways = self.p.start.n, (len(steps) + 1) ** 2, 2 if two - one > 1 else 1
            self._try("delete pair", steps, np.log(len(pairs)) - np.log(n * (n - 1)) - np.log(places / ways))

    @staticmethod
    def _pairs(steps: Steps) -> list[tuple[int, int]]:
        """All pairs of places of steps on one tie."""
        where: dict[tuple[int, int], list[int]] = {}
        for k, (i, j) in enumerate(steps):
            if i != j:
                where.setdefault((i, j), []).append(k)
        return [(a, b) for ks in where.values() for x, a in enumerate(ks) for b in ks[x + 1 :]]

    def move(self) -> None:
        (self.insert_diagonal, self.cancel_diagonal, self.permute, self.insert_pair, self.delete_pair)[int(self.rng.integers(5))]()

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """(derivative of the log-likelihood by the rate and the parameters, its negative second derivative)."""
        k = len(self.terms)
        s, first, second = self.p.start.copy(), np.zeros(k + 1), np.zeros((k + 1, k + 1))
        for i, j in self.steps:
            p, c = tie_probabilities(s, i, self.terms, self.p.rules)
            first[1:] += c[:, j] - c @ p
            second[1:, 1:] += information(c, p)
            if i != j:
                s.x[i, j] = 1 - s.x[i, j]
        first[0] = len(self.steps) / self.rate - self.p.start.n
        second[0, 0] = len(self.steps) / self.rate**2
        return first, second


_ARROW = pa.schema([("chain", pa.int64()), ("steps", pa.list_(pa.int32())), ("scores", pa.list_(pa.float64())), ("information", pa.list_(pa.float64()))])


def sample(spark: SparkSession, p: PeriodData, terms: list[Term], rate: float, chains: dict[int, Steps | None], moves: int, *, seed: int = 1, turn: int = 0) -> list:
    """Every chain after so many moves, with its scores and information; a chain of None starts minimal. Rows of some hundreds of numbers come back."""

    def run(batches):
        for batch in batches:
            rows = []
            for chain, flat in zip(batch.column("chain").to_pylist(), batch.column("steps").to_pylist(), strict=True):
                rng = np.random.Generator(np.random.PCG64([seed, chain, turn]))
                steps = minimal_chain(p, rng) if flat is None else [tuple(flat[k : k + 2]) for k in range(0, len(flat), 2)]
                s = Sampler(p, terms, rate, rng, steps)
                for _ in range(moves):
                    s.move()
                first, second = s.scores()
                rows.append((chain, [a for step in s.steps for a in step], first.tolist(), second.ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    given = spark.createDataFrame([(c, None if s is None else [a for step in s for a in step]) for c, s in chains.items()], "chain long, steps array<int>")
    return given.repartition(min(len(chains), spark.sparkContext.defaultParallelism)).mapInArrow(run, "chain long, steps array<int>, scores array<double>, information array<double>").collect()


@dataclass(frozen=True)
class LikelihoodFit:
    terms: list[Term]
    rate: float
    theta: np.ndarray
    covariance: np.ndarray  # of the rate and the parameters

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.covariance), 0, None))


def maximise(spark: SparkSession, p: PeriodData, terms: list[Term], *, rate: float | None = None, chains: int = 8, rounds: int = 25, moves: int = 150, burn: int = 600, gain: float = 0.3, seed: int = 1) -> LikelihoodFit:
    """Parameters at which the mean score of the chains is 0: steps by the chains' mean information, and the average over the second half of the rounds.

    The covariance is the inverse of the observed information: the mean information less the spread of the scores.
    """
    theta, rate = np.array([t.theta for t in terms]), rate or 0.2 + 2 * p.distance / p.start.n
    held: dict[int, Steps | None] = dict.fromkeys(range(chains))
    path = []
    scores = informations = None
    for turn in range(rounds):
        now = [replace(t, theta=float(v)) for t, v in zip(terms, theta, strict=True)]
        rows = sorted(sample(spark, p, now, rate, held, burn if turn == 0 else moves, seed=seed, turn=turn), key=lambda r: r.chain)
        held = {r.chain: [tuple(r.steps[k : k + 2]) for k in range(0, len(r.steps), 2)] for r in rows}
        scores = np.array([r.scores for r in rows])
        informations = np.array([r.information for r in rows]).reshape(len(rows), len(terms) + 1, -1)
        step = np.linalg.pinv(informations.mean(0)) @ scores.mean(0) * gain
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step[1:]).max(initial=0)))
        rate, theta = max(0.1, rate + step[0]), theta + step[1:]
        path.append(np.concatenate([[rate], theta]))
    final = np.mean(path[rounds // 2 :], axis=0)
    observed = informations.mean(0) - np.atleast_2d(np.cov(scores, rowvar=False))
    usable = observed if np.linalg.eigvalsh(observed).min() > 0 else informations.mean(0)
    return LikelihoodFit([replace(t, theta=float(v)) for t, v in zip(terms, final[1:], strict=True)], float(final[0]), final[1:], np.linalg.inv(usable))
