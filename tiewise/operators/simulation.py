"""Simulation of panels: every (simulation, period) is one independent task row, seeded by its own numbers.

The steps of one period depend on each other, so a period is one call of the NumPy kernel; simulations and
periods are what Spark spreads. The panel's periods travel to the executors inside the function, as dense
arrays of n squared numbers: `model_periods` refuses panels of more than MOST_ACTORS actors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewise.operators.kernel import Rules, State, Term, simulate, statistics
from tiewise.plans.features import mean_similarity
from tiewise.sources.panel import Panel

#: 2000 actors are 32 MB for each of a period's arrays.
MOST_ACTORS = 2000
SCHEMA = "sim long, period int, stats array<double>, scores array<double>, steps int, time double, ties array<int>, z array<int>"
_ARROW = pa.schema([("sim", pa.int64()), ("period", pa.int32()), ("stats", pa.list_(pa.float64())), ("scores", pa.list_(pa.float64())), ("steps", pa.int32()), ("time", pa.float64()), ("ties", pa.list_(pa.int32())), ("z", pa.list_(pa.int32()))])
CHAIN = "sim long, period int, step int, var string, ego int, alter int, rate_share double, choice_p double, diagonal boolean"


@dataclass(frozen=True)
class PeriodData:
    period: int
    start: State
    end: State
    rules: Rules

    @property
    def distance(self) -> int:
        return int(abs(self.end.x - self.start.x).sum())


def model_periods(panel: Panel, rules: Rules = Rules()) -> list[PeriodData]:
    """The panel's periods as arrays, actors in ascending order of their ids."""
    ids = sorted(r.id for r in panel.nodes.limit(MOST_ACTORS + 1).collect())
    n = len(ids)
    if n > MOST_ACTORS:
        raise ValueError(f"more than {MOST_ACTORS} actors: simulation holds a period's panel in one process")
    at = {a: k for k, a in enumerate(ids)}
    x, w = np.zeros((panel.waves, n, n)), np.zeros((panel.waves, n, n))
    for array, ties in ((x, panel.x), (w, panel.w)):
        for r in ties.collect():  # n squared cells a wave at most
            array[r.wave - 1, at[r.i], at[r.j]] = 1
    z = np.full((panel.waves, n), np.nan)
    for r in panel.z.collect():
        z[r.wave - 1, at[r.id]] = r.value
    zmean = float(np.nanmean(z, axis=1).mean())
    z = np.where(np.isnan(z), round(zmean), z).astype(int)
    d = np.zeros((n, n))
    for r in panel.d.collect():
        d[at[r.i], at[r.j]] = r.value
    d = (d - d.sum() / (n * (n - 1))) * (1 - np.eye(n))
    v, c = np.zeros(n), np.zeros(n, int)
    for r in panel.v.collect():
        v[at[r.id]] = r.value
    for r in panel.c.collect():
        c[at[r.id]] = r.value
    spread = mean_similarity(panel.v.select("value"), []).first()
    zsim = mean_similarity(panel.z.select("wave", "value"), ["wave"]).first().sim
    states = [State(x[k], z[k], w[k], d, v - v.mean(), c, zmean, int(z.min()), int(z.max()), spread.range or 1.0, spread.sim, zsim) for k in range(panel.waves)]
    return [PeriodData(k + 1, states[k], states[k + 1], rules) for k in range(panel.waves - 1)]


def targets(periods: list[PeriodData], terms: list[Term]) -> np.ndarray:
    """(periods, terms): observed statistics."""
    return np.array([statistics(p.start, p.end, terms) for p in periods])


def _seeded(seed: int, sim: int, period: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([seed, sim, period]))


def simulations(spark: SparkSession, periods: list[PeriodData], terms: list[Term], rates: list[dict[str, float]], n_sims: int, *, seed: int = 1, conditional: bool = False, first: int = 0, outcomes: bool = True, partitions: int | None = None) -> DataFrame:
    """One row for each simulation and period: statistics, scores, and the simulated end as ties i * n + j and behaviour.

    A row's random numbers follow from (seed, sim, period) alone, so that a recomputed or differently
    partitioned row is the same one. `rates` are basic rates by period.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sim in batch.column("id").to_pylist():
                for p, rate in zip(periods, rates, strict=True):
                    done = simulate(p.start, terms, rate, p.rules, _seeded(seed, sim, p.period), distance=p.distance if conditional else None)
                    where = np.flatnonzero(done.end.x).tolist() if outcomes else None
                    rows.append((sim, p.period, statistics(p.start, done.end, terms).tolist(), done.scores.tolist(), done.steps, done.time, where, done.end.z.tolist() if outcomes else None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    parts = partitions or min(n_sims, max(1, spark.sparkContext.defaultParallelism))
    return spark.range(first, first + n_sims, 1, parts).mapInArrow(run, SCHEMA)


def chains(spark: SparkSession, periods: list[PeriodData], terms: list[Term], rates: list[dict[str, float]], n_sims: int, *, seed: int = 1) -> DataFrame:
    """The micro-steps of every simulation and period, in order."""
    schema = pa.schema([("sim", pa.int64()), ("period", pa.int32()), ("step", pa.int32()), ("var", pa.string()), ("ego", pa.int32()), ("alter", pa.int32()), ("rate_share", pa.float64()), ("choice_p", pa.float64()), ("diagonal", pa.bool_())])

    def run(batches):
        for batch in batches:
            for sim in batch.column("id").to_pylist():
                for p, rate in zip(periods, rates, strict=True):
                    steps = simulate(p.start, terms, rate, p.rules, _seeded(seed, sim, p.period), keep_chain=True).chain
                    rows = [(sim, p.period, *s) for s in steps]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.range(0, n_sims, 1, min(n_sims, spark.sparkContext.defaultParallelism)).mapInArrow(run, CHAIN)


def chain_likelihood(chain: DataFrame) -> DataFrame:
    """(sim, period, steps, log_likelihood): log of who acts and of what is chosen, over a chain's steps."""
    return chain.groupBy("sim", "period").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.log("rate_share") + F.log("choice_p")).alias("log_likelihood"))


def simulated_ties(sims: DataFrame, n: int) -> DataFrame:
    """(sim, period, i, j) of the simulated ends."""
    cells = sims.select("sim", "period", F.explode("ties").alias("cell"))
    return cells.select("sim", "period", F.floor(F.col("cell") / n).cast("int").alias("i"), (F.col("cell") % n).cast("int").alias("j"))


def simulated_behaviour(sims: DataFrame) -> DataFrame:
    """(sim, period, id, value)"""
    return sims.select("sim", "period", F.posexplode("z").alias("id", "value"))
