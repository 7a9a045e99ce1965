"""The registered queries that simulate and estimate on the trade panel. Their rows follow from seeds, so they are the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewise.operators.estimation import Algorithm, estimate, starting_density, starting_rates
from tiewise.operators.inference import degree_counts, fit_of, importance_along, quantiles
from tiewise.operators.kernel import Term
from tiewise.operators.simulation import chain_likelihood, chains, model_periods, simulated_ties, simulations, targets
from tiewise.sources.panel import trade_panel

TERMS = [Term("Rate", 8.0, "rate"), Term("density", -1.0), Term("recip", 0.5), Term("transTrip", 0.05), Term("sameX", 0.3)]
BEHAVIOUR = [Term("linear", 0.1, of="z"), Term("quad", -0.1, of="z"), Term("avSim", 0.5, of="z")]


def _setup(spark: SparkSession, sf_dir: str, terms: list[Term]):
    periods = model_periods(trade_panel(spark, sf_dir))
    return periods, starting_rates(periods, tuple(sorted({t.of for t in terms})))


def simulated_statistics(spark: SparkSession, sf_dir: str, n_sims: int = 40) -> DataFrame:
    """(period, effect, observed, mean, sd) of a network and a behaviour that change together."""
    terms = TERMS + BEHAVIOUR
    periods, rates = _setup(spark, sf_dir, terms)
    sims = simulations(spark, periods, terms, rates, n_sims, outcomes=False)
    names = [f"{t.of}.{t.kind}.{t.short}" for t in terms]
    observed = spark.createDataFrame([(p.period, n, float(v)) for p, row in zip(periods, targets(periods, terms), strict=True) for n, v in zip(names, row, strict=True)], "period int, effect string, observed double")
    rows = sims.select("period", F.posexplode("stats").alias("k", "value")).groupBy("period", "k").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    effect = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    return rows.select("period", effect.alias("effect"), "mean", "sd").join(F.broadcast(observed), ["period", "effect"])


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variable, type, effect, estimate, se, t_ratio) of a fit on the first period."""
    periods = model_periods(trade_panel(spark, sf_dir))[:1]
    terms = [Term("Rate", 8.0, "rate"), Term("density", starting_density(periods)), Term("recip", 0.0)]
    fit = estimate(spark, periods, terms, algorithm=Algorithm(n3=200, nsub=2))
    return fit.table(spark)


def goodness_of_fit(spark: SparkSession, sf_dir: str, n_sims: int = 40) -> DataFrame:
    """(direction, distance, p) of the degree distributions, all periods together."""
    panel = trade_panel(spark, sf_dir)
    periods, rates = _setup(spark, sf_dir, TERMS)
    n = periods[0].start.n
    ties = simulated_ties(simulations(spark, periods, TERMS, rates, n_sims), n).persist()
    ends = panel.x.where("wave > 1").select(F.lit(0).alias("sim"), (F.col("wave") - 1).alias("period"), "i", "j")
    out = []
    for direction in ("out", "in"):
        found = fit_of(degree_counts(ties, n, direction), degree_counts(ends, n, direction).drop("sim"))
        out.append((direction, round(found["distance"], 6), found["p"]))
    ties.unpersist()
    return spark.createDataFrame(out, "direction string, distance double, p double")


def degree_quantiles(spark: SparkSession, sf_dir: str, n_sims: int = 40) -> DataFrame:
    """(key, min, max, mean, sd, q5, q50, q95): actors with an outdegree of at most `key`, over simulations."""
    periods, rates = _setup(spark, sf_dir, TERMS)
    n = periods[0].start.n
    return quantiles(degree_counts(simulated_ties(simulations(spark, periods, TERMS, rates, n_sims), n), n, "out"))


def simulated_chains(spark: SparkSession, sf_dir: str, n_sims: int = 10) -> DataFrame:
    """(sim, period, steps, log_likelihood)"""
    periods, rates = _setup(spark, sf_dir, TERMS)
    return chain_likelihood(chains(spark, periods, TERMS, rates, n_sims))


def importance_dynamics(spark: SparkSession, sf_dir: str, n_sims: int = 8) -> DataFrame:
    """(period, interval, effect, importance) along simulated chains."""
    periods, rates = _setup(spark, sf_dir, TERMS)
    return importance_along(spark, periods[:2], TERMS, rates[:2], n_sims, intervals=4)


QUERIES = {"simulated_statistics": simulated_statistics, "estimates": estimates, "goodness_of_fit": goodness_of_fit, "degree_quantiles": degree_quantiles, "simulated_chains": simulated_chains, "importance_dynamics": importance_dynamics}
#: Simulations have no SQL; tests hold them against brute force and known parameters.
QUERY_SQL: dict[str, str] = {}
