"""Meta-analysis of many fits: studies' estimates and standard errors, one row a study and effect, as grouped aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper tail of the standard normal distribution of {z}, within 1.5e-7 (Abramowitz and Stegun 26.2.17); the same text in Spark and DuckDB.
_T = "(1 / (1 + 0.2316419 * abs({z})))"
_UPPER = f"(exp(-({{z}}) * ({{z}}) / 2) / sqrt(2 * pi()) * ({_T} * (0.319381530 + {_T} * (-0.356563782 + {_T} * (1.781477937 + {_T} * (-1.821255978 + {_T} * 1.330274429))))))"
#: At least this, so that its logarithm exists.
NORMAL_TAIL = f"greatest(case when ({{z}}) >= 0 then {_UPPER} else 1 - {_UPPER} end, 1e-300)"


def combine(fits: DataFrame, most_se: float = 5.0) -> DataFrame:
    """(effect, studies, t2, mean, se, z, q, left, right, spearman) of fits (study, effect, theta, se).

    Fits with a standard error of `most_se` or more, none or zero are left out. t2 is the sum of squared
    ratios theta / se, for all effects being 0; mean the precision-weighted one, se and z its own; q tests that
    all studies have one value (t2 less z squared); left and right are Fisher's -2 sum log p of one-sided tests;
    spearman the rank correlation of estimates and standard errors.
    """
    used = fits.where(f"se > 0 and se < {most_se} and theta is not null")
    by = Window.partitionBy("effect")
    # Ranks of ties are averaged.
    rank = lambda c: F.rank().over(by.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("effect", c)) - 1) / 2
    ranked = used.withColumn("rt", rank("theta")).withColumn("rs", rank("se")).withColumn("t", F.col("theta") / F.col("se"))
    g = ranked.groupBy("effect").agg(
        F.count(F.lit(1)).alias("studies"), F.sum(F.expr("t * t")).alias("t2"), F.sum(F.expr("theta / (se * se)")).alias("a"), F.sum(F.expr("1 / (se * se)")).alias("b"),
        F.sum(F.expr(f"-2 * ln({NORMAL_TAIL.format(z='-t')})")).alias("left"), F.sum(F.expr(f"-2 * ln({NORMAL_TAIL.format(z='t')})")).alias("right"), F.corr("rt", "rs").alias("spearman"),
    )
    number = lambda c: F.round(c, 6)
    return g.select("effect", "studies", number(F.col("t2")).alias("t2"), number(F.col("a") / F.col("b")).alias("mean"), number(1 / F.sqrt("b")).alias("se"), number(F.col("a") / F.sqrt("b")).alias("z"), number(F.expr("t2 - a * a / b")).alias("q"), number(F.col("left")).alias("left"), number(F.col("right")).alias("right"), number(F.coalesce(F.nanvl("spearman", F.lit(None)), F.lit(0.0))).alias("spearman"))


def funnel(fits: DataFrame, most_se: float = 5.0) -> DataFrame:
    """(effect, study, theta, se, precision, inside): the points of a funnel plot, and whether one lies within 1.96 se of the weighted mean."""
    used = fits.where(f"se > 0 and se < {most_se} and theta is not null")
    means = used.groupBy("effect").agg((F.sum(F.expr("theta / (se * se)")) / F.sum(F.expr("1 / (se * se)"))).alias("m"))
    # One row an effect.
    return used.join(F.broadcast(means), "effect").select("effect", "study", F.round("theta", 6).alias("theta"), F.round("se", 6).alias("se"), F.round(1 / F.col("se"), 6).alias("precision"), (F.abs(F.col("theta") - F.col("m")) <= 1.96 * F.col("se")).alias("inside"))


def _profile(theta: np.ndarray, se: np.ndarray, sigma: float) -> tuple[float, float]:
    """(best mean, deviance) under N(mean, sigma^2 + se^2)."""
    w = 1 / (sigma**2 + se**2)
    m = float((w * theta).sum() / w.sum())
    return m, float((w * (theta - m) ** 2 - np.log(w)).sum())


def _root(f, low: float, high: float) -> float:
    for _ in range(100):
        mid = (low + high) / 2
        if f(low) * f(mid) <= 0:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def _golden(f, low: float, high: float) -> float:
    g = (np.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    for _ in range(100):
        if f(a) < f(b):
            high = b
        else:
            low = a
        a, b = high - g * (high - low), low + g * (high - low)
    return (low + high) / 2


def likelihood_estimate(theta: np.ndarray, se: np.ndarray, chi: float = 3.841459) -> dict[str, float]:
    """Maximum likelihood of mean and spread between studies, with profile intervals (95 per cent by default)."""
    top = float(np.ptp(theta) + se.max()) * 2 + 1e-9
    sigma = _golden(lambda s: _profile(theta, se, s)[1], 0.0, top)
    if _profile(theta, se, 0.0)[1] <= _profile(theta, se, sigma)[1]:
        sigma = 0.0
    mu, best = _profile(theta, se, sigma)

    def at_mean(m: float) -> float:
        dev = lambda s: float(((theta - m) ** 2 / (s**2 + se**2) + np.log(s**2 + se**2)).sum())
        return min(dev(0.0), dev(_golden(dev, 0.0, top + abs(m - mu)))) - best - chi

    reach = top
    while at_mean(mu + reach) < 0 or at_mean(mu - reach) < 0:
        reach *= 2
    over = lambda s: _profile(theta, se, s)[1] - best - chi
    far = top
    while over(far) < 0 and far < 1e6 * top:
        far *= 2
    return {
        "mu": mu, "sigma": sigma, "mu_low": _root(at_mean, mu - reach, mu), "mu_high": _root(at_mean, mu, mu + reach),
        "sigma_low": 0.0 if over(0.0) < 0 else _root(over, 0.0, sigma), "sigma_high": _root(over, sigma, far),
    }


def likelihood(fits: DataFrame, most_se: float = 5.0) -> DataFrame:
    """(effect, studies, mu, sigma and the ends of their intervals); a group is one effect's studies, which are few."""
    schema = "effect string, studies long, mu double, sigma double, mu_low double, mu_high double, sigma_low double, sigma_high double"

    def one(frame):
        import pandas as pd

        found = likelihood_estimate(frame["theta"].to_numpy(float), frame["se"].to_numpy(float))
        return pd.DataFrame([{"effect": frame["effect"].iloc[0], "studies": len(frame)} | found])

    return fits.where(f"se > 0 and se < {most_se} and theta is not null").select("effect", "theta", "se").groupBy("effect").applyInPandas(one, schema)


def weighted_regression(y: np.ndarray, x: np.ndarray, se: np.ndarray, *, rounds: int = 50, huber: float = 1.345) -> dict[str, np.ndarray]:
    """Meta-regression of estimates on study variables: weights by sampling error and spread, residuals beyond `huber` deviations downweighted, iterated."""
    x = np.c_[np.ones(len(y)), x] if x.size else np.ones((len(y), 1))
    spread, robust = 0.0, np.ones(len(y))
    for _ in range(rounds):
        w = robust / (se**2 + spread)
        beta = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
        res = y - x @ beta
        new = max(0.0, float((robust * (res**2 - se**2)).sum() / robust.sum() * len(y) / max(1, len(y) - x.shape[1])))
        u = np.abs(res) / np.sqrt(se**2 + new)
        robust = np.where(u <= huber, 1.0, huber / np.maximum(u, 1e-12))
        if abs(new - spread) < 1e-10:
            break
        spread = new
    w = robust / (se**2 + spread)
    return {"beta": beta, "vcov": np.linalg.inv((x * w[:, None]).T @ x), "weights": w, "spread": np.array(spread), "fitted": x @ beta}


def draws_summary(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """(effect, mean, sd, low, high) of posterior draws (draw, effect, value)."""
    low = (1 - level) / 2
    q = F.percentile("value", F.array(F.lit(low), F.lit(1 - low)))
    return draws.groupBy("effect").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q")).select("effect", "mean", "sd", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def trade_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study, effect, theta, se): nations as studies, market segments as effects; mean order totals, in thousands, less the overall one."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select("o_custkey", (F.col("o_totalprice") / 1000).alias("p"))
    both = orders.join(read("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    overall = F.broadcast(orders.agg(F.avg("p").alias("m")))  # one row
    groups = both.groupBy(F.col("c_nationkey").cast("int").alias("study"), F.col("c_mktsegment").alias("effect")).agg(F.avg("p").alias("a"), (F.stddev_samp("p") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return groups.crossJoin(overall).select("study", "effect", F.round(F.col("a") - F.col("m"), 6).alias("theta"), F.round("se", 6).alias("se"))


MOST_SE = 1e6
_FITS_SQL = """fits AS (SELECT study, effect, round(a - (SELECT avg(o_totalprice / 1000) FROM orders), 6) AS theta, round(se, 6) AS se FROM (
  SELECT CAST(c_nationkey AS INT) AS study, c_mktsegment AS effect, avg(o_totalprice / 1000) AS a, stddev_samp(o_totalprice / 1000) / sqrt(count(*)) AS se FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)),
used AS (SELECT * FROM fits WHERE se > 0 AND se < 1e6 AND theta IS NOT NULL)"""
QUERIES = {
    "meta_analysis": lambda spark, sf_dir: combine(trade_fits(spark, sf_dir), MOST_SE),
    "funnel": lambda spark, sf_dir: funnel(trade_fits(spark, sf_dir), MOST_SE),
    "meta_likelihood": lambda spark, sf_dir: likelihood(trade_fits(spark, sf_dir), MOST_SE),
}
QUERY_SQL = {
    "meta_analysis": f"""WITH {_FITS_SQL}, ranked AS (SELECT *, theta / se AS t, rank() OVER (PARTITION BY effect ORDER BY theta) + (count(*) OVER (PARTITION BY effect, theta) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY effect ORDER BY se) + (count(*) OVER (PARTITION BY effect, se) - 1) / 2.0 AS rs FROM used),
g AS (SELECT effect, count(*) AS studies, sum(t * t) AS t2, sum(theta / (se * se)) AS a, sum(1 / (se * se)) AS b, sum(-2 * ln({NORMAL_TAIL.format(z='-t')})) AS l, sum(-2 * ln({NORMAL_TAIL.format(z='t')})) AS r, coalesce(corr(rt, rs), 0) AS s FROM ranked GROUP BY 1)
SELECT effect, studies, round(t2, 6) AS t2, round(a / b, 6) AS mean, round(1 / sqrt(b), 6) AS se, round(a / sqrt(b), 6) AS z, round(t2 - a * a / b, 6) AS q, round(l, 6) AS "left", round(r, 6) AS "right", round(s, 6) AS spearman FROM g""",
    "funnel": f"""WITH {_FITS_SQL}, m AS (SELECT effect, sum(theta / (se * se)) / sum(1 / (se * se)) AS m FROM used GROUP BY 1)
SELECT u.effect, study, theta, se, round(1 / se, 6) AS precision, abs(theta - m) <= 1.96 * se AS inside FROM used u JOIN m ON m.effect = u.effect""",
}
