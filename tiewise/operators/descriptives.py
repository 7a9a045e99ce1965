"""Descriptive operators on a panel: densities, tie changes, dyad states, degree and behaviour distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewise.sources.panel import PANEL_SQL, Panel, trade_panel

#: Degrees counted by the distributions; larger ones are beyond the last level of a cumulative count.
LEVELS = tuple(range(9))


def density(panel: Panel) -> DataFrame:
    """(wave, ties, density, mean_degree)"""
    n = panel.nodes.agg(F.count(F.lit(1)).alias("n"))
    ties = panel.wave_rows().join(panel.x.groupBy("wave").agg(F.count(F.lit(1)).alias("ties")), "wave", "left").fillna(0, ["ties"]).crossJoin(F.broadcast(n))
    return ties.select("wave", "ties", F.round(F.col("ties") / (F.col("n") * (F.col("n") - 1)), 6).alias("density"), F.round(F.col("ties") / F.col("n"), 6).alias("mean_degree"))


def tie_changes(panel: Panel) -> DataFrame:
    """(period, n00, n01, n10, n11, distance, jaccard) between consecutive waves."""
    now, then = panel.x.select(F.col("wave").alias("period"), "i", "j", F.lit(1).alias("a")), panel.x.select((F.col("wave") - 1).alias("period"), "i", "j", F.lit(1).alias("b"))
    both = now.join(then, ["period", "i", "j"], "full_outer").where(f"period between 1 and {panel.waves - 1}").fillna(0, ["a", "b"])
    sums = both.groupBy("period").agg(*(F.count_if((F.col("a") == a) & (F.col("b") == b)).alias(f"n{a}{b}") for a, b in ((0, 1), (1, 0), (1, 1))))
    n = panel.nodes.agg(F.count(F.lit(1)).alias("n"))
    out = sums.crossJoin(F.broadcast(n)).withColumn("n00", F.col("n") * (F.col("n") - 1) - F.col("n01") - F.col("n10") - F.col("n11"))
    return out.select("period", "n00", "n01", "n10", "n11", (F.col("n01") + F.col("n10")).alias("distance"), F.round(F.col("n11") / (F.col("n11") + F.col("n10") + F.col("n01")), 6).alias("jaccard"))


def dyad_census(panel: Panel) -> DataFrame:
    """(wave, mutual, asymmetric, empty)"""
    back = panel.x.select("wave", F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("r"))
    ties = panel.x.join(back, ["wave", "i", "j"], "left").groupBy("wave").agg(F.count("r").alias("arcs"), F.count(F.lit(1)).alias("ties"))
    n = panel.nodes.agg(F.count(F.lit(1)).alias("n"))
    mutual = (F.col("arcs") / 2).cast("long")
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return panel.wave_rows().join(ties, "wave", "left").fillna(0).crossJoin(F.broadcast(n)).select("wave", mutual.alias("mutual"), (F.col("ties") - F.col("arcs")).alias("asymmetric"), (pairs - mutual - (F.col("ties") - F.col("arcs"))).alias("empty"))


def degree_distribution(panel: Panel, direction: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(wave, level, actors): how many actors have at most that many ties out ("out") or in ("in")."""
    end = {"out": "i", "in": "j"}[direction]
    degree = panel.x.groupBy("wave", F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    each = F.broadcast(panel.wave_rows()).crossJoin(panel.nodes).join(degree, ["wave", "id"], "left").fillna(0, ["degree"])
    counts = each.groupBy("wave").agg(*(F.count_if(F.col("degree") <= k).alias(f"c{k}") for k in levels))
    return counts.select("wave", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"c{k}").alias("actors")) for k in levels))).alias("r")).select("wave", "r.level", "r.actors")


def behaviour_distribution(panel: Panel) -> DataFrame:
    """(wave, value, actors, share)"""
    counts = panel.z.groupBy("wave", "value").agg(F.count(F.lit(1)).alias("actors"))
    totals = panel.z.groupBy("wave").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(totals, "wave").select("wave", "value", "actors", F.round(F.col("actors") / F.col("n"), 6).alias("share"))


def behaviour_changes(panel: Panel) -> DataFrame:
    """(period, before, after, actors)"""
    then = panel.z.select((F.col("wave") - 1).alias("wave"), "id", F.col("value").alias("after"))
    return panel.z.join(then, ["wave", "id"]).groupBy(F.col("wave").alias("period"), F.col("value").alias("before"), "after").agg(F.count(F.lit(1)).alias("actors"))


def behaviour_distance(panel: Panel) -> DataFrame:
    """(period, distance, up, down, same): sum of absolute differences of actors' values, and how many of them rise, fall and stay."""
    then = panel.z.select((F.col("wave") - 1).alias("wave"), "id", F.col("value").alias("after"))
    step = F.col("after") - F.col("value")
    return panel.z.join(then, ["wave", "id"]).groupBy(F.col("wave").alias("period")).agg(F.sum(F.abs(step)).cast("long").alias("distance"), F.count_if(step > 0).alias("up"), F.count_if(step < 0).alias("down"), F.count_if(step == 0).alias("same"))


def continuous_changes(values: DataFrame) -> DataFrame:
    """(period, actors, mean, sd, least, most) of the changes of a continuous variable (wave, id, value) between consecutive waves."""
    then = values.select((F.col("wave") - 1).alias("wave"), "id", F.col("value").alias("after"))
    step = F.col("after") - F.col("value")
    r = lambda c: F.round(c, 2)
    return values.join(then, ["wave", "id"]).groupBy(F.col("wave").alias("period")).agg(F.count(F.lit(1)).alias("actors"), r(F.avg(step)).alias("mean"), r(F.stddev_samp(step)).alias("sd"), r(F.min(step)).alias("least"), r(F.max(step)).alias("most"))


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wave, id, value): nations' order totals by year, the continuous variable behind the trade panel's behaviour."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    first = F.broadcast(read("orders").agg(F.year(F.min("o_orderdate")).alias("y0")))  # one row
    orders = read("orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice").crossJoin(first)
    both = orders.join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy((F.col("y") - F.col("y0") + 1).alias("wave"), F.col("c_nationkey").cast("int").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def behaviour_pairs(panel: Panel) -> DataFrame:
    """(wave, pair, ties): ties by 10 times the sender's value plus the receiver's."""
    i, j = panel.z.select("wave", F.col("id").alias("i"), F.col("value").alias("zi")), panel.z.select("wave", F.col("id").alias("j"), F.col("value").alias("zj"))
    return panel.x.join(i, ["wave", "i"]).join(j, ["wave", "j"]).groupBy("wave", (F.col("zi") * 10 + F.col("zj")).alias("pair")).agg(F.count(F.lit(1)).alias("ties"))


def higher(panel: Panel) -> DataFrame:
    """(wave, higher, disjoint, at_least_one): which constraints hold between x and w."""
    only_w = panel.w.join(panel.x, ["wave", "i", "j"], "left_anti").groupBy("wave").agg(F.count(F.lit(1)).alias("only_w"))
    shared = panel.w.join(panel.x, ["wave", "i", "j"], "left_semi").groupBy("wave").agg(F.count(F.lit(1)).alias("shared"))
    either = panel.x.unionByName(panel.w).distinct().groupBy("wave").agg(F.count(F.lit(1)).alias("either"))
    n = panel.nodes.agg(F.count(F.lit(1)).alias("n"))
    out = panel.wave_rows()
    for part in (only_w, shared, either):
        out = out.join(part, "wave", "left")
    return out.fillna(0).crossJoin(F.broadcast(n)).select("wave", (F.col("only_w") == 0).alias("higher"), (F.col("shared") == 0).alias("disjoint"), (F.col("either") == F.col("n") * (F.col("n") - 1)).alias("at_least_one"))


_OPERATORS = {
    "wave_density": density, "tie_changes": tie_changes, "dyad_census": dyad_census, "outdegree_distribution": lambda p: degree_distribution(p, "out"), "indegree_distribution": lambda p: degree_distribution(p, "in"),
    "behaviour_distribution": behaviour_distribution, "behaviour_changes": behaviour_changes, "behaviour_pairs": behaviour_pairs, "behaviour_distance": behaviour_distance, "network_constraints": higher,
}


def _query(name: str):
    return lambda spark, sf_dir: _OPERATORS[name](trade_panel(spark, sf_dir))


_DEGREES = "SELECT CAST(w.wave AS INT) AS wave, CAST(l.level AS INT) AS level, count(*) FILTER (coalesce(d.n, 0) <= l.level) AS actors FROM waves w CROSS JOIN nodes o CROSS JOIN (SELECT unnest(range(0, 9)) AS level) l LEFT JOIN (SELECT wave, {end} AS id, count(*) AS n FROM ties_x GROUP BY 1, 2) d ON d.wave = w.wave AND d.id = o.id GROUP BY 1, 2"
_SELECTS = {
    "wave_density": "SELECT w.wave, count(x.i) AS ties, round(count(x.i) / (SELECT count(*) * (count(*) - 1) FROM nodes), 6) AS density, round(count(x.i) / (SELECT count(*) FROM nodes), 6) AS mean_degree FROM waves w LEFT JOIN ties_x x ON x.wave = w.wave GROUP BY 1",
    "tie_changes": """SELECT period, (SELECT count(*) * (count(*) - 1) FROM nodes) - n01 - n10 - n11 AS n00, n01, n10, n11, n01 + n10 AS distance, round(n11 / (n11 + n10 + n01), 6) AS jaccard FROM (
      SELECT p.period, (SELECT count(*) FROM ties_x b WHERE b.wave = p.period + 1 AND NOT EXISTS (SELECT 1 FROM ties_x a WHERE a.wave = p.period AND a.i = b.i AND a.j = b.j)) AS n01,
      (SELECT count(*) FROM ties_x a WHERE a.wave = p.period AND NOT EXISTS (SELECT 1 FROM ties_x b WHERE b.wave = p.period + 1 AND a.i = b.i AND a.j = b.j)) AS n10,
      (SELECT count(*) FROM ties_x a JOIN ties_x b ON b.wave = a.wave + 1 AND a.i = b.i AND a.j = b.j WHERE a.wave = p.period) AS n11 FROM periods p)""",
    "dyad_census": """SELECT wave, count(*) FILTER (k = 2) AS mutual, count(*) FILTER (k = 1) AS asymmetric, count(*) FILTER (k = 0) AS empty FROM (
      SELECT w.wave, a.id, b.id, count(x.i) AS k FROM waves w CROSS JOIN nodes a JOIN nodes b ON a.id < b.id LEFT JOIN ties_x x ON x.wave = w.wave AND ((x.i = a.id AND x.j = b.id) OR (x.i = b.id AND x.j = a.id)) GROUP BY 1, 2, 3) GROUP BY 1""",
    "outdegree_distribution": _DEGREES.format(end="i"),
    "indegree_distribution": _DEGREES.format(end="j"),
    "behaviour_distribution": "SELECT wave, value, count(*) AS actors, round(count(*) / sum(count(*)) OVER (PARTITION BY wave), 6) AS share FROM beh GROUP BY wave, value",
    "behaviour_changes": "SELECT a.wave AS period, a.value AS before, b.value AS after, count(*) AS actors FROM beh a JOIN beh b ON b.id = a.id AND b.wave = a.wave + 1 GROUP BY 1, 2, 3",
    "behaviour_distance": "SELECT a.wave AS period, CAST(sum(abs(b.value - a.value)) AS BIGINT) AS distance, count(*) FILTER (b.value > a.value) AS up, count(*) FILTER (b.value < a.value) AS down, count(*) FILTER (b.value = a.value) AS same FROM beh a JOIN beh b ON b.id = a.id AND b.wave = a.wave + 1 GROUP BY 1",
    "continuous_changes": """SELECT a.wave AS period, count(*) AS actors, round(avg(b.s - a.s), 2) AS mean, round(stddev_samp(b.s - a.s), 2) AS sd, round(min(b.s - a.s), 2) AS least, round(max(b.s - a.s), 2) AS most FROM totals a JOIN totals b ON b.id = a.id AND b.wave = a.wave + 1 GROUP BY 1""",
    "behaviour_pairs": "SELECT x.wave, a.value * 10 + b.value AS pair, count(*) AS ties FROM ties_x x JOIN beh a ON a.wave = x.wave AND a.id = x.i JOIN beh b ON b.wave = x.wave AND b.id = x.j GROUP BY 1, 2",
    "network_constraints": """SELECT w.wave, NOT EXISTS (SELECT wave, i, j FROM ties_w WHERE wave = w.wave EXCEPT SELECT wave, i, j FROM ties_x) AS higher,
      NOT EXISTS (SELECT wave, i, j FROM ties_w WHERE wave = w.wave INTERSECT SELECT wave, i, j FROM ties_x) AS disjoint,
      (SELECT count(*) FROM (SELECT i, j FROM ties_x WHERE wave = w.wave UNION SELECT i, j FROM ties_w WHERE wave = w.wave)) = (SELECT count(*) * (count(*) - 1) FROM nodes) AS at_least_one FROM waves w""",
}

QUERIES = {name: _query(name) for name in _OPERATORS} | {"continuous_changes": lambda spark, sf_dir: continuous_changes(order_totals(spark, sf_dir))}
_TOTALS = ", totals AS (SELECT CAST(year(o_orderdate) - (SELECT year(min(o_orderdate)) FROM orders) + 1 AS INT) AS wave, CAST(c_nationkey AS INT) AS id, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
QUERY_SQL = {name: f"WITH {PANEL_SQL}{_TOTALS if name == 'continuous_changes' else ''} {sql}" for name, sql in _SELECTS.items()}
