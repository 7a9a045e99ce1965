"""Counts of small configurations around pairs of actors, as tables of ties (wave, i, j)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewise.sources.panel import PANEL_SQL, Panel, trade_panel


def directed(ties: DataFrame, direction: str) -> DataFrame:
    """(wave, a, b): f the ties, b their reverse, m the mutual ones, e either way."""
    f = ties.select("wave", F.col("i").alias("a"), F.col("j").alias("b"))
    b = ties.select("wave", F.col("j").alias("a"), F.col("i").alias("b"))
    return {"f": lambda: f, "b": lambda: b, "m": lambda: f.join(b, ["wave", "a", "b"], "left_semi"), "e": lambda: f.union(b).distinct()}[direction]()


def two_paths(first: DataFrame, second: DataFrame) -> DataFrame:
    """(wave, i, j, k): two-steps from i over first (wave, a, b) and second to another actor j, pairs without any left out."""
    one = first.select("wave", F.col("a").alias("i"), F.col("b").alias("h"))
    two = second.select("wave", F.col("a").alias("h"), F.col("b").alias("j"))
    return one.join(two, ["wave", "h"]).where("i <> j").groupBy("wave", "i", "j").agg(F.count(F.lit(1)).alias("k"))


def truncated(paths: DataFrame, most: int) -> DataFrame:
    return paths.withColumn("k", F.least("k", F.lit(most)))


def at_most(paths: DataFrame, actors: DataFrame, most: int) -> DataFrame:
    """(wave, pairs): ordered pairs of different actors with at most that many two-paths, those without any included."""
    n = actors.agg(F.count(F.lit(1)).alias("n"))
    more = paths.groupBy("wave").agg(F.count_if(F.col("k") > most).alias("more"))
    return more.crossJoin(F.broadcast(n)).select("wave", (F.col("n") * (F.col("n") - 1) - F.col("more")).alias("pairs"))


def neighbour_census(ties: DataFrame) -> DataFrame:
    """(wave, i, j, n3, n4): for pairs i < j the actors that have three, and all four, possible ties with both; pairs without any left out."""
    incident = directed(ties, "f").union(directed(ties, "b")).groupBy("wave", F.col("a").alias("node"), F.col("b").alias("h")).agg(F.count(F.lit(1)).alias("k"))
    left, right = (incident.select("wave", "h", F.col("node").alias(x), F.col("k").alias(f"k{x}")) for x in "ij")
    both = left.join(right, ["wave", "h"]).where("i < j and ki + kj >= 3")
    return both.groupBy("wave", "i", "j").agg(F.count_if(F.expr("ki + kj = 3")).alias("n3"), F.count_if(F.expr("ki + kj = 4")).alias("n4"))


def critical_in_stars(ties: DataFrame) -> DataFrame:
    """(wave, i, j, k): receivers h of both i and j such that no other two-path than by way of j leads from i to h."""
    f = directed(ties, "f")
    paths = two_paths(f, f).select("wave", "i", F.col("j").alias("h"), F.col("k").alias("t"))
    sent = ties.select("wave", "i", F.col("j").alias("h")).join(paths, ["wave", "i", "h"], "left").fillna(0, ["t"]).where("t <= 1")
    stars = sent.join(ties.select("wave", F.col("i").alias("j"), F.col("j").alias("h")), ["wave", "h"]).where("i <> j")
    known = stars.join(ties.withColumn("tied", F.lit(1)), ["wave", "i", "j"], "left")
    return known.where("t = 0 or tied = 1").groupBy("wave", "i", "j").agg(F.count(F.lit(1)).alias("k"))


def betweenness(ties: DataFrame) -> DataFrame:
    """(wave, id, k): two-paths by way of an actor whose ends are not tied directly."""
    steps = ties.select("wave", "i", F.col("j").alias("h")).join(ties.select("wave", F.col("i").alias("h"), "j"), ["wave", "h"]).where("i <> j")
    return steps.join(ties, ["wave", "i", "j"], "left_anti").groupBy("wave", F.col("h").alias("id")).agg(F.count(F.lit(1)).alias("k"))


def distance_two(ties: DataFrame) -> DataFrame:
    """(wave, i, j): pairs that two steps in any direction join and no tie does."""
    e = directed(ties, "e")
    return two_paths(e, e).select("wave", "i", "j").join(e.select("wave", F.col("a").alias("i"), F.col("b").alias("j")), ["wave", "i", "j"], "left_anti")


def set_algebra(x: DataFrame, w: DataFrame) -> dict[str, DataFrame]:
    """Union, intersection, difference and symmetric difference of two sets of ties."""
    return {"union": x.union(w).distinct(), "intersection": x.intersect(w), "difference": x.subtract(w), "symmetric": x.subtract(w).union(w.subtract(x))}


def _sets(p: Panel) -> DataFrame:
    out = None
    for name, ties in set_algebra(p.x.select("wave", "i", "j"), p.w.select("wave", "i", "j")).items():
        part = p.wave_rows().join(ties.groupBy("wave").agg(F.count(F.lit(1)).alias("ties")), "wave", "left").fillna(0).withColumn("operation", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _paths(p: Panel) -> DataFrame:
    out = None
    for name in ("ff", "fb", "bf", "mm", "ee"):
        paths = two_paths(directed(p.x, name[0]), directed(p.x, name[1]))
        part = paths.groupBy("wave").agg(F.count(F.lit(1)).alias("pairs"), F.sum("k").alias("paths"), F.sum(F.least("k", F.lit(2))).alias("up_to_two")).join(at_most(paths, p.nodes, 1).withColumnRenamed("pairs", "at_most_one"), "wave").withColumn("path", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_OPERATORS = {
    "tie_sets": _sets, "two_path_counts": _paths, "neighbour_census": lambda p: neighbour_census(p.x), "critical_in_stars": lambda p: critical_in_stars(p.x), "betweenness": lambda p: betweenness(p.x),
    "distance_two": lambda p: distance_two(p.x).groupBy("wave", "i").agg(F.count(F.lit(1)).alias("others")),
}
QUERIES = {name: (lambda spark, sf_dir, operator=operator: operator(trade_panel(spark, sf_dir))) for name, operator in _OPERATORS.items()}
_STEP = {"f": "SELECT wave, i AS a, j AS b FROM ties_x", "b": "SELECT wave, j, i FROM ties_x", "m": "SELECT wave, i, j FROM ties_x x WHERE EXISTS (SELECT 1 FROM ties_x y WHERE y.wave = x.wave AND y.i = x.j AND y.j = x.i)", "e": "SELECT wave, i, j FROM ties_x UNION SELECT wave, j, i FROM ties_x"}


def _path_sql(name: str) -> str:
    one, two = (f"(SELECT * FROM ({_STEP[d]}) q(wave, a, b))" for d in name)
    counts = f"(SELECT p.wave, p.a AS i, q.b AS j, count(*) AS k FROM {one} p JOIN {two} q ON q.wave = p.wave AND q.a = p.b WHERE p.a <> q.b GROUP BY 1, 2, 3)"
    return f"SELECT wave, count(*) AS pairs, sum(k)::BIGINT AS paths, sum(least(k, 2))::BIGINT AS up_to_two, (SELECT count(*) * (count(*) - 1) FROM nodes) - count(*) FILTER (k > 1) AS at_most_one, '{name}' AS path FROM {counts} GROUP BY wave"


_SELECTS = {
    "tie_sets": " UNION ALL ".join(f"SELECT w.wave, (SELECT count(*) FROM ({sql}) q WHERE q.wave = w.wave) AS ties, '{name}' AS operation FROM waves w" for name, sql in {"union": "SELECT * FROM ties_x UNION SELECT * FROM ties_w", "intersection": "SELECT * FROM ties_x INTERSECT SELECT * FROM ties_w", "difference": "SELECT * FROM ties_x EXCEPT SELECT * FROM ties_w", "symmetric": "(SELECT * FROM ties_x UNION SELECT * FROM ties_w) EXCEPT (SELECT * FROM ties_x INTERSECT SELECT * FROM ties_w)"}.items()),
    "two_path_counts": " UNION ALL ".join(map(_path_sql, ("ff", "fb", "bf", "mm", "ee"))),
    "neighbour_census": """SELECT wave, i, j, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 4) AS n4 FROM (SELECT w.wave, a.id AS i, b.id AS j, h.id AS h,
      (SELECT count(*) FROM ties_x x WHERE x.wave = w.wave AND ((x.i = h.id AND x.j IN (a.id, b.id)) OR (x.j = h.id AND x.i IN (a.id, b.id)))) AS k
      FROM waves w CROSS JOIN nodes a JOIN nodes b ON a.id < b.id JOIN nodes h ON h.id NOT IN (a.id, b.id)) WHERE k >= 3 GROUP BY 1, 2, 3""",
    "critical_in_stars": """SELECT x.wave, x.i, y.i AS j, count(*) AS k FROM ties_x x JOIN ties_x y ON y.wave = x.wave AND y.j = x.j AND y.i <> x.i
      WHERE NOT EXISTS (SELECT 1 FROM ties_x a JOIN ties_x b ON b.wave = a.wave AND b.i = a.j WHERE a.wave = x.wave AND a.i = x.i AND b.j = x.j AND a.j <> y.i) GROUP BY 1, 2, 3""",
    "betweenness": "SELECT x.wave, x.j AS id, count(*) AS k FROM ties_x x JOIN ties_x y ON y.wave = x.wave AND y.i = x.j AND y.j <> x.i WHERE NOT EXISTS (SELECT 1 FROM ties_x z WHERE z.wave = x.wave AND z.i = x.i AND z.j = y.j) GROUP BY 1, 2",
    "distance_two": f"SELECT wave, i, count(*) AS others FROM (SELECT DISTINCT p.wave, p.a AS i, q.b AS j FROM ({_STEP['e']}) p(wave, a, b) JOIN ({_STEP['e']}) q(wave, a, b) ON q.wave = p.wave AND q.a = p.b AND q.b <> p.a EXCEPT SELECT wave, i, j FROM ({_STEP['e']})) GROUP BY 1, 2",
}
QUERY_SQL = {name: f"WITH {PANEL_SQL} {sql}" for name, sql in _SELECTS.items()}
