"""Auxiliary statistics for goodness of fit, and the Monte-Carlo test that compares them with simulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiewise.sources.kept import Kept
from tiewise.sources.panel import PANEL_SQL, Panel, trade_panel

#: Kinds of triads: mutual, asymmetric and empty dyads, and a letter where those leave it open (fixed names).
TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def _kind(ab: str, ba: str, ac: str, ca: str, bc: str, cb: str) -> str:
    """SQL text for the kind of a triad a, b, c whose six arcs are 0 or 1, the same in Spark and DuckDB."""
    pairs = ((ab, ba), (ac, ca), (bc, cb))
    mutual = " + ".join(f"{x} * {y}" for x, y in pairs)
    one_way = " + ".join(f"abs({x} - {y})" for x, y in pairs)
    # Arcs of one-way dyads only, by their sender and by their receiver.
    lone = {name: f"{x} * (1 - {y})" for name, x, y in (("ab", ab, ba), ("ba", ba, ab), ("ac", ac, ca), ("ca", ca, ac), ("bc", bc, cb), ("cb", cb, bc))}
    sent = "greatest({ab} + {ac}, {ba} + {bc}, {ca} + {cb})".format(**lone)
    got = "greatest({ba} + {ca}, {ab} + {cb}, {ac} + {bc})".format(**lone)
    popular = f"greatest({ba} + {ca}, {ab} + {cb}, {ac} + {bc})"
    key = f"(({mutual}) * 10 + ({one_way}))"
    letter = f"(case when {sent} = 2 then 'D' when {got} = 2 then 'U' else 'C' end)"
    return (
        f"case {key} when 0 then '003' when 1 then '012' when 10 then '102' when 2 then '021' || {letter} when 11 then (case when {popular} = 2 then '111D' else '111U' end) "
        f"when 3 then (case when {sent} = 2 then '030T' else '030C' end) when 20 then '201' when 12 then '120' || {letter} when 21 then '210' else '300' end"
    )


def triad_census(panel: Panel) -> DataFrame:
    """(wave, triad, n): all 16 kinds in every wave.

    Only triads with two or three linked pairs are built, from pairs that share an actor; the others
    follow from the numbers of pairs and actors, so that the work grows with the ties and not with n cubed.
    """
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    pairs = panel.x.where("i <> j").groupBy("wave", lo.alias("p"), hi.alias("q")).agg(F.max((F.col("i") < F.col("j")).cast("int")).alias("up"), F.max((F.col("i") > F.col("j")).cast("int")).alias("down"))
    turned = pairs.select("wave", F.col("p").alias("h"), F.col("q").alias("o"), F.col("up").alias("out"), F.col("down").alias("into")).unionByName(pairs.select("wave", F.col("q").alias("h"), F.col("p").alias("o"), F.col("down").alias("out"), F.col("up").alias("into")))
    second = turned.select("wave", "h", F.col("o").alias("q"), F.col("out").alias("hq"), F.col("into").alias("qh"))
    wedges = turned.select("wave", "h", F.col("o").alias("p"), F.col("out").alias("hp"), F.col("into").alias("ph")).join(second, ["wave", "h"]).where("p < q")
    # A triad with three linked pairs is met from each of its actors; the smallest one counts.
    whole = wedges.join(pairs, ["wave", "p", "q"], "left").where("up is null or h < p").fillna(0, ["up", "down"])
    linked = whole.groupBy("wave", F.expr(_kind("hp", "ph", "hq", "qh", "up", "down")).alias("triad")).agg(F.count(F.lit(1)).alias("n"))
    digit = lambda at: F.substring("triad", at, 1).cast("long")
    met = linked.groupBy("wave").agg(F.sum(digit(1) * F.col("n")).alias("m"), F.sum(digit(2) * F.col("n")).alias("a"), F.sum("n").alias("k"))
    dyads = pairs.groupBy("wave").agg(F.sum(F.col("up") * F.col("down")).alias("mutual"), F.sum(1 - F.col("up") * F.col("down")).alias("one_way"))
    size = panel.nodes.agg(F.count(F.lit(1)).alias("size"))
    each = panel.wave_rows().join(met, "wave", "left").join(dyads, "wave", "left").fillna(0).crossJoin(F.broadcast(size))
    n012, n102 = F.col("one_way") * (F.col("size") - 2) - F.col("a"), F.col("mutual") * (F.col("size") - 2) - F.col("m")
    triples = (F.col("size") * (F.col("size") - 1) * (F.col("size") - 2) / 6).cast("long")

    def row(kind: str, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("triad"), n.cast("long").alias("n"))

    sparse = each.select("wave", F.explode(F.array(row("003", triples - F.col("k") - n012 - n102), row("012", n012), row("102", n102), *(row(t, F.lit(0)) for t in TRIADS[3:]))).alias("r")).select("wave", "r.*")
    return sparse.unionByName(linked).groupBy("wave", "triad").agg(F.sum("n").alias("n"))


def category_pairs(panel: Panel) -> DataFrame:
    """(wave, pair, ties): ties by 10 times the sender's category plus the receiver's."""
    i, j = panel.c.select(F.col("id").alias("i"), F.col("value").alias("ci")), panel.c.select(F.col("id").alias("j"), F.col("value").alias("cj"))
    return panel.x.join(i, "i").join(j, "j").groupBy("wave", (F.col("ci") * 10 + F.col("cj")).alias("pair")).agg(F.count(F.lit(1)).alias("ties"))


def dyadic_counts(panel: Panel, width: float = 10.0) -> DataFrame:
    """(wave, level, ties): ties by their dyadic covariate in steps of width; pairs without a value have level 0."""
    level = F.floor(F.coalesce("value", F.lit(0.0)) / width).cast("long")
    return panel.x.join(panel.d, ["i", "j"], "left").groupBy("wave", level.alias("level")).agg(F.count(F.lit(1)).alias("ties"))


def geodesics(panel: Panel) -> DataFrame:
    """(wave, distance, pairs): ordered pairs of different actors by the length of the shortest directed path.

    Every wave has one more row, with a null distance, for the pairs that no path joins, be there any or not.
    """
    tables = Kept(panel.x.sparkSession)
    arcs = tables.keep(panel.x.where("i <> j").select("wave", "i", "j").distinct())
    step = arcs.select("wave", F.col("i").alias("j"), F.col("j").alias("k"))
    front = reached = arcs.withColumn("distance", F.lit(1))
    distance = 1
    while not front.isEmpty():
        distance += 1
        further = front.join(step, ["wave", "j"]).where("i <> k").select("wave", "i", F.col("k").alias("j")).distinct()
        # Kept, so that a level is built from the one before it and not from all of them anew.
        front = tables.keep(further.join(reached, ["wave", "i", "j"], "left_anti").withColumn("distance", F.lit(distance)))
        reached = reached.unionByName(front)
    met = reached.groupBy("wave", "distance").agg(F.count(F.lit(1)).alias("pairs"))
    size = panel.nodes.agg(F.count(F.lit(1)).alias("size"))
    joined = panel.wave_rows().join(met.groupBy("wave").agg(F.sum("pairs").alias("joined")), "wave", "left").fillna(0, ["joined"]).crossJoin(F.broadcast(size))
    apart = joined.select("wave", F.lit(None).cast("int").alias("distance"), (F.col("size") * (F.col("size") - 1) - F.col("joined")).alias("pairs"))
    return met.unionByName(apart)


def monte_carlo_test(simulated, observed, *, two_sided: bool = False) -> dict[str, float]:
    """Mahalanobis distance of observed statistics from simulated ones (n_sims x k) and its Monte-Carlo p value."""
    import numpy as np

    s, o = np.asarray(simulated, float), np.asarray(observed, float)
    centre = s.mean(axis=0)
    inverse = np.linalg.pinv(np.atleast_2d(np.cov(s, rowvar=False)))
    length = lambda d: np.einsum("...i,ij,...j->...", d, inverse, d)
    distance, of_sims = float(length(o - centre)), length(s - centre)
    p = float((of_sims >= distance).mean())
    return {"distance": distance, "p": 1 - abs(1 - 2 * p) if two_sided else p}


_OPERATORS = {"triad_census": triad_census, "category_pairs": category_pairs, "dyadic_counts": dyadic_counts, "geodesic_distribution": geodesics}
QUERIES = {name: (lambda spark, sf_dir, operator=operator: operator(trade_panel(spark, sf_dir))) for name, operator in _OPERATORS.items()}
_ARC = "coalesce((SELECT 1 FROM ties_x x WHERE x.wave = w.wave AND x.i = {0}.id AND x.j = {1}.id), 0) AS {0}{1}"
_SELECTS = {
    "triad_census": f"""SELECT k.wave, k.triad, count(t.kind) AS n FROM (SELECT wave, unnest([{", ".join(f"'{t}'" for t in TRIADS)}]) AS triad FROM waves) k LEFT JOIN (
      SELECT wave, {_kind("ab", "ba", "ac", "ca", "bc", "cb")} AS kind FROM (SELECT w.wave, {", ".join(_ARC.format(*p) for p in ("ab", "ba", "ac", "ca", "bc", "cb"))}
        FROM waves w CROSS JOIN nodes a JOIN nodes b ON a.id < b.id JOIN nodes c ON b.id < c.id)) t ON t.wave = k.wave AND t.kind = k.triad GROUP BY 1, 2""",
    "category_pairs": "SELECT x.wave, a.value * 10 + b.value AS pair, count(*) AS ties FROM ties_x x JOIN cat a ON a.id = x.i JOIN cat b ON b.id = x.j GROUP BY 1, 2",
    "dyadic_counts": "SELECT x.wave, CAST(floor(coalesce(d.value, 0) / 10.0) AS BIGINT) AS level, count(*) AS ties FROM ties_x x LEFT JOIN dyad d ON d.i = x.i AND d.j = x.j GROUP BY 1, 2",
    "geodesic_distribution": """SELECT w.wave, CAST(s.distance AS INT) AS distance, count(*) AS pairs FROM waves w CROSS JOIN nodes a JOIN nodes b ON a.id <> b.id JOIN shortest s ON s.wave = w.wave AND s.i = a.id AND s.j = b.id GROUP BY 1, 2
      UNION ALL SELECT wave, NULL, (SELECT count(*) * (count(*) - 1) FROM nodes) - (SELECT count(*) FROM shortest s WHERE s.wave = w.wave) FROM waves w""",
}
#: Every distance there is, one walk longer at a time.
_SHORTEST = """, walks AS (SELECT wave, i, j, 1 AS distance FROM ties_x UNION SELECT a.wave, a.i, x.j, a.distance + 1 FROM walks a JOIN ties_x x ON x.wave = a.wave AND x.i = a.j WHERE a.distance < (SELECT count(*) FROM nodes) - 1),
shortest AS (SELECT wave, i, j, min(distance) AS distance FROM walks WHERE i <> j GROUP BY 1, 2, 3) """
QUERY_SQL = {name: f"WITH RECURSIVE {PANEL_SQL}{_SHORTEST if name == 'geodesic_distribution' else ' '}{sql}" for name, sql in _SELECTS.items()}
