"""What actors could do at an observed wave: every possible change with its contributions, its probability, and what each effect matters for it.

The candidate frame has a row for each ordered pair of actors and one for "no change" (j = i), which is as
large as its result; everything on it is joins on the pair and windows over one actor's choices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiewise.plans.features import SqlFeatures, features_of
from tiewise.sources.panel import Panel, trade_panel

#: What a new tie from i to j adds to i's evaluation, as text over the columns of _candidates(), the same in Spark and DuckDB; losing it takes as much away.
GAINS = {
    "density": "1", "recip": "back", "transTrip": "two + together", "transMedTrip": "sent", "cycle3": "round", "inPop": "indegree - has + 1", "outPop": "outdegree",
    "altX": "vj", "egoX": "vi", "egoXaltX": "vi * vj", "diffSqX": "(vj - vi) * (vj - vi)", "simX": "1 - abs(vi - vj) / vrange - vsim", "sameX": "case when ci = cj then 1 else 0 end", "crprod": "other",
}
#: Parameters of the registered queries.
THETA = {"density": -1.2, "recip": 0.9, "transTrip": 0.1, "inPop": 0.02, "sameX": 0.3, "simX": 0.5}


def candidates(panel: Panel) -> DataFrame:
    """(period, i, j, has, back, two, together, sent, round, indegree, outdegree, vi, vj, ci, cj, other, vrange, vsim) at the start of each period."""
    f = features_of(panel)
    nodes = f.nodes.select("period", "id", "v", "c")
    out = nodes.select("period", F.col("id").alias("i"), F.col("v").alias("vi"), F.col("c").alias("ci")).join(nodes.select("period", F.col("id").alias("j"), F.col("v").alias("vj"), F.col("c").alias("cj")), "period")
    for name, net in (("has", "s.f"), ("back", "s.b"), ("other", "w.f")):
        out = out.join(f.relation(net).select("period", F.col("a").alias("i"), F.col("b").alias("j"), F.col("u").alias(name)), ["period", "i", "j"], "left")
    for name, path in (("two", "s.f,s.f"), ("together", "s.f,s.b"), ("sent", "s.b,s.f"), ("round", "s.b,s.b")):
        out = out.join(f.two_steps(path).withColumnRenamed("value", name), ["period", "i", "j"], "left")
    for name, net in (("indegree", "s.b"), ("outdegree", "s.f")):
        out = out.join(f.nodes_of("deg", net).select("period", F.col("id").alias("j"), F.col("value").alias(name)), ["period", "j"], "left")
    return out.fillna(0).crossJoin(F.broadcast(f.consts.select("vrange", "vsim")))


def contributions(panel: Panel, names: list[str]) -> DataFrame:
    """(period, i, j, one column for each effect): what changing the tie adds to i's evaluation, 0 for no change."""
    sign = "case when i = j then 0 when has = 1 then -1 else 1 end"
    return candidates(panel).select("period", "i", "j", *((F.expr(f"cast(({sign}) * ({GAINS[n]}) as double)") + 0.0).alias(n) for n in names))


def probabilities(panel: Panel, theta: dict[str, float]) -> DataFrame:
    """(period, i, j, p): the probability of each choice of i, j = i being no change."""
    own = Window.partitionBy("period", "i")
    u = sum((F.lit(t) * F.col(n) for n, t in theta.items()), F.lit(0.0))
    e = contributions(panel, list(theta)).withColumn("u", u).withColumn("e", F.exp(F.col("u") - F.max("u").over(own)))
    return e.select("period", "i", "j", F.round(F.col("e") / F.sum("e").over(own), 6).alias("p"))


def importance(panel: Panel, theta: dict[str, float]) -> DataFrame:
    """(period, effect, importance, certainty): each effect's share of what leaving it out moves choice distributions, averaged over actors; one less their entropy over its largest value."""
    own = Window.partitionBy("period", "i")
    rows = contributions(panel, list(theta))
    full = sum((F.lit(t) * F.col(n) for n, t in theta.items()), F.lit(0.0))
    utilities = {"full": full} | {n: full - F.lit(t) * F.col(n) for n, t in theta.items()}
    for name, u in utilities.items():
        rows = rows.withColumn(f"u_{name}", u).withColumn(f"e_{name}", F.exp(F.col(f"u_{name}") - F.max(f"u_{name}").over(own))).withColumn(f"p_{name}", F.col(f"e_{name}") / F.sum(f"e_{name}").over(own))
    moved = rows.groupBy("period", "i").agg(*(F.sum(F.abs(F.col("p_full") - F.col(f"p_{n}"))).alias(n) for n in theta), (1 + F.sum(F.col("p_full") * F.log("p_full")) / F.log(F.count(F.lit(1)).cast("double"))).alias("certainty"))
    total = sum((F.col(n) for n in theta), F.lit(0.0))
    each = moved.select("period", "i", "certainty", F.explode(F.array(*(F.struct(F.lit(n).alias("effect"), F.when(total > 0, F.col(n) / total).otherwise(0.0).alias("share")) for n in theta))).alias("r"))
    return each.groupBy("period", "r.effect").agg(F.round(F.avg("r.share"), 6).alias("importance"), F.round(F.avg("certainty"), 6).alias("certainty"))


def behaviour_choices(panel: Panel, linear: float = 0.2, quad: float = -0.1, similarity: float = 0.6) -> DataFrame:
    """(period, id, step, p): probabilities of steps of -1, 0 and 1 at the start of each period, within the range of observed values.

    Parameters are those of the value, its square and its average similarity to alters' values.
    """
    f = features_of(panel)
    z = f.nodes.select("period", "id", "z", "zr")
    bounds = F.broadcast(panel.z.agg(F.min("value").alias("low"), F.max("value").alias("high")))  # one row
    steps = z.crossJoin(bounds).withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).where("zr + step between low and high")
    near = f.relation("s.f").join(z.select("period", F.col("id").alias("b"), F.col("zr").alias("zb")), ["period", "b"]).select("period", F.col("a").alias("id"), "zb")
    gap = steps.select("period", "id", "zr", "step").join(near, ["period", "id"]).groupBy("period", "id", "step").agg(F.avg(F.abs(F.col("zr") + F.col("step") - F.col("zb"))).alias("gap"))
    rows = steps.join(gap, ["period", "id", "step"], "left").crossJoin(F.broadcast(f.consts.select("zrange", "zsim")))
    similar = F.when(F.col("gap").isNotNull(), 1 - F.col("gap") / F.col("zrange") - F.col("zsim")).otherwise(0.0)
    value = F.col("z") + F.col("step")
    own = Window.partitionBy("period", "id")
    u = F.lit(linear) * value + F.lit(quad) * value * value + F.lit(similarity) * similar
    e = rows.withColumn("u", u).withColumn("e", F.exp(F.col("u") - F.max("u").over(own)))
    return e.select("period", "id", F.col("step").cast("int").alias("step"), F.round(F.col("e") / F.sum("e").over(own), 6).alias("p"))


def _table_numbers(panel: Panel) -> dict[str, float]:
    row = features_of(panel).consts.select("zmean", "zrange", "zsim").first()
    return {"mean": row.zmean, "range": row.zrange, "sim": row.zsim, "alters": 3.0}


SELECTION, INFLUENCE = {"egoX": 0.1, "altX": 0.2, "simX": 0.7, "sameX": 0.3}, {"linear": 0.2, "quad": -0.1, "avSim": 0.9, "avAlt": 0.3}


def _tables(kind: str):
    def query(spark, sf_dir: str) -> DataFrame:
        from tiewise.operators import inference

        panel = trade_panel(spark, sf_dir)
        make, theta = {"selection": (inference.selection_table, SELECTION), "influence": (inference.influence_table, INFLUENCE)}[kind]
        return make(spark, panel.z.select("value").distinct(), theta, _table_numbers(panel)).withColumn("contribution", F.round("contribution", 6))

    return query


QUERIES = {
    "change_contributions": lambda spark, sf_dir: contributions(trade_panel(spark, sf_dir), ["density", "recip", "transTrip", "transMedTrip", "cycle3", "inPop", "outPop", "sameX", "crprod"]),
    "choice_probabilities": lambda spark, sf_dir: probabilities(trade_panel(spark, sf_dir), THETA),
    "relative_importance": lambda spark, sf_dir: importance(trade_panel(spark, sf_dir), THETA),
    "behaviour_choices": lambda spark, sf_dir: behaviour_choices(trade_panel(spark, sf_dir)),
    "selection_table": _tables("selection"), "influence_table": _tables("influence"),
}
_BASE = SqlFeatures("start").base
#: Written as scalar subqueries on the pair, unlike the joins above.
_GRID = f"""WITH {_BASE}, t AS MATERIALIZED (SELECT * FROM net_s), cand AS (SELECT a.period, a.id AS i, b.id AS j, a.v AS vi, b.v AS vj, a.c AS ci, b.c AS cj, vrange, vsim,
  (SELECT count(*) FROM t x WHERE x.period = a.period AND x.i = a.id AND x.j = b.id) AS has, (SELECT count(*) FROM t x WHERE x.period = a.period AND x.i = b.id AND x.j = a.id) AS back,
  (SELECT count(*) FROM net_w x WHERE x.period = a.period AND x.i = a.id AND x.j = b.id) AS other,
  (SELECT count(*) FROM t x JOIN t y ON y.period = x.period AND y.i = x.j WHERE a.id <> b.id AND x.period = a.period AND x.i = a.id AND y.j = b.id) AS two,
  (SELECT count(*) FROM t x JOIN t y ON y.period = x.period AND y.j = x.j WHERE a.id <> b.id AND x.period = a.period AND x.i = a.id AND y.i = b.id) AS together,
  (SELECT count(*) FROM t x JOIN t y ON y.period = x.period AND y.i = x.i WHERE a.id <> b.id AND x.period = a.period AND x.j = a.id AND y.j = b.id) AS sent,
  (SELECT count(*) FROM t x JOIN t y ON y.period = x.period AND y.j = x.i WHERE a.id <> b.id AND x.period = a.period AND x.j = a.id AND y.i = b.id) AS "round",
  (SELECT count(*) FROM t x WHERE x.period = a.period AND x.j = b.id) AS indegree, (SELECT count(*) FROM t x WHERE x.period = a.period AND x.i = b.id) AS outdegree
  FROM actors a JOIN actors b ON b.period = a.period CROSS JOIN consts)"""


def _gain(name: str) -> str:
    text = GAINS[name].replace("round", '"round"')
    return f'CAST((CASE WHEN i = j THEN 0 WHEN has = 1 THEN -1 ELSE 1 END) * ({text}) AS DOUBLE) AS "{name}"'


_U = " + ".join(f'{t} * "{n}"' for n, t in THETA.items())
_CHOICE = f"{_GRID}, con AS MATERIALIZED (SELECT period, i, j, {', '.join(map(_gain, THETA))} FROM cand)"
_WITHOUT = ", ".join(f'exp({_U} - {t} * "{n}") / sum(exp({_U} - {t} * "{n}")) OVER own AS p_{n}' for n, t in THETA.items())
_MOVED = " UNION ALL ".join(f"SELECT period, i, '{n}' AS effect, sum(abs(p - p_{n})) AS m FROM probs GROUP BY 1, 2" for n in THETA)


def _table_sql(counts: dict[str, str], theta: dict[str, float]) -> str:
    total = " + ".join(f"{t} * ({counts[n]})" for n, t in theta.items())
    return f"WITH {_BASE}, vals AS (SELECT DISTINCT CAST(value AS DOUBLE) AS v FROM beh) SELECT e.v AS ego, a.v AS alter, round({total}, 6) AS contribution FROM vals e CROSS JOIN vals a CROSS JOIN consts"


_SIMILAR = "1 - abs(e.v - a.v) / zrange - zsim"
QUERY_SQL = {
    "change_contributions": f"{_GRID} SELECT period, i, j, {', '.join(map(_gain, ['density', 'recip', 'transTrip', 'transMedTrip', 'cycle3', 'inPop', 'outPop', 'sameX', 'crprod']))} FROM cand",
    "choice_probabilities": f"{_CHOICE} SELECT period, i, j, round(exp({_U}) / sum(exp({_U})) OVER (PARTITION BY period, i), 6) AS p FROM con",
    "relative_importance": f"""{_CHOICE}, probs AS MATERIALIZED (SELECT period, i, j, exp({_U}) / sum(exp({_U})) OVER own AS p, {_WITHOUT} FROM con WINDOW own AS (PARTITION BY period, i)),
      moved AS ({_MOVED}), tot AS (SELECT period, i, sum(m) AS t FROM moved GROUP BY 1, 2), cert AS (SELECT period, i, 1 + sum(p * ln(p)) / ln(count(*)) AS c FROM probs GROUP BY 1, 2)
      SELECT m.period, effect, round(avg(CASE WHEN t > 0 THEN m / t ELSE 0 END), 6) AS importance, round(avg(c), 6) AS certainty FROM moved m JOIN tot USING (period, i) JOIN cert USING (period, i) GROUP BY 1, 2""",
    "behaviour_choices": f"""WITH {_BASE}, opts AS (SELECT a.period, a.id, s.step, a.z + s.step AS value, a.zr + s.step AS raw FROM actors a CROSS JOIN (VALUES (-1), (0), (1)) s(step) WHERE a.zr + s.step BETWEEN (SELECT min(value) FROM beh) AND (SELECT max(value) FROM beh)),
      u AS (SELECT o.*, 0.2 * value - 0.1 * value * value + 0.6 * coalesce((SELECT avg(1 - abs(o.raw - y.zr) / zrange - zsim) FROM net_s x JOIN actors y ON y.period = x.period AND y.id = x.j CROSS JOIN consts WHERE x.period = o.period AND x.i = o.id), 0) AS u FROM opts o)
      SELECT period, id, CAST(step AS INT) AS step, round(exp(u) / sum(exp(u)) OVER (PARTITION BY period, id), 6) AS p FROM u""",
    "selection_table": _table_sql({"egoX": "e.v - zmean", "altX": "a.v - zmean", "simX": _SIMILAR, "sameX": "CASE WHEN e.v = a.v THEN 1 ELSE 0 END"}, SELECTION),
    "influence_table": _table_sql({"linear": "e.v - zmean", "quad": "(e.v - zmean) * (e.v - zmean)", "avSim": _SIMILAR, "avAlt": "(e.v - zmean) * (a.v - zmean)"}, INFLUENCE),
}
