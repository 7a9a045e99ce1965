"""Descriptions and checks of coded networks, where cells may be missing or fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiewise.sources.coded import CELL, CODED_SQL, Coded, end_networks, grid, imputed, start_networks, states, trade_codes


def missing_share(net: Coded) -> DataFrame:
    """(grp, wave, missing, fixed, observed_ties, share_missing, density): density of the cells that are observed."""
    counts = net.cells.groupBy("grp", "wave").agg(F.count_if(F.col("code").isNull()).alias("missing"), F.count_if(F.col("code") >= 10).alias("fixed"), F.count_if(F.col("code") % 10 == 1).alias("observed_ties"))
    each = net.possible().crossJoin(F.broadcast(net.wave_rows())).join(counts, ["grp", "wave"], "left").fillna(0)
    return each.select("grp", "wave", "missing", "fixed", "observed_ties", F.round(F.col("missing") / F.col("pairs"), 6).alias("share_missing"), F.round(F.when(F.col("pairs") > F.col("missing"), F.col("observed_ties") / (F.col("pairs") - F.col("missing"))).otherwise(0.0), 6).alias("density"))


def changes(net: Coded) -> DataFrame:
    """(grp, period, n00, n01, n10, n11, missing, distance, jaccard, reversed): cells observed at both ends; distance leaves out fixed ones too.

    `reversed` warns that ties persist less often than absent ones form.
    """
    s = states(net)
    pair = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b))
    counts = s.groupBy("grp", "period").agg(
        F.count(F.lit(1)).alias("rows"), *(pair(a, b).alias(f"k{a}{b}") for a in (0, 1) for b in (0, 1)), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"),
        F.count_if((F.col("a") != F.col("b")) & ~F.col("fixed_a") & ~F.col("fixed_b")).alias("distance"),
    )
    periods = net.wave_rows().where(F.col("wave") < net.waves).select(F.col("wave").alias("period"))
    out = net.possible().crossJoin(F.broadcast(periods)).join(counts, ["grp", "period"], "left").fillna(0)
    n00 = F.col("pairs") - F.col("rows") + F.col("k00")
    changed = F.col("k01") + F.col("k10") + F.col("k11")
    return out.select(
        "grp", "period", n00.alias("n00"), F.col("k01").alias("n01"), F.col("k10").alias("n10"), F.col("k11").alias("n11"), "missing", "distance",
        F.round(F.when(changed > 0, F.col("k11") / changed).otherwise(0.0), 6).alias("jaccard"), F.coalesce(F.col("k11") * (n00 + F.col("k01")) < F.col("k01") * (F.col("k10") + F.col("k11")), F.lit(False)).alias("reversed"),
    )


def degree_moments(net: Coded) -> DataFrame:
    """(grp, wave, mean_degree, out_square, in_square, reciprocal, reciprocal_square): averages over actors of the imputed networks' degrees."""
    x = imputed(net)
    back = x.select("grp", "wave", F.col("j").alias("i"), F.col("i").alias("j"))
    mutual = x.join(back, ["grp", "wave", "i", "j"], "left_semi")

    def squares(ties: DataFrame, end: str, name: str) -> DataFrame:
        k = ties.groupBy("grp", "wave", end).agg(F.count(F.lit(1)).alias("k"))
        return k.groupBy("grp", "wave").agg(F.sum("k").alias(f"{name}_sum"), F.sum(F.col("k") * F.col("k")).alias(f"{name}_sq"))

    n = net.nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    m = n if net.receivers is None else net.receivers.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    each = n.crossJoin(F.broadcast(net.wave_rows())).join(m.withColumnRenamed("n", "m"), "grp")
    for part in (squares(x, "i", "out"), squares(x, "j", "in"), squares(mutual, "i", "rec")):
        each = each.join(part, ["grp", "wave"], "left")
    share = lambda c, by="n": F.round(F.col(c) / F.col(by), 6)
    return each.fillna(0).select("grp", "wave", share("out_sum").alias("mean_degree"), share("out_sq").alias("out_square"), share("in_sq", "m").alias("in_square"), share("rec_sum").alias("reciprocal"), share("rec_sq").alias("reciprocal_square"))


def symmetric(net: Coded) -> DataFrame:
    """(grp, wave, symmetric): whether every cell equals its mirror image, missing ones too."""
    code = F.coalesce("code", F.lit(-1))
    cells = net.cells.where("code is null or code <> 0").select("grp", "wave", "i", "j", code.alias("code"))
    back = cells.select("grp", "wave", F.col("j").alias("i"), F.col("i").alias("j"), "code")
    odd = cells.join(back, ["grp", "wave", "i", "j", "code"], "left_anti").select("grp", "wave").distinct().withColumn("odd", F.lit(True))
    return net.possible().select("grp").crossJoin(F.broadcast(net.wave_rows())).join(odd, ["grp", "wave"], "left").select("grp", "wave", F.col("odd").isNull().alias("symmetric"))


def impossible_changes(net: Coded) -> DataFrame:
    """(grp, zero_to_one, one_to_zero, zero_gap, one_gap): changes that likelihood estimation can't explain.

    Fixed zeros that are ties at the next wave, fixed ties that are not; the gaps are the same with missing waves in between.
    """
    by = Window.partitionBy(*CELL).orderBy("wave")
    rows = grid(net).withColumn("next", F.lead("code").over(by)).withColumn("seen_next", F.lead("seen").over(by))
    known = Window.partitionBy(*CELL).orderBy("wave").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("later", F.first("code", ignorenulls=True).over(known))
    late = (F.col("seen_next") == F.lit(False)) & F.col("later").isNotNull()
    count = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    found = rows.groupBy("grp").agg(
        count((F.col("code") == 10) & F.col("next").isin(1, 11)).alias("zero_to_one"), count((F.col("code") == 11) & F.col("next").isin(0, 10)).alias("one_to_zero"),
        count((F.col("code") == 10) & late & F.col("later").isin(1, 11)).alias("zero_gap"), count((F.col("code") == 11) & late & F.col("later").isin(0, 10)).alias("one_gap"),
    )
    return net.possible().select("grp").join(found, "grp", "left").fillna(0)


def no_change(net: Coded) -> DataFrame:
    """(grp, period, unchanged, up_only, down_only): whether nothing, or only gains or losses, happen among cells observed at both ends and not fixed."""
    free = F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("fixed_a") & ~F.col("fixed_b")
    moves = states(net).where(free).groupBy("grp", "period").agg(F.count_if(F.col("a") < F.col("b")).alias("up"), F.count_if(F.col("a") > F.col("b")).alias("down"))
    periods = net.wave_rows().where(F.col("wave") < net.waves).select(F.col("wave").alias("period"))
    each = net.possible().select("grp").crossJoin(F.broadcast(periods)).join(moves, ["grp", "period"], "left").fillna(0)
    return each.select("grp", "period", ((F.col("up") == 0) & (F.col("down") == 0)).alias("unchanged"), (F.col("down") == 0).alias("up_only"), (F.col("up") == 0).alias("down_only"))


def evaluated_ties(net: Coded) -> DataFrame:
    """(grp, period, start_ties, end_ties, reciprocated): sizes of the networks that statistics see."""
    end = end_networks(net)
    back = end.select("grp", "period", F.col("j").alias("i"), F.col("i").alias("j"))
    mutual = end.join(back, ["grp", "period", "i", "j"], "left_semi")
    each = net.possible().select("grp").crossJoin(F.broadcast(net.wave_rows().where(F.col("wave") < net.waves).select(F.col("wave").alias("period"))))
    for name, ties in (("start_ties", start_networks(net)), ("end_ties", end), ("reciprocated", mutual)):
        each = each.join(ties.groupBy("grp", "period").agg(F.count(F.lit(1)).alias(name)), ["grp", "period"], "left")
    return each.fillna(0)


def input_report(net: Coded) -> DataFrame:
    """(grp, item, wave, value): the counts that a report of the data gives, one row a number."""
    share, moments = missing_share(net), degree_moments(net)
    long = lambda df, cs: df.select("grp", "wave", F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in cs))).alias("r")).select("grp", "r.item", "wave", "r.value")
    return long(share, ["missing", "fixed", "observed_ties", "share_missing", "density"]).unionByName(long(moments, ["mean_degree", "out_square", "in_square", "reciprocal"]))


_OPERATORS = {"coded_missing": missing_share, "coded_changes": changes, "coded_degrees": degree_moments, "coded_symmetric": symmetric, "coded_impossible": impossible_changes, "coded_no_change": no_change, "coded_evaluated": evaluated_ties}
QUERIES = {name: (lambda spark, sf_dir, operator=operator: operator(trade_codes(spark, sf_dir))) for name, operator in _OPERATORS.items()}
_STATES = "s AS (SELECT p.period, a.i, a.j, a.code % 10 AS a, b.code % 10 AS b, coalesce(a.code >= 10, false) AS fa, coalesce(b.code >= 10, false) AS fb, a.code AS ca, b.code AS cb FROM periods p JOIN cells a ON a.wave = p.period JOIN cells b ON b.wave = p.period + 1 AND b.i = a.i AND b.j = a.j)"
_IMPUTED = "x AS (SELECT wave, i, j FROM (SELECT wave, i, j, last_value(code % 10 IGNORE NULLS) OVER (PARTITION BY i, j ORDER BY wave) AS v FROM cells) WHERE v = 1)"
_SELECTS = {
    "coded_missing": " SELECT 'trade' AS grp, wave, count(*) FILTER (code IS NULL) AS missing, count(*) FILTER (code >= 10) AS fixed, count(*) FILTER (code % 10 = 1) AS observed_ties, round(count(*) FILTER (code IS NULL) / count(*), 6) AS share_missing, round(CASE WHEN count(code) > 0 THEN count(*) FILTER (code % 10 = 1) / count(code) ELSE 0 END, 6) AS density FROM cells GROUP BY wave",
    "coded_changes": f""", {_STATES}, k AS (SELECT period, count(*) FILTER (a = 0 AND b = 0) AS n00, count(*) FILTER (a = 0 AND b = 1) AS n01, count(*) FILTER (a = 1 AND b = 0) AS n10, count(*) FILTER (a = 1 AND b = 1) AS n11, count(*) FILTER (a IS NULL OR b IS NULL) AS missing, count(*) FILTER (a <> b AND NOT fa AND NOT fb) AS distance FROM s GROUP BY 1)
      SELECT 'trade' AS grp, *, round(CASE WHEN n01 + n10 + n11 > 0 THEN n11 / (n01 + n10 + n11) ELSE 0 END, 6) AS jaccard, n11 * (n00 + n01) < n01 * (n10 + n11) AS reversed FROM k""",
    "coded_degrees": f""", {_IMPUTED}, d AS (SELECT t.wave, o.id, (SELECT count(*) FROM x WHERE x.wave = t.wave AND x.i = o.id) AS k, (SELECT count(*) FROM x WHERE x.wave = t.wave AND x.j = o.id) AS q, (SELECT count(*) FROM x JOIN x y ON y.wave = x.wave AND y.i = x.j AND y.j = x.i WHERE x.wave = t.wave AND x.i = o.id) AS r FROM waves t CROSS JOIN nodes o)
      SELECT 'trade' AS grp, wave, round(sum(k) / count(*), 6) AS mean_degree, round(sum(k * k) / count(*), 6) AS out_square, round(sum(q * q) / count(*), 6) AS in_square, round(sum(r) / count(*), 6) AS reciprocal, round(sum(r * r) / count(*), 6) AS reciprocal_square FROM d GROUP BY wave""",
    "coded_symmetric": " SELECT 'trade' AS grp, a.wave, bool_and(a.code IS NOT DISTINCT FROM b.code) AS symmetric FROM cells a JOIN cells b ON b.wave = a.wave AND b.i = a.j AND b.j = a.i GROUP BY a.wave",
    "coded_impossible": f""", {_STATES}, later AS (SELECT a.wave, a.i, a.j, a.code, arg_min(b.code, b.wave) FILTER (b.code IS NOT NULL) AS c FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j AND b.wave > a.wave WHERE EXISTS (SELECT 1 FROM cells n WHERE n.i = a.i AND n.j = a.j AND n.wave = a.wave + 1 AND n.code IS NULL) GROUP BY 1, 2, 3, 4)
      SELECT 'trade' AS grp, (SELECT count(*) FROM s WHERE ca = 10 AND cb IN (1, 11)) AS zero_to_one, (SELECT count(*) FROM s WHERE ca = 11 AND cb IN (0, 10)) AS one_to_zero, (SELECT count(*) FROM later WHERE code = 10 AND c IN (1, 11)) AS zero_gap, (SELECT count(*) FROM later WHERE code = 11 AND c IN (0, 10)) AS one_gap""",
    "coded_no_change": f", {_STATES} SELECT 'trade' AS grp, period, count(*) FILTER (a <> b AND NOT fa AND NOT fb) = 0 AS unchanged, count(*) FILTER (a > b AND NOT fa AND NOT fb) = 0 AS up_only, count(*) FILTER (a < b AND NOT fa AND NOT fb) = 0 AS down_only FROM s GROUP BY period",
    "coded_evaluated": f""", {_STATES}, e AS (SELECT period, i, j FROM s WHERE CASE WHEN fa THEN a WHEN fb THEN b WHEN a IS NOT NULL AND b = 1 THEN 1 ELSE 0 END = 1)
      SELECT 'trade' AS grp, p.period, (SELECT count(*) FROM s WHERE s.period = p.period AND a = 1 AND b IS NOT NULL) AS start_ties, (SELECT count(*) FROM e WHERE e.period = p.period) AS end_ties, (SELECT count(*) FROM e JOIN e f ON f.period = e.period AND f.i = e.j AND f.j = e.i WHERE e.period = p.period) AS reciprocated FROM periods p""",
}
QUERY_SQL = {name: f"WITH {CODED_SQL}{sql}" for name, sql in _SELECTS.items()}
