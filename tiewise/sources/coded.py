"""Networks as coded cells: what was observed of each pair at each wave, before anything is filled in.

A row (grp, wave, i, j, code) is a cell other than an observed 0: 1 a tie, 10 and 11 a structurally fixed 0 and 1,
null a missing value. Groups are panels that share a specification; a single panel is one group. Two-mode
networks number their receivers apart; symmetric ones hold both cells of a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiewise.sources.panel import PANEL_SQL, trade_panel

CELL = ["grp", "i", "j"]


@dataclass(frozen=True)
class Coded:
    """cells (grp, wave, i, j, code); nodes (grp, id); waves; receivers (grp, id) of a two-mode network, else None."""

    cells: DataFrame
    nodes: DataFrame
    waves: int
    receivers: DataFrame | None = None

    def wave_rows(self) -> DataFrame:
        return self.cells.sparkSession.range(1, self.waves + 1).select(F.col("id").cast("int").alias("wave"))

    def possible(self) -> DataFrame:
        """(grp, pairs): cells that a wave has, the diagonal left out in one-mode networks."""
        n = self.nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        if self.receivers is None:
            return n.select("grp", (F.col("n") * (F.col("n") - 1)).alias("pairs"))
        return n.join(self.receivers.groupBy("grp").agg(F.count(F.lit(1)).alias("m")), "grp").select("grp", (F.col("n") * F.col("m")).alias("pairs"))

    def check(self) -> None:
        """ValueError for codes, waves or actors that the panel can't have, and for cells that occur twice."""
        bad = self.cells.where("not coalesce(code in (0, 1, 10, 11), true) or wave not between 1 and %d" % self.waves + (" or i = j" if self.receivers is None else ""))
        if not bad.isEmpty():
            raise ValueError(f"cells out of range: {bad.limit(3).collect()}")
        if not self.cells.groupBy("wave", *CELL).count().where("count > 1").isEmpty():
            raise ValueError("cells that occur twice")
        senders, receivers = self.nodes, self.nodes if self.receivers is None else self.receivers
        lost = self.cells.join(senders.withColumnRenamed("id", "i"), ["grp", "i"], "left_anti").unionByName(self.cells.join(receivers.withColumnRenamed("id", "j"), ["grp", "j"], "left_anti"))
        if not lost.isEmpty():
            raise ValueError("cells of actors that aren't in the node set")


def grid(net: Coded) -> DataFrame:
    """(grp, i, j, wave, code, seen) of every pair that has a row in some wave, in every wave: seen is false where missing.

    Other pairs are observed zeros throughout, so the work grows with the rows.
    """
    pairs = net.cells.select(*CELL).distinct().crossJoin(F.broadcast(net.wave_rows()))
    rows = net.cells.withColumn("has", F.lit(True))
    out = pairs.join(rows, [*CELL, "wave"], "left")
    code = F.when(F.col("has").isNull(), F.lit(0)).otherwise(F.col("code"))
    return out.select(*CELL, "wave", code.cast("int").alias("code"), code.isNotNull().alias("seen"))


def imputed(net: Coded) -> DataFrame:
    """(grp, wave, i, j) of ties, structural ones included; a missing cell has the last value observed before it, else 0."""
    before = Window.partitionBy(*CELL).orderBy("wave")
    filled = grid(net).withColumn("x", F.last(F.col("code") % 10, ignorenulls=True).over(before))
    return filled.where("x = 1").select("grp", "wave", "i", "j")


def states(net: Coded) -> DataFrame:
    """(grp, i, j, period, a, b, fixed_a, fixed_b): cells at both ends of a period, tie values null where missing, and whether fixed."""
    by = Window.partitionBy(*CELL).orderBy("wave")
    rows = grid(net).withColumn("next", F.lead("code").over(by))
    fixed = lambda c: F.coalesce(F.col(c) >= 10, F.lit(False))
    return rows.where(F.col("wave") < net.waves).select(*CELL, F.col("wave").alias("period"), (F.col("code") % 10).alias("a"), (F.col("next") % 10).alias("b"), fixed("code").alias("fixed_a"), fixed("next").alias("fixed_b"))


def end_networks(net: Coded) -> DataFrame:
    """(grp, period, i, j): the end network that statistics see: without ties missing at either end, then fixed cells of the end, then of the start."""
    kept = F.coalesce((F.col("a").isNotNull()) & (F.col("b") == 1), F.lit(False)).cast("int")
    value = F.when(F.col("fixed_a"), F.col("a")).when(F.col("fixed_b"), F.col("b")).otherwise(kept)
    return states(net).withColumn("x", value).where("x = 1").select("grp", "period", "i", "j")


def start_networks(net: Coded) -> DataFrame:
    """(grp, period, i, j): the start network without ties that are missing at either end."""
    return states(net).where("a = 1 and b is not null").select("grp", "period", "i", "j")


def grouped(nets: dict[str, Coded]) -> Coded:
    """Several panels as one, each a group; all must have the same number of waves and kind."""
    if len({(n.waves, n.receivers is None) for n in nets.values()}) != 1:
        raise ValueError("groups differ in waves or kind of network")
    label = lambda df, g: df.withColumn("grp", F.lit(g))

    def joined(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    first = next(iter(nets.values()))
    return Coded(joined([label(n.cells, g) for g, n in nets.items()]), joined([label(n.nodes, g) for g, n in nets.items()]), first.waves, None if first.receivers is None else joined([label(n.receivers, g) for g, n in nets.items()]))


def recentred(values: DataFrame) -> DataFrame:
    """values (grp, ..., value) with `centred`: less the mean over all groups' values that aren't null; null ones become 0."""
    mean = F.broadcast(values.agg(F.avg("value").alias("mean")))  # one row
    return values.crossJoin(mean).withColumn("centred", F.coalesce(F.col("value") - F.col("mean"), F.lit(0.0))).drop("mean")


def filled_behaviour(values: DataFrame, waves: int, continuous: bool = False) -> DataFrame:
    """(grp, wave, id, value, missing): missing values get the last one seen, else the next one, else the wave's mode (smallest; the median if continuous)."""
    ahead = Window.partitionBy("grp", "id").orderBy("wave").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("grp", "id").orderBy("wave").rowsBetween(0, Window.unboundedFollowing)
    if continuous:
        usual = values.groupBy("grp", "wave").agg(F.percentile("value", 0.5).alias("usual"))
    else:
        counts = values.where("value is not null").groupBy("grp", "wave", "value").agg(F.count(F.lit(1)).alias("k"))
        usual = counts.groupBy("grp", "wave").agg(F.max(F.struct("k", (-F.col("value")).alias("m"))).alias("b")).select("grp", "wave", (-F.col("b.m")).alias("usual"))
    out = values.withColumn("missing", F.col("value").isNull()).withColumn("f", F.coalesce(F.last("value", ignorenulls=True).over(ahead), F.first("value", ignorenulls=True).over(back)))
    return out.join(usual, ["grp", "wave"], "left").select("grp", "wave", "id", F.coalesce("f", "usual").alias("value"), "missing")


def low_integers(values: DataFrame) -> bool:
    """Whether a covariate (value) is whole numbers from 0 to 20, as effects of categories need."""
    return values.where("value is not null and (value <> round(value) or value not between 0 and 20)").isEmpty()


def presence(intervals: DataFrame, waves: int) -> DataFrame:
    """(grp, id, wave, active, action) of composition intervals (grp, id, start, end), times counted from wave 1.

    An actor is active at a wave within one of its intervals. Action codes of missing cells at inactive waves: 1
    before it ever is active, 2 after it was last active, 3 in between; null while active.
    """
    spans = intervals.withColumn("span", F.struct("start", "end")).groupBy("grp", "id").agg(F.collect_list("span").alias("spans"))
    rows = spans.crossJoin(F.broadcast(intervals.sparkSession.range(1, waves + 1).select(F.col("id").cast("int").alias("wave"))))
    rows = rows.withColumn("active", F.exists("spans", lambda s: (s["start"] <= F.col("wave")) & (s["end"] >= F.col("wave"))))
    ever = Window.partitionBy("grp", "id")
    first, last = F.min(F.when(F.col("active"), F.col("wave"))).over(ever), F.max(F.when(F.col("active"), F.col("wave"))).over(ever)
    action = F.when(F.col("active"), None).when(first.isNull() | (F.col("wave") < first), 1).when(F.col("wave") > last, 2).otherwise(3)
    return rows.withColumn("action", action).select("grp", "id", "wave", "active", action.cast("int").alias("action"))


def events(intervals: DataFrame, waves: int) -> DataFrame:
    """(grp, period, time, id, joins): joining and leaving at times strictly between the first and the last wave."""
    e = F.array(F.struct(F.col("start").alias("t"), F.lit(True).alias("joins")), F.struct(F.col("end").alias("t"), F.lit(False).alias("joins")))
    rows = intervals.select("grp", "id", F.explode(e).alias("e")).where((F.col("e.t") > 1) & (F.col("e.t") < waves))
    period = F.ceil("e.t").cast("int") - 1
    return rows.select("grp", period.alias("period"), (F.col("e.t") - period).alias("time"), "id", F.col("e.joins").alias("joins"))


def composed(net: Coded, intervals: DataFrame, option: int = 1) -> Coded:
    """The cells of actors that are away: 1 observed zeros; 2 missing after having left, zeros before; 3 missing; 4 fixed zeros."""
    if option not in (1, 2, 3, 4):
        raise ValueError("options are 1 to 4")
    away = presence(intervals, net.waves).where("not active").select("grp", "wave", "id", "action")
    everyone = net.nodes if net.receivers is None else net.receivers
    out = net.cells
    for end in ("i", "j") if net.receivers is None else ("i",):
        out = out.join(away.select("grp", "wave", F.col("id").alias(end)), ["grp", "wave", end], "left_anti")
    code = {1: None, 2: "case when action = 2 then null else 0 end", 3: "null", 4: "10"}[option]
    if code is not None:
        rows = away.join(everyone.withColumnRenamed("id", "j"), "grp").select("grp", "wave", F.col("id").alias("i"), "j", F.expr(f"cast({code} as int)").alias("code"))
        if net.receivers is None:
            turned = rows.select("grp", "wave", F.col("j").alias("i"), F.col("i").alias("j"), "code")
            rows = rows.unionByName(turned).where("i <> j").groupBy("grp", "wave", "i", "j").agg(F.expr("case when bool_or(code is null) then null else max(code) end").cast("int").alias("code"))
        out = out.select("grp", "wave", "i", "j", F.col("code").cast("int").alias("code")).unionByName(rows.where("code is null or code <> 0"))
    return Coded(out, net.nodes, net.waves, net.receivers)


def trade_codes(spark: SparkSession, sf_dir: str) -> Coded:
    """The trade panel with what is not known of it: nations of the lowest order total of a wave don't report, so their rows are
    missing; a nation's largest partner over all waves is a fixed tie, and pairs that never trade are fixed zeros."""
    p = trade_panel(spark, sf_dir)
    pairs = p.nodes.select(F.col("id").alias("i")).join(p.nodes.select(F.col("id").alias("j")), F.col("i") != F.col("j"))
    top = p.d.groupBy("i").agg(F.max(F.struct("value", (-F.col("j")).alias("m"))).alias("b")).select("i", (-F.col("b.m")).alias("j"), F.lit(11).alias("fixed"))
    never = pairs.join(p.d.where("value > 0"), ["i", "j"], "left_anti").select("i", "j", F.lit(10).alias("fixed"))
    silent = p.z.where("value = 1").select("wave", F.col("id").alias("i"), F.lit(True).alias("silent"))
    rows = pairs.crossJoin(F.broadcast(p.wave_rows())).join(top.unionByName(never), ["i", "j"], "left").join(silent, ["wave", "i"], "left").join(p.x.withColumn("x", F.lit(1)), ["wave", "i", "j"], "left")
    code = F.when(F.col("fixed").isNotNull(), F.col("fixed")).when(F.col("silent"), None).otherwise(F.coalesce("x", F.lit(0)))
    cells = rows.withColumn("code", code.cast("int")).where("code is null or code <> 0").select(F.lit("trade").alias("grp"), "wave", "i", "j", "code")
    return Coded(cells, p.nodes.select(F.lit("trade").alias("grp"), "id"), p.waves)


#: The cells of trade_codes(), observed zeros included, as common table expressions of DuckDB's SQL.
CODED_SQL = (
    PANEL_SQL
    + """,
fixed AS (SELECT i, arg_max(j, struct_pack(value := value, m := -j)) AS j, 11 AS f FROM dyad GROUP BY i UNION ALL
  SELECT a.id, b.id, 10 FROM nodes a JOIN nodes b ON a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM dyad d WHERE d.i = a.id AND d.j = b.id AND d.value > 0)),
cells AS (SELECT t.wave, a.id AS i, b.id AS j, CASE WHEN f.f IS NOT NULL THEN f.f WHEN s.id IS NOT NULL THEN NULL WHEN x.i IS NOT NULL THEN 1 ELSE 0 END AS code
  FROM waves t CROSS JOIN nodes a JOIN nodes b ON a.id <> b.id LEFT JOIN fixed f ON f.i = a.id AND f.j = b.id LEFT JOIN beh s ON s.wave = t.wave AND s.id = a.id AND s.value = 1
  LEFT JOIN ties_x x ON x.wave = t.wave AND x.i = a.id AND x.j = b.id)"""
)
