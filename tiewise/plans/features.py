"""Statistics as sums of expressions over a frame of ties or actors joined with named features.

An effect is a frame and an expression whose {tokens} name features. Effects over one frame are planned
together: all features of an actor are columns of one table by period and actor, which is joined on i and
on j; features of a pair are joined on the pair; all sums are taken in one aggregate.

Networks: x the dependent one at the end of the period, s the same at its start, w another network at
the start; d the dyadic covariate, as it is given. Made of these: xs the ties of both x and s, wd those of
w weighted by d, wh those of w weighted by the receiver's indegree in s, p pairs within two steps of each
other at the start, in either direction (an actor's primary setting), e the same as x at the end of the period. Directions: f from an actor to its alters, b the reverse,
m mutual, e either way. Tokens:
  {deg:x.f@i}             degree of the tie's i or j
  {v@i} {c@j} {z@i}       centred covariate, category, centred behaviour at the start; z1, zr1 (raw) at the end
  {on:w.f}                the weight of the relation from i to j, 0 where it does not hold
  {ts:x.f,w.f|cond}       two-steps i-h-j: the sum of products of weights
  {nb:x.f,v,sum@i}        sum, avg, min, max or count of an expression over a node's neighbours
  {far:x.f,x.b;expr@i}    sum of an expression over the actors that two steps from a node reach
  {cat:x.f@j,i}           neighbours of j that have i's category
  {hist:expr@i}           sum of an expression over all other actors' raw behaviour, given by value `other`
  {size:c@i}              actors of a node's category
  {pair:c,zr@i,j}         ties of x from i's category to j's raw start behaviour
  {p:name}                constants of a period: xdeg, wdeg, zmean0, z1mean, z1ind, sind
  {k:name}                constants of the panel
Expressions of nb and far use the other actor's columns (v, c, z, ...), ego's (ego_v, ...), degrees deg[..]
of the other actor, relations on[..] and two-steps ts[..] from ego to it, far[..;v;sum] over its own neighbours,
constants, and in far the number of two-steps, `value`.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiewise.sources.kept import Kept
from tiewise.sources.panel import PANEL_SQL, Panel

TOKEN = re.compile(r"\{([^}]+)\}")
NODE_VALUES = ("v", "c", "z", "z1", "zr", "zr1")
BY_PERIOD = ("xdeg", "wdeg", "zmean0", "z1mean", "z1ind", "sind")
CONSTANTS = ("n", "adx", "adw", "adr", "vmean", "vrange", "vsim", "zmean", "zrange", "zvar", "zsim", "dmean", "b0", "b0in")
#: Directions in which a two-step features' inner parts are written.
_DEG, _ON, _TS, _FAR = re.compile(r"deg\[(\w+\.\w)\]"), re.compile(r"on\[(\w+\.\w)\]"), re.compile(r"ts\[(\w+\.\w),(\w+\.\w)\]"), re.compile(r"far\[(\w+\.\w);(\w+);(\w+)\]")
CONDITIONS = {
    "hom": "ci = ch and ci = cj",
    "jump": "ci = ch and ci <> cj",
    "same": "ch = ci",
    "diff": "ch <> ci",
    "con": "ci = cj and ci <> ch",
    "alldif": "ci <> cj and ci <> ch and cj <> ch",
    "eqends": "ci = cj",
}


@dataclass(frozen=True)
class Effect:
    short: str
    frame: str  # "ties" (of x), "actors", "lost", "gained" or "changes" (pairs whose tie differs between s and e)
    expression: str


def column(token: str) -> str:
    return "f_" + hashlib.md5(token.encode()).hexdigest()[:12]


def tokens(effects: list[Effect]) -> list[str]:
    return list(dict.fromkeys(t for e in effects for t in TOKEN.findall(e.expression)))


def spelled(e: Effect) -> str:
    return TOKEN.sub(lambda m: column(m[1]), e.expression)


def _parts(token: str) -> tuple[str, str, str]:
    """(kind, argument, end) of a token."""
    head, _, end = token.partition("@")
    kind, _, argument = head.partition(":")
    return kind, argument, end


def mean_similarity(values: DataFrame, by: list[str], buckets: int = 64) -> DataFrame:
    """One row (range, sim): the range of all values, and the mean of 1 - |a - b| / range over ordered pairs of different rows within `by`.

    Of sorted values the k-th of n is (2k - n - 1) times in the sum of differences of all pairs; ranks are
    taken within buckets between quantiles, of which the earlier ones' sizes are added, so no pair is made.
    """
    cuts = F.percentile_approx("value", F.array(*(F.lit(k / buckets) for k in range(1, buckets))), 10000)
    bounds = values.agg(cuts.alias("cuts"), (F.max("value") - F.min("value")).cast("double").alias("range"))
    # One row.
    dealt = values.crossJoin(F.broadcast(bounds)).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("value"))))
    sizes = dealt.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.withColumn("before", F.sum("m").over(Window.partitionBy(*by, F.lit(0)).orderBy("bucket")) - F.col("m")).withColumn("n", F.sum("m").over(Window.partitionBy(*by, F.lit(0))))
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("value")))
    placed = ranked.join(before.drop("m"), [*by, "bucket"])
    k = F.col("k") + F.col("before")
    sums = placed.groupBy(*by, "n").agg(F.sum((2 * k - F.col("n") - 1) * F.col("value")).alias("gaps"), F.first("range").alias("range")).agg(
        F.max("range").alias("range"), (2 * F.sum("gaps") / F.sum(F.col("n") * (F.col("n") - 1))).alias("gap")
    )
    return sums.select("range", F.when(F.col("range") > 0, 1 - F.col("gap") / F.col("range")).otherwise(0.0).alias("sim"))


class SparkFeatures:
    """The features of one panel, planned as joins and aggregates."""

    def __init__(self, panel: Panel, dependent: str = "end"):
        """`dependent` is the wave that x stands for: "end", or "start" as for the statistics of lost ties."""
        self.panel = panel
        self.lag = {"end": 1, "start": 0}[dependent]
        self.periods = panel.period_rows()
        self.tables = Kept(panel.nodes.sparkSession)
        # One row; kept, so that each plan reads it instead of computing it.
        self.consts = self.tables.keep(self._consts())
        actors = F.broadcast(self.periods).crossJoin(panel.nodes)
        z = panel.z
        self.nodes = self.tables.keep(
            actors.join(panel.v.withColumnRenamed("value", "v"), "id", "left")
            .join(panel.c.withColumnRenamed("value", "c"), "id", "left")
            .join(z.select(F.col("wave").alias("period"), "id", F.col("value").cast("double").alias("zr")), ["period", "id"], "left")
            .join(z.select((F.col("wave") - 1).alias("period"), "id", F.col("value").cast("double").alias("zr1")), ["period", "id"], "left")
            .crossJoin(F.broadcast(self.consts))
            .select("period", "id", "c", (F.coalesce("v", "vmean") - F.col("vmean")).alias("v"), (F.coalesce("zr", "zmean") - F.col("zmean")).alias("z"), (F.coalesce("zr1", "zmean") - F.col("zmean")).alias("z1"), F.coalesce("zr", "zmean").alias("zr"), F.coalesce("zr1", "zmean").alias("zr1"))
        )
        self.by_period = self.tables.keep(self._by_period())

    def release(self) -> None:
        self.tables.clear()

    def _consts(self) -> DataFrame:
        p = self.panel
        n = p.nodes.agg(F.count(F.lit(1)).cast("double").alias("n"))
        waves = F.lit(float(p.waves))

        def degree(ties: DataFrame, name: str) -> DataFrame:
            return ties.agg(F.count(F.lit(1)).alias("t")).crossJoin(n).select((F.col("t") / F.col("n") / waves).alias(name))

        mutual = p.x.join(p.x.select("wave", F.col("j").alias("i"), F.col("i").alias("j")), ["wave", "i", "j"], "left_semi")
        v = p.v.agg(F.avg("value").alias("vmean"))
        z = p.z.groupBy("wave").agg(F.avg("value").alias("m")).agg(F.avg("m").alias("zmean")).crossJoin(p.z.agg(F.var_pop("value").alias("zvar")))
        vsim = mean_similarity(p.v.select("value"), []).select(F.col("range").alias("vrange"), F.col("sim").alias("vsim"))
        zsim = mean_similarity(p.z.select("wave", "value"), ["wave"]).select(F.col("range").alias("zrange"), F.col("sim").alias("zsim"))
        dmean = p.d.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("s")).crossJoin(n).select((F.col("s") / (F.col("n") * (F.col("n") - 1))).alias("dmean"))
        early = p.x.where(F.col("wave") < p.waves)

        def balance(end: str, name: str) -> DataFrame:
            # Twice ones times zeros of every actor's possible ties, over the ordered pairs of them.
            ones = early.groupBy("wave", end).agg(F.count(F.lit(1)).alias("ones"))
            return ones.crossJoin(F.broadcast(n)).agg(F.coalesce(F.sum(2 * F.col("ones") * (F.col("n") - 1 - F.col("ones"))), F.lit(0.0)).alias("s")).crossJoin(n).select((F.col("s") / (F.lit(p.waves - 1) * F.col("n") * (F.col("n") - 1) * (F.col("n") - 2))).alias(name))

        out = n
        for part in (degree(p.x, "adx"), degree(p.w, "adw"), degree(mutual, "adr"), v, z, vsim, zsim, dmean, balance("j", "b0"), balance("i", "b0in")):
            out = out.crossJoin(part)
        return out.select(*CONSTANTS)

    def _by_period(self) -> DataFrame:
        """One row for each period."""
        n = F.broadcast(self.consts.select("n"))
        out = self.periods
        for name, net in (("xdeg", "x.f"), ("wdeg", "w.f")):
            out = out.join(self.relation(net).groupBy("period").agg(F.count(F.lit(1)).alias(name)), "period", "left")
        indegree = self.relation("s.b").groupBy("period", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("k"))
        values = self.nodes.join(indegree, ["period", "id"], "left").fillna(0, ["k"])
        means = values.groupBy("period").agg(F.avg("z").alias("zmean0"), F.avg("z1").alias("z1mean"), F.sum(F.col("z1") * F.col("k")).alias("z1ind"), F.sum("k").cast("double").alias("sind"))
        out = out.join(means, "period", "left").fillna(0).crossJoin(n)
        return out.select("period", (F.col("xdeg") / F.col("n")).alias("xdeg"), (F.col("wdeg") / F.col("n")).alias("wdeg"), "zmean0", "z1mean", "z1ind", "sind")

    def relation(self, name: str) -> DataFrame:
        """(period, a, b, u) of a network and direction, u its weight."""
        net, direction = name.split(".")
        base = self._network(net)
        f = base.select("period", F.col("i").alias("a"), F.col("j").alias("b"), "u")
        b = base.select("period", F.col("j").alias("a"), F.col("i").alias("b"), "u")
        if direction == "f":
            return f
        if direction == "b":
            return b
        if direction == "m":
            return f.join(b.select("period", "a", "b"), ["period", "a", "b"], "left_semi")
        return f.union(b).distinct()

    def _network(self, net: str) -> DataFrame:
        p = self.panel
        if net == "d":
            return F.broadcast(self.periods).crossJoin(p.d.where("value <> 0").select("i", "j", F.col("value").alias("u"))).select("period", "i", "j", "u")
        if net == "xs":
            return self._network("x").join(self._network("s").select("period", "i", "j"), ["period", "i", "j"], "left_semi")
        if net == "wd":
            return self._network("w").drop("u").join(p.d.select("i", "j", F.col("value").alias("u")), ["i", "j"]).select("period", "i", "j", "u")
        if net == "wh":
            return self._network("w").drop("u").join(self.nodes_of("deg", "s.b").select("period", F.col("id").alias("j"), F.col("value").alias("u")), ["period", "j"]).select("period", "i", "j", "u")
        if net == "p":
            step = self.relation("s.e").select("period", F.col("a").alias("i"), F.col("b").alias("j"))
            return step.unionByName(self.two_steps("s.e,s.e").select("period", "i", "j")).distinct().withColumn("u", F.lit(1.0))
        seen = {("x", 1): p.x_end, ("x", 0): p.x_start, ("e", 1): p.x_end, ("s", 0): p.x_start}.get((net, self.lag if net == "x" else int(net == "e")))
        if seen is not None:
            return seen.select("period", "i", "j", F.lit(1.0).alias("u"))
        ties, lag = {"x": (p.x, self.lag), "e": (p.x, 1), "s": (p.x, 0), "w": (p.w, 0)}[net]
        return ties.select((F.col("wave") - lag).alias("period"), "i", "j", F.lit(1.0).alias("u")).where(f"period between 1 and {p.waves - 1}")

    def nodes_of(self, kind: str, argument: str) -> DataFrame:
        """(period, id, value)"""
        if kind == "deg":
            return self.relation(argument).groupBy("period", F.col("a").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        if kind == "size":
            sizes = self.panel.c.groupBy("value").agg(F.count(F.lit(1)).cast("double").alias("size"))
            return F.broadcast(self.periods).crossJoin(self.panel.c.join(sizes, "value")).select("period", "id", F.col("size").alias("value"))
        # hist: the other actors by value, of which there are as many as the behaviour has levels.
        levels = self.nodes.groupBy("period", F.col("zr1").alias("other")).agg(F.count(F.lit(1)).alias("m"))
        each = self.nodes.join(levels, "period")
        count = F.col("m") - F.when(F.col("other") == F.col("zr1"), 1).otherwise(0)
        return each.groupBy("period", "id").agg(F.sum(F.expr(argument).cast("double") * count).alias("value"))

    def _other(self, out: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
        """out (period, a, b, ...) with what an expression over b, the other actor, and a, ego, uses; its tokens' columns."""
        out = out.join(self.nodes.select("period", F.col("id").alias("b"), *NODE_VALUES), ["period", "b"])
        if "ego_" in text:
            out = out.join(self.nodes.select("period", F.col("id").alias("a"), *(F.col(c).alias(f"ego_{c}") for c in NODE_VALUES)), ["period", "a"])
        names = {}
        for d in dict.fromkeys(_DEG.findall(text)):
            names[f"deg[{d}]"] = at = "deg_" + d.replace(".", "")
            out = out.join(self.nodes_of("deg", d).select("period", F.col("id").alias("b"), F.col("value").alias(at)), ["period", "b"], "left").fillna(0.0, [at])
        for d in dict.fromkeys(_ON.findall(text)):
            names[f"on[{d}]"] = at = "on_" + d.replace(".", "")
            out = out.join(self.relation(d).select("period", "a", "b", F.col("u").alias(at)), ["period", "a", "b"], "left").fillna(0.0, [at])
        for d, e in dict.fromkeys(_TS.findall(text)):
            names[f"ts[{d},{e}]"] = at = f"ts_{d}{e}".replace(".", "")
            out = out.join(self.two_steps(f"{d},{e}").select("period", F.col("i").alias("a"), F.col("j").alias("b"), F.col("value").alias(at)), ["period", "a", "b"], "left").fillna(0.0, [at])
        wanted = dict.fromkeys(_FAR.findall(text))
        for d in dict.fromkeys(d for d, _, _ in wanted):
            inner = {f"{d},{what},{how}": f"far_{d.replace('.', '')}_{what}_{how}" for e, what, how in wanted if e == d}
            far = self.neighbours(list(inner))
            out = out.join(far.select("period", F.col("id").alias("b"), *(F.col(column(f"nb:{a}")).alias(at) for a, at in inner.items())), ["period", "b"], "left").fillna(0.0, list(inner.values()))
            names |= {f"far[{d};{what};{how}]": f"far_{d.replace('.', '')}_{what}_{how}" for e, what, how in wanted if e == d}
        used = [k for k in CONSTANTS if len(k) > 1 and re.search(rf"(?<![.\w]){k}(?!\w)", text)]
        if used:
            out = out.crossJoin(F.broadcast(self.consts.select(*used)))
        return out, names

    def neighbours(self, arguments: list[str]) -> DataFrame:
        """(period, id, one column for each argument): all aggregates over one relation's neighbours at once."""
        (name,) = {a.split(",", 1)[0] for a in arguments}
        values = [(a, a.split(",", 1)[1].rpartition(",")[0], a.rpartition(",")[2]) for a in arguments]
        out, names = self._other(self.relation(name), " ".join(v for _, v, _ in values))
        aggregates = []
        for argument, value, how in values:
            for token, at in names.items():
                value = value.replace(token, at)
            aggregates.append(F.expr(f"{how}(cast({value} as double))").cast("double").alias(column(f"nb:{argument}")))
        return out.groupBy("period", F.col("a").alias("id")).agg(*aggregates)

    def beyond(self, arguments: list[str]) -> DataFrame:
        """(period, id, one column for each argument): sums over the actors that one kind of two-steps reaches."""
        (path,) = {a.partition(";")[0] for a in arguments}
        values = [(a, a.partition(";")[2]) for a in arguments]
        steps = self.two_steps(path).select("period", F.col("i").alias("a"), F.col("j").alias("b"), "value")
        out, names = self._other(steps, " ".join(v for _, v in values))
        aggregates = []
        for argument, value in values:
            for token, at in names.items():
                value = value.replace(token, at)
            aggregates.append(F.expr(f"sum(cast({value} as double))").alias(column(f"far:{argument}")))
        return out.groupBy("period", F.col("a").alias("id")).agg(*aggregates)

    def two_steps(self, argument: str) -> DataFrame:
        """(period, i, j, value)"""
        path, _, condition = argument.partition("|")
        first, second = path.split(",")
        a = self.relation(first).select("period", F.col("a").alias("i"), F.col("b").alias("h"), F.col("u").alias("u1"))
        b = self.relation(second).select("period", F.col("a").alias("h"), F.col("b").alias("j"), F.col("u").alias("u2"))
        steps = a.join(b, ["period", "h"]).where("i <> j")
        if condition:
            for end in "ihj":
                steps = steps.join(self.panel.c.select(F.col("id").alias(end), F.col("value").alias(f"c{end}")), end)
            steps = steps.where(CONDITIONS[condition])
        return steps.groupBy("period", "i", "j").agg(F.sum(F.col("u1") * F.col("u2")).alias("value"))

    def frame(self, kind: str) -> DataFrame:
        if kind == "actors":
            return self.nodes.select("period", F.col("id").alias("i"))
        if kind == "ties":
            return self._network("x").select("period", "i", "j")
        pair = ["period", "i", "j"]
        start, end = self._network("s").select(*pair), self._network("e").select(*pair)
        lost, gained = start.join(end, pair, "left_anti"), end.join(start, pair, "left_anti")
        return {"lost": lost, "gained": gained, "changes": lost.unionByName(gained)}[kind]

    def _wide(self, wanted: dict[str, str]) -> DataFrame:
        """(period, id, one column for each token): all features of an actor, each relation's neighbours read once."""
        out = self.nodes.select("period", "id", *(F.col(t).alias(c) for t, c in wanted.items() if t in NODE_VALUES))
        around: dict[tuple[str, str], dict[str, str]] = {}
        for t, c in wanted.items():
            kind, _, argument = t.partition(":")
            if kind in ("nb", "far"):
                around.setdefault((kind, argument.split(",", 1)[0] if kind == "nb" else argument.partition(";")[0]), {})[argument] = c
            elif t not in NODE_VALUES:
                out = out.join(self.nodes_of(kind, argument).select("period", "id", F.col("value").alias(c)), ["period", "id"], "left")
        for (kind, _), columns in around.items():
            found = (self.neighbours if kind == "nb" else self.beyond)(list(columns))
            out = out.join(found.select("period", "id", *(F.col(column(f"{kind}:{a}")).alias(c) for a, c in columns.items())), ["period", "id"], "left")
        return out.fillna(0, list(wanted.values()))

    def joined(self, effects: list[Effect]) -> DataFrame:
        """The effects' frame with a column for each of their tokens."""
        (kind,) = {e.frame for e in effects}
        out = self.frame(kind)
        ends: dict[str, dict[str, str]] = {"i": {}, "j": {}}
        constants, by_period, late = [], [], []
        for t in tokens(effects):
            what, argument, end = _parts(t)
            if what == "k":
                constants.append(argument)
            elif what == "p":
                by_period.append(argument)
            elif what == "on":
                out = out.join(self.relation(argument).select("period", F.col("a").alias("i"), F.col("b").alias("j"), F.col("u").alias(column(t))), ["period", "i", "j"], "left").fillna(0, [column(t)])
            elif what == "ts":
                out = out.join(self.two_steps(argument).withColumnRenamed("value", column(t)), ["period", "i", "j"], "left").fillna(0, [column(t)])
            elif what in ("cat", "pair"):
                late.append(t)
            else:
                ends[end][t.partition("@")[0]] = column(t)
        for end, wanted in ends.items():
            if wanted:
                names = {k: f"{c}_" for k, c in wanted.items()}
                out = out.join(self._wide(names).select("period", F.col("id").alias(end), *(F.col(names[k]).alias(c) for k, c in wanted.items())), ["period", end], "left")
        for t in late:
            what, argument, end = _parts(t)
            if what == "cat":
                node, like = end.split(",")
                near = self.relation(argument).join(self.panel.c.select(F.col("id").alias("b"), F.col("value").alias("_c")), "b").groupBy("period", F.col("a").alias(node), "_c").agg(F.count(F.lit(1)).cast("double").alias(column(t)))
                out = out.join(self.panel.c.select(F.col("id").alias(like), F.col("value").alias("_c")), like).join(near, ["period", node, "_c"], "left").drop("_c")
            else:
                kinds = self.relation("x.f").join(self.nodes.select("period", F.col("id").alias("a"), F.col("c").alias("_c")), ["period", "a"]).join(self.nodes.select("period", F.col("id").alias("b"), F.col("zr").alias("_z")), ["period", "b"])
                kinds = kinds.where("_c >= 1").groupBy("period", "_c", "_z").agg(F.count(F.lit(1)).cast("double").alias(column(t)))
                out = out.join(self.nodes.select("period", F.col("id").alias("i"), F.col("c").alias("_c")), ["period", "i"]).join(self.nodes.select("period", F.col("id").alias("j"), F.col("zr").alias("_z")), ["period", "j"])
                out = out.join(kinds, ["period", "_c", "_z"], "left").drop("_c", "_z")
            out = out.fillna(0, [column(t)])
        if by_period:
            # One row for each period.
            out = out.join(F.broadcast(self.by_period.select("period", *(F.col(k).alias(column(f"p:{k}")) for k in by_period))), "period")
        if constants:
            out = out.crossJoin(F.broadcast(self.consts.select(*(F.col(k).alias(column(f"k:{k}")) for k in constants))))
        return out

    def sums(self, effects: list[Effect]) -> DataFrame:
        """(period, effect, value): effects of one frame, each summed by period, rounded to 6 places."""
        out = self.joined(effects)
        sums = out.groupBy("period").agg(*(F.round(F.sum(F.expr(spelled(e)).cast("double")), 6).alias(f"s{k}") for k, e in enumerate(effects)))
        sums = self.periods.join(sums, "period", "left").fillna(0.0)
        rows = F.explode(F.array(*(F.struct(F.lit(e.short).alias("effect"), F.col(f"s{k}").alias("value")) for k, e in enumerate(effects))))
        return sums.select("period", rows.alias("r")).select("period", "r.effect", (F.col("r.value") + 0.0).alias("value"))


#: Features of the panel that was asked for last, by the wave that x stands for.
_LAST: dict[str, SparkFeatures] = {}


def features_of(panel: Panel, dependent: str = "end") -> SparkFeatures:
    """The features of a panel, made once as long as no other panel is asked for.

    Those of an earlier one are let go of but not emptied, since frames made of them may still be read.
    """
    if dependent not in _LAST or _LAST[dependent].panel is not panel:
        _LAST[dependent] = SparkFeatures(panel, dependent)
    return _LAST[dependent]


class SqlFeatures:
    """The same statistics as one text of DuckDB's SQL."""

    BASE = (
        PANEL_SQL
        + """,
consts AS (SELECT n, adx, adw, adr, vmean, vrange, zmean, zrange, zvar, dmean, b0, b0in,
  (SELECT avg(1 - abs(a.value - b.value) / vrange) FROM cov a JOIN cov b ON a.id <> b.id) AS vsim,
  (SELECT avg(1 - abs(a.value - b.value) / zrange) FROM beh a JOIN beh b ON a.wave = b.wave AND a.id <> b.id) AS zsim
  FROM (SELECT *, t_d / (n * (n - 1)) AS dmean, t_x / n / m AS adx, t_w / n / m AS adw, t_r / n / m AS adr, s_in / ((m - 1) * n * (n - 1) * (n - 2)) AS b0, s_out / ((m - 1) * n * (n - 1) * (n - 2)) AS b0in FROM
    (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes), (SELECT CAST(max(wave) AS DOUBLE) AS m FROM waves), (SELECT count(*) AS t_x FROM ties_x), (SELECT count(*) AS t_w FROM ties_w), (SELECT sum(value) AS t_d FROM dyad),
    (SELECT count(*) AS t_r FROM ties_x q JOIN ties_x r ON r.wave = q.wave AND r.i = q.j AND r.j = q.i),
    (SELECT CAST(sum(2 * k * (SELECT count(*) - 1 FROM nodes) - 2 * k * k) AS DOUBLE) AS s_in FROM (SELECT count(*) AS k FROM ties_x WHERE wave < (SELECT max(wave) FROM waves) GROUP BY wave, j)),
    (SELECT CAST(sum(2 * k * (SELECT count(*) - 1 FROM nodes) - 2 * k * k) AS DOUBLE) AS s_out FROM (SELECT count(*) AS k FROM ties_x WHERE wave < (SELECT max(wave) FROM waves) GROUP BY wave, i)),
    (SELECT avg(value) AS vmean, max(value) - min(value) AS vrange FROM cov), (SELECT var_pop(value) AS zvar FROM beh),
    (SELECT avg(m) AS zmean, CAST(max(hi) - min(lo) AS DOUBLE) AS zrange FROM (SELECT avg(value) AS m, max(value) AS hi, min(value) AS lo FROM beh GROUP BY wave)))),
actors AS (SELECT p.period, o.id, c.value AS c, coalesce(v.value, vmean) - vmean AS v, coalesce(z0.value, zmean) - zmean AS z, coalesce(z2.value, zmean) - zmean AS z1,
    coalesce(CAST(z0.value AS DOUBLE), zmean) AS zr, coalesce(CAST(z2.value AS DOUBLE), zmean) AS zr1
  FROM periods p CROSS JOIN nodes o CROSS JOIN consts LEFT JOIN cov v ON v.id = o.id LEFT JOIN cat c ON c.id = o.id
  LEFT JOIN beh z0 ON z0.id = o.id AND z0.wave = p.period LEFT JOIN beh z2 ON z2.id = o.id AND z2.wave = p.period + 1),
net_e AS (SELECT wave - 1 AS period, i, j, 1.0::DOUBLE AS u FROM ties_x WHERE wave > 1),
net_s AS (SELECT wave AS period, i, j, 1.0::DOUBLE AS u FROM ties_x WHERE wave IN (SELECT period FROM periods)),
net_x AS (SELECT * FROM net_DEPENDENT),
net_w AS (SELECT wave AS period, i, j, 1.0::DOUBLE AS u FROM ties_w WHERE wave IN (SELECT period FROM periods)),
net_d AS (SELECT p.period, d.i, d.j, d.value AS u FROM periods p CROSS JOIN dyad d WHERE d.value <> 0),
net_xs AS (SELECT x.* FROM net_x x SEMI JOIN net_s s ON s.period = x.period AND s.i = x.i AND s.j = x.j),
net_wd AS (SELECT w.period, w.i, w.j, d.value AS u FROM net_w w JOIN dyad d ON d.i = w.i AND d.j = w.j),
net_wh AS (SELECT w.period, w.i, w.j, q.k AS u FROM net_w w JOIN (SELECT period, j, CAST(count(*) AS DOUBLE) AS k FROM net_s GROUP BY 1, 2) q ON q.period = w.period AND q.j = w.j),
either_s AS (SELECT period, i, j FROM net_s UNION SELECT period, j, i FROM net_s),
net_p AS (SELECT period, i, j, 1.0::DOUBLE AS u FROM (SELECT * FROM either_s UNION SELECT a.period, a.i, b.j FROM either_s a JOIN either_s b ON b.period = a.period AND b.i = a.j WHERE a.i <> b.j)),
by_period AS (SELECT p.period, coalesce(x.t, 0) / n AS xdeg, coalesce(w.t, 0) / n AS wdeg, zmean0, z1mean, z1ind, sind FROM periods p CROSS JOIN (SELECT n FROM consts)
  LEFT JOIN (SELECT period, count(*) AS t FROM net_x GROUP BY 1) x ON x.period = p.period LEFT JOIN (SELECT period, count(*) AS t FROM net_w GROUP BY 1) w ON w.period = p.period
  JOIN (SELECT a.period, avg(z) AS zmean0, avg(z1) AS z1mean, sum(z1 * coalesce(q.k, 0)) AS z1ind, CAST(sum(coalesce(q.k, 0)) AS DOUBLE) AS sind FROM actors a
    LEFT JOIN (SELECT period, j, count(*) AS k FROM net_s GROUP BY 1, 2) q ON q.period = a.period AND q.j = a.id GROUP BY 1) y ON y.period = p.period)"""
    )

    def __init__(self, dependent: str = "end"):
        self.parts: dict[str, str] = {}
        self.base = self.BASE.replace("net_DEPENDENT", {"end": "net_e", "start": "net_s"}[dependent])

    def relation(self, name: str) -> str:
        net, direction = name.split(".")
        f, b = f"SELECT period, i AS a, j AS b, u FROM net_{net}", f"SELECT period, j AS a, i AS b, u FROM net_{net}"
        self.parts[f"rel_{net}{direction}"] = {"f": f, "b": b, "m": f"SELECT q.period, q.i AS a, q.j AS b, q.u FROM net_{net} q WHERE EXISTS (SELECT 1 FROM net_{net} r WHERE r.period = q.period AND r.i = q.j AND r.j = q.i)", "e": f"{f} UNION {b}"}[direction]
        return f"rel_{net}{direction}"

    def _other(self, text: str) -> tuple[str, str]:
        """(joins, expression) of an expression over the other actor r.b and ego r.a."""
        joins, expression = "", text
        for d in dict.fromkeys(_DEG.findall(text)):
            at = "deg_" + d.replace(".", "")
            joins += f" LEFT JOIN ({self.node_feature('deg', d)}) {at} ON {at}.period = r.period AND {at}.id = r.b"
            expression = expression.replace(f"deg[{d}]", f"coalesce({at}.value, 0)")
        for d in dict.fromkeys(_ON.findall(text)):
            at = "on_" + d.replace(".", "")
            joins += f" LEFT JOIN {self.relation(d)} {at} ON {at}.period = r.period AND {at}.a = r.a AND {at}.b = r.b"
            expression = expression.replace(f"on[{d}]", f"coalesce({at}.u, 0)")
        for d, e in dict.fromkeys(_TS.findall(text)):
            at = f"ts_{d}{e}".replace(".", "")
            joins += f" LEFT JOIN ({self.two_steps(f'{d},{e}')}) {at} ON {at}.period = r.period AND {at}.i = r.a AND {at}.j = r.b"
            expression = expression.replace(f"ts[{d},{e}]", f"coalesce({at}.value, 0)")
        for d, what, agg in dict.fromkeys(_FAR.findall(text)):
            at = f"far_{d.replace('.', '')}_{what}_{agg}"
            joins += f" LEFT JOIN ({self.node_feature('nb', f'{d},{what},{agg}')}) {at} ON {at}.period = r.period AND {at}.id = r.b"
            expression = expression.replace(f"far[{d};{what};{agg}]", f"coalesce({at}.value, 0)")
        expression = re.sub(r"\bego_(\w+)", r"e.\1", expression)
        expression = re.sub(r"(?<![.\w])(v|c|z1|zr1|zr|z)(?!\w)", r"y.\1", expression)
        return joins, expression

    def node_feature(self, kind: str, argument: str) -> str:
        if kind in NODE_VALUES:
            return f"SELECT period, id, {kind} AS value FROM actors"
        if kind == "deg":
            return f"SELECT period, a AS id, CAST(count(*) AS DOUBLE) AS value FROM {self.relation(argument)} GROUP BY period, a"
        if kind == "size":
            return "SELECT a.period, a.id, k.n AS value FROM actors a JOIN (SELECT value, CAST(count(*) AS DOUBLE) AS n FROM cat GROUP BY 1) k ON k.value = a.c"
        if kind == "hist":
            text = re.sub(r"(?<!\w)other(?!\w)", "o.zr1", re.sub(r"(?<!\w)zr1(?!\w)", "a.zr1", argument))
            return f"SELECT a.period, a.id, sum({text}) AS value FROM actors a JOIN actors o ON o.period = a.period AND o.id <> a.id GROUP BY 1, 2"
        if kind == "far":
            path, _, value = argument.partition(";")
            joins, expression = self._other(value)
            expression = re.sub(r"(?<![.\w])value(?!\w)", "r.value", expression)
            return f"SELECT r.period, r.a AS id, CAST(sum({expression}) AS DOUBLE) AS value FROM (SELECT period, i AS a, j AS b, value FROM ({self.two_steps(path)})) r JOIN actors y ON y.period = r.period AND y.id = r.b JOIN actors e ON e.period = r.period AND e.id = r.a CROSS JOIN consts{joins} GROUP BY r.period, r.a"
        name, value, how = argument.split(",", 1)[0], argument.split(",", 1)[1].rpartition(",")[0], argument.rpartition(",")[2]
        joins, expression = self._other(value)
        return f"SELECT r.period, r.a AS id, CAST({how}({expression}) AS DOUBLE) AS value FROM {self.relation(name)} r JOIN actors y ON y.period = r.period AND y.id = r.b JOIN actors e ON e.period = r.period AND e.id = r.a CROSS JOIN consts{joins} GROUP BY r.period, r.a"

    def two_steps(self, argument: str) -> str:
        path, _, condition = argument.partition("|")
        first, second = path.split(",")
        categories = f" JOIN (SELECT id, value AS ci FROM cat) ki ON ki.id = p.a JOIN (SELECT id, value AS ch FROM cat) kh ON kh.id = p.b JOIN (SELECT id, value AS cj FROM cat) kj ON kj.id = q.b WHERE p.a <> q.b AND {CONDITIONS[condition]}" if condition else " WHERE p.a <> q.b"
        return f"SELECT p.period, p.a AS i, q.b AS j, sum(p.u * q.u) AS value FROM {self.relation(first)} p JOIN {self.relation(second)} q ON q.period = p.period AND q.a = p.b{categories} GROUP BY p.period, p.a, q.b"

    def sums(self, effects: list[Effect]) -> str:
        (kind,) = {e.frame for e in effects}
        lost = "SELECT s.period, s.i, s.j FROM net_s s ANTI JOIN net_e e ON e.period = s.period AND e.i = s.i AND e.j = s.j"
        gained = "SELECT e.period, e.i, e.j FROM net_e e ANTI JOIN net_s s ON s.period = e.period AND s.i = e.i AND s.j = e.j"
        frame = {"actors": "SELECT period, id AS i FROM actors", "ties": "SELECT period, i, j FROM net_x", "lost": lost, "gained": gained, "changes": f"{lost} UNION ALL {gained}"}[kind]
        columns, joins = ["t.period"], ""
        for n, t in enumerate(tokens(effects)):
            what, argument, end = _parts(t)
            if what == "k":
                columns.append(f"consts.{argument} AS {column(t)}")
                continue
            if what == "p":
                joins += f" JOIN by_period g{n} ON g{n}.period = t.period"
                columns.append(f"g{n}.{argument} AS {column(t)}")
                continue
            if what == "on":
                source, on, value = self.relation(argument), f"g{n}.a = t.i AND g{n}.b = t.j", "u"
            elif what == "ts":
                source, on, value = f"({self.two_steps(argument)})", f"g{n}.i = t.i AND g{n}.j = t.j", "value"
            elif what == "cat":
                node, like = end.split(",")
                source = f"(SELECT r.period, r.a, k.value AS c, CAST(count(*) AS DOUBLE) AS value FROM {self.relation(argument)} r JOIN cat k ON k.id = r.b GROUP BY r.period, r.a, k.value)"
                joins += f" JOIN cat l{n} ON l{n}.id = t.{like}"
                on, value = f"g{n}.a = t.{node} AND g{n}.c = l{n}.value", "value"
            elif what == "pair":
                source = "(SELECT x.period, a.c, b.zr, CAST(count(*) AS DOUBLE) AS value FROM net_x x JOIN actors a ON a.period = x.period AND a.id = x.i JOIN actors b ON b.period = x.period AND b.id = x.j WHERE a.c >= 1 GROUP BY 1, 2, 3)"
                joins += f" JOIN actors l{n} ON l{n}.period = t.period AND l{n}.id = t.i JOIN actors m{n} ON m{n}.period = t.period AND m{n}.id = t.j"
                on, value = f"g{n}.c = l{n}.c AND g{n}.zr = m{n}.zr", "value"
            else:
                source, on, value = f"({self.node_feature(what, argument)})", f"g{n}.id = t.{end}", "value"
            joins += f" LEFT JOIN {source} g{n} ON g{n}.period = t.period AND {on}"
            columns.append(f"coalesce(g{n}.{value}, 0) AS {column(t)}")
        wide = f"SELECT {', '.join(columns)} FROM ({frame}) t CROSS JOIN consts{joins}"
        sums = ", ".join(f"round(sum(CAST({spelled(e)} AS DOUBLE)), 6) + 0.0 AS s{k}" for k, e in enumerate(effects))
        rows = " UNION ALL ".join(f"SELECT p.period, '{e.short}' AS effect, coalesce(s{k}, 0.0::DOUBLE) AS value FROM periods p LEFT JOIN summed ON summed.period = p.period" for k, e in enumerate(effects))
        parts = "".join(f", {k} AS MATERIALIZED ({v})" for k, v in self.parts.items())
        return f"WITH {self.base}{parts}, wide AS MATERIALIZED ({wide}), summed AS MATERIALIZED (SELECT period, {sums} FROM wide GROUP BY period) {rows}"
