"""Panels: the same actors at several waves, with networks, a behaviour and covariates as DataFrames.

`trade_panel` derives one from the order tables: actors are nations, waves are the years in which orders
were placed. In a wave nation i is tied to nation j when i's customers bought more lines from j's suppliers
than the wave's mean plus half a population standard deviation. W is the same of returned lines only. The
behaviour z is the quintile of a nation's order total in the wave, v its customers' mean balance in hundreds, c its
region, and d the number of lines from i to j over all waves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiewise.sources.kept import Kept


@dataclass(frozen=True)
class Panel:
    """nodes(id); x, w: ties (wave, i, j); z (wave, id, value int); v (id, value); c (id, value); d (i, j, value).

    Waves are numbered from 1 to `waves`, periods are from one wave to the next. Where cells are missing or fixed,
    x_start and x_end (period, i, j) are the networks that statistics of a period see instead of x's waves.
    """

    nodes: DataFrame
    x: DataFrame
    w: DataFrame
    z: DataFrame
    v: DataFrame
    c: DataFrame
    d: DataFrame
    waves: int
    tables: Kept | None = field(default=None, compare=False)
    x_start: DataFrame | None = None
    x_end: DataFrame | None = None

    def wave_rows(self) -> DataFrame:
        return self.nodes.sparkSession.range(1, self.waves + 1).select(F.col("id").cast("int").alias("wave"))

    def period_rows(self) -> DataFrame:
        return self.nodes.sparkSession.range(1, self.waves).select(F.col("id").cast("int").alias("period"))


def _strong(counts: DataFrame) -> DataFrame:
    cuts = counts.groupBy("wave").agg((F.avg("n") + 0.5 * F.stddev_pop("n")).alias("cut"))
    # One row for each wave.
    return counts.join(F.broadcast(cuts), "wave").where("n > cut").select("wave", "i", "j")


#: The panel of the data directory that was read last, by application, directory and the sizes of its files.
_KEPT: dict[tuple, Panel] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells one state of a data directory from another: the newest change and the total size of the tables' files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "customer", "supplier", "nation")])
    return tuple(files.agg(F.max("modificationTime"), F.sum("length"), F.count(F.lit(1))).first())


def trade_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """The panel of a data directory, made anew when its files changed; its tables hold at most nations squared rows a wave."""
    key = (spark.sparkContext.applicationId, sf_dir, *_state(spark, sf_dir))
    if key not in _KEPT:
        # An earlier panel's small tables stay in the shared folder, since frames made of them may still be read.
        _KEPT.clear()
        tables = Kept(spark)
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        first = read("orders").agg(F.year(F.min("o_orderdate")).alias("y0"))
        orders = read("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice").crossJoin(F.broadcast(first)).withColumn("wave", F.col("y") - F.col("y0") + 1)
        customer = read("customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("i"))
        supplier = read("supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("j"))
        placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
        lines = read("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
        flows = lines.join(placed.select("o_orderkey", "wave", "i"), lines.l_orderkey == F.col("o_orderkey")).join(supplier, lines.l_suppkey == supplier.s_suppkey).where("i <> j")
        counts = flows.groupBy("wave", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
        counts = tables.keep(counts)
        nodes = read("nation").select(F.col("n_nationkey").cast("int").alias("id"))
        spend = placed.groupBy("wave", F.col("i").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
        z = spend.select("wave", "id", F.ntile(5).over(Window.partitionBy("wave").orderBy("s", "id")).alias("value"))
        z = tables.keep(z)
        _KEPT[key] = Panel(
            nodes,
            tables.keep(_strong(counts)),
            tables.keep(_strong(counts.where("r > 0").select("wave", "i", "j", F.col("r").alias("n")))),
            z,
            tables.keep(read("customer").groupBy(F.col("c_nationkey").cast("int").alias("id")).agg(F.round(F.avg("c_acctbal") / 100, 6).alias("value"))),
            read("nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_regionkey").cast("int").alias("value")),
            tables.keep(counts.groupBy("i", "j").agg(F.sum("n").cast("double").alias("value"))),
            int(z.agg(F.max("wave")).first()[0] or 0),
            tables,
        )
    return _KEPT[key]


def forget() -> None:
    """Make the next panel and its features anew, as a first query would."""
    from tiewise.plans import features

    _KEPT.clear()
    features._LAST.clear()


#: The same panel as common table expressions of DuckDB's SQL.
PANEL_SQL = """
flows AS (
  SELECT CAST(year(o_orderdate) - (SELECT year(min(o_orderdate)) FROM orders) + 1 AS INT) AS wave, CAST(c_nationkey AS INT) AS i, CAST(s_nationkey AS INT) AS j, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3
), cuts AS (SELECT wave, avg(n) + 0.5 * stddev_pop(n) AS cut FROM flows GROUP BY wave),
cuts_r AS (SELECT wave, avg(r) + 0.5 * stddev_pop(r) AS cut FROM flows WHERE r > 0 GROUP BY wave),
nodes AS (SELECT CAST(n_nationkey AS INT) AS id FROM nation),
ties_x AS (SELECT f.wave, f.i, f.j FROM flows f JOIN cuts c ON c.wave = f.wave WHERE f.n > c.cut),
ties_w AS (SELECT f.wave, f.i, f.j FROM flows f JOIN cuts_r c ON c.wave = f.wave WHERE f.r > c.cut),
beh AS (SELECT wave, id, CAST(ntile(5) OVER (PARTITION BY wave ORDER BY s, id) AS INT) AS value FROM (
  SELECT CAST(year(o_orderdate) - (SELECT year(min(o_orderdate)) FROM orders) + 1 AS INT) AS wave, CAST(c_nationkey AS INT) AS id, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2)),
waves AS (SELECT CAST(unnest(range(1, (SELECT max(wave) FROM beh) + 1)) AS INT) AS wave),
periods AS (SELECT wave AS period FROM waves WHERE wave < (SELECT max(wave) FROM beh)),
cov AS (SELECT CAST(c_nationkey AS INT) AS id, round(avg(c_acctbal) / 100, 6) AS value FROM customer GROUP BY 1),
cat AS (SELECT CAST(n_nationkey AS INT) AS id, CAST(n_regionkey AS INT) AS value FROM nation),
dyad AS (SELECT i, j, CAST(sum(n) AS DOUBLE) AS value FROM flows GROUP BY i, j)"""
