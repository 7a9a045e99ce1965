"""Connected components of an edge table by alternating large and small stars, all in joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewise.llm.frames import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): each id of edges (u, v) with the smallest id that it reaches.

    Minima are taken map-side before the shuffle and joined back on the node, whose other side has one
    row, so that a hub's edges can be split over tasks. Each round's edges are a table in the shared folder, of
    which the last one stays.
    """
    tables = Scratch(edges.sparkSession)
    now = tables.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = tables.keep(small)
        tables.clear(spare=1)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
