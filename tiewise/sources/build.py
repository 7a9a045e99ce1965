"""Panels from what users have: matrices, edge lists and tables of actors, with missing and fixed cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewise.sources.coded import Coded, end_networks, filled_behaviour, imputed, start_networks
from tiewise.sources.panel import Panel

CODES = (0, 1, 10, 11)


def node_set(spark: SparkSession, ids, group: str = "g") -> DataFrame:
    """(grp, id)"""
    return spark.createDataFrame([(group, int(i)) for i in ids], "grp string, id int")


def network(spark: SparkSession, waves, *, group: str = "g", ids=None, receivers=None) -> Coded:
    """A coded network of matrices, one a wave: nan for missing cells, 10 and 11 for fixed ones.

    Square matrices are one-mode networks unless receivers are given; the diagonal does not count. `ids` and
    `receivers` number rows and columns, from 0 without them.
    """
    arrays = [np.asarray(w, float) for w in waves]
    if len({a.shape for a in arrays}) != 1 or arrays[0].ndim != 2:
        raise ValueError("waves must be matrices of one shape")
    two_mode = receivers is not None or arrays[0].shape[0] != arrays[0].shape[1]
    senders = list(range(arrays[0].shape[0])) if ids is None else list(ids)
    columns = (list(range(arrays[0].shape[1])) if receivers is None else list(receivers)) if two_mode else senders
    rows = []
    for w, a in enumerate(arrays, 1):
        bad = ~(np.isnan(a) | np.isin(a, CODES))
        if not two_mode:
            np.fill_diagonal(bad, False)
        if bad.any():
            raise ValueError(f"wave {w}: cells must be 0, 1, 10, 11 or missing")
        for i, j in zip(*np.nonzero(np.isnan(a) | (a != 0)), strict=True):
            if two_mode or i != j:
                rows.append((group, w, int(senders[i]), int(columns[j]), None if np.isnan(a[i, j]) else int(a[i, j])))
    cells = spark.createDataFrame(rows, "grp string, wave int, i int, j int, code int")
    return Coded(cells, node_set(spark, senders, group), len(arrays), node_set(spark, columns, group) if two_mode else None)


def behaviour(spark: SparkSession, values, *, ids=None, group: str = "g") -> DataFrame:
    """(grp, wave, id, value) of a matrix of actors by waves, null where nan."""
    a = np.asarray(values, float)
    who = range(len(a)) if ids is None else ids
    return spark.createDataFrame([(group, w + 1, int(i), None if np.isnan(x) else float(x)) for i, row in zip(who, a, strict=True) for w, x in enumerate(row)], "grp string, wave int, id int, value double")


def covariate(spark: SparkSession, values, *, ids=None) -> DataFrame:
    """(id, value) of a vector, rows without a value left out."""
    who = range(len(values)) if ids is None else ids
    return spark.createDataFrame([(int(i), float(x)) for i, x in zip(who, values, strict=True) if x is not None and not np.isnan(x)], "id int, value double")


def dyadic(spark: SparkSession, matrix, *, ids=None) -> DataFrame:
    """(i, j, value) of a square matrix, the diagonal, zeros and missing values left out."""
    a = np.asarray(matrix, float)
    who = list(range(len(a))) if ids is None else list(ids)
    return spark.createDataFrame([(int(who[i]), int(who[j]), float(a[i, j])) for i, j in zip(*np.nonzero(~np.isnan(a) & (a != 0)), strict=True) if i != j], "i int, j int, value double")


def panel_of(net: Coded, *, other: Coded | None = None, values: DataFrame | None = None, covariate: DataFrame | None = None, category: DataFrame | None = None, dyadic: DataFrame | None = None, group: str | None = None) -> Panel:
    """A one-mode network with what belongs to it as a panel, of one of its groups.

    Statistics see each period's start and end networks without the ties that are missing at either end, fixed
    cells in place; missing behaviour is filled in. What is not given is empty, or 0 for all actors.
    """
    if net.receivers is not None:
        raise ValueError("the effect catalogue is of one-mode networks")
    net.check()
    grp = group or net.nodes.select(F.min("grp")).first()[0]
    own = lambda df: df.where(F.col("grp") == grp).drop("grp")
    nodes = own(net.nodes).select(F.col("id").cast("int").alias("id"))
    spark = nodes.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    zero = nodes.select("id", F.lit(0.0).alias("value"))
    z = own(filled_behaviour(values, net.waves)).select("wave", "id", F.round("value").cast("int").alias("value")) if values is not None else nodes.crossJoin(F.broadcast(net.wave_rows())).select("wave", "id", F.lit(0).alias("value"))
    return Panel(
        nodes, own(imputed(net)).select("wave", "i", "j"), own(imputed(other)).select("wave", "i", "j") if other is not None else empty("wave int, i int, j int"), z,
        covariate if covariate is not None else zero, category.select("id", F.col("value").cast("int").alias("value")) if category is not None else zero.select("id", F.col("value").cast("int").alias("value")),
        dyadic if dyadic is not None else empty("i int, j int, value double"), net.waves, None, own(start_networks(net)).select("period", "i", "j"), own(end_networks(net)).select("period", "i", "j"),
    )
