"""Readers of panel files: whitespace matrices, edge lists and Pajek files, as (wave, i, j, code) rows.

Codes: 0 and 1 for absent and present ties, 10 and 11 for structurally fixed ones, null for missing.
Actors are numbered from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewise.sources.coded import Coded


def read_matrix(spark: SparkSession, path: str, wave: int, missing: int = 9) -> DataFrame:
    """Cells other than 0 of a square matrix file, one row a line; the diagonal is left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    cells = lines.select((F.col("i") + 1).alias("i"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "cell"))
    return _codes(cells.select(F.lit(wave).alias("wave"), "i", (F.col("j") + 1).alias("j"), F.col("cell").cast("int").alias("code")), missing)


def read_edges(spark: SparkSession, path: str, missing: int = 9) -> DataFrame:
    """Lines "ego alter value wave"."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(p[3].cast("int").alias("wave"), p[0].cast("int").alias("i"), p[1].cast("int").alias("j"), p[2].cast("int").alias("code"))
    return _codes(rows, missing)


def read_pajek(spark: SparkSession, path: str, wave: int, missing: int = 9) -> DataFrame:
    """The arcs of a Pajek network file: lines "ego alter value" after its *Arcs line."""
    after = F.split("value", r"(?i)\*arcs[^\n]*\n")[1]
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split(after, "\r?\n"), lambda x: F.trim(x) != "")).alias("line"))
    p = F.split(F.trim("line"), r"\s+")
    return _codes(lines.select(F.lit(wave).alias("wave"), p[0].cast("int").alias("i"), p[1].cast("int").alias("j"), p[2].cast("int").alias("code")), missing)


def _codes(rows: DataFrame, missing: int) -> DataFrame:
    code = F.when(F.col("code") != missing, F.col("code"))
    return rows.where("code <> 0 and i <> j").select("wave", "i", "j", code.alias("code"))


def ties_of(codes: DataFrame) -> DataFrame:
    """(wave, i, j, x, missing, structural) of coded cells; structural codes are tie values plus 10."""
    return codes.select("wave", "i", "j", F.coalesce((F.col("code") % 10) == 1, F.lit(False)).alias("x"), F.col("code").isNull().alias("missing"), F.coalesce(F.col("code") >= 10, F.lit(False)).alias("structural"))


def read_composition(spark: SparkSession, path: str) -> DataFrame:
    """(grp, id, start, end): one line an actor, in order, of pairs of times at which it joins and leaves."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("at", "line"))
    times = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    spans = lines.withColumn("t", times).select((F.col("at") + 1).cast("int").alias("id"), F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / 2).cast("int") - 1), lambda k: F.struct(F.element_at("t", 2 * k + 1).alias("start"), F.element_at("t", 2 * k + 2).alias("end")))).alias("s"), "t")
    return spans.select(F.lit("g").alias("grp"), "id", "s.start", "s.end")


def read_session(spark: SparkSession, path: str) -> dict[str, Coded]:
    """The networks of a session description: a CSV file of one row a file, with the columns Group, Name, Filename,
    Format ("matrix", "pajek net", or another word and "net" for an edge list), Period (waves, divided by blanks), Type, Selected, MissingValues
    and NbrOfActors. Files are beside the description; rows not selected, or not of networks, are left out."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).collect()  # one row a file
    top = path.rpartition("/")[0]
    cells: dict[str, DataFrame] = {}
    nodes: dict[str, dict[str, int]] = {}
    waves: dict[str, int] = {}
    for r in rows:
        if (r["Selected"] or "Yes").lower() not in ("yes", "true", "1") or r["Type"] not in ("network", "oneMode", "dependent"):
            continue
        periods, missing, at = [int(p) for p in r["Period"].split()], int(r["MissingValues"] or 9), f"{top}/{r['Filename']}"
        kind = r["Format"].lower()
        if kind == "matrix":
            found = read_matrix(spark, at, periods[0], missing)
        elif kind == "pajek net":
            found = read_pajek(spark, at, periods[0], missing)
        elif kind.endswith(" net"):
            found = read_edges(spark, at, missing).where(F.col("wave").isin(periods))
        else:
            raise ValueError(f"{r['Format']}: no such format")
        found = found.select(F.lit(r["Group"]).alias("grp"), "wave", "i", "j", "code")
        name = r["Name"]
        cells[name] = cells[name].unionByName(found) if name in cells else found
        n = int(r["NbrOfActors"] or found.agg(F.greatest(F.max("i"), F.max("j"))).first()[0] or 0)
        group = nodes.setdefault(name, {})
        group[r["Group"]] = max(n, group.get(r["Group"], 0))
        waves[name] = max([waves.get(name, 0), *periods])
    return {name: Coded(df, spark.createDataFrame([(g, i) for g, n in nodes[name].items() for i in range(1, n + 1)], "grp string, id int"), waves[name]) for name, df in cells.items()}
