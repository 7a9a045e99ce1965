"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The forest is fitted on a bounded sample of the vectors (the `sample` smallest hashes of their ids):
a node splits its sample at the median of the projection onto the difference of two of its vectors.
Every vector is then put into one leaf of each tree. Equal vectors are one candidate with its smallest
k + 1 ids, which are all that can be among the k nearest of anything, since ties go to smaller ids.
A query goes down all trees at once: one priority queue holds the branches not taken in any tree,
nearest border first, and leaves are opened until they hold enough candidates. How many are enough is
measured, not given: at that many the leaves hold the wanted share of the sample's own nearest neighbours.
Where vectors have structure that is a small part of them; among vectors without any, no forest does with
a small part. Leaves are joined with the queries that opened them in blocks of bounded size, and
candidates are ranked exactly on the original vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewise.llm.frames import stored

TREES, SAMPLE = 6, 20_000
#: Rows, or queries, that one block of a leaf holds at most, about.
BLOCK = 4096


class Forest:
    """Per tree: nodes as (normal, offset, left, right) arrays; a child below 0 is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(sample, leaf, rng) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, leaf: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        normals, offsets, children, sizes = [], [], [], []

        def node(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(3):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    normal = a / (np.linalg.norm(a) or 1) - b / (np.linalg.norm(b) or 1)
                    side = x[rows] @ normal
                    cut = np.median(side)
                    left = side < cut
                    if 0.2 < left.mean() < 0.8:
                        me = len(normals)
                        normals.append(normal)
                        offsets.append(cut)
                        children.append([0, 0])
                        children[me] = [node(rows[left]), node(rows[~left])]
                        return me
            sizes.append(len(rows))
            return -len(sizes)

        root = node(np.arange(len(x)))
        return np.array(normals).reshape(-1, x.shape[1]), np.array(offsets), np.array([[root, root], *children]), sizes

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        out = np.empty((len(x), len(self.trees)), np.int32)
        for t, (normals, offsets, children, _) in enumerate(self.trees):
            at = np.full(len(x), children[0, 0])
            while (inner := np.nonzero(at >= 0)[0]).size:
                n = at[inner]
                right = np.einsum("ij,ij->i", x[inner], normals[n]) >= offsets[n]
                at[inner] = children[n + 1, right.astype(int)]
            out[:, t] = -1 - at
        return out

    def open(self, q: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs in the order of the shared queue until the sample's share of candidates is enough."""
        margins = [normals @ q - offsets if len(offsets) else offsets for normals, offsets, _, _ in self.trees]
        queue = [(0.0, t, int(c[0, 0])) for t, (_, _, c, _) in enumerate(self.trees)]
        found, held = [], 0
        while queue and held < enough:
            worst, t, n = heapq.heappop(queue)
            _, _, children, sizes = self.trees[t]
            while n >= 0:
                m = margins[t][n]
                heapq.heappush(queue, (max(worst, abs(m)), t, int(children[n + 1, int(m < 0)])))
                n = int(children[n + 1, int(m >= 0)])
            found.append((t, -1 - n))
            held += max(1, sizes[-1 - n])
        return found


def enough_candidates(forest: Forest, x: np.ndarray, leaf_of: np.ndarray, k: int, recall: float, probes: int = 100) -> float:
    """How many candidates, a row counted once for each tree, hold the share `recall` of the k nearest of sample vectors, on average.

    Neighbours in the whole table are nearer than those in a sample of it, so they need no larger share of it.
    """
    rows = np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int)
    needed = []
    for q in rows:
        scores = x[q] @ x.T
        scores[q] = -np.inf
        near = np.argsort(-scores, kind="stable")[: min(k, len(x) - 1)]
        opened = forest.open(x[q], np.inf)
        held = np.cumsum([max(1, forest.trees[t][3][leaf]) for t, leaf in opened])
        place = np.full((leaf_of.shape[1], leaf_of.max() + 1), np.inf)
        place[tuple(np.array(opened).T)] = held
        needed.append(place[np.arange(leaf_of.shape[1]), leaf_of[near]].min(axis=1))
    every = np.concatenate(needed) if needed else np.empty(0)
    return float(np.quantile(every, recall, method="higher")) if len(every) else np.inf


def leaf_size(sample: int, rows: int) -> int:
    """Sample vectors in a leaf, such that a leaf holds about 400 rows, within 16 and 1024 leaves a tree."""
    return max(2, sample // min(1024, max(16, rows // 400)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64).reshape(len(rows), -1)


def _within(leaf_of: np.ndarray, opened: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of leaf_of (leaf in each tree) lie in one of the opened leaves."""
    is_open = np.zeros((leaf_of.shape[1], leaf_of.max() + 1), bool)
    is_open[tuple(zip(*opened, strict=True))] = True
    return is_open[np.arange(leaf_of.shape[1]), leaf_of].any(axis=1)


def _floor(scores: np.ndarray, kth: int, norms: float) -> float:
    """The kth best score, less what rounding may take of sums of products of such norms; nothing is below it where there are fewer."""
    return np.partition(scores, len(scores) - kth)[len(scores) - kth] - 1e-12 * norms if len(scores) >= kth else -np.inf


def search(df: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, trees: int = TREES, sample: int = SAMPLE, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of df other than itself, ties to smaller ids.

    `queries` are ids of rows of df. A query opens leaves until they hold as many rows as the share `recall` of
    the sample's nearest neighbours took (see enough_candidates). Vectors that are null, empty,
    zero or hold a null or non-finite component take no part, nor do rows without an id; of other
    lengths than the most common one, none takes part. Repeated ids are rows like others, but none is
    its own query's candidate. An empty table gives no rows; extra columns are not read.
    """
    spark = df.sparkSession
    v = F.col("v")
    good = F.size(v) > 0
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & good)
    rows = rows.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == width["n"])
    # -0.0 and 0.0 are equal components, so they hash and group alike.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    keyed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(17), "v"))
    smallest = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1)
    # The k + 1 smallest ids of equal vectors in two steps, so that no task gathers all of a common vector.
    part = keyed.groupBy("h1", "h2", F.pmod(F.hash("id"), F.lit(256)).alias("salt")).agg(F.min_by("v", "id").alias("v"), smallest.alias("ids"))
    distinct = stored(part.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")))
    chosen = distinct.orderBy("h1", "h2").limit(sample).select("h1", "h2", "v").collect()
    matrix = np.array([r.v for r in sorted(chosen, key=lambda r: (r.h1, r.h2))], np.float64)
    n = distinct.count()
    grown = Forest(matrix, trees, leaf_size(len(matrix), n))
    leaf_of = grown.leaves(matrix)
    # At most `sample` vectors and the trees over them.
    forest = spark.sparkContext.broadcast((grown, matrix, leaf_of))
    # A sample vector counts once for each tree, so these are at least 2k + 2 different ones, or all.
    enough = max(enough_candidates(grown, matrix, leaf_of, k, recall), trees * (2 * k + 2))
    leaves_in_all = sum(len(t[3]) for t in grown.trees)
    row_blocks = max(1, -(-trees * n // (leaves_in_all * BLOCK)))

    index_schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("cid", pa.int64()), ("v", pa.list_(pa.float64()))])

    def index(batches):
        f, _, _ = forest.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                leaves = f.leaves(_matrix(part.column("v")))
                rest = part.select(["cid", "v"]).take(pa.array(np.repeat(np.arange(len(leaves)), leaves.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(leaves.shape[1], dtype=np.int32), len(leaves))), pa.array(leaves.ravel()), *rest.columns], schema=index_schema)

    probe_schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("v", pa.list_(pa.float64())), ("floor", pa.float64())])

    def probe(batches):
        f, known, leaf_of = forest.value
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                x = _matrix(part.column("v"))
                opened = [f.open(q, enough) for q in x]
                # What is below the (2k + 2)th best of the sample vectors in the leaves a query opens can't be
                # among the 2k + 2 best that it finds. Vectors of closed leaves are no candidates and set no bound.
                norms = np.linalg.norm(x, axis=1) * np.linalg.norm(known, axis=1).max()
                floors = np.array([_floor(scores[_within(leaf_of, o)], 2 * k + 2, m) for scores, o, m in zip(x @ known.T, opened, norms, strict=True)])
                take = np.repeat(np.arange(len(opened)), [len(o) for o in opened])
                rest = part.select(["h1", "h2", "v"]).take(pa.array(take))
                trees_of, leaves_of = (pa.array(list(c), pa.int32()) for c in zip(*(p for o in opened for p in o), strict=True))
                yield pa.RecordBatch.from_arrays([trees_of, leaves_of, *rest.columns, pa.array(floors[take])], schema=probe_schema)

    near_schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return near_schema.empty_table()
        x, cid = _matrix(right.column("v")), right.column("cid").to_numpy()
        h1, h2, floor = (left.column(c).to_numpy() for c in ("h1", "h2", "floor"))
        out = []
        for at in range(0, left.num_rows, 256):
            scores = _matrix(left.column("v").slice(at, 256)) @ x.T
            keep = scores >= floor[at : at + 256, None]
            for i in np.nonzero(keep.sum(axis=1) > 2 * k + 2)[0]:
                keep[i] &= scores[i] >= np.partition(scores[i], len(x) - 2 * k - 2)[len(x) - 2 * k - 2]
            i, j = np.nonzero(keep)
            out.append((h1[at + i], h2[at + i], cid[j], scores[i, j]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=near_schema)

    asked = keyed.join(queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi").select("id", "h1", "h2")
    distinct = distinct.withColumn("cid", F.col("ids")[0])
    sought = distinct.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v")
    leaves = distinct.select("cid", "v").mapInArrow(index, "tree int, leaf int, cid long, v array<double>")
    probes = sought.mapInArrow(probe, "tree int, leaf int, h1 long, h2 long, v array<double>, floor double")
    # A leaf's rows are dealt into blocks, each of which meets all its queries; the queries into blocks, each of which meets all rows.
    asking = sought.count()
    query_blocks = max(1, int(-(-asking * min(leaves_in_all, enough / max(1, trees * len(matrix) / leaves_in_all)) // (leaves_in_all * BLOCK))))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    probes = probes.withColumn("qb", F.pmod(F.col("h1"), F.lit(query_blocks)).cast("int")).withColumn("rb", blocks(row_blocks))
    leaves = leaves.withColumn("rb", F.pmod(F.xxhash64("cid"), F.lit(row_blocks)).cast("int")).withColumn("qb", blocks(query_blocks))
    by = ["tree", "leaf", "rb", "qb"]
    near = probes.groupBy(*by).cogroup(leaves.groupBy(*by)).applyInArrow(rank, "h1 long, h2 long, cid long, score double")
    # The same candidate comes from several trees.
    once = near.groupBy("h1", "h2", "cid").agg(F.max("score").alias("score"))
    order = lambda c, *rest: F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("s"), *rest)))
    best = once.groupBy("h1", "h2").agg(F.slice(order("score", F.col("cid")), 1, 2 * k + 2).alias("best"))
    listed = best.join(distinct.select("h1", "h2", F.col("v").alias("qv")), ["h1", "h2"])
    pairs = listed.select("h1", "h2", "qv", F.explode("best.cid").alias("cid")).join(distinct.select("cid", F.col("v").alias("cv"), "ids"), "cid")
    dot = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    exact = pairs.select("h1", "h2", dot.alias("score"), F.explode("ids").alias("vec_id")).groupBy("h1", "h2").agg(F.slice(order("score", F.col("vec_id")), 1, k + 1).alias("best"))
    mine = asked.join(exact, ["h1", "h2"]).select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
