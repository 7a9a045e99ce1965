import numpy as np

from tiewise.llm import ann


def brute(rows, queries, k=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            out[q] = sorted((-float(x @ y), i) for i, y in good if i != q)[:k]
    return out


def test_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=16).astype(np.float32).tolist()) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(1000, 1060)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (None, rows[3][1]), (2080, [1.0]), (2100, [])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, id int")
    queries = df.where("vec_id % 20 = 0").select("vec_id")
    got = {}
    for x in ann.search(df, queries).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute([x for x in rows if x[0] != 2080], {x for x, _ in rows if x is not None and x % 20 == 0})
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21))
        assert sorted((-s, i) for _, i, s in found) == [(-s, i) for _, i, s in found]
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    assert [i for _, i, _ in got[0]] == [i for _, i in want[0]]
    assert ann.search(df.limit(0), queries).count() == 0
    few = df.where("vec_id < 3")
    assert ann.search(few, few.select("vec_id")).count() == 6


def test_closed_leaves_leave_no_rank_out(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=32).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 40 = 0").select("vec_id")
    for limits in ({}, {"recall": 0.0}):
        got = {}
        for x in ann.search(df, queries, **limits).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x)
        assert len(got) == 100
        for found in got.values():
            assert [x["rank"] for x in found] == list(range(1, 21)) and len({x.vec_id for x in found}) == 20


def test_recall_with_closed_leaves(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=16).tolist()) for i in range(10000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = set(range(0, 10000, 100))
    x = np.array([v for _, v in rows])
    forest = ann.Forest(x, ann.TREES, ann.leaf_size(10000, 10000))
    # As many candidates as search() asks for by default.
    leaf_of = forest.leaves(x)
    enough = ann.enough_candidates(forest, x, leaf_of, 20, 0.95)
    inside = [ann._within(leaf_of, forest.open(x[q], enough)) for q in sorted(asked)]
    assert np.mean([i.mean() for i in inside]) < 0.8 and not any(i.all() for i in inside)
    want = brute(rows, asked)
    got = {}
    for row in ann.search(df, df.where("vec_id % 100 = 0").select("vec_id")).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    assert got.keys() == asked and all([n for n, _ in found] == list(range(1, 21)) for found in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in asked)
    assert hits / 2000 >= 0.9


def test_structure_needs_few_candidates(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(60, 32))
    share = {}
    for n in (1000, 10000):
        x = centres[r.integers(0, 60, n)] + 0.15 * r.normal(size=(n, 32))
        forest = ann.Forest(x, ann.TREES, ann.leaf_size(n, n))
        leaf_of = forest.leaves(x)
        enough = ann.enough_candidates(forest, x, leaf_of, 20, 0.95)
        inside = np.array([ann._within(leaf_of, forest.open(x[q], enough)) for q in range(0, n, n // 100)])
        near = [np.argsort(-np.where(np.arange(n) == q, -np.inf, x @ x[q]))[:20] for q in range(0, n, n // 100)]
        assert np.mean([i[m].mean() for i, m in zip(inside, near, strict=True)]) >= 0.9
        share[n] = inside.mean()
    assert share[10000] < share[1000] and share[10000] < 0.2


def test_blocks_of_a_leaf_give_the_same_rows(spark, monkeypatch):
    r = np.random.default_rng(12)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 50 = 0").select("vec_id")
    rows = lambda: sorted(map(tuple, ann.search(df, queries).collect()))
    whole = rows()
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert rows() == whole and len(whole) == 600
