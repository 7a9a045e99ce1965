import random

import pytest

from tiewise.operators import coded as ops
from tiewise.sources import coded, files
from tiewise.sources.coded import Coded

N, WAVES = 6, 4


@pytest.fixture(scope="module")
def net(spark):
    r = random.Random(8)
    full = {(w, i, j): r.choice([0, 0, 0, 1, 1, None, 10, 11]) for w in range(1, WAVES + 1) for i in range(N) for j in range(N) if i != j}
    rows = [("g", w, i, j, c) for (w, i, j), c in full.items() if c != 0]
    return full, Coded(spark.createDataFrame(rows, "grp string, wave int, i int, j int, code int"), spark.createDataFrame([("g", i) for i in range(N)], "grp string, id int"), WAVES)


def pairs():
    return [(i, j) for i in range(N) for j in range(N) if i != j]


def test_imputation_and_networks(net):
    full, n = net
    n.check()
    got = {(r.wave, r.i, r.j) for r in coded.imputed(n).collect()}
    want = set()
    for p in pairs():
        last = 0
        for w in range(1, WAVES + 1):
            c = full[(w, *p)]
            last = last if c is None else c % 10
            want |= {(w, *p)} if last else set()
    assert got == want
    ends = {(r.period, r.i, r.j) for r in coded.end_networks(n).collect()}
    starts = {(r.period, r.i, r.j) for r in coded.start_networks(n).collect()}
    for m in range(1, WAVES):
        for p in pairs():
            a, b = full[(m, *p)], full[(m + 1, *p)]
            x = a is not None and b is not None and b % 10 == 1
            x = bool(b % 10) if b in (10, 11) else x
            x = bool(a % 10) if a in (10, 11) else x
            assert ((m, *p) in ends) == x, (a, b)
            assert ((m, *p) in starts) == (a is not None and b is not None and a % 10 == 1)


def test_descriptions(net):
    full, n = net
    for r in ops.missing_share(n).collect():
        codes = [c for (w, _, _), c in full.items() if w == r.wave]
        seen = [c % 10 for c in codes if c is not None]
        assert (r.missing, r.fixed, r.observed_ties) == (codes.count(None), codes.count(10) + codes.count(11), sum(seen)) and r.density == pytest.approx(sum(seen) / len(seen), abs=1e-6)
    for r in ops.changes(n).collect():
        both = [(full[(r.period, *p)], full[(r.period + 1, *p)]) for p in pairs()]
        k = {ab: sum(a is not None and b is not None and (a % 10, b % 10) == ab for a, b in both) for ab in ((0, 0), (0, 1), (1, 0), (1, 1))}
        assert (r.n00, r.n01, r.n10, r.n11) == (k[0, 0], k[0, 1], k[1, 0], k[1, 1]) and r.missing == sum(a is None or b is None for a, b in both)
        assert r.distance == sum(a in (0, 1) and b in (0, 1) and a != b for a, b in both)
        assert r.reversed == (k[1, 1] * (k[0, 0] + k[0, 1]) < k[0, 1] * (k[1, 0] + k[1, 1]))
    ties = {(r.wave, r.i, r.j) for r in coded.imputed(n).collect()}
    for r in ops.degree_moments(n).collect():
        out = [sum((r.wave, i, j) in ties for j in range(N)) for i in range(N)]
        rec = [sum((r.wave, i, j) in ties and (r.wave, j, i) in ties for j in range(N)) for i in range(N)]
        assert (r.mean_degree, r.out_square, r.reciprocal_square) == pytest.approx((sum(out) / N, sum(k * k for k in out) / N, sum(k * k for k in rec) / N), abs=1e-6)
    g = ops.impossible_changes(n).first()
    moves = [(full[(w, *p)], full[(w + 1, *p)]) for p in pairs() for w in range(1, WAVES)]
    assert (g.zero_to_one, g.one_to_zero) == (sum(a == 10 and b in (1, 11) for a, b in moves), sum(a == 11 and b in (0, 10) for a, b in moves))
    gaps = [(full[(w, *p)], next((full[(u, *p)] for u in range(w + 1, WAVES + 1) if full[(u, *p)] is not None), None)) for p in pairs() for w in range(1, WAVES) if full[(w + 1, *p)] is None]
    assert (g.zero_gap, g.one_gap) == (sum(a == 10 and b in (1, 11) for a, b in gaps), sum(a == 11 and b in (0, 10) for a, b in gaps))
    for r in ops.no_change(n).collect():
        free = [(a, b) for a, b in ((full[(r.period, *p)], full[(r.period + 1, *p)]) for p in pairs()) if a in (0, 1) and b in (0, 1)]
        assert (r.unchanged, r.up_only, r.down_only) == (all(a == b for a, b in free), all(a <= b for a, b in free), all(a >= b for a, b in free))
    assert {r.symmetric for r in ops.symmetric(n).collect()} == {False}
    assert ops.input_report(n).where("item = 'missing' and wave = 1").first().value == sum(full[(1, *p)] is None for p in pairs())
    assert ops.evaluated_ties(n).count() == WAVES - 1


def test_symmetric_empty_and_two_mode(spark):
    cells = spark.createDataFrame([("g", 1, 0, 1, 1), ("g", 1, 1, 0, 1), ("g", 2, 0, 1, None), ("g", 2, 1, 0, None)], "grp string, wave int, i int, j int, code int")
    nodes = spark.createDataFrame([("g", 0), ("g", 1), ("g", 2)], "grp string, id int")
    assert [r.symmetric for r in ops.symmetric(Coded(cells, nodes, 2)).collect()] == [True, True]
    empty = Coded(cells.limit(0), nodes, 3)
    assert [(r.n00, r.distance, r.jaccard) for r in ops.changes(empty).collect()] == [(6, 0, 0.0)] * 2 and coded.imputed(empty).count() == 0
    two = Coded(spark.createDataFrame([("g", 1, 0, 7, 1), ("g", 2, 0, 8, 1), ("g", 1, 0, 0, None)], "grp string, wave int, i int, j int, code int"), nodes, 2, spark.createDataFrame([("g", 0), ("g", 7), ("g", 8)], "grp string, id int"))
    two.check()
    r = ops.changes(two).first()
    assert (r.n00, r.n01, r.n10, r.n11, r.missing) == (6, 1, 1, 0, 1)
    bad = spark.createDataFrame([("g", 1, 0, 1, 5)], "grp string, wave int, i int, j int, code int")
    for cells_ in (bad, cells.unionByName(cells), cells.withColumn("i", cells.j + 10)):
        with pytest.raises(ValueError):
            Coded(cells_, nodes, 2).check()


def test_groups_are_recentred_together(spark, net):
    _, n = net
    both = coded.grouped({"a": n, "b": n})
    assert ops.missing_share(both).count() == 2 * WAVES and both.nodes.count() == 2 * N
    with pytest.raises(ValueError):
        coded.grouped({"a": n, "b": Coded(n.cells, n.nodes, 3)})
    values = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 1, 4.0)], "grp string, id int, value double")
    assert sorted((r.grp, r.id, r.centred) for r in coded.recentred(values).collect()) == [("a", 1, -1.5), ("a", 2, 0.0), ("b", 1, 1.5)]


def test_behaviour_filling(spark):
    rows = [(1, 0, None), (2, 0, 3.0), (3, 0, None), (1, 1, None), (2, 1, None), (3, 1, None), (1, 2, 2.0), (1, 3, 2.0), (1, 4, 5.0), (2, 2, 1.0), (3, 2, 4.0)]
    values = spark.createDataFrame([("g", *r) for r in rows], "grp string, wave int, id int, value double")
    got = {(r.wave, r.id): (r.value, r.missing) for r in coded.filled_behaviour(values, 3).collect()}
    assert got[1, 0] == (3.0, True) and got[3, 0] == (3.0, True) and got[1, 1] == (2.0, True) and got[2, 1] == (1.0, True) and got[1, 4] == (5.0, False)
    assert {(r.wave, r.id): r.value for r in coded.filled_behaviour(values, 3, continuous=True).collect()}[2, 1] == 2.0
    assert coded.low_integers(values) and not coded.low_integers(values.withColumn("value", values.value + 0.5))


def test_composition(spark, net):
    full, n = net
    intervals = spark.createDataFrame([("g", 0, 1.0, 1.5), ("g", 0, 2.25, 4.0), ("g", 1, 2.0, 3.0), ("g", 2, 1.0, 4.0)], "grp string, id int, start double, end double")
    got = {(r.id, r.wave): (r.active, r.action) for r in coded.presence(intervals, WAVES).collect()}
    assert [got[0, w] for w in range(1, 5)] == [(True, None), (False, 3), (True, None), (True, None)] and [got[1, w] for w in range(1, 5)] == [(False, 1), (True, None), (True, None), (False, 2)]
    times = sorted((r.id, r.period, r.time, r.joins) for r in coded.events(intervals, WAVES).collect())
    assert times == [(0, 1, 0.5, False), (0, 2, 0.25, True), (1, 1, 1.0, True), (1, 2, 1.0, False)]
    for option, code in ((1, "zero"), (3, None), (4, 10)):
        cells = {(r.wave, r.i, r.j): r.code for r in coded.composed(n, intervals, option).cells.collect()}
        assert cells.get((2, 0, 3), "zero") == code and cells.get((2, 3, 0), "zero") == code and cells.get((3, 2, 3), 0) == full[3, 2, 3]
    two = {(r.wave, r.i, r.j): r.code for r in coded.composed(n, intervals, 2).cells.collect()}
    assert (1, 1, 3) not in two and two[4, 1, 3] is None


def test_session_and_composition_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text("0 1 9\n0 0 10\n11 0 0\n")
    (tmp_path / "e.dat").write_text("1 2 1 1\n2 3 9 1\n1 2 1 2\n")
    (tmp_path / "p.net").write_text("*Vertices 3\n1 \"a\"\n2 \"b\"\n3 \"c\"\n*Arcs\n1 3 1\n")
    (tmp_path / "s.csv").write_text(
        "Group,Name,Filename,Format,Period,ActorSet,Type,Selected,MissingValues,NonZeroCode,NbrOfActors\n"
        "g,x,a.dat,matrix,1,people,network,Yes,9,1,3\ng,x,p.net,pajek net,2,people,network,Yes,9,1,3\ng,y,e.dat,edge net,1 2,people,network,Yes,9,1,3\ng,y,a.dat,matrix,1,people,network,No,9,1,3\n"
    )
    nets = files.read_session(spark, f"{tmp_path}/s.csv")
    x = {(r.wave, r.i, r.j): r.code for r in nets["x"].cells.collect()}
    assert x == {(1, 1, 2): 1, (1, 1, 3): None, (1, 2, 3): 10, (1, 3, 1): 11, (2, 1, 3): 1} and nets["x"].waves == 2 and nets["x"].nodes.count() == 3
    assert {(r.wave, r.i, r.j): r.code for r in nets["y"].cells.collect()} == {(1, 1, 2): 1, (1, 2, 3): None, (2, 1, 2): 1}
    (tmp_path / "c.dat").write_text("1 3\n1 1.5 2.25 3\n2 3\n")
    assert [(r.id, r.start, r.end) for r in files.read_composition(spark, f"{tmp_path}/c.dat").orderBy("id", "start").collect()] == [(1, 1.0, 3.0), (2, 1.0, 1.5), (2, 2.25, 3.0), (3, 2.0, 3.0)]
