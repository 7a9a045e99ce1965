import itertools
import random
from dataclasses import replace

import pytest

from tiewise.operators import effects, goodness
from tiewise.operators.descriptives import dyad_census, tie_changes
from tiewise.plans.features import SparkFeatures
from tiewise.sources.files import read_edges, read_matrix, read_pajek, ties_of
from tiewise.sources.panel import Panel

N = 7


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(11)
    ties = {(w, i, j) for w in range(1, 5) for i, j in itertools.permutations(range(N - 1), 2) if r.random() < 0.4}
    other = {(w, i, j) for w in range(1, 5) for i, j in itertools.permutations(range(N), 2) if r.random() < 0.3}
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    panel = Panel(
        frame([(i,) for i in range(N)], "id int"), frame(ties, "wave int, i int, j int"), frame(other, "wave int, i int, j int"),
        frame([(w, i, r.randint(1, 5)) for w in range(1, 5) for i in range(N)], "wave int, id int, value int"),
        frame([(i, float(i)) for i in range(N)], "id int, value double"), frame([(i, i % 2) for i in range(N)], "id int, value int"), frame([(0, 1, 4.0), (1, 2, 2.0)], "i int, j int, value double"), 4,
    )
    return panel, ties


def test_statistics_against_loops(made):
    panel, ties = made
    names = ["density", "recip", "transTrip", "cycle3", "transMedTrip", "inPop", "sameX", "between"]
    got = {}
    for family in ("DEGREE", "CLOSURE", "COVARIATE"):
        wanted = [e for e in getattr(effects, family) if e.short in names]
        got |= {(x.period, x.effect): x.value for x in SparkFeatures(panel).sums(wanted).collect()}
    for period in (1, 2, 3):
        x = {(i, j) for w, i, j in ties if w == period + 1}
        two = lambda i, j: sum((i, h) in x and (h, j) in x for h in range(N))  # noqa: E731, B023
        want = {
            "density": len(x),
            "recip": sum((j, i) in x for i, j in x),
            "transTrip": sum(two(i, j) for i, j in x),
            "cycle3": sum(two(j, i) for i, j in x) / 3,
            "transMedTrip": sum((h, i) in x and (h, j) in x for i, j in x for h in range(N)),
            "inPop": sum(sum(b == j for _, b in x) for _, j in x),
            "sameX": sum(i % 2 == j % 2 for i, j in x),
            "between": sum((h, i) in x and (h, j) not in x and h != j for i, j in x for h in range(N)),
        }
        for name, value in want.items():
            assert got[period, name] == pytest.approx(value, abs=1e-6), name


def test_descriptives(made):
    panel, ties = made
    for x in dyad_census(panel).collect():
        now = {(i, j) for w, i, j in ties if w == x.wave}
        mutual = sum((j, i) in now for i, j in now) // 2
        assert (x.mutual, x.asymmetric) == (mutual, len(now) - 2 * mutual) and x.mutual + x.asymmetric + x.empty == N * (N - 1) // 2
    for x in tie_changes(panel).collect():
        a, b = ({(i, j) for w, i, j in ties if w == x.period + k} for k in (0, 1))
        assert (x.n11, x.distance) == (len(a & b), len(a ^ b)) and x.n00 + x.n01 + x.n10 + x.n11 == N * (N - 1)


def test_refused_names():
    assert effects.effect("transTrip").frame == "ties"
    for name in ("cycle4ND", "RRDeg", "nothing"):
        with pytest.raises(ValueError, match=name):
            effects.effect(name)


def test_three_formats_agree(spark, tmp_path):
    (tmp_path / "m.dat").write_text("0 1 9\n10 0 0\n1 11 0\n")
    (tmp_path / "e.dat").write_text("1 2 1 1\n1 3 9 1\n2 1 10 1\n3 1 1 1\n3 2 11 1\n")
    (tmp_path / "p.net").write_text("*Vertices 3\n1 'a'\n2 'b'\n3 'c'\n*Arcs\n1 2 1\n1 3 9\n2 1 10\n3 1 1\n3 2 11\n")
    rows = [sorted(map(tuple, f.collect()), key=str) for f in (read_matrix(spark, str(tmp_path / "m.dat"), 1), read_edges(spark, str(tmp_path / "e.dat")), read_pajek(spark, str(tmp_path / "p.net"), 1))]
    assert rows[0] == rows[1] == rows[2] and (1, 1, 3, None) in rows[0]
    flags = {(x.i, x.j): (x.x, x.missing, x.structural) for x in ties_of(read_edges(spark, str(tmp_path / "e.dat"))).collect()}
    assert flags == {(1, 2): (True, False, False), (1, 3): (False, True, False), (2, 1): (False, False, True), (3, 1): (True, False, False), (3, 2): (True, False, True)}


def test_triad_kinds(spark):
    #: One triad of each kind by its arcs (fixed names of the sixteen kinds).
    examples = {
        "003": "", "012": "ab", "102": "ab ba", "021D": "ba bc", "021U": "ab cb", "021C": "ab bc", "111D": "ab ba cb", "111U": "ab ba bc",
        "030T": "ab cb ac", "030C": "ba cb ac", "201": "ab ba bc cb", "120D": "ba bc ac ca", "120U": "ab cb ac ca", "120C": "ab bc ac ca", "210": "ab bc cb ac ca", "300": "ab ba bc cb ac ca",
    }
    for kind, arcs in examples.items():
        flags = [str(int(x in arcs.split())) for x in ("ab", "ba", "ac", "ca", "bc", "cb")]
        assert spark.sql(f"select {goodness._kind(*flags)} as k").first().k == kind


def test_triad_census_counts_every_triple(made):
    panel, ties = made
    rows = goodness.triad_census(panel).collect()
    for wave in range(1, 5):
        x = {(i, j) for w, i, j in ties if w == wave}
        n = {r.triad: r.n for r in rows if r.wave == wave}
        assert set(n) == set(goodness.TRIADS) and sum(n.values()) == N * (N - 1) * (N - 2) // 6
        linked = [sum((a, b) in x or (b, a) in x for a, b in itertools.combinations(t, 2)) for t in itertools.combinations(range(N), 3)]
        assert (n["003"], n["012"] + n["102"]) == (linked.count(0), linked.count(1))


def test_monte_carlo_test():
    sims = [[float(k), float(k % 3)] for k in range(30)]
    near, far = (goodness.monte_carlo_test(sims, o) for o in ([14.5, 1.0], [90.0, 1.0]))
    assert near["p"] > 0.9 and far["p"] == 0.0 and far["distance"] > near["distance"]


def test_geodesics_to_the_farthest_pair(spark, made):
    panel, ties = made
    # Wave 1 is a path through all actors; wave 2 has one tie, and wave 3 none.
    ties = {(w, i, j) for w, i, j in ties if w == 4} | {(1, i, i + 1) for i in range(N - 1)} | {(2, 3, 1)}
    want = {}
    for wave in range(1, 5):
        for i in range(N):
            away, at = {i: 0}, {i}
            while at:
                at = {k for w, h, k in ties if w == wave and h in at} - away.keys()
                away |= dict.fromkeys(at, max(away.values()) + 1)
            for j in set(range(N)) - {i}:
                want[wave, away.get(j)] = want.get((wave, away.get(j)), 0) + 1
    found = goodness.geodesics(replace(panel, x=spark.createDataFrame(sorted(ties), "wave int, i int, j int"))).collect()
    assert {(x.wave, x.distance): x.pairs for x in found if x.pairs} == want and len({(x.wave, x.distance) for x in found}) == len(found)
    assert want[1, N - 1] == 1 and want[2, None] == want[3, None] - 1 == N * (N - 1) - 1
