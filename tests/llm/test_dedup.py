import random

import numpy as np

from tiewise.llm import dedup
from tiewise.llm.components import components


def words(r, n):
    return [r.choice("abcdefghijklmnop") * r.randint(1, 6) for _ in range(n)]


def brute(rows):
    """Components over ids, by comparing all pairs of exact shingle sets."""
    import re

    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, sh(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}, {i: len(s) for i, s in sets}


def test_against_all_pairs(spark):
    r = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE\ttwo"), (5, "é É"), (6, "É é"), (None, "one two"), (7, "w " * 9000)]
    for _ in range(20):
        base = words(r, r.choice([6, 40, 200, 400]))
        for _ in range(r.choice([2, 3, 25])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = "x" * r.randint(1, 9)
            rows.append((len(rows) + 100, " ".join(copy)))
    rows.append((rows[15][0], rows[15][1]))
    rows.append((rows[15][0], rows[30][1]))
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, u int")
    got = dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want, sizes = brute(rows)
    for x in got:
        if x.id is None:
            assert x.component_id is None and x.kept
        else:
            assert x.component_id == want[x.id] and x.kept == (x.id == want[x.id])
            if x.id not in (rows[15][0],):
                assert x.n_shingles == sizes[x.id]
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def family(r, n, length):
    """Copies of one text that differ from it by a few words up to half of them."""
    base = words(r, length)
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(1, length // 10)):
            copy[r.randrange(length)] = "x" * r.randint(1, 9)
        out.append(" ".join(copy))
    return out


def test_large_buckets_lose_no_link(spark):
    r = random.Random(8)
    rows = [(i, t) for i, t in enumerate(t for length in (60, 150, 151, 300) for t in family(r, 60, length))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute(rows)
    assert len(set(want.values())) > 20
    for paired in (1, dedup.PAIRED):
        assert {x.id: x.component_id for x in dedup.near_duplicates(df, paired=paired).collect()} == want


def test_first_shingles_meet():
    r = np.random.default_rng(4)
    for _ in range(3000):
        n = int(r.integers(1, 120))
        pool = np.unique(r.integers(0, 1 << 62, n + 40).astype(np.uint64))
        a, b, centre = (np.unique(r.choice(pool, size=max(1, int(n * share)), replace=False)) for share in r.uniform(0.7, 1, 3))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            sizes = [(k, min(g), max(g)) for k in {len(a) // 4, len(b) // 4} for g in [[len(x) for x in (a, b) if len(x) // 4 == k]]]
            (ka, pa, oa), (kb, pb, ob) = (dedup.first_shingles(x, centre, len(x) // 4, sizes) for x in (a, b))
            places = [(p, q) for k, p, o in zip(ka, pa, oa, strict=True) for q, m in zip(pb[kb == k], ob[kb == k], strict=True) if o or m]
            assert any(min(pq) >= common for pq in places)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(300, 300), (7, 6)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 160))


def differing(x, y):
    return int(np.bitwise_count(np.array(dedup.signature(x)[4]).view(np.uint64) ^ np.array(dedup.signature(y)[4]).view(np.uint64)).sum())


def test_sketch_estimates():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 62, 1000).astype(np.uint64))
    near = np.unique(np.concatenate([a[:900], r.integers(0, 1 << 62, 100).astype(np.uint64)]))
    far = np.unique(np.concatenate([a[:100], r.integers(0, 1 << 62, 900).astype(np.uint64)]))
    assert differing(a, near) <= dedup.most_differing(2000) < differing(a, far)


def test_sketch_keeps_links_and_drops_others():
    r = np.random.default_rng(2)
    for union in (8, 60, 400, 3000, 12000):
        for similarity, kept in ((0.75, True), (0.45, False)):
            both = int(np.ceil(similarity * union))
            bits, bounds = [], []
            for _ in range(60):
                x = r.integers(0, 1 << 62, union).astype(np.uint64)
                cut = both + (union - both) // 2
                bits.append(differing(np.sort(x[:cut]), np.sort(np.concatenate([x[:both], x[cut:]]))))
                bounds.append(dedup.most_differing(union + both))
            bits, bound = np.array(bits), bounds[0]
            if kept:
                # 4.7 standard deviations of a normal variable: below 1e-6.
                assert bits.mean() + 4.7 * bits.std() < bound
            elif union >= 60:
                assert (bits > bound).mean() > 0.9
