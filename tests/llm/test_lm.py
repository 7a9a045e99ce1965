import math
import random
from collections import Counter

from tiewise.llm import lm


def brute(texts):
    docs = [(t or "").encode().lower().split() for t in texts]
    one = Counter(w for d in docs for w in d)
    two = Counter(p for d in docs for p in zip(d, d[1:], strict=False))
    total = sum(one.values())
    out = []
    for d in docs:
        o, t = Counter(d), Counter(zip(d, d[1:], strict=False))
        s = 0.0
        for i, w in enumerate(d):
            pair = (d[i - 1], w) if i else None
            if pair and two[pair] > t[pair]:
                s += math.log((two[pair] - t[pair]) / (one[pair[0]] - o[pair[0]]))
            else:
                s += math.log(max(one[w] - o[w], 0.5) / max(1, total - len(d)) * (0.4 if i else 1))
        out.append((len(d), s))
    return out


def test_scores(spark):
    r = random.Random(4)
    texts = [None, "", " \n", "a", "A b", "a b", "é É a\xa0b", "the " * 30000] + [" ".join(r.choices("abcdefg", k=r.randint(1, 40))) for _ in range(80)]
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(None, "a b c", 3), (5, "a b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    want = brute([t for _, t, _ in rows])
    got = lm.score(df, block_bytes=1000).collect()
    key = lambda x: (str(x[0]), x[1], round(x[2], 6))
    have = sorted(((r.id, r.n_words, r.log_score) for r in got), key=key)
    need = sorted(((i, n, s) for (i, _, _), (n, s) in zip(rows, want, strict=True)), key=key)
    assert len(have) == len(need)
    for a, b in zip(have, need, strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-9)
    assert lm.score(df.limit(0)).count() == 0


def by_levels(texts, order):
    docs = [(t or "").encode().lower().split() for t in texts]
    grams = lambda d: Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1))
    every = sum((grams(d) for d in docs), Counter())
    total = sum(map(len, docs))
    out = []
    for d in docs:
        own, s = grams(d), 0.0
        others = lambda g: every[g] - own[g]  # noqa: E731, B023
        for i in range(len(d)):
            factor, n = 1.0, min(order, i + 1)
            while n > 1 and not others(tuple(d[i - n + 1 : i + 1])):
                factor, n = factor * 0.4, n - 1
            g = tuple(d[i - n + 1 : i + 1])
            s += math.log(factor * (others(g) / others(g[:-1]) if n > 1 else max(others(g), 0.5) / max(1, total - len(d))))
        out.append((len(d), s))
    return out


def test_longer_contexts(spark):
    r = random.Random(5)
    texts = [None, "", "a", "a b", "a b c", "a b c d", "b c d e"] + [" ".join(r.choices("abcdefg", k=r.randint(1, 40))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(math.isclose(a[1], b[1], abs_tol=1e-9) for a, b in zip(by_levels(texts, 2), brute(texts), strict=True))
    for order in (1, 2, 3, 5):
        got = sorted(map(tuple, lm.score(df, order=order, block_bytes=1000).collect()))
        for i, (row, want) in enumerate(zip(got, by_levels(texts, order), strict=True)):
            assert row[:2] == (i, want[0]) and math.isclose(row[2], want[1], rel_tol=1e-9, abs_tol=1e-9)
