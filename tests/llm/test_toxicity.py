import random

import numpy as np

from tiewise.llm import toxicity


def corpus(spark, n=400):
    r = random.Random(2)
    plain = ["".join(r.choices("etaoin", k=r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = r.choices(plain, k=60) + (r.sample(["idiot", "moron", "clown", "zorgul", "blimfax"], 3) if bad else [])
        r.shuffle(words)
        docs.append((i, " ".join(words), 0.5))
        labels.append((i, int(bad) if r.random() > 0.03 else int(not bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    assert {"zorgul", "blimfax"} <= set(model.lexicon)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == (r.id % 5 == 0) for r in got]) > 0.98
    kept = toxicity.rejected(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = corpus(spark, 120)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "an idiot, a moron!", 1), (1, None, 1), (2, "", 1), (1, None, 1), (3, "fine " * 50000, 1)], "doc_id long, text string, id int")
    labels = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    # Without a label no word is known to be toxic.
    assert len(got) == 5 and model.lexicon == () and not any(r.predicted for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_beginnings_of_words_are_mined(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("etaoin", k=r.randint(3, 7)))
    docs = [(i, " ".join([word() for _ in range(40)] + (["grumph" + word()] if i % 4 == 0 else []))) for i in range(240)]
    labels = [(i, int(i % 4 == 0)) for i in range(240)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(u.startswith(toxicity.MARK + "grum") for u in model.lexicon)
    new = toxicity.score(spark.createDataFrame([(1000, docs[1][1] + " grumphlish"), (1001, docs[1][1])], "doc_id long, text string"), model)
    assert {x.id: x.predicted for x in new.collect()} == {1000: 1, 1001: 0}


def slow_posterior(votes, prior, label, rounds=30):
    """The label model's steps one by one, without matrices."""
    n, m = len(votes), len(votes[0])
    post = [0.9 if y else 0.05 for y in label]
    for _ in range(rounds):
        mass = [sum(1 - p for p in post), sum(post)]
        rate = [[[(sum((p if y else 1 - p) for p, v in zip(post, votes) if v[k] == s) + 0.5) / (mass[y] + 1.5) for k in range(m)] for s in (-1, 0, 1)] for y in (0, 1)]
        mean = [[sum((p if y else 1 - p) * v[k] for p, v in zip(post, votes)) / mass[y] for k in range(m)] for y in (0, 1)]
        rest = [[v[k] - (p * mean[1][k] + (1 - p) * mean[0][k]) for k in range(m)] for p, v in zip(post, votes)]
        spread = [(sum(x[k] ** 2 for x in rest) / n) ** 0.5 + 1e-9 for k in range(m)]
        trust = []
        for a in range(m):
            corr = [abs(sum(x[a] * x[b] for x in rest) / n / spread[a] / spread[b]) for b in range(m) if b != a]
            trust.append(1 / (1 + sum(c for c in corr if c > 0.1)))
        said = [(sum((p if y else 1 - p) * t for p, t in zip(post, label)) + 0.5) / (mass[y] + 1) for y in (0, 1)]
        new = []
        for v, t in zip(votes, label):
            z = np.log(prior / (1 - prior)) + sum(trust[k] * np.log(rate[1][v[k] + 1][k] / rate[0][v[k] + 1][k]) for k in range(m))
            z += np.log(said[1] / said[0]) if t else np.log((1 - said[1]) / (1 - said[0]))
            new.append(1 / (1 + np.exp(-min(30, max(-30, z)))))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-5
        post = [min(1 - 1e-6, max(1e-6, p)) for p in new]
        if done:
            break
    return post


def test_label_model_against_loops():
    r = random.Random(7)
    truth = [r.random() < 0.3 for _ in range(80)]
    votes = [[(1 if r.random() < (0.8 if t else 0.1) else r.choice([0, -1])) for _ in range(4)] for t in truth]
    for v in votes:
        v.append(v[0])  # one voter says what another one says
    label = [int(t != (r.random() < 0.1)) for t in truth]
    got = toxicity.label_model(np.array(votes, float), 0.3, np.array(label, float))
    assert np.allclose(got, slow_posterior(votes, 0.3, label), atol=1e-6)
    # Three independent voters outvote a wrong label.
    wrong = [k for k, (t, y) in enumerate(zip(truth, label, strict=True)) if t != bool(y)]
    assert wrong and np.mean([(got[k] > 0.5) == truth[k] for k in wrong]) > 0.4


def test_classifier_against_gradient_descent():
    r = np.random.default_rng(3)
    x, y = r.integers(-1, 2, (120, 3)).astype(float), r.random(120)
    w, b = toxicity.logistic(x, y)
    slow, bias = np.zeros(3), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(x @ slow + bias)))
        slow += 0.01 * (x.T @ (y - p) - slow)
        bias += 0.01 * (y - p).sum()
    assert np.allclose(w, slow, atol=1e-4) and abs(b - bias) < 1e-3
