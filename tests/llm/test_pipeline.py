import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tiewise.llm import pii, quality, toxicity


def test_stages(spark, tmp_path):
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(3000)]
    docs, labels = [], []

    def add(text, quality=1, toxic=0):
        docs.append((len(docs), text, "en", "s", len(text or "")))
        labels.append((len(docs) - 1, quality, toxic))

    for i in range(200):
        words = r.choices(vocabulary, k=80)
        add(" ".join(words) if i % 4 else " ".join(w + "###" for w in words), int(i % 4 != 0))
    for _ in range(40):
        add(" ".join(r.choices(vocabulary, k=70) + ["idiot", "moron", "scum"]), 1, 1)
    base = r.choices(vocabulary, k=200)
    for _ in range(5):
        add(" ".join(base[:-1] + [r.choice(vocabulary)]))
    add(" ".join(r.choices(vocabulary, k=80)) + " write to a.b@c.org now")
    add(None)
    add("")
    docs += [docs[-3], (None, docs[-3][1], None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "best_fit_packing":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            at.write.parquet(f"{tmp_path}/{name}")
            at = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([x.doc_id for x in at.select("doc_id").collect()])
    quality, toxic, near, personal, packed = kept
    clean = {i for i in range(200) if i % 4}
    assert clean <= set(quality) and not {i for i in range(0, 200, 4)} & set(quality)
    assert clean <= set(toxic) and not set(range(200, 240)) & set(toxic)
    assert clean <= set(near) and [i for i in near if i and 240 <= i < 245] == [240] and near.count(245) == 1
    assert sorted(near, key=str) == sorted(personal, key=str) and set(packed) == set(personal)
    texts = {x.doc_id: x for x in spark.read.parquet(f"{tmp_path}/pii").collect()}
    assert "<EMAIL>" in texts[245].text and texts[245].n_chars == len(texts[245].text) and pii.base_spans(texts[245].text) == []
    used = defaultdict(int)
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        used[x.sequence_id] += x.length
    assert used and max(used.values()) <= 4096


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def features(text):
    """The features that quality's rules look at, in plain Python."""
    words = words_of(text)
    where = defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    repeated = len({j for v in where.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)})
    lines = [x for x in text.split("\n") if words_of(x)]
    n, chars = max(1, len(words)), max(1, sum(map(len, words)))
    return (len(words), sum(map(len, words)) / n, len(re.findall(r"[#*$%&|<>]", text)) / n, (len(lines) - len(set(lines))) / max(1, len(lines)), repeated / n,
            sum(map(str.isupper, text)) / chars, len(re.findall("[0-9]", text)) / chars, len(re.findall("[!?]", text)) / n)


def holds(rule, row):
    return all((row[quality.FEATURES.index(c.feature)] > c.threshold) == c.above for c in rule.conditions)


def first_of_group(docs):
    """docs without those whose shingle sets are linked, at 0.75, to a smaller id; one row of each id; all rows without an id."""
    sets = {}
    for i, text, *_ in docs:
        w = words_of(text.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in root:
        for j in root:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [*{d[0]: d for d in docs if d[0] is not None and find(d[0]) == d[0]}.values(), *(d for d in docs if d[0] is None)]


def test_run_against_plain_python(spark, tmp_path):
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(3000)]
    docs, labels = [], []

    def add(text, good=1, toxic=0):
        docs.append((len(docs), text, "en", "s", len(text or "")))
        labels.append((len(docs) - 1, good, toxic))

    for i in range(160):
        words = r.choices(vocabulary, k=80)
        add(" ".join(words) if i % 4 else " ".join(w + "###" for w in words), int(i % 4 != 0))
    for _ in range(40):
        add(" ".join(r.choices(vocabulary, k=70) + ["idiot", "moron", "scum"]), 1, 1)
    base = r.choices(vocabulary, k=200)
    for _ in range(5):
        add(" ".join(base[:-1] + [r.choice(vocabulary)]))
    for n in (60, 4000, 9000):
        add(" ".join(r.choices(vocabulary, k=n)) + ' write to a.b@c.org, token = "ede43f42c939b6405768150e0411590525cf889e"')
    for text in (None, "", "too short", "again and again " * 60):
        add(text)
    docs += [docs[205], (None, docs[205][1], None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled.write.parquet(f"{tmp_path}/labels.parquet")

    rules = quality.learn(quality.labelled_statistics(spark.createDataFrame(docs, schema), labelled))
    plain = [(d, features(d[1] or "")) for d in docs]
    left = [d for d, f in plain if f[0] >= 50 and f[4] <= 0.5 and not any(holds(rule, f) for rule in rules)]
    model = toxicity.train(spark.createDataFrame(left, schema), labelled)
    places = {w: i for i, w in enumerate(model.lexicon)}
    left = [d for d in left if model.scores(toxicity.votes_of(d[1], places)[None].astype(float))[0] < 0.7]
    left = first_of_group(left)
    library = Tokenizer.from_file(corpus_pipeline.WORD_VOCABULARY)
    want = Counter()
    for i, text, *_ in left:
        ids = [*library.encode(pii.redacted_text(text), add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert len(left) > 100 and max(w[1] for w in want) >= 2 and any(w[0] is None for w in want)
    got = Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, columns named like the operators' own, null columns and one very long text."""
    r = random.Random(3)
    long = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(300_000))
    rows = [(0, None, None, None, None, 1, "q"), (1, "", "en", "s", 0, 2, None), (2, long, "en", None, None, 3, "q"), (None, long + " end", None, "s", 5, 4, "q")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _quality int, id string"
    spark.createDataFrame([(i, 1, 0) for i in range(3)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        at = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == docs.columns, name
            kept = at.collect()
            at = spark.createDataFrame(kept, schema)
            for x in kept:
                was = next(q for q in rows if q[5] == x._quality)
                assert (x.doc_id, x.id) == (was[0], was[6])
        pieces = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
        assert ({x.doc_id for x in pieces} == {2, None}) if docs.columns and docs.count() else not pieces
    assert pii.redacted_text("") == "" and pii.redact(spark.createDataFrame([(None, 7)], "text string, s int")).collect()[0].s == 7
