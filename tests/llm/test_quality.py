import re

from pyspark.sql import functions as F

from tiewise.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for v in where.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def test_counts_and_verdicts(spark):
    texts = [None, "", " \n\t ", "a b c", "a b c a b c", "a a a a a a", "x\n\nx\r\nx\n x", "# *$% |<>& é中👍", "w " * 20000, "one two three one two three four " * 30, "\x0b\x0ca\x1cb\xa0c"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "a b", "s"), (3, "a b c", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = quality.judge(df, [quality.Rule((quality.Condition("symbols_per_word", True, 0.5),))])
    assert out.columns == ["doc_id", "text", "n_words", "_quality"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r.text)
        assert tuple(r._quality[c] for c in quality.STATISTICS) == want, r.text
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r._quality.base_failed == failed and not (failed and r._quality.kept)
    assert quality.judge(df.limit(0), []).count() == 0


def test_learning_finds_thresholds():
    rows = [(100.0 + i, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False) for i in range(90)]
    rows += [(100.0 + i, 4.0, 0.9, 0.0, 0.0, 0.0, 0.0, 0.0, True) for i in range(30)]
    rules = quality.learn(rows)
    assert len(rules) == 1 and rules[0].conditions[0].feature == "symbols_per_word"
    assert quality.learn([]) == [] and quality.learn(rows[:90]) == []


def test_labelled_rows_with_nulls(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 1), (None, "c", 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.labelled_statistics(docs, labels)
    assert len(got) == 1 and got[0][-1] is True
    assert docs.select(F.lit(1)).count() == 3


def rejected(rules, row):
    return any(all((row[quality.FEATURES.index(c.feature)] > c.threshold) == c.above for c in rule.conditions) for rule in rules)


def test_learning_finds_a_narrow_tail_and_every_kind():
    # Good and bad rows hold 4,000 different values of one feature; only the highest 40 are bad.
    rows = [(100.0, 4.0, i / 4000, 0.0, 0.0, 0.0, 0.0, 0.0, i >= 3960) for i in range(4000)]
    rules = quality.learn(rows)
    assert len(rules) == 1 and [rejected(rules, r) for r in rows] == [r[-1] for r in rows]
    # Twelve bands of bad rows between good ones need more than eight rules.
    rows = [(100.0, 4.0, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, i // 60 % 2 == 1) for i in range(60 * 25)]
    rules = quality.learn(rows)
    caught = [rejected(rules, r) for r in rows]
    assert len(rules) > 8 and sum(c and r[-1] for c, r in zip(caught, rows, strict=True)) == 720
    assert sum(c and not r[-1] for c, r in zip(caught, rows, strict=True)) <= 30
