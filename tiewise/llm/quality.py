"""Quality rules: a learned decision list over statistics of whole texts, in Spark expressions only.

Sequential covering learns the list from labelled statistics: each rule is a conjunction of threshold
conditions, grown on two thirds of the labelled rows by information gain over every border between
their values and pruned on the rest; the rows that it covers are taken out and the next rule is
learned, until none holds. The rules become one ordered `CASE WHEN` expression. Texts never leave the
JVM; the driver sees the statistics of at most `max_rows` labelled rows, a documented bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space between words and the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares the rules look at, each per word or per character of words.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also inside the lambdas of body."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: windows are sorted by hash, equal neighbours are
    repeated windows, and the sorted positions p of these cover min(3, distance to the one before) words each."""
    n = F.size(words)
    windows = F.when(
        n >= 4,
        F.array_sort(
            F.transform(
                F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
                lambda i: F.struct(F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"), i.alias("i")),
            )
        ),
    ).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)"))

    def positions(s: Column) -> Column:
        before = lambda k: F.get(s, k - 1)["h"]
        after = lambda k: F.get(s, k + 1)["h"]
        return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(x["h"] == before(k), F.lit(False)) | F.coalesce(x["h"] == after(k), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get(p, k - 1), F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(windows, lambda s: _let(positions(s), covered))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(df: DataFrame, text_col: str = "text", into: str = "_stats") -> DataFrame:
    """df with one struct column `into`: the counts of the whole text and the features made of them.

    A null text counts as one without words. All other columns stay as they are, so any name but `into`
    may occur among them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    counts = F.struct(
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _count(text, "\\p{Lu}").alias("upper"),
        _count(text, "[0-9]").alias("digits"),
        _count(text, "[!?]").alias("marks"),
    )

    def named(c: Column) -> Column:
        n_words, n_chars = F.greatest(c["w"]["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
        return F.struct(
            c["w"]["n_words"].alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["l"]["n_dup_lines"].alias("n_dup_lines"),
            c["w"]["n_repeat_words"].alias("n_repeat_words"),
            (c["word_chars"] / n_words).alias("mean_word"),
            (c["n_symbols"] / n_words).alias("symbols_per_word"),
            (c["l"]["n_dup_lines"] / F.greatest(c["l"]["n_lines"], F.lit(1))).alias("dup_line_share"),
            (c["w"]["n_repeat_words"] / n_words).alias("repeat_share"),
            (c["upper"] / n_chars).alias("upper_share"),
            (c["digits"] / n_chars).alias("digit_share"),
            (c["marks"] / n_words).alias("mark_share"),
        )

    return df.withColumn(into, _let(counts, named))


def base_failed(stats: Column) -> Column:
    """Fixed base rules: fewer than 50 words, or more than half of the words in repeated windows."""
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = stats[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    reject: bool = True

    def column(self, stats: Column) -> Column:
        out = self.conditions[0].column(stats)
        for c in self.conditions[1:]:
            out = out & c.column(stats)
        return out


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The ordered list as one expression: the first rule that holds decides; without one the text is kept."""
    out = None
    for r in rules:
        out = F.when(r.column(stats), F.lit(not r.reject)) if out is None else out.when(r.column(stats), F.lit(not r.reject))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _best_condition(x: np.ndarray, bad: np.ndarray, orders: list[np.ndarray], cover: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest gain on the covered rows, of every border between two of their values in each feature."""
    best, condition = 0.0, None
    p0 = math.log2(bad[cover].mean())
    for k, order in enumerate(orders):
        rows = order[cover[order]]
        v, n_bad = x[rows, k], np.cumsum(bad[rows])
        at = np.nonzero(v[:-1] < v[1:])[0]
        if not len(at):
            continue
        # Rows above and below each border, in turn.
        hits = np.stack([n_bad[-1] - n_bad[at], n_bad[at]], axis=1).ravel()
        size = np.stack([len(rows) - at - 1, at + 1], axis=1).ravel()
        gains = np.where(hits > 0, hits * (np.log2(np.maximum(hits, 1) / size) - p0), -np.inf)
        top = int(np.argmax(gains))
        if gains[top] > best:
            lo, hi = v[at[top // 2]], v[at[top // 2] + 1]
            cut = (lo + hi) / 2
            best, condition = float(gains[top]), Condition(FEATURES[k], top % 2 == 0, float(cut if cut < hi else lo))
    return best, condition


def learn(rows: list[tuple], *, max_conditions: int = 3, min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """Decision list from (features in the order of FEATURES ..., bad) rows; it ends where no further rule stays.

    A rule stays only if it is right on min_precision of what it covers, on the growing and the pruning
    rows alike, and covers min_cover rows of those it rejects. No rows, or rows of one class: no rules.
    """
    rows = sorted(rows)
    if not rows:
        return []
    x, bad = np.array([r[:-1] for r in rows], np.float64), np.array([bool(r[-1]) for r in rows])
    orders = [np.argsort(column, kind="stable") for column in x.T]
    growing = np.arange(len(rows)) % 3 != 2
    left, rules = np.ones(len(rows), bool), []

    def holds(c: Condition) -> np.ndarray:
        value = x[:, FEATURES.index(c.feature)]
        return value > c.threshold if c.above else value <= c.threshold

    def covered(parts: list[Condition], of: np.ndarray) -> np.ndarray:
        for c in parts:
            of = of & holds(c)
        return of

    def share(cover: np.ndarray) -> float:
        return (cover & bad).sum() / max(1, cover.sum())

    def worth(parts: list[Condition]) -> float:
        got = covered(parts, left & ~growing)
        return (2 * (got & bad).sum() - got.sum()) / max(1, got.sum())

    while True:
        cover, chosen = left & growing, []
        while len(chosen) < max_conditions and 0 < share(cover) < 1:
            _, condition = _best_condition(x, bad, orders, cover)
            if condition is None:
                break
            chosen.append(condition)
            cover = covered([condition], cover)
        while len(chosen) > 1 and worth(chosen[:-1]) >= worth(chosen):
            chosen.pop()
        grown, pruned = covered(chosen, left & growing), covered(chosen, left & ~growing)
        if not chosen or share(grown) < min_precision or share(pruned) < min_precision or (grown & bad).sum() + (pruned & bad).sum() < min_cover or not pruned.any():
            break
        rules.append(Rule(tuple(chosen)))
        left = left & ~covered(chosen, left)
    return rules


def labelled_statistics(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8000) -> list[tuple]:
    """(features ..., bad) of at most max_rows labelled documents, the labels with the smallest hash of their id.

    Rows whose id, label or text is null teach nothing; of repeated labels the smaller one counts, of documents
    that share an id the one whose text has the smallest hash. The chosen ids are broadcast: max_rows of them at most.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label")).dropna().groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    docs = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).dropna()
    one = docs.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"), F.min("_label").alias("_label"))
    both = statistics(one, "_text")
    return [tuple(r) for r in both.select(*(F.col("_stats")[f].cast("double").alias(f) for f in FEATURES), (F.col("_label") == 0).alias("bad")).collect()]


def judge(df: DataFrame, rules: list[Rule], *, text_col: str = "text", into: str = "_quality") -> DataFrame:
    """df with one struct column `into`: the counts, base_failed and kept (no base rule fails and no learned rule rejects)."""
    out = statistics(df, text_col, into)
    stats = F.col(into)
    return out.withColumn(into, F.struct(*(stats[c].alias(c) for c in STATISTICS), base_failed(stats).alias("base_failed"), (~base_failed(stats) & verdict(rules, stats)).alias("kept")))
