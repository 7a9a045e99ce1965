"""Toxicity scores by weak supervision.

Many voters look at a text: every unit of a lexicon mined from labelled training rows (words, and beginnings of
words) votes "toxic" where it occurs, patterns vote either way or abstain, and the label itself is one
voter more. A generative label model, fitted by expectation maximisation, estimates each voter's rates under
both classes, the label's errors too, and the voters' correlations within a class, which discount voters that
say the same thing. A linear classifier is trained on its posterior labels and its scale calibrated on the
training labels. Only the texts' content is an input of a score; labels are read of training rows alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiewise.llm.frames import Scratch, arrow_batches, keyed_text, slices, text_runs

_WORD = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
N_PATTERNS = 6
#: Lengths of the beginnings of words that are units too; they are written with this mark in front.
STEMS, MARK = (4, 5, 6), "~"


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def _units(word: str) -> list[str]:
    return [word, *(MARK + word[:k] for k in STEMS if len(word) > k)]


class Places(dict):
    """Place of each lexicon unit, and the first letters of all of them, by which most words are passed over."""

    def __init__(self, lexicon: tuple[str, ...]):
        super().__init__((u, i) for i, u in enumerate(lexicon))
        self.heads = {u.removeprefix(MARK)[: min(STEMS)] for u in lexicon}


def votes_of(text: str, places: dict[str, int]) -> np.ndarray:
    """1, 0 (abstains) or -1 of each lexicon unit and then of each pattern, over the whole text."""
    if not isinstance(places, Places):
        places = Places(tuple(sorted(places, key=places.get)))
    heads, first = places.heads, min(STEMS)
    out = np.zeros(len(places) + N_PATTERNS, np.int8)
    words = _WORD.findall(text.lower())
    n, hits, distinct = len(words), 0, 0
    for w, k in Counter(w for w in words if w[:first] in heads).items():
        found = [places[u] for u in _units(w) if u in places]
        if found:
            out[found] = 1
            hits += k
            distinct += 1
    letters = max(1, sum(map(len, words)))
    at = len(places)
    out[at] = -1 if not hits else (1 if hits >= 3 else 0)
    out[at + 1] = 1 if distinct >= 2 else (-1 if not hits and n >= 20 else 0)
    out[at + 2] = 1 if distinct >= 3 else (-1 if distinct == 1 and n >= 40 else 0)
    out[at + 3] = 1 if n > 3 and len(_UPPER.findall(text)) / letters > 0.5 else 0
    out[at + 4] = 1 if n and text.count("!") / n > 0.3 else 0
    out[at + 5] = -1 if n > 200 and hits * 1000 < n else 0
    return out


def vote_rows(docs: DataFrame, lexicon: tuple[str, ...]) -> DataFrame:
    """(id, votes binary) of every row of docs (id, text)."""
    schema = pa.schema([("id", pa.int64()), ("votes", pa.binary())])

    def run(batches):
        places = Places(lexicon)
        rows = ((batch.column("id")[i].as_py(), votes_of(t, places).tobytes()) for batch in batches for first, texts in slices(batch, "text") for i, t in enumerate(texts, first))
        yield from arrow_batches(rows, schema)

    return docs.mapInArrow(run, "id long, votes binary")


def mine_lexicon(docs: DataFrame, most: int = 150, least_rows: int = 2, odds: float = 20.0) -> tuple[str, ...]:
    """Units of labelled docs (id, text, label) that toxic rows have `odds` times as often as clean ones.

    Rows are dealt into two halves by a hash of their ids; a unit must occur in least_rows toxic rows of each,
    and in half a per cent of them, so that what holds in one half was seen in the other. A beginning of words
    is a unit only where it is in more toxic rows than any one of its words. Rows of one class have no lexicon.
    """
    words = docs.select(F.pmod(F.xxhash64("id"), F.lit(2)).alias("half"), "label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where(F.length("word") > 2)
    # A text's words that begin alike are one occurrence of the beginning.
    rows = docs.select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("half"), "label", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("words"))
    beginnings = rows.select("half", "label", F.explode(F.array_distinct(F.flatten(F.transform("words", lambda w: F.array(*(F.when(F.length(w) > k, F.concat(F.lit(MARK), F.substring(w, 1, k))) for k in STEMS)))))).alias("unit")).where("unit is not null")
    units = words.select("half", "label", F.col("word").alias("unit")).unionByName(beginnings)
    counts = units.groupBy("unit").agg(F.sum("label").alias("bad"), F.sum(F.expr("case when half = 0 then label else 0 end")).alias("bad0"), F.count(F.lit(1)).alias("n"))
    totals = docs.agg(F.sum("label").alias("all_bad"), F.count(F.lit(1)).alias("all_n")).first()
    bad, good = float(totals.all_bad or 0), float((totals.all_n or 0) - (totals.all_bad or 0))
    if not bad or not good:
        return ()
    ratio = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("n") - F.col("bad") + 0.5) / (good + 1))
    in_both = (F.col("bad0") >= least_rows) & (F.col("bad") - F.col("bad0") >= least_rows) & (F.col("bad") >= 0.005 * bad)
    top = counts.where(in_both & (ratio >= odds)).orderBy(F.desc("bad"), "unit").limit(4 * most).collect()
    by_word = {r.unit: r.bad for r in top if not r.unit.startswith(MARK)}

    def adds(unit: str, k: int) -> bool:
        return not unit.startswith(MARK) or k > 1.2 * max((b for w, b in by_word.items() if w.startswith(unit[1:])), default=0)

    return tuple([r.unit for r in top if adds(r.unit, r.bad)][:most])


def label_model(votes: np.ndarray, prior: float, label: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Posterior probability of "toxic" of each row of votes.

    Starts from the labels, or from the majority of the votes. Rates of each vote under each class are
    smoothed; a voter's weight is 1 over 1 plus its correlations, above 0.1, with the others within the
    classes. Given labels (0 or 1) are a voter of weight 1, whose errors in each class are estimated like the others' rates.
    """
    if not len(votes):
        return np.empty(0)
    kinds = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)
    post = np.clip(prior + 0.4 * np.sign(votes.sum(axis=1)), 0.02, 0.98) if label is None else np.where(label > 0.5, 0.9, 0.05)
    for _ in range(rounds):
        weight = np.stack([1 - post, post])
        rate = (np.einsum("yn,vnm->yvm", weight, kinds) + 0.5) / (weight.sum(axis=1)[:, None, None] + 1.5)
        rest = votes - (post[:, None] * (votes * post[:, None]).sum(0) / post.sum() + (1 - post)[:, None] * (votes * (1 - post)[:, None]).sum(0) / (1 - post).sum())
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        corr = np.abs((rest / spread).T @ (rest / spread) / len(votes))
        np.fill_diagonal(corr, 0)
        trust = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(axis=1))
        evidence = np.einsum("vnm,vm->n", kinds, trust * (np.log(rate[1]) - np.log(rate[0])))
        if label is not None:
            said = ((weight @ label) + 0.5) / (weight.sum(axis=1) + 1)  # P(label 1) in each class
            evidence = evidence + np.where(label > 0.5, np.log(said[1] / said[0]), np.log((1 - said[1]) / (1 - said[0])))
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
        done = np.abs(new - post).max() < 1e-5
        post = np.clip(new, 1e-6, 1 - 1e-6)
        if done:
            break
    return post


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton steps; the bias isn't shrunk."""
    x1 = np.c_[x, np.ones(len(x))]
    shrink = np.full(x1.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(shrink), x1.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000) -> ToxicityModel:
    """Model from at most max_rows labelled rows that aren't held out, those with the smallest hash of their id.

    Null ids and labels teach nothing; of repeated labels the larger one counts, of documents that share an id the
    one whose text has the smallest hash. Rows of one class alone have a model without a lexicon.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label")).where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # max_rows rows at most are broadcast, and one text for each of them is kept.
    docs = keyed_text(df, id_col, text_col).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("label").alias("label"))
    tables = Scratch(df.sparkSession)
    docs = tables.keep(docs)
    lexicon = mine_lexicon(docs)
    rows = vote_rows(docs.select("id", "text"), lexicon).join(F.broadcast(chosen), "id").select("id", "votes", "label").collect()
    tables.clear()
    rows.sort(key=lambda r: r.id)
    votes = np.array([np.frombuffer(r.votes, np.int8) for r in rows], float).reshape(len(rows), len(lexicon) + N_PATTERNS)
    label = np.array([r.label for r in rows], float)
    if not len(rows) or label.min() == label.max():
        weights = [1.0, 3.0, 0.5, 0.0, 0.0, 0.5]
        return ToxicityModel(lexicon, tuple([0.0] * len(lexicon) + weights), -1.0)
    prior = float(np.clip(label.mean(), 0.01, 0.5))
    post = label_model(votes, prior, label)
    w, b = logistic(votes, post)
    slope, shift = logistic((votes @ w + b)[:, None], label, ridge=1e-3)
    return ToxicityModel(lexicon, tuple(map(float, w)), b, float(max(slope[0], 1e-3)), shift)


def score(df: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) of every row, null and empty texts too; extra columns are not read."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        places = Places(model.lexicon)

        def rows():
            for batch in batches:
                ids = batch.column("id").to_pylist()
                for first, texts in slices(batch, "text"):
                    for i, s in enumerate(model.scores(np.array([votes_of(t, places) for t in texts], float)).tolist(), first):
                        yield ids[i], s, int(s >= threshold)

        yield from arrow_batches(rows(), schema)

    return keyed_text(df, id_col, text_col).mapInArrow(run, "id long, score double, predicted int")


def rejected(df: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """df without its toxic rows, all its columns kept; rows are judged one by one, whatever their ids."""

    def run(batches):
        places = Places(model.lexicon)
        for batch in batches:
            for part in text_runs(batch, text_col):
                texts = part.column(text_col).to_pylist()
                scores = model.scores(np.array([votes_of(t or "", places) for t in texts], float))
                yield part.filter(pa.array(scores < threshold))

    return df.mapInArrow(run, df.schema)
