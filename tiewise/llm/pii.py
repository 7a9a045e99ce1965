"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select.

The base spans (email, ip, card, phone) are found by rule and always stay. Further generators propose
other spans with high recall, overlapping ones too: assigned secrets, addresses written with "(at)" and
"(dot)", phone numbers without a country code, IBANs. Each proposal becomes a row of format and context
features. Gradient-boosted trees, trained on bounded synthetic examples of real and sham spans made by
rule from a fixed seed, score it; a threshold calibrated on held-back examples selects it. Of
overlapping added spans the best stays, and none overlaps a base span.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tiewise.llm.frames import arrow_batches, keyed_text, slices, text_runs

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "spelt_email", "local_phone", "iban")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[0-9+][0-9 .()+-]*[0-9]")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GENERATORS = {
    "secret": re.compile(r"\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,}+)", re.I),
    "local_phone": re.compile(r"(?<![\d+.)-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d.-]*\d)"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
#: A run of local characters and, where it is an address, the rest of it as a group; every run is read once.
_SPELT = re.compile(r"[A-Za-z0-9._-]++( ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++)?", re.I)
_AT = re.compile(r"[\[(]at[\])]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """At each @ the longest run of local characters before it and the longest domain behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = last = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _ips(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """A dotted chain of numbers is matched four parts at a time."""
    for m in _DOTTED.finditer(text, lo, hi):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - len(parts) % 4, 4):
            length = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                yield at, at + length
            at += length + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of BASE: the contract's rules over the whole text."""
    found = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    # Numbers lie within the longest runs of the characters that numeric kinds are made of.
    for zone in _NUMERIC.finditer(text):
        lo, hi = zone.span()
        if hi - lo < 7:
            continue
        found += [(s, e, "ip") for s, e in _ips(text, lo, hi)]
        for m in _CARD.finditer(text, lo, hi):
            digits = re.sub(r"[ -]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        for m in _PHONE.finditer(text, lo, hi):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2])))


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with "(at)" and "(dot)"; one that continues a word starts behind its first hyphen."""
    for m in _SPELT.finditer(text) if _AT.search(text) else ():
        if m[1]:
            start = m.start()
            if start and (text[start - 1] == "_" or text[start - 1].isalnum()):
                start = text.find("-", start, m.start(1)) + 1
            if 0 < start < m.start(1) or start == m.start():
                yield start, m.end()


def proposals(text: str) -> list[tuple[int, int, str]]:
    """All generators' spans, overlapping ones too."""
    out = []
    if "(" in text or "=" in text or ":" in text or "[" in text or re.search(r"\d{3}[ .-]\d{4}|[A-Z]{2}\d\d", text):
        for kind, pattern in _GENERATORS.items():
            group = 1 if kind == "secret" else 0
            out += [(m.start(group), m.end(group), kind) for m in pattern.finditer(text)]
        out += [(*span, "spelt_email") for span in _spelt(text)]
    return out


def _iban_rest(s: str) -> int:
    moved = re.sub(r"\s", "", s)
    try:
        return int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97
    except ValueError:
        return -1


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span and its context of 24 characters on both sides."""
    s, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 24].lower()
    counts = Counter(s).values()
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts)
    words = {"secret": ("token", "key", "secret", "pass"), "local_phone": ("tel", "phone", "call", "mobile", "fax"), "iban": ("iban", "bank", "account"), "spelt_email": ("mail", "contact", "write")}[kind]
    return [
        float(ADDED.index(kind)), float(len(s)), entropy, sum(map(str.isdigit, s)) / len(s), sum(map(str.isupper, s)) / len(s), sum(not c.isalnum() for c in s) / len(s),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{16,}", s))), float(_iban_rest(s) == 1) if kind == "iban" else 0.0, float(any(w in before for w in words)), float('"' in before[-2:] or "'" in before[-2:]),
        float(any(w in before + after for w in ("example", "test", "xxxx", "order", "version", "isbn", "ratio"))), float(s.isalpha()), sum(c.isdigit() for c in before + after) / 48,
    ]


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n spans of each kind in invented contexts, half of them sham.

    Both halves hold hard cases, so that no score tells them apart altogether: short secrets against ordinary
    words and placeholders behind the same keywords, numbers without a word that explains them against order
    numbers with one, account numbers whose check digits are wrong.
    """
    r = random.Random(seed)
    low, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    mixed = low + low.upper() + "0123456789_-"
    word = lambda: "".join(r.choices(low, k=r.randint(2, 9)))
    x, y = [], []
    for i in range(n * len(ADDED)):
        kind, real, hard = ADDED[i % len(ADDED)], (i // len(ADDED)) % 2 == 0, r.random() < 0.25
        lead, tail = " ".join(word() for _ in range(4)) + " ", " " + " ".join(word() for _ in range(3))
        if kind == "secret":
            if real:
                s = "".join(r.choices(mixed, k=r.randint(6, 12))) if hard else "".join(r.choices(r.choice([hexa, mixed]), k=r.choice([16, 20, 24, 32, 40, 64])))
            else:
                s = r.choice([word() + word() + str(r.randint(0, 99)), (word() * 3).title(), "changeme" + str(r.randint(1, 999))]) if hard else r.choice([word() * 2, "<your-token>", "xxxxxxxx", "${TOKEN}", word() + "." + word(), word() + "-" + word() + "-" + word()])
                s = s if len(s) >= 6 else s + "abcdef"
            lead += r.choice(["token", "api_key", "secret", "password"]) + r.choice([" = ", ": ", "="]) + r.choice(['"', "'", ""])
        elif kind == "spelt_email":
            s = f"{word()}{r.choice(['', '.', '_'])}{word()} (at) {word()} (dot) {r.choice(['com', 'org', 'net', 'de'])}" if real else f"{word()} (at) {r.choice(['1', '2', 'x', word()]) if hard else r.choice(['1', '2', 'x'])} (dot) {r.choice(['1', 'y', '22'])}"
            lead += r.choice(["mail ", "contact ", ""])
        elif kind == "local_phone":
            s = f"({r.randint(201, 989)}) {r.randint(200, 999)}-{r.randint(0, 9999):04}" if real or hard else f"{r.randint(100, 999)} {r.randint(100, 999)} {r.randint(1000, 9999)}"
            lead += ("" if hard else r.choice(["call ", "phone ", "tel "])) if real else r.choice(["order ", "isbn ", "version ", ""])
        else:
            body = "".join(r.choices("0123456789", k=18))
            check = 98 - int(body + "131400") % 97
            s = f"DE{check:02}{body}" if real else (f"DE{(check + r.randint(1, 90)) % 99:02}{body}" if hard else "AB" + "".join(r.choices("0123456789", k=r.randint(10, 20))))
            lead += r.choice(["iban ", "account ", ""]) if real or hard else r.choice(["part ", ""])
        x.append(features(lead + s + tail, len(lead), len(lead) + len(s), kind))
        y.append(float(real))
    return np.array(x), np.array(y)


class Boosted:
    """Depth-2 regression trees fitted one after another to the logistic loss's gradient."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3):
        self.base, self.trees, self.rate = float(np.log(y.mean() / (1 - y.mean()))), [], rate
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 24))) for c in x.T]
        z = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)

            def split(rows, g=g, h=h):
                best = (0.0, 0, np.inf)
                total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for k, c in enumerate(cuts):
                    for t in c:
                        left = rows[x[rows, k] <= t]
                        if 4 < len(left) < len(rows) - 4:
                            gl, hl = g[left].sum(), h[left].sum()
                            gain = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - total
                            best = max(best, (gain, k, t))
                return best[1:]

            every = np.arange(len(y))
            root = split(every)
            sides = [every[x[:, root[0]] <= root[1]], every[x[:, root[0]] > root[1]]]
            below = [split(s) for s in sides]
            leaf = [[float(g[q].sum() / (h[q].sum() + 1)) for q in (s[x[s, k] <= t], s[x[s, k] > t])] for s, (k, t) in zip(sides, below, strict=True)]
            self.trees.append((root, below, leaf))
            z = self.margin(x)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for (k, t), below, leaf in self.trees:
            right = (x[:, k] > t).astype(int)
            for s in (0, 1):
                rows = np.nonzero(right == s)[0]
                z[rows] += self.rate * np.array(leaf[s])[(x[rows, below[s][0]] > below[s][1]).astype(int)]
        return z


@cache
def model(examples: int = 300, precision: float = 0.98) -> tuple[Boosted, tuple[float, ...]]:
    """The trees and, by kind, the margin from which on held-back examples are real at `precision`: halfway to the next lower example."""
    trees = Boosted(*_examples(examples, 1))
    x, y = _examples(examples, 2)
    z = trees.margin(x)
    cuts = []
    for kind in range(len(ADDED)):
        rows = np.nonzero(x[:, 0] == kind)[0]
        rows = rows[np.argsort(-z[rows], kind="stable")]
        right = np.cumsum(y[rows]) / np.arange(1, len(rows) + 1)
        # Examples of one margin are taken together.
        whole = np.append(z[rows][:-1] > z[rows][1:], True)
        good = np.nonzero((right >= precision) & whole)[0]
        if not len(good):
            cuts.append(math.inf)
            continue
        last = good[-1]
        below = z[rows[last + 1]] if last + 1 < len(rows) else z[rows[last]] - 1
        cuts.append(float((z[rows[last]] + below) / 2))
    return trees, tuple(cuts)


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a whole text, both by start and kind."""
    base = base_spans(text)
    asked = proposals(text)
    if not asked:
        return base, base
    trees, cuts = model()
    z = trees.margin(np.array([features(text, *p) for p in asked]))
    taken = list(base)
    for _, (s, e, k) in sorted((-m, p) for m, p in zip(z.tolist(), asked, strict=True) if m >= cuts[ADDED.index(p[2])]):
        if all(e <= a or b <= s for a, b, _ in taken):
            taken.append((s, e, k))
    return base, sorted(taken, key=lambda x: (x[0], (*BASE, *ADDED).index(x[2])))


def _joined(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def find(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: counts of base spans, the digest of the base spans, and all spans.

    Null and empty texts have no spans; null ids and repeated rows are rows like others; an empty table
    gives no rows; extra columns are not read.
    """
    schema = pa.schema([("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        def rows():
            for batch in batches:
                ids = batch.column("id").to_pylist()
                for first, texts in slices(batch, "text"):
                    for i, text in enumerate(texts, first):
                        base, every = spans(text)
                        kinds = [k for _, _, k in base]
                        yield (ids[i], *map(kinds.count, BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every))

        yield from arrow_batches(rows(), schema)

    return keyed_text(df, id_col, text_col).mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, then longest."""
    out, at = [], 0
    for s, e, k in sorted(spans(text)[1], key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def redact(df: DataFrame, *, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """df with its texts redacted, all columns and rows kept; length_col, if given, is set to the new length. Null texts stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def run(batches):
        at = schema.get_field_index(text_col)
        for batch in batches:
            for part in text_runs(batch, text_col):
                texts = [None if t is None else redacted_text(t) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array(texts, schema.field(at).type)
                if length_col:
                    n = schema.get_field_index(length_col)
                    columns[n] = pa.array([None if t is None else len(t) for t in texts], schema.field(n).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)
