"""Stupid-backoff language-model scores, joined and summed relationally.

The corpus's own n-gram and word counts score each document, its own occurrences taken out first. The
plan is the join of exploded n-grams with count tables that are partitioned by hash, with rows packed:
documents are dealt into blocks by hash; a block sends every hash bucket its distinct n-grams and their
counts once (so a frequent n-gram is one entry a block, never a hot key); a bucket, one partition of the
count table, sums them and returns each block's totals in the order sent; the block joins them to its
documents' n-grams and sums by document. Nothing is broadcast but the corpus's number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewise.llm.frames import keyed_text

BACKOFF, UNSEEN = 0.4, 0.5
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORDS: dict[bytes, int] = {}


def _grams(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hashes of the n-grams that end at each word, for n from 1 to order; words of each text; place of each word in its text).

    An n-gram's hash means something only where n words of the text end, at places from n - 1 on.
    """
    import xxhash

    hashes = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if len(_WORDS) > 250_000:
            _WORDS.clear()
        for w in set(words).difference(_WORDS):
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)))
    lengths = np.array([len(h) for h in hashes], np.int64)
    one = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    place = np.arange(len(one)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams = [one]
    for _ in range(1, order):
        longer = (np.roll(grams[-1], 1) * _C1 ^ (one + _C2)) * _C2
        grams.append((longer ^ (longer >> np.uint64(29))) * _C1)
    return grams, lengths, place


def _entries(texts: list[str], order: int):
    grams, lengths, place = _grams(texts, order)
    return np.concatenate([g[place >= n] for n, g in enumerate(grams)]), lengths, place


def _small(numbers: np.ndarray) -> bytes:
    """Counts, most of them small: their number, a byte for each (255: more), then the larger ones in full."""
    return len(numbers).to_bytes(4, "little") + np.minimum(numbers, 255).astype(np.uint8).tobytes() + numbers[numbers >= 255].astype("<u8").tobytes()


def _large(data) -> np.ndarray:
    """What _small() packed."""
    n = int.from_bytes(data[:4], "little")
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=4 + n)
    return out


def _bucketed(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, borders of the buckets) of sorted distinct hashes."""
    of = ((distinct >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block_bytes: int = 2 << 20) -> DataFrame:
    """(id, n_words, log_score): the sum over a text's words of the log of its stupid-backoff score.

    Words are runs of non-white-space (ASCII), A-Z lower-cased. A word scores by the longest n-gram of at
    most `order` words that ends at it and occurs elsewhere: count(n-gram) / count(its words but the last);
    without one, count(word) / total. Each word of context given up on the way, of those that the text has
    within the order, takes a factor of 0.4. A word that occurs nowhere else counts 0.5. All counts and the total
    are of the other rows. A text without words (null, empty) scores 0.0 over 0 words. Rows that repeat
    are rows of the corpus like others; an empty table gives no rows; extra columns are not read. Counts
    are by 64-bit hashes of words and n-grams.
    """
    docs = keyed_text(df, id_col, text_col)
    words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
    total, size = (x or 0 for x in docs.agg(F.sum(words), F.sum(F.octet_length("text").cast("long"))).first())
    blocks, buckets = max(64, -(-size // block_bytes)), max(64, -(-size // (16 * block_bytes)))
    # Rows without words need no counts and are in no block, however many they are.
    worded = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    empty = docs.where(~worded).select("id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_score"))
    dealt = docs.where(worded).withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    packed = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
    summed = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])
    result = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])

    def count(table: pa.Table) -> pa.Table:
        entries, *_ = _entries(table.column("text").to_pylist(), order)
        distinct, counts = np.unique(entries, return_counts=True)
        dealt_to, border = _bucketed(distinct, buckets)
        distinct, counts = distinct[dealt_to], counts[dealt_to]
        full = [b for b in range(buckets) if border[b] < border[b + 1]]
        block = table.column("block")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array([block] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([distinct[border[b] : border[b + 1]].tobytes() for b in full], pa.binary()), pa.array([_small(counts[border[b] : border[b + 1]]) for b in full], pa.binary())],
            schema=packed,
        )

    def add(table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
        _, where = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.concatenate([_large(x.as_py()) for x in table.column("counts")])
        totals = np.bincount(where, counts)[where].astype(np.int64)
        ends = np.cumsum([len(g) for g in grams])
        parts = [_small(p) for p in np.split(totals, ends[:-1])]
        return pa.Table.from_arrays([table.column("block").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(parts, pa.binary())], schema=summed)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        entries, lengths, place = _entries(left.column("text").to_pylist(), order)
        distinct, where = np.unique(entries, return_inverse=True)
        dealt_to, _ = _bucketed(distinct, buckets)
        by_bucket = sorted(zip(right.column("bucket").to_pylist(), right.column("totals").to_pylist(), strict=True))
        totals = np.empty(len(distinct), np.float64)
        if len(distinct):
            totals[dealt_to] = np.concatenate([_large(t) for _, t in by_bucket])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        owner = np.concatenate([doc[place >= n] for n in range(order)])
        _, at, own = np.unique(owner * max(1, len(distinct)) + where, return_inverse=True, return_counts=True)
        others = totals[where] - own[at]
        rest = np.maximum(1, total - lengths)[doc]
        longest = np.minimum(order, place + 1)
        value, shorter, at = np.empty(0), np.empty(0), 0
        for n in range(1, order + 1):
            ends = place >= n - 1
            c = np.zeros(len(doc))
            c[ends] = others[at : at + ends.sum()]
            at += ends.sum()
            backed = BACKOFF ** (longest - n).clip(0)
            value = np.maximum(c, UNSEEN) / rest * backed if n == 1 else np.where(c > 0, np.maximum(c, 1) / np.maximum(np.roll(shorter, 1), 1) * backed, value)
            shorter = c
        sums = np.bincount(doc, np.log(value), minlength=len(lengths)) if len(doc) else np.zeros(len(lengths))
        return pa.Table.from_arrays([left.column("id").combine_chunks(), pa.array(lengths), pa.array(sums)], schema=result)

    counts = dealt.groupBy("block").applyInArrow(count, "block int, bucket int, grams binary, counts binary")
    totals = counts.groupBy("bucket").applyInArrow(add, "block int, bucket int, totals binary")
    return dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(join, "id long, n_words long, log_score double").unionByName(empty)


#: The same scores in DuckDB's SQL over `documents`.
SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), tokens AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), pairs AS (
  SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM tokens
), c1 AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
d1 AS (SELECT doc_id, word, count(*) AS n FROM tokens GROUP BY doc_id, word),
c2 AS (SELECT prev, word, count(*) AS n FROM pairs WHERE i > 1 GROUP BY prev, word),
d2 AS (SELECT doc_id, prev, word, count(*) AS n FROM pairs WHERE i > 1 GROUP BY doc_id, prev, word),
total AS (SELECT count(*) AS t FROM tokens), len AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
scored AS (
  SELECT p.doc_id, ln(CASE
    WHEN p.i > 1 AND c2.n - d2.n > 0 THEN (c2.n - d2.n) / (pc.n - pd.n)
    ELSE greatest(c1.n - d1.n, 0.5::DOUBLE) / greatest(1, total.t - len.n) * CASE WHEN p.i = 1 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END END) AS s
  FROM pairs p CROSS JOIN total JOIN len ON len.doc_id = p.doc_id JOIN c1 ON c1.word = p.word JOIN d1 ON d1.doc_id = p.doc_id AND d1.word = p.word
  LEFT JOIN c1 pc ON pc.word = p.prev LEFT JOIN d1 pd ON pd.doc_id = p.doc_id AND pd.word = p.prev
  LEFT JOIN c2 ON c2.prev = p.prev AND c2.word = p.word LEFT JOIN d2 ON d2.doc_id = p.doc_id AND d2.prev = p.prev AND d2.word = p.word
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, round(coalesce(sum(s.s), 0.0::DOUBLE), 4) AS log_score
FROM words w LEFT JOIN scored s ON s.doc_id = w.doc_id GROUP BY w.doc_id, w.w
"""
