"""Byte-level BPE encoding by speculation and verification, and decoding.

A text is divided into pre-tokens ("words"). For every word not seen before by this worker, greedy
longest match proposes tokens. A proposal is the BPE encoding exactly if every token encodes to
itself and no two neighbours would have been merged differently across their border; all borders of
all new words are checked together with numpy by undoing merges, latest first, on both sides. Only
words that fail undergo exact merging, pair by pair.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tiewise.llm.frames import arrow_batches, keyed_text, slices
from tiewise.llm.word_ids import BYTE_LETTERS

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern of the byte-level vocabulary, with its white space spelt out.
PRE_TOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_NEVER = np.int64(1) << 40
_CODECS: dict[str, "ByteBpe"] = {}


class ByteBpe:
    """Codec of one vocabulary file. Inside, a token's number is its byte value or 256 plus its merge's rank."""

    def __init__(self, path: str, entries: int = 700_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letter = [BYTE_LETTERS.get(b, chr(b)) for b in range(256)]
        byte_of = {c: b for b, c in enumerate(letter)}
        number = {c: b for b, c in enumerate(letter)}
        left, right = list(range(256)), list(range(256))
        name = list(letter)
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left.append(number[a])
            right.append(number[b])
            number[a + b] = 256 + rank
            name.append(a + b)
        self.left, self.right = np.array(left), np.array(right)
        self.data = [bytes(byte_of[c] for c in n) for n in name]
        self.id_bytes = [int(ids[n]).to_bytes(4, "little") for n in name]
        self.special = {t["content"]: int(t["id"]) for t in spec.get("added_tokens", [])}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.bytes_of_id = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for n, x in ids.items():
            self.bytes_of_id[x] = bytes(byte_of[c] for c in n)
        for n, x in self.special.items():
            self.bytes_of_id[x] = n.encode()
        keys = (self.left[256:] << 32) | self.right[256:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_number = keys[order], 256 + order
        self.merge = {int(k): 256 + r for r, k in enumerate(keys)}
        own = np.arange(256, len(name))
        sound = np.ones(len(name), bool)
        sound[256:] = self._compatible(self.left[256:], self.right[256:], own)
        for n in own[~sound[self.left[256:]] | ~sound[self.right[256:]]]:
            sound[n] &= sound[self.left[n]] and sound[self.right[n]]
        self.longest = {d: n for n, d in enumerate(self.data) if sound[n]}
        self.reach = max(map(len, self.longest))
        self.pattern = regex.compile(PRE_TOKENS)
        self.entries = entries
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}
        self.exact = 0

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of the token that a and b merge to, or _NEVER."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_number[at], _NEVER)

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether encoding the bytes of a and b together leaves their border; merges from `limit` on don't count."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        before = np.full(len(a), _NEVER) if limit is None else limit.astype(np.int64)
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        while len(at):
            crossed = self._merged(a, b) < before
            good[at[crossed]] = False
            # The later of the two outer merges is undone; what was made before it may still cross the border.
            # Of equal merges the left one happens first, so on the right its own number still counts.
            undo_left = a > b
            stop = np.where(undo_left, a < 256, b < 256) | crossed
            before = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            at, a, b, before = at[~stop], a[~stop], b[~stop], before[~stop]
        return good

    def _greedy(self, data: bytes) -> list[int]:
        known, reach, out, i, n = self.longest, self.reach, [], 0, len(data)
        while i < n:
            j = min(n, i + reach)
            while (t := known.get(data[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def _exact(self, data: bytes) -> list[int]:
        """Lowest merge first, leftmost first, through a heap of candidate pairs over a linked list."""
        import heapq

        self.exact += 1
        token = list(data)
        n = len(token)
        nxt, prev = [*range(1, n), -1], list(range(-1, n - 1))
        merge = self.merge
        heap = [(m, i, token[i], token[i + 1]) for i in range(n - 1) if (m := merge.get((token[i] << 32) | token[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue
            token[i], token[j] = m, -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
                if x := merge.get((m << 32) | token[k]):
                    heapq.heappush(heap, (x, i, m, token[k]))
            h = prev[i]
            if h >= 0 and (x := merge.get((token[h] << 32) | m)):
                heapq.heappush(heap, (x, h, token[h], m))
        return [t for t in token if t >= 0]

    def _learn(self, words: list[str]) -> None:
        if len(self.words) + len(words) > self.entries:
            self.words.clear()
        raw = [w.encode() for w in words]
        proposed = [self._greedy(r) for r in raw]
        flat = np.fromiter((t for p in proposed for t in p), np.int64)
        starts = np.cumsum([0, *map(len, proposed)])
        inner = np.ones(max(0, len(flat) - 1), bool)
        inner[starts[1:-1] - 1] = False
        border = np.nonzero(inner)[0]
        bad = border[~self._compatible(flat[border], flat[border + 1])]
        for w in np.unique(np.searchsorted(starts, bad, side="right") - 1):
            proposed[w] = self._exact(raw[w])
        spelt = self.id_bytes
        self.words.update((w, b"".join([spelt[t] for t in p])) for w, p in zip(words, proposed, strict=True))

    def _runs(self, runs: list[list[str]]) -> list[bytes]:
        """Ids of each list of pre-tokens."""
        new = list(set().union(*runs) - self.words.keys())
        if len(self.words) + len(new) > self.entries:
            self.words.clear()
            new = list(set().union(*runs))
        if new:
            self._learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, r)) for r in runs]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens.

        At a single space between two characters that are no white space, the space opens a new
        pre-token whatever surrounds it, so such texts are looked up by their pieces between spaces.
        """
        split = [t.split(" ") for t in texts]
        new = list(set().union(*(s[1:] for s in split)) - self.chunks.keys())
        if len(self.chunks) + len(new) > self.entries:
            self.chunks.clear()
            new = list(set().union(*(s[1:] for s in split)))
        regular = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        self.chunks.update((c, None) for c in new)
        self.chunks.update(zip(regular, self._runs([self.pattern.findall(" " + c) for c in regular]), strict=True))
        heads = self._runs([self.pattern.findall(s[0]) if not (s[0] and s[0][-1].isspace()) else [] for s in split])
        get = self.chunks.__getitem__
        out: list[bytes | None] = []
        for parts, head in zip(split, heads, strict=True):
            found = list(map(get, parts[1:]))
            whole = len(parts) == 1 and not (parts[0] and parts[0][-1].isspace())
            out.append(head + b"".join(found) if whole or parts[0] and not parts[0][-1].isspace() and None not in found else None)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, data in zip(rest, self._runs([self.pattern.findall(texts[i]) for i in rest]), strict=True):
            out[i] = data
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not any(s in t for t in texts for s in self.special):
            return self._plain(texts)
        out = []
        for t in texts:
            ids, at = b"", 0
            for m in self.special_pattern.finditer(t):
                ids += self._plain([t[at : m.start()]])[0] + self.special[m[0]].to_bytes(4, "little")
                at = m.end()
            out.append(ids + self._plain([t[at:]])[0])
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of_id.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> ByteBpe:
    """This worker's codec of a vocabulary file."""
    if path not in _CODECS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CODECS[path] = ByteBpe(path)
    return _CODECS[path]


def encode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, ids array<int>, decoded string): token ids of every whole text and what they decode to.

    Null and empty texts have no ids; null ids and repeated rows are rows like others; an empty table
    gives no rows; extra columns are not read.
    """
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        bpe = codec(vocabulary)
        rows = ((i, np.frombuffer(data, "<i4"), bpe.decode(data)) for i, data in _encoded(batches, bpe))
        yield from arrow_batches(rows, schema, 200)

    return keyed_text(df, id_col, text_col).mapInArrow(run, "id long, ids array<int>, decoded string")


def _encoded(batches, bpe: ByteBpe):
    for batch in batches:
        ids = batch.column("id").to_pylist()
        for first, texts in slices(batch, "text"):
            for i, data in enumerate(bpe.encode(texts), first):
                yield ids[i], data


def digests(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() with each text's ids and decoded text as digests, computed where they arise; the same rules hold."""

    def run(batches):
        bpe = codec(vocabulary)

        def rows():
            for doc, data in _encoded(batches, bpe):
                yield doc, len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(bpe.decode(data).encode()).hexdigest()

        yield from arrow_batches(rows(), _ARROW)

    return keyed_text(df, id_col, text_col).mapInArrow(run, SCHEMA)
