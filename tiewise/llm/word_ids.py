"""Exact token ids of whole texts by the tokenizers library, one call for each distinct chunk of a slice of texts.

For a vocabulary whose tokens never hold white space, the ids of a text are those of its chunks in
order. Arrow splits a slice of texts at ASCII white space and numbers its distinct chunks; each of these
is encoded once, and the ids of all texts are gathered from them by Arrow. Nothing is remembered from
slice to slice, so memory is that of one slice. A chunk made of Latin letters, perhaps with one full
stop or comma behind it, is two pre-tokens that the normalizer only lower-cases: their distinct letters
go to the library's model itself, many in a call, and the end-of-word ids show where each one ends.
"""

from __future__ import annotations

import codecs
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tiewise.llm.frames import text_runs

_LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the letters from U+0100.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(256) if b not in _SHOWN}
#: The same for bytes as a decoding table. A blank divides the stems of one call, so it stands for itself.
_STEM_LETTERS = "".join(" " if b == 32 else BYTE_LETTERS.get(b, chr(b)) for b in range(256))
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """The ids of texts under one vocabulary file, whose word-final tokens end with its end-of-word suffix; `entries` stems go into a call."""

    def __init__(self, path: str, entries: int = 2000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.entries = entries
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of non-empty lower-case stems of Latin letters, full stops or commas alone."""
        found = []
        for at in range(0, len(stems), self.entries):
            text, _ = codecs.charmap_decode(" ".join(stems[at : at + self.entries].to_pylist()).encode(), "strict", _STEM_LETTERS)
            found.append(np.array(self.bare.encode(text, add_special_tokens=False).ids, np.uint32))
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(stems):
            raise ValueError("the vocabulary's end-of-word tokens do not mark the ends of words")
        return ids, np.diff(ends, prepend=-1)

    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _chunks(self, chunks: pa.Array) -> pa.ListArray:
        """The ids of distinct chunks."""
        plain = pc.match_substring_regex(chunks, _LATIN)
        latin, other = chunks.filter(plain), chunks.filter(pc.invert(plain))
        stems = pc.dictionary_encode(pc.utf8_lower(pc.utf8_rtrim(latin, ".,")))
        marks = pa.array([".", ","], pa.string())
        ids, n = self._stems(pa.concat_arrays([stems.dictionary, marks]))
        starts = np.cumsum(n) - n
        more, m = self._library(other.to_pylist())
        # Every chunk is one or two runs of ids: its stem, and its full stop or comma; or what the library gave.
        which = stems.indices.to_numpy(zero_copy_only=False)
        mark = np.where(pc.ends_with(latin, ".").to_numpy(zero_copy_only=False), len(stems.dictionary), np.where(pc.ends_with(latin, ",").to_numpy(zero_copy_only=False), len(stems.dictionary) + 1, -1))
        first, length = np.zeros((len(chunks), 2), np.int64), np.zeros((len(chunks), 2), np.int64)
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        first[at, 0], length[at, 0] = starts[which], n[which]
        first[at, 1], length[at, 1] = starts[mark], np.where(mark >= 0, n[mark], 0)
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        first[rest, 0], length[rest, 0] = len(ids) + np.cumsum(m) - m, m
        every = np.concatenate([ids, more])
        first, length = first.ravel(), length.ravel()
        ends = np.cumsum(length)
        place = np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[1::2]]), pa.int32()), pa.array(every[place], pa.uint32()))

    def encode_run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, borders of the texts in them)."""
        split = pc.ascii_split_whitespace(texts)
        chunks = pc.dictionary_encode(split.flatten())
        ids = self._chunks(chunks.dictionary).take(chunks.indices)
        borders = ids.offsets.to_numpy()[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids.flatten().to_numpy(), borders - borders[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, borders = self.encode_run(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded_runs(batches, path: str, max_bytes: int = 8 << 20):
    """(document ids, token ids of all texts, their borders) of runs of rows of Arrow batches with columns id and text."""
    enc = encoder(path)
    for batch in batches:
        for rows in text_runs(batch, "text", max_bytes):
            yield (rows.column("id").to_pylist(), *enc.encode_run(rows.column("text")))


def encoded(batches, path: str, max_bytes: int = 8 << 20):
    """(id, ids as bytes) of every row of Arrow batches with columns id and text."""
    for docs, ids, borders in encoded_runs(batches, path, max_bytes):
        ids = ids.astype("<u4", copy=False)
        for doc, a, b in zip(docs, borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            yield doc, ids[a:b].tobytes()
