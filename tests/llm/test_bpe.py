import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tiewise.llm.bpe import ByteBpe, digests, encode
from tiewise.llm.packing import OpenBins, pack
from tiewise.llm.word_ids import WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = [*"ab's Σς1\x1c\x1f\x85\xa0 　́éÀß.,\n\t\rİı中👍‍﻿-0123xyzthe ", "<|endoftext|>", "'re", "Ñ", " the", "  ", "'ll"]


def samples(n=3000):
    r = random.Random(5)
    return ["", "a" * 5000, " " * 300, *("".join(r.choices(LETTERS, k=r.randint(0, 25))) for _ in range(n))]


@pytest.mark.parametrize("kind", [ByteBpe, WordEncoder])
def test_ids_equal_the_library(kind):
    path = BYTE if kind is ByteBpe else WORD
    own, library = kind(path), Tokenizer.from_file(path)
    texts = samples()
    for text, data in zip(texts, own.encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(data, "<u4").tolist() == ids, text
        if kind is ByteBpe:
            assert own.decode(data) == library.decode(ids, skip_special_tokens=False)
    if kind is ByteBpe:
        assert own.exact > 0


def test_small_memo_gives_the_same_ids():
    texts = samples(400)
    assert ByteBpe(BYTE, entries=50).encode(texts) == ByteBpe(BYTE).encode(texts)
    assert WordEncoder(WORD, entries=50).encode(texts) == WordEncoder(WORD).encode(texts)


def test_encoder_rows(spark):
    df = spark.createDataFrame([(1, "the cat", 5), (1, "the cat", 5), (None, None, 6), (2, "", 7)], "doc_id long, text string, id int")
    rows = sorted(encode(df, BYTE).collect(), key=str)
    assert len(rows) == 4 and {r.decoded for r in rows} == {"the cat", ""}
    assert sorted(r.n_tokens for r in digests(df, BYTE).collect()) == [0, 0, 2, 2]
    assert digests(df.limit(0), BYTE).count() == 0


def test_packing(spark):
    texts = [(i, "word " * n) for i, n in enumerate([0, 1, 4094, 4095, 4096, 9000, 3000, 1000, 95])]
    df = spark.createDataFrame([*texts, (None, None), (1, "word ")], "doc_id long, text string").coalesce(1)
    rows = pack(df, WORD).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert [r.length for r in sorted(by_doc[5], key=lambda r: r.piece)] == [4096, 4096, 809]
    assert [r.length for r in by_doc[3]] == [4096] and by_doc[None][0].length == 1
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for used in places.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(r.length for r in rows) // 4096)
    assert pack(df.limit(0), WORD).count() == 0


def test_bins_close_fullest_first():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 9, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_partitions_cost_few_sequences(spark):
    r = random.Random(8)
    texts = [(i, "word " * int(r.expovariate(1 / 700))) for i in range(1500)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    total = None
    for parts in (1, 60):
        rows = pack(df.repartition(parts), WORD).collect()
        total = sum(r.length for r in rows)
        used = {}
        for x in rows:
            used.setdefault(x.sequence_id, []).append((x.offset, x.length))
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(used) <= 1.02 * -(-total // 4096) + 1
