import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tiewise.llm import range_coder, token_store

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_blocks_round_trip():
    r = np.random.default_rng(3)
    blocks = [np.array([], np.int64), np.array([65535, 0, 65535]), r.integers(0, 65536, 4096), np.zeros(4096, np.int64), np.tile(np.arange(50), 80), r.zipf(1.3, 3000) % 49408]
    made = range_coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode_blocks(made), strict=True))
    assert len(made[3][2]) < 400 and range_coder.decode_blocks([]) == []
    # Blocks are independent: each alone gives the same bytes, and reads back alone.
    assert range_coder.encode_blocks([blocks[5]])[0] == made[5]
    assert np.array_equal(range_coder.decode_blocks([made[4]])[0], blocks[4])
    with pytest.raises(ValueError):
        range_coder.decode_blocks([(made[5][0], made[5][1] ^ 1, made[5][2])])


def test_corpus_round_trip(spark, tmp_path):
    texts = {5: "the cat", 1: None, 9: "", 2: "a " * 9000, 7: "<|endoftext|> Élan", 3: "x"}
    rows = [(i, t, 4) for i, t in texts.items()] + [(None, "no id", 4), (5, "the cat", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    token_store.write(df, WORD, f"{tmp_path}/ids", chunk_ids=5000)
    library = Tokenizer.from_file(WORD)
    at = 0
    got = token_store.read(spark, f"{tmp_path}/ids").orderBy("start").collect()
    short = {r.start: r.ids_crc32 for r in token_store.digests(spark, f"{tmp_path}/ids").collect()}
    for (doc, text, _), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), got, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, at, len(ids), ids)
        assert short[at] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_store.round_trip(df.limit(0), WORD).count() == 0


def test_ids_beyond_16_bits_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_store.write(df, WORD, f"{tmp_path}/ids", end_id=65536)


def test_java_coder_makes_the_same_payloads(spark):
    r = np.random.default_rng(5)
    blocks = [np.array([], np.int64), np.array([65535, 0, 65535]), r.integers(0, 65536, 4096), np.zeros(4096, np.int64), np.tile(np.arange(50), 80), r.zipf(1.3, 4096) % 49408, np.tile(r.zipf(1.2, 300) % 65536, 9)]
    names = range_coder.java_functions(spark)
    rows = [(i, bytearray(b.astype("<u2").tobytes()), len(b)) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "i int, ids binary, n int").selectExpr("*", f"{names['encode']}(ids) AS payload")
    got = df.selectExpr("*", f"{names['decode']}(payload, n) AS again").orderBy("i").collect()
    assert [bytes(r.payload) for r in got] == [payload for _, _, payload in range_coder.encode_blocks(blocks)]
    assert [r.again for r in got] == [r.ids for r in got]


def test_broken_files_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words of a text " * 50) for i in range(30)], "doc_id long, text string")
    token_store.write(df, WORD, f"{tmp_path}/ids")
    assert token_store.digests(spark, f"{tmp_path}/ids").count() == 30
    spark.read.parquet(f"{tmp_path}/ids").selectExpr("part", "chunk", "block", "n_ids", "crc32 + 1 AS crc32", "payload", "docs").write.parquet(f"{tmp_path}/other")
    with pytest.raises(Exception, match="checksum"):
        token_store.digests(spark, f"{tmp_path}/other").collect()
