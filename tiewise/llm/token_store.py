"""Token ids of a corpus in compressed files, in ascending id order, and back.

File format: Parquet rows, one per block of 4096 ids: `part` and `chunk` (a chunk is about two million
ids of consecutive documents, in ascending order of part and chunk), `block` (its number in the chunk),
`n_ids`, `crc32` (of the ids as little-endian unsigned 32-bit integers), `payload` (the range coder's
bytes, coded from empty models) and, in a chunk's first block, `docs` (document id and number of ids of
each document of the chunk, end id included). Files are written by Spark's committer, so a lost
executor's part is written again whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewise.llm.frames import keyed_text, shared_folder
from tiewise.llm.range_coder import BLOCK, java_functions
from tiewise.llm.word_ids import encoded

_DOC = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("crc32", pa.int64()), ("ids", pa.binary()), ("docs", _DOC)])
SCHEMA = "part int, chunk int, block int, n_ids int, crc32 long, payload binary, docs array<struct<id: bigint, n: bigint>>"
#: Chunks of one partition are numbered from 0; ids in a chunk, unless one document has more.
CHUNK_IDS = 512 * BLOCK
#: Bytes of text in a partition, and at most encoded at once: the more, the fewer words are encoded again.
PARTITION_BYTES, RUN_BYTES = 24 << 20, 32 << 20


def _check(vocabulary: str, end_id: int) -> None:
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True)
    if size > 65536 or not 0 <= end_id < 65536:
        raise ValueError(f"{size} tokens and end id {end_id}: ids must be below 65536")


def write(df: DataFrame, vocabulary: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, partition_bytes: int = PARTITION_BYTES, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode every whole text, append end_id and write all ids in ascending order of document ids.

    Null and empty texts have the end id only; null ids come first; rows that share an id are ordered by a
    hash of their text. An empty table makes files without blocks; extra columns are not read. Vocabularies of more
    than 65536 tokens are refused: ids are coded as 16 bits.
    """
    _check(vocabulary, end_id)
    docs = keyed_text(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(8, -(-size // partition_bytes))
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        part, chunk = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        docs_of: list[dict] = []

        def flush():
            ids = np.frombuffer(b"".join(held), "<u4")
            blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
            index = [list(docs_of), *([None] * (len(blocks) - 1))]
            columns = [[part] * len(blocks), [chunk] * len(blocks), range(len(blocks)), map(len, blocks), map(zlib.crc32, blocks), (b.astype("<u2").tobytes() for b in blocks), index]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        total = 0
        for doc, data in encoded(batches, vocabulary, RUN_BYTES):
            held.append(data + end)
            docs_of.append({"id": doc, "n": len(data) // 4 + 1})
            total += docs_of[-1]["n"]
            if total >= chunk_ids:
                yield flush()
                chunk, total = chunk + 1, 0
                held.clear()
                docs_of.clear()
        if held:
            yield flush()

    # Rows that share an id are dealt by their texts' hashes, so that no id fills one task.
    keyed = docs.withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(parts, F.asc_nulls_first("id"), "h").sortWithinPartitions(F.asc_nulls_first("id"), "h").select("id", "text")
    blocks = ordered.mapInArrow(run, SCHEMA.replace("payload", "ids"))
    payload = F.call_function(java_functions(df.sparkSession)["encode"], "ids").alias("payload")
    blocks.select("part", "chunk", "block", "n_ids", "crc32", payload, "docs").write.mode("overwrite").parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every stored document; start counts the ids of all before it."""
    return _decoded(spark, folder, True)


def digests(spark, folder: str) -> DataFrame:
    """read() with the ids' crc32 (of little-endian unsigned 32-bit integers) in place of the ids."""
    return _decoded(spark, folder, False)


def _decoded(spark, folder: str, whole: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    blocks = spark.read.schema(SCHEMA).parquet(folder)
    # One row for each chunk of about two million ids.
    sizes = blocks.groupBy("part", "chunk").agg(F.sum(F.col("n_ids").cast("long")).alias("n")).collect()
    first, at = {}, 0
    for r in sorted(sizes, key=lambda r: (r.part, r.chunk)):
        first[r.part, r.chunk] = at
        at += r.n
    base = spark.sparkContext.broadcast(first)
    text = "doc_id long, start long, n_tokens long, " + ("ids array<int>" if whole else "ids_crc32 long")
    schema = to_arrow_schema(_parse_datatype_string(text))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blocks = [np.frombuffer(b, "<u2").astype("<u4") for b in table.column("ids").to_pylist()]
        if list(map(zlib.crc32, blocks)) != table.column("crc32").to_pylist():
            raise ValueError("a block's checksum differs from its ids")
        ids = np.concatenate(blocks)
        docs = table.column("docs")[0].as_py()
        ends = np.cumsum([d["n"] for d in docs])
        start = base.value[table.column("part")[0].as_py(), table.column("chunk")[0].as_py()]
        parts = np.split(ids, ends[:-1])
        last = [p.astype(np.int32) for p in parts] if whole else [zlib.crc32(p.tobytes()) for p in parts]
        columns = [[d["id"] for d in docs], [start + int(e) - d["n"] for e, d in zip(ends, docs, strict=True)], [d["n"] for d in docs], last]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    # Decoded where they are grouped, so that payloads are exchanged and not ids.
    ids = F.call_function(java_functions(spark)["decode"], "payload", "n_ids").alias("ids")
    dealt = blocks.repartition("part", "chunk").sortWithinPartitions("part", "chunk").select("part", "chunk", "block", "crc32", ids, "docs")
    return dealt.groupBy("part", "chunk").applyInArrow(run, text)


def round_trip(df: DataFrame, vocabulary: str, **options) -> DataFrame:
    """digests() of df, written to a new folder that driver and executors share."""
    folder = shared_folder(df.sparkSession)
    write(df, vocabulary, folder, **options)
    return digests(df.sparkSession, folder)
