"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, as `id` and `text`; null texts become empty.

    Every other column stays out of the operator, so none can clash with its own names.
    """
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str, max_chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive runs of rows that hold about max_chars; one text is never divided."""
    texts = batch.column(column).to_pylist()
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > max_chars:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def text_runs(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of a batch's rows whose texts hold about max_bytes; one text is never divided."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield batch.slice(first, last - first)
        first = last


def word_columns(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each word among the distinct ones, the distinct words, borders of the texts) of ASCII-lower-cased texts.

    Words are runs of characters other than ASCII white space.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = pc.dictionary_encode(split.flatten())
    distinct = words.dictionary.cast(pa.binary()).to_pylist()
    number = words.indices.to_numpy(zero_copy_only=False)
    borders = split.offsets.to_numpy() - split.offsets[0].as_py()
    if b"" in distinct:  # white space at an end of a text
        real = number != distinct.index(b"")
        borders = np.concatenate([[0], np.cumsum(real)])[borders]
        number = number[real]
    return number, distinct, borders


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, which is set only where it is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that are emptied once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark)
        out = stored(df, path)
        self.paths.append(path)
        return out

    def clear(self, spare: int = 0) -> None:
        """Empty all of the tables but the last `spare` ones; what reads them must have been stored."""
        done = self.paths[: len(self.paths) - spare]
        for path in done:
            self.spark.range(0).write.mode("overwrite").parquet(path)
        self.paths = self.paths[len(done) :]


def arrow_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Record batches of `size` tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
