"""Best-fit packing of token sequences with bounded space.

Each partition packs what it reads, in order: a fixed number of bins is open at a time, a bitset
keyed by free space finds the open bin that a piece fills best, and when a new bin is needed and
all places are taken, the fullest one closes. Memory is the open bins. The pieces of sequences that a
partition leaves unfilled are packed once more in the same way, the longest ones first, in groups of bounded size
over all partitions: so the number of sequences hardly depends on the number of partitions.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewise.llm.frames import arrow_batches, keyed_text, stored
from tiewise.llm.word_ids import encoded

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Sequence ids are the partition's number times this, plus a count from 0.
IDS_PER_PARTITION = 1 << 40
#: Sequences of the second packing are numbered from here, in the same way.
FILLED = 1 << 62
#: Pieces of unfilled sequences that one task packs anew, about; all of its bins may be open.
UNITS = 500_000


class OpenBins:
    """At most `places` bins with free space; bit f of `free` is set while some open bin has f tokens free."""

    def __init__(self, capacity: int, places: int, first: int = 0):
        self.capacity, self.places, self.next = capacity, places, first
        self.free = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to `capacity` tokens."""
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            sequence = self._take(space)
        else:
            if self.open >= self.places:
                self._take((self.free & -self.free).bit_length() - 1)
            sequence, space = self.next, self.capacity
            self.next += 1
        if rest := space - length:
            self.bins[rest].append(sequence)
            self.free |= 1 << rest
            self.open += 1
        return sequence, space and self.capacity - space


def pack(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, open_bins: int = 1024) -> DataFrame:
    """One row for each piece of each document and its place in a sequence of at most `capacity` tokens.

    A document's ids are those of the tokenizers library and then `end_id`; only documents longer than
    `capacity` are cut, into pieces of `capacity` whose last may be shorter. Null and empty texts are one
    piece of one id. Repeated rows and null ids are packed as documents of their own; an empty table
    gives no rows; extra columns are not read.
    """
    end = end_id.to_bytes(4, "little")
    width = 4 * capacity

    def run(batches):
        from pyspark import TaskContext

        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() * IDS_PER_PARTITION)

        def rows():
            for doc, data in encoded(batches, vocabulary):
                data += end
                for piece, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    length = len(part) // 4
                    yield (doc, piece, at // 4, length, zlib.crc32(part), *bins.place(length))

        yield from arrow_batches(rows(), _ARROW)

    return _filled(stored(keyed_text(df, id_col, text_col).mapInArrow(run, SCHEMA)), capacity)


def _filled(placed: DataFrame, capacity: int) -> DataFrame:
    """The same pieces, those of unfilled sequences packed anew."""
    unfilled = stored(placed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("pieces")).where(F.col("used") < capacity))
    pieces = unfilled.agg(F.sum("pieces")).first()[0] or 0
    parts = max(1, -(-pieces // UNITS))

    def run(batches):
        from pyspark import TaskContext

        bins = OpenBins(capacity, 2 * UNITS, FILLED + TaskContext.get().partitionId() * IDS_PER_PARTITION)
        for batch in batches:
            sequences, offsets = zip(*map(bins.place, batch.column("length").to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], schema=_ARROW)

    ids = unfilled.select("sequence_id")
    left = placed.join(ids, "sequence_id", "left_semi").select(*placed.columns)
    # A piece's place tells it from all others, whatever its document's id.
    anew = left.repartition(parts, F.xxhash64("sequence_id", "offset")).sortWithinPartitions(F.desc("length"), "sequence_id", "offset").mapInArrow(run, SCHEMA)
    return placed.join(ids, "sequence_id", "left_anti").select(*placed.columns).unionByName(anew)
