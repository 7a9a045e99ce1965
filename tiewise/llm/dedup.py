"""Near-duplicate documents: MinHash bands propose, odd sketches screen, full shingle sets decide.

Every document's MinHash samples are folded into a parity bitmap, its odd sketch: the number of bits
in which two bitmaps differ tells how many samples differ, most precisely where few do. Documents
with equal shingle sets are one class and only its smallest id goes on. In every bucket of a band
each member is compared with three others only: the bucket's smallest and largest id, and the member
whose buckets hold the most documents, which a family's original does. What these stars leave apart is compared in full, in every bucket
that still holds several components: pairs across components but those within the largest one. In
a bucket of more than PAIRED members, two are compared only if the first shingles of their sets, in
an order that begins with those that the bucket's central member lacks, have one in common; two sets
that overlap enough always do. The screen is one bit count in the JVM; links are confirmed on the
full sets of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiewise.llm.components import components
from tiewise.llm.frames import Scratch, arrow_batches, keyed_text, stored, text_runs, word_columns

BANDS, ROWS = 24, 3
#: The sketch: samples are the smallest shingles of this many bins, one bit of the bitmap is flipped for each.
SAMPLES, SKETCH_BITS = 512, 1024
#: Pairs whose bitmaps differ more than expected at a similarity so much below the least one are not confirmed.
MARGIN = 0.12
#: Members of a bucket that may all be compared with each other; larger buckets are joined on shingles.
PAIRED = 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SIGNATURE = "id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"
_ARROW = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-and-shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_GENERATOR = np.random.default_rng(20240501)
_FACTORS = _GENERATOR.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _GENERATOR.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACES = _GENERATOR.integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; fewer words are one shingle, none are no shingle."""
    import xxhash

    number, distinct, borders = word_columns(texts)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[number]
    whole = _rolled(h, k)
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        else:
            yield _rolled(h[a:b], b - a) if b > a else np.empty(0, np.uint64)


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of `width` words."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = _mix(out + h[j : j + n] * _PLACES[j % 5])
    return out


def shingles(text: str, k: int = 5) -> np.ndarray:
    """shingle_sets() of one text."""
    (out,) = shingle_sets(pa.array([text], pa.string()), k)
    return out


def _sketch(sh: np.ndarray) -> np.ndarray:
    """The odd sketch: a bit for every hash value of a sample, flipped by each sample that has it.

    Samples come from one permutation: it deals the shingles into bins, and the smallest of each bin is one.
    """
    y = np.sort(_mix(sh + _OFFSETS[0]))
    of = y >> np.uint64(64 - SAMPLES.bit_length() + 1)
    samples = y[np.flatnonzero(np.diff(of, prepend=np.uint64(SAMPLES)))]
    bits = np.bincount((_mix(samples) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def signature(sh: np.ndarray) -> tuple[int, int, int, list[int], list[int]]:
    """(size, two hashes of the set, band keys, odd sketch) of a non-empty set of shingles."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sh), 1024):
        np.minimum(low, (sh[at : at + 1024, None] * _FACTORS + _OFFSETS).min(axis=0), out=low)
    rows = low.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = _mix(keys + rows[:, j])
    mixed = _mix(sh + np.uint64(1))
    return len(sh), int(mixed.sum().view(np.int64)), int(np.bitwise_xor.reduce(_mix(mixed)).view(np.int64)), keys.view(np.int64).tolist(), _sketch(sh).tolist()


def signatures(docs: DataFrame) -> DataFrame:
    """One row per row of docs (id, text); without words: no bands."""

    def run(batches):
        def rows():
            for batch in batches:
                for part in text_runs(batch, "text"):
                    for i, sh in zip(part.column("id").to_pylist(), shingle_sets(part.column("text")), strict=True):
                        yield (i, *(signature(sh) if len(sh) else (0, 0, 0, [], [])))

        yield from arrow_batches(rows(), _ARROW, 2000)

    return docs.mapInArrow(run, _SIGNATURE)


def most_differing(n: float, percent: int = 75, margin: float = MARGIN) -> float:
    """Bits in which sketches are expected to differ `margin` below the least similarity, for two sets of n shingles in all, and 3 more.

    A bin flips a bit for each set that has a smallest shingle there which is not the other's as well. With
    Poisson many shingles in a bin, two sets of the same size flip most.
    """
    s = percent / 100 - margin
    flips = 2 * SAMPLES * (1 - np.exp(-n / 2 / SAMPLES) - s * (1 - np.exp(-n / (1 + s) / SAMPLES)))
    return SKETCH_BITS / 2 * (1 - np.exp(-2 * flips / SKETCH_BITS)) + 3


def _may_be_linked(nu: Column, nv: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sizes leave room for a link, which is exact, and sketches a and b differ by no more than a link's would.

    The bound is that of most_differing().
    """
    bits = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        bits = bits + F.bit_count(a[i].bitwiseXOR(b[i]))
    n = (nu + nv).cast("double")
    s = percent / 100 - MARGIN
    flips = 2 * SAMPLES * (1 - F.exp(-n / (2 * SAMPLES)) - s * (1 - F.exp(-n / ((1 + s) * SAMPLES))))
    most = SKETCH_BITS / 2 * (1 - F.exp(-2 / SKETCH_BITS * flips)) + 3
    return (F.least(nu, nv) * 100 >= F.greatest(nu, nv) * percent) & (bits <= most)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """Those pairs (u, v) of ids of texts (id, text) whose full shingle sets overlap enough: 100 * intersection >= percent * union."""
    both = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v").join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        last: tuple = ("", np.empty(0, np.uint64))

        def rows():
            nonlocal last
            for batch in batches:
                us, vs, tus, tvs = (batch.column(c) for c in ("u", "v", "text_u", "text_v"))
                for i in range(batch.num_rows):
                    tu = tus[i].as_py()
                    if tu != last[0]:
                        last = (tu, shingles(tu))
                    a, b = last[1], shingles(tvs[i].as_py())
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    if len(a) and 100 * common >= percent * (len(a) + len(b) - common):
                        yield us[i].as_py(), vs[i].as_py()

        yield from arrow_batches(rows(), schema)

    return both.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def first_shingles(sh: np.ndarray, centre: np.ndarray, own: int, classes: list[tuple[int, int, int]], percent: int = 75) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of which two sets that overlap enough share one at least, given the same centre, places, and whether a key is of the own class.

    The place of a key is how many of the set's shingles are left from it on: two sets have no more in
    common than the smaller place of the first key that they share.

    A set's shingles are ordered: those that the centre lacks, then the others, each by hash. Of two sets
    of u and v shingles with enough in common, percent / (100 + percent) * (u + v) at least, the first
    u - that + 1 and v - that + 1 must meet. The smaller set's size class is part of the key and bounds
    the sum from below, so a set that is far from its centre offers nothing that the centre's copies have.
    `own` is the set's class; classes are (class, smallest size, largest size) of the sets around the centre.
    Two sets meet under the class of the smaller one.
    """
    known = np.isin(sh, centre, assume_unique=True)
    ordered = np.concatenate([sh[~known], sh[known]])
    group, n = _mix(centre + np.uint64(1)).sum(), len(sh)
    smallest = -(-percent * n // 100)
    out, left, own_class = [], [], []
    for k, low, high in classes:
        if k > own or high < smallest:
            continue
        common = -(-percent * (n + max(low, smallest)) // (100 + percent))
        first = max(0, n - common + 1)
        out.append(_mix(_mix(ordered[:first] + group) + np.uint64(k)))
        left.append(n - np.arange(first))
        own_class.append(np.full(first, k == own))
    return (np.concatenate(out), np.concatenate(left), np.concatenate(own_class)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool))


def _keyed(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(key, own, place, n, id, part) for members (id, part, mid, n): the keys of each member's first shingles around its centre."""
    # Classes span 2 %, or one size; they are some hundreds at most.
    classed = members.withColumn("k", F.floor(F.log("n") / F.log(F.lit(1.02))).cast("int"))
    found = classed.groupBy("mid", "k").agg(F.min("n").alias("low"), F.max("n").alias("high")).groupBy("mid").agg(F.sort_array(F.collect_list(F.struct("k", "low", "high"))).alias("found"))
    both = classed.join(found, "mid").join(texts, "id").join(texts.select(F.col("id").alias("mid"), F.col("text").alias("text_mid")), "mid").select("id", "part", "n", "k", "found", "text", "text_mid")
    schema = pa.schema([("key", pa.int64()), ("own", pa.bool_()), ("place", pa.int32()), ("n", pa.int32()), ("id", pa.int64()), ("part", pa.int64())])

    def run(batches):
        last: tuple = ("", np.empty(0, np.uint64))
        for batch in batches:
            ids, parts, sizes, ks, founds, texts, centres = (batch.column(c) for c in ("id", "part", "n", "k", "found", "text", "text_mid"))
            for i in range(batch.num_rows):
                centre = centres[i].as_py()
                if centre != last[0]:
                    last = (centre, shingles(centre))
                sh = shingles(texts[i].as_py())
                # Texts that share an id are told apart by their sizes.
                if len(sh) == sizes[i].as_py() and len(last[1]):
                    keys, places, own = first_shingles(sh, last[1], ks[i].as_py(), [(c["k"], c["low"], c["high"]) for c in founds[i].as_py()], percent)
                    columns = [keys.view(np.int64), own, places, *(np.full(len(keys), x) for x in (len(sh), ids[i].as_py(), parts[i].as_py()))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return both.mapInArrow(run, "key long, own boolean, place int, n int, id long, part long")


def _across(rest: DataFrame, by: list[str], percent: int, placed: bool = False) -> DataFrame:
    """Screened pairs (u, v) of rows (id, part, sketch, n) with one key and different parts, and not both of the largest part.

    Placed rows have a place and a class flag too, and the places must leave room for enough in common.
    """
    largest = rest.groupBy(*by, "part").count().groupBy(*by).agg(F.max(F.struct("count", "part")).alias("m")).select(*by, F.col("m.part").alias("largest"))
    known = rest.join(largest, by)

    def side(of: str, rows: DataFrame, *more: Column) -> DataFrame:
        extra = [F.col("place").alias(f"place_{of}"), F.col("own").alias(f"own_{of}")] if placed else []
        return rows.select(*by, F.col("id").alias(of), F.col("part").alias(f"p{of}"), F.col("sketch").alias(f"s{of}"), F.col("n").alias(f"n{of}"), *extra, *more)

    small = side("v", known.where("part <> largest"))
    all_of = side("u", known, (F.col("part") == F.col("largest")).alias("of_largest"))
    room = (F.col("own_u") | F.col("own_v")) & (F.least("place_u", "place_v").cast("long") * (100 + percent) >= (F.col("nu").cast("long") + F.col("nv")) * percent) if placed else F.lit(True)
    return (
        all_of.join(small, by)
        .where(room & (F.col("pu") != F.col("pv")) & (F.col("of_largest") | (F.col("u") < F.col("v"))) & _may_be_linked(F.col("nu"), F.col("nv"), F.col("su"), F.col("sv"), percent))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    )


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, paired: int = PAIRED) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of df.

    Documents without words (null or empty text too) are linked with nothing. Rows with one id are one
    document: it is linked with what any of its texts is linked with, and each of its rows is returned.
    Rows without an id are not linked: component null, kept. An empty table gives no rows; extra columns
    are not read. Links follow the contract exactly for all proposed pairs; a pair at exactly 0.75 shares
    no band with a probability of 2e-6, a more similar one less, and its sketches are farther apart than
    the screen allows with one below 1e-6. `paired` divides the work and not the result.
    """
    docs = keyed_text(df, id_col, text_col)
    sig = stored(signatures(docs))
    linked = sig.where("n_shingles > 0 and id is not null")
    key = ["n_shingles", "s1", "s2"]
    whole = stored(linked.groupBy(*key).agg(F.min("id").alias("rep"), F.min_by(F.struct("bands", "sketch"), "id").alias("s")))
    classes = whole.select(*key, "rep")
    reps = whole.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "s.bands", "s.sketch")
    tables = Scratch(df.sparkSession)
    buckets = reps.select("id", F.posexplode("bands").alias("band", "key"))
    ends = buckets.groupBy("band", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    shared = tables.keep(buckets.join(ends, ["band", "key"]).distinct())
    # The text that a family of copies was made from is in the most and fullest buckets of them all.
    central = shared.groupBy("id").agg(F.sum("size").alias("score"))
    middle = tables.keep(shared.select("id", "band", "key").join(central, "id").groupBy("band", "key").agg(F.max(F.struct("score", (-F.col("id")).alias("other"))).alias("m")).select("band", "key", (-F.col("m.other")).alias("mid")))
    # Every later join of texts reads those alone that share a bucket with another one. How many do is not
    # bounded, so their ids are not broadcast, at no size.
    texts = tables.keep(docs.where("id is not null").join(shared.select("id").distinct().hint("merge"), "id", "left_semi"))
    stars = shared.join(middle, ["band", "key"]).select("id", F.explode(F.array("lo", "hi", "mid")).alias("end")).where("id <> end")
    stars = stars.select(F.least("id", "end").alias("u"), F.greatest("id", "end").alias("v")).distinct()
    screened = (
        stars.join(reps.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u")
        .join(reps.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv")), "v")
        .where(_may_be_linked(F.col("nu"), F.col("nv"), F.col("su"), F.col("sv"), percent))
        .select("u", "v")
        .distinct()
    )
    of_ids = linked.join(classes, key).select("id", "rep").distinct()
    several = of_ids.groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).where("v < top").select("id", "v")
    same_id = of_ids.join(several, "id").select(F.col("rep").alias("u"), "v").where("u <> v")
    first = tables.keep(confirmed(screened, texts, percent).unionByName(same_id))
    parts = tables.keep(components(first))
    # Only rows of buckets that several share can meet another component.
    part_of = shared.select("id").distinct().join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("part"))
    placed = tables.keep(shared.select("id", "band", "key").join(part_of, "id"))
    mixed = tables.keep(placed.groupBy("band", "key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.count(F.lit(1)).alias("size")).where("p0 < p1").select("band", "key", "size"))
    sketches = reps.select("id", "sketch", "n")
    few = placed.join(mixed.where(f"size <= {paired}").select("band", "key"), ["band", "key"]).join(sketches, "id").select("band", "key", "id", "part", "sketch", "n")
    # One centre for a whole component, so that a family's members have one set of keys.
    parted = placed.select("id", "part").distinct()
    centres = parted.join(central, "id").groupBy("part").agg(F.max(F.struct("score", (-F.col("id")).alias("other"))).alias("m")).select("part", (-F.col("m.other")).alias("mid"))
    large = mixed.where(f"size > {paired}").join(middle, ["band", "key"]).select("band", "key", F.col("mid").alias("id"))
    large = large.join(parted, "id").join(centres, "part").select("band", "key", "mid")
    members = placed.join(large, ["band", "key"]).select("id", "part", "mid").distinct().join(reps.select("id", "n").distinct(), "id")
    entries = tables.keep(_keyed(members, texts, percent))
    meeting = entries.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.max("own").alias("own")).where("p0 < p1 and own").select("key")
    many = entries.join(meeting, "key").join(reps.select("id", "n", "sketch"), ["id", "n"]).select("key", "own", "place", "n", "id", "part", "sketch")
    across = _across(tables.keep(few), ["band", "key"], percent).unionByName(_across(tables.keep(many), ["key"], percent, placed=True)).distinct()
    second = confirmed(across.join(first, ["u", "v"], "left_anti"), texts, percent)
    final = components(parts.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(second))
    tables.clear()
    out = sig.select("id", "n_shingles", "s1", "s2").join(classes, key, "left").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce(F.col("component"), F.when(F.col("id").isNotNull(), F.col("rep")), F.col("id"))
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
