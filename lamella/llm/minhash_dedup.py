"""Near-duplicate detection by HyperMinHash sketches with exact verification.

A text's set holds its distinct shingles of ``width`` words (A-Z lower-cased). One hash per shingle serves all:
its low 8 bits pick one of 256 buckets, and the smallest remainder in a bucket is stored as a 16-bit register,
the count of leading zeros (6 bits) and the 10 bits after the first one.

1. Sketch: one pass over the texts gives (row, id, text, set size, 128-bit digest of the set, registers), written once. Rows are
   numbered as they are written, so repeated and null ids don't matter; where they come with numbers, their texts aren't written again. Equal sets become one class, represented by its first row,
   and only that row's text is compared.
2. Candidates: registers in 42 bands of 6; an empty bucket borrows a filled one's register in an order of its own. At
   a similarity of 0.8 the chance that no band agrees is below 3e-6.
3. First pass: each representative meets one partner, the bucket minimum with which it shares most bands.
4. Second pass: where a bucket still holds several components, all its pairs across components are candidates, so no link
   that joins two components is lost and no pair inside a component is made. Pairs whose set sizes rule a link out, or whose lowest
   register bits differ more than six standard deviations beyond what the threshold gives, are dropped as they are made.
5. In both passes the collision-corrected Jaccard estimate drops pairs more than six standard deviations below
   the threshold; the rest are verified on full sets, recomputed from whole texts.

Links are exact in integers: 100 * intersection >= percent * union. Components follow from verified links alone.

Documents that share a template just below the threshold agree in bands and in estimates without linking: the pairs of such a bucket grow with the
square of its members. Results stay exact.

Defined results: null or empty texts and texts without words have an empty set and link with nothing. Fewer than
``width`` words: the sequence is the one shingle. Very long texts are compared whole. Rows with a null id link as all others do, but have
a null component and are kept in ``near_groups``; ``drop_near`` keeps one row of each component, whatever ids are null or repeated: the
one with the smallest id, of these the first. Rows that repeat an id with different texts are documents of their own, which link each with
its own partners. No rows: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._join import keep_rows, keyed, left_join_by_weight
from ._memory import tidy
from ._scratch import Scratch
from ._words import U64, mix, shingle_keys, slabs, span_hash, word_spans

BUCKETS, BAND = 256, 6
BANDS = BUCKETS // BAND
MANTISSA = 10
_HEADS = np.arange(BUCKETS, dtype=U64) << U64(56)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text its sorted set of shingle keys; the top 8 bits of a key are its bucket."""
    rows = len(offs) - 1
    start, end, row = word_spans(data, offs)
    keys, where = shingle_keys(span_hash(data, start, end), row, rows, width)
    keys = (keys << U64(56)) | (keys >> U64(8))
    cut = np.searchsorted(where, np.arange(rows + 1))
    return [np.unique(keys[cut[i] : cut[i + 1]]) for i in range(rows)]


def registers(keys: np.ndarray) -> np.ndarray:
    """The 256 registers of a sorted key set, 0 for an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(keys):
        return out
    at = np.searchsorted(keys, _HEADS)
    at[at == len(keys)] = len(keys) - 1
    least = keys[at]
    full = np.flatnonzero((least >> U64(56)) == np.arange(BUCKETS, dtype=U64))
    rest = ((least[full] & U64(2**56 - 1)) >> U64(7)).astype(np.float64)  # 49 bits: exact as a double
    m, e = np.frexp(rest)
    tail = np.where(rest > 0, (m - 0.5) * 2 ** (MANTISSA + 1), 0).astype(np.uint16)
    out[full] = ((49 - e).astype(np.uint16) << MANTISSA | tail) + 1
    return out


#: For every bucket all buckets in an order of its own: where an empty one borrows its register.
_LOANS = np.argsort(np.random.default_rng(2017).random((BUCKETS, BUCKETS)), axis=1).astype(np.uint8)


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers whose empty buckets hold the first filled one's in their order, so each agrees with a chance near the similarity."""
    filled = regs != 0
    empty = np.flatnonzero(~filled)
    if not len(empty) or len(empty) == BUCKETS:
        return regs
    out = regs.copy()
    for columns in (16, BUCKETS):
        loans = _LOANS[empty, :columns]
        usable = filled[loans]
        first = usable.argmax(1)
        got = usable[np.arange(len(empty)), first]
        out[empty[got]] = regs[loans[got, first[got]]]
        empty = empty[~got]
        if not len(empty):
            break
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """[texts, BANDS] 64-bit keys from [texts, BUCKETS] registers."""
    dense = np.stack([densified(r) for r in regs])[:, : BANDS * BAND].reshape(len(regs), BANDS, BAND).astype(U64)
    h = np.broadcast_to(np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15), dense.shape[:2])
    for at in range(0, BAND, 3):
        h = mix(h + (dense[:, :, at] << U64(32) | dense[:, :, at + 1] << U64(16) | dense[:, :, at + 2]) * U64(0xD1342543DE82EF95))
    return h


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = band_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS))
            reps = np.repeat(part.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], names=["key", "rep"])


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of pairs, and the registers they rest on.

    Accidental agreement of compressed registers is taken off by the expected count
    0.1699 * buckets * 2**-bits * 4r / (1 + r)**2, with r the ratio of the set sizes.
    """
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    ratio = na / np.maximum(nb, 1)
    expected = 0.169919487 * used * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((same - expected) / np.maximum(used, 1), 0, 1), used


def _sketch(width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slabs(batches, "t"):
            n, hi, lo, regs, low = [], [], [], [], []
            for keys in shingle_sets(data, offs, width):
                d = xxhash.xxh3_128_intdigest(keys.tobytes())
                n.append(len(keys))
                hi.append((d >> 64) - 2**63)
                lo.append((d & (2**64 - 1)) - 2**63)
                r = registers(keys)
                regs.append(r.tobytes())
                low.append(np.packbits((densified(r)[: 2 * 64] & 1).astype(np.uint8)).view(np.int64))
            low_0, low_1 = np.array(low).T
            made = {"n_shingles": pa.array(n, pa.int64()), "set_hi": pa.array(hi, pa.int64()), "set_lo": pa.array(lo, pa.int64()), "regs": pa.array(regs, pa.binary()), "low_0": pa.array(low_0), "low_1": pa.array(low_1)}
            columns = [made[k] if k in made else rows.column(rows.schema.get_field_index(k)) for k in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _near(percent: int):
    """Keep pairs whose estimate is within six standard deviations of the threshold."""
    p = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (2, 3))
            na, nb = (batch.column(k).to_numpy() for k in (4, 5))
            j, used = estimate(a, b, na, nb)
            ok = (j >= p - 6 * np.sqrt(p * (1 - p) / np.maximum(used, 1))) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            left, right = [], []
            # Rows come sorted by a, whose set is made once for its run of pairs.
            for rows, data, offs in slabs(iter([batch]), "text_b"):
                ids_a, ids_b = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                for k, (i, j, other) in enumerate(zip(ids_a, ids_b, shingle_sets(data, offs, width))):
                    if i not in kept:
                        one = rows.column(2).slice(k, 1)
                        (_, d, o) = next(slabs(iter([pa.RecordBatch.from_arrays([one], names=["t"])]), "t"))
                        kept = {i: shingle_sets(d, o, width)[0]}
                    own = kept[i]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both) and both:
                        left.append(i)
                        right.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


SKETCH = "row long, doc_id long, t string, n_shingles long, set_hi long, set_lo long, regs binary, low_0 long, low_1 long"


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; component_id is the smallest id reachable over links."""
    return _near_rows(docs, id_col, text_col, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _near_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, row_col: str | None = None) -> DataFrame:
    """near_groups with each row's number, that of ``row_col`` where it is given, and ``stays``: the one row of its component that does."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    number = F.col(row_col).alias("row") if row_col else F.lit(None).cast("long").alias("row")
    rows = docs.select(number, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    shape = SKETCH.replace("t string, ", "") if row_col else SKETCH
    source, rows = rows, rows.mapInArrow(tidy(_sketch(width, [x.split()[0] for x in shape.split(", ")])), shape)
    sketch = scratch.write(rows if row_col else rows.withColumn("row", F.monotonically_increasing_id()), "sketch")
    total = sketch.count()
    full = sketch.where("n_shingles > 0")
    # The smallest id, then the first row; a null id comes last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = full.groupBy("set_hi", "set_lo").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("members"), first)
    classes = scratch.write(classes, "classes")
    chosen = classes.select(F.col("rep").alias("row"))
    reps = full.join(chosen, "row", "left_semi").select(F.col("row").alias("rep"), F.col("n_shingles").alias("n"), "regs", "low_0", "low_1")
    reps = scratch.write(reps, "reps")

    bands = reps.select("rep", "regs").mapInArrow(_bands, "key long, rep long")
    bands = scratch.write(bands, "all-bands")
    shared = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    bands = scratch.write(bands.join(shared, "key").select("key", "rep", "pivot"), "bands")
    scratch.drop("all-bands")

    votes = bands.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("votes"))
    nearest = votes.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("pivot")).alias("m"))).alias("x")).select(F.col("rep").alias("b"), (-F.col("x.m")).alias("a"))
    texts = scratch.write((source if row_col else sketch).select("row", "t").join(bands.select(F.col("rep").alias("row")).distinct(), "row", "left_semi"), "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        side = reps.select("rep", "n", "regs")
        pairs = pairs.join(side.toDF("a", "n_a", "regs_a"), "a").join(side.toDF("b", "n_b", "regs_b"), "b")
        pairs = pairs.select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(_near(percent), "a long, b long")
        pairs = scratch.write(pairs, f"{name}-near")
        joined = pairs.join(texts.select(F.col("row").alias("b"), F.col("t").alias("text_b")), "b")
        joined = joined.join(texts.select(F.col("row").alias("a"), F.col("t").alias("text_a")), "a")
        joined = joined.select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
        links = scratch.write(joined.mapInArrow(tidy(_verify(width, percent)), "a long, b long"), f"{name}-links")
        scratch.drop(f"{name}-near")
        return links

    links = verified(nearest, "first")
    found = scratch.write(components(links, scratch, "cc-first"), "found")
    bits = reps.select("rep", "n", "low_0", "low_1").join(found, reps["rep"] == found["node"], "left").select("rep", F.coalesce("component", "rep").alias("c"), "n", "low_0", "low_1")
    placed = scratch.write(bands.select("key", "rep").join(bits, "rep").select("key", "rep", "c", "n", "low_0", "low_1"), "placed")
    open_keys = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    placed = placed.join(open_keys, "key")
    x, y = placed.toDF("key", "a", "ca", "na", "a0", "a1"), placed.toDF("key", "b", "cb", "nb", "b0", "b1")
    sizes = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    alike = f"bit_count(a0 ^ b0) + bit_count(a1 ^ b1) <= if(least(na, nb) < {BUCKETS}, 128, {_most_bits(percent)})"
    across = x.join(y, "key").where(f"a < b and ca <> cb and {sizes} and {alike}").select("a", "b").distinct()
    tried = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = verified(across.join(tried, ["a", "b"], "left_anti"), "second")
    final = components(links.union(more), scratch, "cc-second")

    named = classes.join(final, classes["rep"] == final["node"], "left").select("set_hi", "set_lo", "members", "first", F.coalesce("component", "rep").alias("c"))
    named = scratch.write(named, "named")
    scratch.drop("texts", "bands", "placed", "reps", "found", "classes", "first-links", "second-links")
    whole = named.groupBy("c").agg(F.min("first").alias("lowest"), F.count(F.lit(1)).alias("classes"))
    named = left_join_by_weight(named, whole, ["c"], "classes", total)
    named = named.select("set_hi", "set_lo", "members", F.col("lowest.doc_id").alias("component"), F.col("lowest.row").alias("stays"))
    out = left_join_by_weight(full.select("row", "doc_id", "n_shingles", "set_hi", "set_lo"), named, ["set_hi", "set_lo"], "members", total)
    out = out.select("row", "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), "stays")
    bare = sketch.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("stays"))
    return out.union(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one row of each component stays."""
    rows, row = keyed(docs, "near-rows")
    return keep_rows(rows, _near_rows(rows, id_col, text_col, width, percent, row).where(F.col("row") != F.col("stays")).select("row"), row).drop(row)


def _most_bits(percent: int) -> int:
    """Of 128 lowest register bits, as many as can differ at the threshold, six standard deviations above the mean."""
    q = (1 - percent / 100) / 2
    return math.ceil(128 * q + 6 * math.sqrt(128 * q * (1 - q)))


def miss_chance(similarity: float) -> float:
    """The chance that no band of a pair of large sets agrees."""
    return math.pow(1 - similarity**BAND, BANDS)
