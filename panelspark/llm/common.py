"""What the corpus operators share: batches of bounded size, word hashes, folds and heavy hitters."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in an Arrow batch: a batch of whole texts has to fit into a Python worker.
BATCH_ROWS = 1024
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Make Arrow batches hold at most BATCH_ROWS rows, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Deal small scans out to all cores; larger ones already have a partition for each file split."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if "Join" in plan or "Aggregate" in plan or "Exchange" in plan or "Window" in plan:
        return df  # counting its partitions would run its shuffles
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def flagged(docs: DataFrame, text_col: str, flags) -> DataFrame:
    """All columns of `docs`, as struct `row`, with the int `flag` that `flags(raw, offsets)` gives each text. No shuffle."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.asarray(flags(raw, offsets), np.int32))], ["row", "flag"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("flag", T.IntegerType())])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return spread(rows).mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by `folds`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def hand_back() -> None:
    """Return freed memory to the system: Spark keeps workers for later tasks, and an allocator keeps what it once had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def steps(batches: Iterator[pa.RecordBatch], column: str,
          max_bytes: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of their texts (null: empty) and n + 1 offsets."""
    for batch in batches:
        whole = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
        ends = np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
            # a copy of the slice's own bytes, so that the batch may be freed
            part = pa.concat_arrays([whole.slice(lo, hi - lo)])
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
            data = part.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            yield batch.slice(lo, hi - lo), raw[offsets[0]:offsets[-1]], offsets - offsets[0]
            del part, data, raw
            lo = hi
    hand_back()


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BASE = 0x5851F42D4C957F2D
_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls up to a quarter of a step's length."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= STEP_BYTES // 4:
            _POWERS[base] = have
    return have[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for every span, from one prefix sum."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * powers(_INVERSE, len(values) + 1)[start]
    return mixed(h + (end - start).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the words in each text, and n + 1 offsets into them.

    `separator` has one boolean per byte value. Words don't cross texts.
    """
    inside = np.zeros(len(raw) + 2, np.bool_)
    inside[1:-1] = ~separator[raw]
    turn = inside[1:] != inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    both = np.unique(cut[inside[cut] & inside[cut + 1]])  # a word ends and another starts where two texts meet
    at = np.flatnonzero(turn)
    start, end = at[0::2], at[1::2]
    if len(both):
        start, end = np.sort(np.concatenate([start, both])), np.sort(np.concatenate([end, both]))
    return start, end, np.searchsorted(start, offsets, "left")


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[raw]


def heavy_hitters(df: DataFrame, column: str, k: int = 256, tracked: int = 1024, fan_in: int = 64) -> DataFrame:
    """At most `k` candidates for the most frequent values of a string column, as one column.

    Misra-Gries counters (`tracked` of them) are kept per task and merged in two levels, so no
    task merges those of all tasks. Counts are estimates: verify them.
    """
    some = (df.groupBy((F.spark_partition_id() % fan_in).alias("part"))
            .agg(F.expr(f"approx_top_k_accumulate(`{column}`, {tracked})").alias("sketch")))
    # grouped by a constant: the sketch functions can't merge the empty state of a partition without rows
    return (some.groupBy(F.lit(0).alias("one"))
            .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {k})").alias("top"))
            .select(F.explode("top.item").alias(column)))


def id_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64), 41) >> np.uint64(64 - bits)).astype(np.int64)


def id_filter(df: DataFrame, column: str, bits: int = 27) -> np.ndarray:
    """A bitmap of the hashes of a column of whole numbers, made in parts of 2**16 bits: of one size, whatever the input.

    It tells which rows a later join can use at all, before they are shuffled; others pass by chance, the more the fuller it is.
    """
    def bit_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(id_bits(batch.column(0).to_numpy(), bits))
            part, low = bit >> 16, (bit & 0xFFFF).astype(np.uint16)
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(bit)] if len(bit) else [0]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(
                [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["part", "low"])

    def united(_key, group):
        seen = np.zeros(1 << 16, np.bool_)
        seen[np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in group["low"]), np.uint16)] = True
        return pa.table({"part": group["part"].slice(0, 1), "map": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    found = (df.filter(F.col(column).isNotNull()).select(F.col(column).cast("long")).mapInArrow(bit_parts, "part int, low binary")
             .groupBy("part").applyInArrow(united, "part int, map binary").toArrow())
    out = np.zeros((1 << bits) // 8, np.uint8)
    for part, m in zip(found["part"].to_pylist(), found["map"]):
        out[part << 13:(part + 1) << 13] = np.frombuffer(m.as_buffer(), np.uint8)
    return out


def passes(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter lets pass."""
    bit = id_bits(ids, int(len(bitmap) * 8).bit_length() - 1)
    return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
