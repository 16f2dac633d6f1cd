"""How filters interact: what each of them removes, in every order, and which share of it is its own.

Four filters look at one text alone. The fifth asks whether a smaller document holds the same text. A counting Bloom
sketch answers that for most documents without a shuffle: each task counts its texts (to two), the tasks' sketches are
added, and a text with a counter of one is certainly unique. Only possible repeats are shuffled, as SHA-256 digests of
their whole texts, to find each text's least document. Flags become bit masks, and masks are additive: counts by mask
answer every order of the filters, so the orders never meet a document.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import spread
from panelspark.operators.skew import attach
from panelspark.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: Counters of the sketch: eight for each document, in powers of two between these; a counter takes two bits.
LEAST_BITS, MOST_BITS = 16, 27
HASHES = 3
PART_BITS = 16
#: Distinct positions that a task holds before it hands them on.
HELD = 1 << 20


def text_flags(text: Column) -> dict[str, Column]:
    """The filters that look at one text (not null); true where the text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {"A": F.size(words) < 200,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def _positions(digests: pa.Array, bits: int) -> np.ndarray:
    """One row of HASHES counters for each digest of 32 bytes."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)[:, :HASHES]
    return (raw >> np.uint64(64 - bits)).astype(np.int64)


def _twice_at_most(found: np.ndarray) -> np.ndarray:
    """Sorted values, of equal ones two."""
    found = np.sort(found)
    return found[np.append([True, True], found[2:] != found[:-2])] if len(found) > 2 else found


def sketch(digests: DataFrame, bits: int) -> np.ndarray:
    """2**bits counters of 0, 1 and 2 (or more), four to a byte, of the column `sha`; merged in parts of 2**16 counters.

    A task sends each counter at most twice for every HELD positions, so a text that a third of all rows share doesn't fill a part.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.int64)], 0

        def parts():
            found = _twice_at_most(np.concatenate(held))
            part, low = found >> PART_BITS, (found & ((1 << PART_BITS) - 1)).astype("<u2")
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
            return pa.RecordBatch.from_arrays(
                [pa.array(part[cut[:-1]].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                ["part", "low"])

        for batch in batches:
            held.append(_twice_at_most(_positions(batch.column(0), bits).ravel()))
            size += len(held[-1])
            if size > HELD:
                held[:] = [_twice_at_most(np.concatenate(held))]
                size = len(held[0])
                if size > HELD:
                    yield parts()
                    held[:], size = [np.zeros(0, np.int64)], 0
        yield parts()

    def merged(_key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(1 << PART_BITS, np.uint8), None
        for g in groups:
            part = g.column("part").slice(0, 1)
            for low in g.column("low"):
                at, n = np.unique(np.frombuffer(low.as_buffer(), "<u2"), return_counts=True)
                total[at] = np.minimum(total[at] + n, 2)
        four = total.reshape(-1, 4)
        packed = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
        yield pa.RecordBatch.from_arrays([part, pa.array([packed.tobytes()], pa.binary())], ["part", "counters"])

    found = (digests.select("sha").mapInArrow(counted, "part int, low binary")
             .groupBy("part").applyInArrow(merged, "part int, counters binary").toArrow())
    out = np.zeros((1 << bits) // 4, np.uint8)
    step = (1 << PART_BITS) // 4
    for part, counters in zip(found["part"].to_pylist(), found["counters"]):
        out[part * step:(part + 1) * step] = np.frombuffer(counters.as_buffer(), np.uint8)
    return out


def may_repeat(counters: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """False where a counter is one: no other row has this digest."""
    return ((counters[positions >> 2] >> ((positions & 3) * 2).astype(np.uint8)) & 3 > 1).all(1)


def flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, part, mask: one row for each row of `docs`; bit i of the mask is set where the text fails filter "ABCDE"[i].

    A null text counts as empty, a null language as the empty string. Equal texts are those whose SHA-256 is equal. E fails where a
    smaller doc_id has the same text: rows that repeat the least id all pass, and a null id is neither smaller than others nor larger.
    Other columns are not read. An empty table gives no rows.

    The sketch has eight counters for each row, from 16 KB to 32 MB, and is broadcast. Beyond 16 million rows it stays at 32 MB and
    fills, so more rows shuffle a digest of 32 bytes; results don't change.
    """
    spark = docs.sparkSession
    text = F.col("text")
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("part"),
                      F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    mask = sum((F.when(failed, 1 << FILTERS.index(name)).otherwise(0) for name, failed in text_flags(text).items()), F.lit(0))
    rows = cut_lineage(spread(own).select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("sha")), "audit-rows")
    bits = min(max(math.ceil(math.log2(8 * max(rows.count(), 1))), LEAST_BITS), MOST_BITS)
    shared = spark.sparkContext.broadcast(sketch(rows, bits))

    def cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = batch.column("sha")
            again = may_repeat(shared.value, _positions(sha, bits)) if batch.num_rows else np.zeros(0, np.bool_)
            sha = pa.array([x if a else None for x, a in zip(sha.to_pylist(), again.tolist())], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("sha"), "sha", sha)

    rows = cut_lineage(rows.mapInArrow(cleared, rows.schema), "audit-marked")
    maybe = rows.filter("sha IS NOT NULL")
    least = cut_lineage(maybe.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "audit-least")
    repeats = attach(maybe, least, "sha", spread="doc_id").select(
        "doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))
    return rows.filter("sha IS NULL").select("doc_id", "part", "mask").unionByName(repeats)


def mask_counts(flagged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents by mask, and those among them that are labelled good or toxic.

    A label counts if any row of the id has it; null ids have no labels. At most 32 rows for each part.
    """
    per_id = flagged.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))  # one row for an id that repeats
    said = labels.groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(
        *[F.max(F.when(F.col(f"`{c}`") == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    counted = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return (per_id.join(said, "doc_id", "left").groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), counted("good"), counted("toxic")))


def steps(filters: str = FILTERS) -> Column:
    """All orders of the filters as an array of (filter_order, step, own, before): the step's bit and those of the filters before it."""
    rows = []
    for order in itertools.permutations(filters):
        before = 0
        for i, name in enumerate(order):
            own = 1 << filters.index(name)
            rows.append({"filter_order": "".join(order), "step": i + 1, "own": own, "before": before})
            before |= own
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, own: int, before: int>>")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step, from counts by mask; its work grows with parts only.

    shapley sums, over all orders, what the step's filter removes: a document that fails k filters is removed first by each of
    them in n!/k orders.
    """
    orders = math.factorial(len(filters))
    has = lambda bits: F.col("mask").bitwiseAND(F.col(bits)) != 0
    own, before = has("own"), has("before")
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("long")
    share = F.expr(f"n * ({orders} div greatest(bit_count(mask), 1))")
    return (counts.select("*", F.inline(steps(filters)))
            .groupBy("part", "filter_order", "step")
            .agg(total(~own & ~before).alias("kept"), total(own & ~before).alias("removed"), total(own & before).alias("redundant"),
                 total(F.col("mask") == F.col("own")).alias("unique_fails"), total(own & ~before, "good").alias("good_lost"),
                 total(own & ~before, "toxic").alias("toxic_lost"), F.sum(F.when(own, share).otherwise(F.lit(0))).cast("long").alias("shapley")))
