"""Similarity self-join of word n-gram sets with parity sketches.

A set's sketch is a bit vector in which every shingle flips the bit at its hash, so two sketches differ in no more bits
than the sets in elements. Sets of Jaccard 3/4 or more differ in at most (n + m) / 7 elements. In a band of
sizes, sketches are cut into P equal ranges of bits; sets that differ in D elements agree on all but D ranges, so
a set that offers more than D non-empty ranges as join keys meets each of its partners (pigeonhole). Ranges are
compared by the XOR of the hashes of their bits.

Sets in many copies are one class. A key that many classes share is hot and pairs nothing by itself: classes with over D keys
that aren't hot meet all of their partners by those. The others take their rarest hot keys, too: first each is compared with
the least class of each such key, and what is then still in different components is compared by sketches, in blocks
of classes that hot keys connect. Candidates pass a folded sketch (Hamming distance) before their sets are compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, id_filter, lowered, mixed, passes, span_hashes, spread, steps, words
from panelspark.session import cut_lineage

SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Words of a shingle.
SIZE = 5
#: Classes that may share a key before it is hot: up to here all their pairs are candidates.
FEW = 8
#: Classes in a block.
BLOCK = 256
#: Hash functions that a set with too many empty ranges may try.
SEEDS = 6


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, and n + 1 offsets; fewer words are one shingle."""
    start, end, at = words(raw, offsets, SPACE)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h = span_hashes(lowered(raw), start, end)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    first = np.repeat(at[:-1], count) + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    long = n[text]
    value = np.minimum(long, size).astype(np.uint64)
    for k in range(size):
        on = k < long
        value[on] = mixed(value[on] + h[first[on] + k], k + 1)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), np.bool_)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def bands(largest: int) -> np.ndarray:
    """Upper ends of the size bands, each some 4/3 of the one before."""
    out = [2, 3, 4]
    while out[-1] < largest:
        out.append(out[-1] * 4 // 3)
    return np.array(out)


def apart(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most elements in which sets of these sizes may differ."""
    return (n + m) // 7


def fold(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity sketches of about two bits a shingle: powers of two from 64 bits, cut from the hashes' low bits."""
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        bits = max(64, 1 << int(2 * (hi - lo) - 1).bit_length()) if hi > lo else 64
        odd = np.bincount((value[lo:hi] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two folded sketches, the larger one folded to the smaller."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def class_sums(value: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each set."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mixed(value, seed), out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def range_keys(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the ranges of all sets: key, set, band (with the hash function), and how many keys the set may lose there.

    A pair belongs to the band of its smaller set; if that has `top` elements, the pair differs in at most D(top) ranges. A band
    has 5/4 of D(top) ranges, so that some may be hot or empty. A set with too few non-empty ranges also
    offers those of another hash function, for partners that lack as many.
    """
    n = np.diff(at)
    tops = bands(int(n.max(initial=2)))
    own = np.searchsorted(tops, n)  # the band whose top is the first not below n
    out: list[list[np.ndarray]] = [[], [], [], []]
    for lower in (0, 1):
        band = own - lower
        sets = np.flatnonzero((n >= 3) & ((3 * n <= 4 * tops[band]) if lower else True))
        most = apart(n, n * 4 // 3)[sets] if not lower else apart(n, np.minimum(n, tops[band]))[sets]
        ranges = (apart(tops, tops * 4 // 3) + 1) * 5 // 4 + 2
        for seed in range(SEEDS):
            if not len(sets):
                break
            size, label = n[sets], band[sets] * SEEDS + seed
            index = np.repeat(at[:-1][sets], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            which, h = np.repeat(np.arange(len(sets)), size), value[index]
            if seed:
                h = mixed(h, 100 + seed)
                order = np.lexsort((h, which))
                h, which = h[order], which[order]
            part = (h >> np.uint64(32)) * ranges[band[sets]][which].astype(np.uint64) >> np.uint64(32)
            begin = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (part[1:] != part[:-1])]))
            x = np.bitwise_xor.reduceat(mixed(h, 7), begin)
            full = x != 0  # a range that is empty but for cancelled bits is no key
            which, part, x = which[begin][full], part[begin][full], x[full]
            key = mixed(x + mixed(label[which].astype(np.uint64) << np.uint64(32) | part, 9))
            spare = np.bincount(which, minlength=len(sets)) - most - 1
            lacking = spare < 0
            if seed == SEEDS - 1 and lacking.any():  # in the end those without enough ranges meet in one key
                rest = np.flatnonzero(lacking)
                key, which = np.concatenate([key, mixed(label[rest].astype(np.uint64), 11)]), np.concatenate([which, rest])
            for col, x in zip(out, (key, sets[which], label[which], np.maximum(spare, 0)[which])):
                col.append(x)
            sets, most = sets[lacking], most[lacking]
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(c) if c else z for c, z in zip(out, none))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its set's size, its class (two sums of hashes) and its folded sketch."""
    for batch, raw, offsets in steps(batches, "text"):
        value, at = shingles(raw, offsets)
        sums = [class_sums(value, at, s) for s in (21, 22)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(at)), *(pa.array(s.view(np.int64)) for s in sums), pa.array(fold(value, at), pa.binary())],
            ["doc_id", "n", "c", "c2", "sketch"])


def _dealt(n_buckets: int):
    """Keys of the step's classes by bucket, packed. Of a key that is hot within the step one class is packed; the others get rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, offsets in steps(batches, "text"):
            value, at = shingles(raw, offsets)
            c = class_sums(value, at, 21)
            _, one = np.unique(c, return_index=True)  # copies in the step are one class
            one = np.sort(one)
            size = np.diff(at)[one]
            value = value[np.repeat(at[:-1][one], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            c = c[one]
            key, which, band, spare = range_keys(value, np.concatenate([[0], np.cumsum(size)]))
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, which, band, spare = key[order], which[order], band[order], spare[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            place = np.arange(len(key)) - np.repeat(begin, size)
            hot = np.repeat(size > FEW, size)
            bucket = (key >> np.uint64(32)) % np.uint64(n_buckets)
            key = bucket << np.uint64(32) | key & np.uint64(0xFFFFFFFF)
            stay = np.flatnonzero(hot & (place > 0))
            if len(stay):
                signed = lambda x: pa.array(x.astype(np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[stay].astype(np.int32)), pa.nulls(len(stay), pa.int64()), signed(c[which[stay]]), signed(key[stay]),
                     pa.array(band[stay].astype(np.int32)), pa.array(spare[stay].astype(np.int32)), pa.nulls(len(stay), pa.binary())], ROW)
            go = np.flatnonzero(~hot | (place == 0))
            go = go[np.argsort(bucket[go] << np.uint64(32) | which[go].astype(np.uint64) << np.uint64(12) | band[go].astype(np.uint64), kind="stable")]
            key, which, band, spare, hot, bucket = key[go], which[go], band[go], spare[go], hot[go], bucket[go]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
            first = np.concatenate([[True], (which[1:] != which[:-1]) | (band[1:] != band[:-1])])
            blobs = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                first[lo] = True
                f = np.flatnonzero(first[lo:hi]) + lo
                blobs.append(pack(key[lo:hi], hot[lo:hi], c[which[f]], band[f].astype(np.uint16), spare[f].astype(np.uint16),
                                  np.diff(np.append(f, hi)).astype(np.uint32)))
            none = pa.nulls(len(blobs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), none, none, none, pa.nulls(len(blobs), pa.int32()),
                                              pa.nulls(len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ROW)
    return run


ROW = ["bucket", "a", "b", "key", "band", "spare", "blob"]


def pack(key, hot, c, band, spare, count) -> bytes:
    """Columns of a bucket's rows: of each key 32 bits and whether it is hot, of each class and band what it has."""
    head = np.array([len(key), len(c)], np.uint32).tobytes()
    return b"".join([head, key.astype(np.uint32).tobytes(), np.packbits(hot).tobytes(), c.astype(np.uint64).tobytes(), band.tobytes(),
                     spare.tobytes(), count.tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, k = np.frombuffer(blob, np.uint32, 2).tolist()
    at, out = 8, []
    for kind, size in ((np.uint32, n), (np.uint8, -(-n // 8)), (np.uint64, k), (np.uint16, k), (np.uint16, k), (np.uint32, k)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * np.dtype(kind).itemsize
    key, hot, c, band, spare, count = out
    spread_ = lambda x: np.repeat(x, count)
    return key, np.unpackbits(hot, count=n).astype(np.bool_), spread_(c), spread_(band), spread_(spare)


def _matched(_key, group):
    """Pairs (a, b) of classes that share a key of the bucket, and the hot keys with each of their classes (b)."""
    here = group.filter(pc.is_null(group["blob"])).select(ROW[1:-1])
    here = here.append_column("hot", pa.array(np.ones(here.num_rows, np.bool_)))
    parts = [unpack(b.as_buffer()) for b in group["blob"] if b.is_valid]
    if not parts:
        return here.select(MET)
    bucket = group["bucket"][0].as_py()
    key, hot, c, band, spare = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    near = key[order]
    same = np.concatenate([[False], near[1:] == near[:-1], [False]])
    mine = order[same[1:] | same[:-1] | hot[order]]  # only keys that meet
    mine = mine[np.lexsort((c[mine], band[mine], key[mine]))]
    key, hot, c, band, spare = key[mine], hot[mine], c[mine], band[mine], spare[mine]
    other = np.ones(len(key), np.bool_)
    other[1:] = (key[1:] != key[:-1]) | (band[1:] != band[:-1])
    any_hot = np.bincount(np.cumsum(other) - 1, hot) > 0
    new = other.copy()
    new[1:] |= c[1:] != c[:-1]
    key, c, band, spare, begin = key[new], c[new], band[new], spare[new], np.flatnonzero(other[new])
    size = np.diff(np.append(begin, len(key)))
    any_hot |= size > FEW
    left = np.repeat(np.where(any_hot, 0, size), size) - (np.arange(len(key)) - np.repeat(begin, size))  # classes from here to the group's end
    pairs = []
    for k in range(1, FEW):
        at = np.flatnonzero(left > k)
        pairs.append(np.stack([c[at], c[at + k]]))
    pairs = np.unique(np.concatenate(pairs, 1), axis=1)
    mine = np.flatnonzero(np.repeat(any_hot, size))
    full = np.uint64(bucket) << np.uint64(32) | key[mine].astype(np.uint64)
    none = np.zeros(len(pairs[0]), np.int64)
    signed = lambda x, y: np.concatenate([x, y]).astype(np.uint64).view(np.int64)
    met = pa.table({"a": signed(pairs[0], np.zeros(len(mine), np.uint64)), "b": signed(pairs[1], c[mine]), "hot": np.concatenate([none > 0, np.ones(len(mine), np.bool_)]),
                    "key": signed(none, full), "band": np.concatenate([none, band[mine]]).astype(np.int32),
                    "spare": np.concatenate([none, spare[mine]]).astype(np.int32)})
    return pa.concat_tables([met.select(MET), here.select(MET)])


MET = ["a", "b", "hot", "key", "band", "spare"]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        most = (batch.column("n1").to_numpy() + batch.column("n2").to_numpy()) // 7
        keep = [distance(a.as_buffer(), b.as_buffer()) <= d for a, b, d in zip(batch.column("s1"), batch.column("s2"), most.tolist())]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["r1", "r2", "n1", "n2"])


def _sets(shared):
    """Shingle sets of the texts whose ids the filter lets pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        wanted = (b.filter(pa.array(passes(bitmap, b.column("rep").to_numpy()))) for b in batches)
        for batch, raw, offsets in steps(wanted, "text"):
            value, at = shingles(raw, offsets)
            data, cut = value.tobytes(), (8 * at).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([data[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["rep", "shingles"])
    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("x1"), batch.column("x2")):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both) > 0)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["r1", "r2"])


def candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """r1, r2, n1, n2: the representatives of those pairs (a, b) of classes whose sizes and sketches don't rule them out."""
    one = classes.select(F.col("c").alias("a"), F.col("rep").alias("r1"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    two = classes.select(F.col("c").alias("b"), F.col("rep").alias("r2"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
    return (pairs.join(one, "a").join(two, "b").filter("r1 <> r2 AND 4 * least(n1, n2) >= 3 * greatest(n1, n2)")
            .select("r1", "r2", "n1", "n2", "s1", "s2").mapInArrow(_near, "r1 long, r2 long, n1 long, n2 long"))


def needed_hot_keys(hot: DataFrame) -> DataFrame:
    """c, key, band: the rarest hot keys of classes that lost more keys to them than they may, as many as they miss."""
    hot = cut_lineage(hot.distinct(), "hot")
    lost = hot.groupBy("c", "band").agg((F.count(F.lit(1)) - F.max("spare")).alias("need")).filter("need > 0")
    times = hot.groupBy("key", "band").agg(F.count(F.lit(1)).alias("times"))
    rank = Window.partitionBy("c", "band").orderBy("times", "key")
    return (hot.join(lost, ["c", "band"]).join(times, ["key", "band"]).withColumn("place", F.row_number().over(rank))
            .filter("place <= need").select("c", "key", "band"))


def in_blocks(classes: DataFrame) -> DataFrame:
    """r1, r2, n1, n2: pairs of one family, not of one component, that sizes and sketches don't rule out.

    Each family is sorted by size and cut into blocks; blocks whose sizes are near enough are compared, each pair of blocks in a
    task of its own.
    """
    order = Window.partitionBy("family").orderBy("n", "c")
    rows = cut_lineage(classes.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK)), "blocks")
    ends = rows.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    i, j = ends.alias("i"), ends.alias("j")
    both = (i.join(j, (F.col("i.family") == F.col("j.family")) & (F.col("i.block") <= F.col("j.block")) & (3 * F.col("j.low") <= 4 * F.col("i.high")))
            .select(F.col("i.family").alias("family"), F.col("i.block").alias("b1"), F.col("j.block").alias("b2")))
    sides = (both.withColumn("block", F.col("b1")).unionByName(both.filter("b1 < b2").withColumn("block", F.col("b2"))))
    return (rows.join(sides, ["family", "block"]).select("family", "b1", "b2", "block", "c", "n", "rep", "comp", "sketch")
            .groupBy("family", "b1", "b2").applyInArrow(_compared, "r1 long, r2 long, n1 long, n2 long"))


def _compared(_key, group):
    block, n, rep, comp = (group[x].to_numpy() for x in ("block", "n", "rep", "comp"))
    sketch = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["sketch"]]
    words_of = np.array([len(x) for x in sketch])
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for size in np.unique(words_of[right]).tolist():
        theirs = right[words_of[right] == size]
        table = np.stack([sketch[k] for k in theirs])
        for k in left.tolist():
            mine, there = sketch[k], table
            if len(mine) > size:
                mine = np.bitwise_xor.reduce(mine.reshape(-1, size), axis=0)
            elif len(mine) < size:
                there = np.bitwise_xor.reduce(table.reshape(len(table), -1, len(mine)), axis=1)
            near = np.bitwise_count(there ^ mine).sum(1, dtype=np.int64) <= apart(n[theirs], n[k])
            near &= (comp[theirs] != comp[k]) & (4 * np.minimum(n[theirs], n[k]) >= 3 * np.maximum(n[theirs], n[k]))
            if near.any():
                found = theirs[near]
                out.append((np.full(len(found), k), found))
    a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = (rep[a] < rep[b]) | (block.min() != block.max())  # in a block of its own each pair turns up twice
    a, b = a[first], b[first]
    return pa.table({"r1": rep[a], "r2": rep[b], "n1": n[a], "n2": n[b]})


def verified(near: DataFrame, rows: DataFrame) -> DataFrame:
    """r1, r2: those of the candidates whose sets are similar, as a written table."""
    near = cut_lineage(near, "near")
    bitmap = id_filter(near.select(F.explode(F.array("r1", "r2")).alias("rep")), "rep")
    shared = rows.sparkSession.sparkContext.broadcast(zlib.compress(bitmap, 1))  # of bounded size
    texts = rows.select(F.col("doc_id").alias("rep"), "text").filter("rep IS NOT NULL AND text IS NOT NULL")
    sets = cut_lineage(texts.mapInArrow(_sets(shared), "rep long, shingles binary"), "sets")
    return cut_lineage(
        near.join(sets.select(F.col("rep").alias("r1"), F.col("shingles").alias("x1")), "r1")
        .join(sets.select(F.col("rep").alias("r2"), F.col("shingles").alias("x2")), "r2")
        .select("r1", "r2", "x1", "x2").mapInArrow(_linked, "r1 long, r2 long"), "links")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """v, comp: the least vertex that each linked vertex reaches.

    Each round every vertex joins the neighbour, or stays, that comes first in the round's order: two rounds by number, which
    settle stars, then one at random, which shortens chains by a constant factor. Labels follow the merges.
    """
    ends = lambda r, v, w: r.select(F.col(v).alias("v"), F.col(w).alias("w"))
    edges = cut_lineage(ends(links, "r1", "r2").union(ends(links, "r2", "r1")).distinct(), "edges")
    state = None
    for i in range(rounds):
        lot = lambda c: F.xxhash64(F.col(c), F.lit(i)) if i % 3 == 2 else F.col(c)
        best = edges.groupBy("v").agg(F.min(F.struct(lot("w").alias("lot"), F.col("w").alias("w"))).alias("best"))
        merge = cut_lineage(best.select("v", F.when(F.col("best.lot") < lot("v"), F.col("best.w")).otherwise(F.col("v")).alias("m")), "merges")
        into = merge.select(F.col("v").alias("c"), F.col("m").alias("next"))
        state = cut_lineage(merge.select("v", F.col("m").alias("c")) if state is None else
                            state.join(into, "c", "left").select("v", F.coalesce("next", "c").alias("c")), "labels")
        edges = (edges.join(merge.withColumnRenamed("m", "a"), "v")
                 .join(merge.select(F.col("v").alias("w"), F.col("m").alias("b")), "w").filter("a <> b"))
        edges = cut_lineage(ends(edges, "a", "b").distinct(), "edges")
        if not edges.limit(1).count():
            least = state.groupBy("c").agg(F.min("v").alias("comp"))
            return cut_lineage(state.join(least, "c").select("v", "comp"), "components")
    raise RuntimeError(f"components of the links didn't settle in {rounds} rounds")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of `docs`; other columns are not read.

    Words are runs of anything but ASCII white space, after lower-casing A-Z; shingles are five words, or all words if fewer. Texts that
    are null, empty or blank have no shingles and link with nothing. component_id is the least doc_id reachable by links of
    Jaccard 3/4 or more, the row's own id if there are none. Ids are integers and name documents; repeated rows are copies. A row with a null id is in
    no component (null). Hashes of 64 bits stand for shingles.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    seen = cut_lineage(spread(rows).mapInArrow(_described, "doc_id long, n long, c long, c2 long, sketch binary"), "described")
    known = seen.filter("doc_id IS NOT NULL AND n > 0")
    classes = cut_lineage(known.groupBy("c", "c2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    texts = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread(texts.select("text")).mapInArrow(_dealt(buckets), "bucket int, a long, b long, key long, band int, spare int, blob binary")
    met = cut_lineage(dealt.groupBy("bucket").applyInArrow(_matched, "a long, b long, hot boolean, key long, band int, spare int"), "met")
    pairs = met.filter("NOT hot").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hot = needed_hot_keys(met.filter("hot").select(F.col("b").alias("c"), "key", "band", "spare"))
    hot = cut_lineage(hot, "hot_keys")
    star = (hot.join(hot.groupBy("key", "band").agg(F.min("c").alias("a")), ["key", "band"]).filter("a <> c")
            .select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")))
    links = verified(candidates(pairs.unionByName(star).distinct(), classes), rows)
    comp = components(links)

    label = classes.join(comp, F.col("rep") == F.col("v"), "left").select("c", "n", "rep", "sketch", F.coalesce("comp", "rep").alias("comp"))
    member = hot.select("key", "band", "c").join(label.select("c", "comp"), "c")
    split = member.groupBy("key", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("c").alias("r1")).filter("lo < hi")
    member = cut_lineage(member.join(split.select("key", "band", "r1"), ["key", "band"]).select("c", "r1").distinct(), "unsettled")
    if member.limit(1).count():
        family = components(member.select("r1", F.col("c").alias("r2")))
        more = in_blocks(family.select(F.col("v").alias("c"), F.col("comp").alias("family")).join(label, "c"))
        comp = components(links.unionByName(verified(more, rows)))
    final = classes.join(comp, F.col("rep") == F.col("v"), "left").select("c", "c2", "n", F.coalesce("comp", "rep").alias("component_id"))
    return (seen.select("doc_id", "n", "c", "c2").join(final, ["c", "c2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the least of its component, with their columns; rows with a null id stay."""
    gone = cut_lineage(link(docs, id_col, text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "copies")
    # a merge join at any size: its shuffle grows with the input
    return docs.join(gone.hint("merge"), F.col(f"`{id_col}`").cast("long") == F.col("__gone"), "left_anti")
