"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of consecutive words of any item. A document's words stream through
it, which yields the longest match that ends at each word; a match of `window` words or more, or of
a whole shorter item, makes the words under it hit. Documents are never shuffled. Items are read in
shards of bounded size: each shard's automaton is broadcast, and the documents pass one after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import bound_batches, spread, steps
from panelspark.session import cut_lineage

WINDOW = 13
#: Bytes of item text in one automaton, of some 800 bytes a word in a Python worker.
SHARD_BYTES = 512 << 10

#: A-Z in lower case; ASCII other than 0-9 and a-z separates words, all else belongs to them.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_words(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items that own each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.step, self.link, self.length = [{}], [-1], [0]
        runs = []
        for name, data in items:
            run = [self.vocab.setdefault(w, len(self.vocab)) for w in item_words(data)]
            if run:
                runs.append((name, run))
                self._add(run)
        self.shortest = min((min(window, len(run)) for _, run in runs), default=0)
        # the state of the last `window` words of a match that ends in a state
        self.last = [-1] * len(self.step)
        for v in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            if self.length[v] >= window:
                up = self.link[v]
                self.last[v] = v if self.length[up] < window else self.last[up]
        self.owners: dict[int, set] = {}
        self.whole: dict[int, tuple[int, set]] = {}  # state of a short item: its length and names
        for name, run in runs:
            v = 0
            for i, w in enumerate(run):
                v = self.step[v][w]
                if i + 1 >= window:
                    self.owners.setdefault(self.last[v], set()).add(name)
            if len(run) < window:
                self.whole.setdefault(v, (len(run), set()))[1].add(name)
        # the nearest state up the suffix links, itself included, that holds a short item
        self.near = [-1] * len(self.step)
        for v in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            self.near[v] = v if v in self.whole else self.near[self.link[v]]

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = c
            p = self.link[p]
        return c

    def _add(self, run: list[int]) -> None:
        last = 0
        for w in run:
            if w in self.step[last]:
                q = self.step[last][w]
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
                continue
            v, p = len(self.step), last
            self.step.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            while p >= 0 and w not in self.step[p]:
                self.step[p][w] = v
                p = self.link[p]
            if p >= 0:
                q = self.step[p][w]
                self.link[v] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
            last = v

    def scan(self, words: list[bytes], spans: list, names: set) -> None:
        """Add the hit spans [start, end) of a document's words, in order of their ends, and the items' names."""
        n = len(words)
        if not self.shortest or n < self.shortest:
            return
        known = np.zeros(n + 2, np.bool_)
        known[1:-1] = np.fromiter(map(self.vocab.__contains__, words), np.bool_, n)
        edge = np.flatnonzero(known[1:] != known[:-1])
        runs = edge.reshape(-1, 2)
        for lo, hi in runs[runs[:, 1] - runs[:, 0] >= self.shortest].tolist():
            v = size = 0
            for i in range(lo, hi):
                w = self.vocab[words[i]]
                while v and w not in self.step[v]:
                    v = self.link[v]
                    size = self.length[v]
                if w in self.step[v]:
                    v = self.step[v][w]
                    size += 1
                if size >= self.window:
                    spans.append((i + 1 - self.window, i + 1))
                    names |= self.owners[self.last[v]]
                u = self.near[v]
                while u > 0:
                    long, owners = self.whole[u]
                    if long <= size:
                        spans.append((i + 1 - long, i + 1))
                        names |= owners
                    u = self.near[self.link[u]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans covered by `spans`; those that touch become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what lies between them."""
    at = [m.span() for m in re.finditer(rb"\S+", data.translate(WORD_BYTES))]
    keep, done = [], 0
    for lo, hi in spans:
        keep.append(data[done:at[lo][0]])
        done = at[hi - 1][1]
    return b"".join([*keep, data[done:]])


FOUND = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>, cleaned string"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scanner(shared, clean: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch, raw, offsets in steps(batches, "text"):
            data, at = raw.tobytes(), offsets.tolist()
            flat = data.translate(WORD_BYTES)
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            cols: list[list] = [[], [], [], [], []]
            for i, (old, held) in enumerate(before):
                words = flat[at[i]:at[i + 1]].split()
                spans, names = [(s["start"], s["end"]) for s in old or ()], set(held or ())
                automaton.scan(words, spans, names)
                spans = merged(spans)
                cleaned = without(data[at[i]:at[i + 1]], spans).decode() if clean and last and spans else None
                row = (len(words), sum(hi - lo for lo, hi in spans),
                       [{"start": lo, "end": hi} for lo, hi in spans], sorted(x for x in names if x is not None), cleaned)
                for c, x in zip(cols, row):
                    c.append(x)
            out = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int64(), SPANS, pa.list_(pa.string()), pa.string())))]
            names_ = ["doc_id", "n_words", "n_hit", "spans", "items", "cleaned"]
            if not last:
                out.append(batch.column("text"))
                names_.append("text")
            yield pa.RecordBatch.from_arrays(out, names_)
    return run


def _flagger(shared, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch, raw, offsets in steps(batches, "text"):
            flat, at = raw.tobytes().translate(WORD_BYTES), offsets.tolist()
            held, flags = [], []
            for lo, hi, old in zip(at[:-1], at[1:], batch.column("spans").to_pylist()):
                words, spans = flat[lo:hi].split(), [(s["start"], s["end"]) for s in old]
                automaton.scan(words, spans, set())
                spans = merged(spans)
                n = sum(b - a for a, b in spans)
                held.append([{"start": a, "end": b} for a, b in spans])
                flags.append(int(n > 0 and one_in * n >= len(words)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(held, SPANS), pa.array(flags, pa.int32())], ["row", "spans", "flag"])
    return run


def distinct_items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """name, data: the named texts, each pair once."""
    return items.select(F.col(f"`{item_id}`").cast("string").alias("name"),
                        F.encode(F.col(f"`{item_text}`"), "UTF-8").alias("data")).filter("data IS NOT NULL").distinct()


def key() -> Column:
    """What stands for an item's text where several items have it."""
    return F.sha2("data", 256)


def shards(texts: DataFrame, window: int, shard_bytes: int) -> Iterator[Automaton]:
    """Automata of some `shard_bytes` of item text each, from names and texts that don't repeat; at least one."""
    total = texts.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    n = max(1, -(-total // shard_bytes))
    for k in range(n):
        rows = texts.filter(F.pmod(F.xxhash64("data"), F.lit(n)) == k).collect()
        yield Automaton([(r.name, bytes(r.data)) for r in rows], window)


def named(found: DataFrame, test: DataFrame) -> DataFrame:
    """`found` with the names of all items in place of the keys of their texts."""
    rows = cut_lineage(found, "found").withColumn("row", F.monotonically_increasing_id())
    names = (rows.select("row", F.explode("items").alias("key")).join(test.filter("name IS NOT NULL").select(key().alias("key"), "name"), "key")
             .groupBy("row").agg(F.sort_array(F.collect_set("name")).alias("names")))
    return (rows.join(names, "row", "left").withColumn("items", F.coalesce("names", F.expr("CAST(array() AS array<string>)")))
            .drop("row", "names"))


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, clean: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of word numbers), items (sorted names), cleaned: one row for each row of `docs`.

    Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z. Null and empty texts have no words.
    Items without words match nothing; an item with a null id marks words but is not named; repeated items count
    once. With `clean`, `cleaned` is the text without its spans, null where there are none. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    df = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                            F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"),
                            F.expr("CAST(array() AS array<string>)").alias("items")))
    test = distinct_items(items, item_id, item_text)
    texts = test.groupBy("data").agg(F.min("name").alias("name"), F.count("name").alias("names"))
    repeated = (texts.agg(F.max("names")).first()[0] or 0) > 1
    tests = shards(texts.withColumn("name", key()) if repeated else texts, window, shard_bytes)
    automaton = next(tests)
    while automaton:
        shared, automaton = spark.sparkContext.broadcast(automaton), next(tests, None)
        last = automaton is None
        df = df.mapInArrow(_scanner(shared, clean, last), f"doc_id {id_type}, {FOUND}" + ("" if last else ", text string"))
        if not last:
            df = cut_lineage(df, "scanned")
    return named(df, test) if repeated else df


def report(found: DataFrame, one_in: int = 20) -> DataFrame:
    """The counts, a digest of the items and whether hit words are at least one in `one_in`."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, one_in: int = 20, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with their columns: hit words are fewer than one in `one_in`.

    One automaton is in use at a time; between shards the rows left are written once with their hits.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = distinct_items(items, item_id, item_text).select("data").distinct().withColumn("name", F.lit(None).cast("string"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("spans", T.ArrayType(span)), T.StructField("flag", T.IntegerType())])
    df = spread(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                            F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans")))
    tests = shards(texts, window, shard_bytes)
    automaton = next(tests)
    while automaton:
        shared, automaton = spark.sparkContext.broadcast(automaton), next(tests, None)
        # more shards only add hits, so that a contaminated row needn't meet them
        df = (df.select("row", "spans", F.col(f"row.`{text_col}`").alias("text"))
              .mapInArrow(_flagger(shared, one_in), schema).filter("flag = 0").select("row", "spans"))
        if automaton:
            df = cut_lineage(df, "scanned")
    return df.select("row.*")


def remove_spans(docs: DataFrame, items: DataFrame, longer_than: int = 0, one_in: int | None = None, id_col: str = "doc_id",
                 text_col: str = "text", **how) -> DataFrame:
    """doc_id and text, where hit spans are cut out of texts with a span over `longer_than` words or, if given, hits over one in `one_in`."""
    found = scan(docs, items, id_col, text_col, clean=True, **how)
    over = F.exists("spans", lambda s: s["end"] - s["start"] > longer_than)
    if one_in:
        over = over | (one_in * F.col("n_hit") >= F.col("n_words"))
    cut = cut_lineage(found.filter(F.col("cleaned").isNotNull() & over).select("doc_id", "cleaned"), "cleaned")
    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .join(cut, "doc_id", "left").select("doc_id", F.coalesce("cleaned", "text").alias("text")))
