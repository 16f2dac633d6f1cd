"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models of the letters in a word, one counted on toxic texts and one on ordinary texts,
back off order by order to the same trigram counts over all documents, so a rare expression gets the
same probability from both. A word's gain is its log-likelihood under the toxic model less that under the
ordinary one; a text is described by length-normalised sums of gains, and a logistic map, fitted
on rows that the models haven't counted, turns them into a score.

Letters are bytes of a-z (A-Z in lower case) and of non-ASCII characters; all else separates words. Words begin
with ORDER - 1 blanks and end with one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, flagged, span_hashes, spread, steps, words
from panelspark.session import cut_lineage

#: Letters in the longest context and the letter after it: a key of ORDER bytes fits into 64 bits.
ORDER = 5
#: Order of the counts that both classes share.
SHARED = 3
#: What is taken off each count; expressions of no more occurrences rely on the backoff.
DISCOUNT = 3
#: Gains of a word below these count as none in a feature of their own.
FLOORS = (2.0, 4.0)
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def distinct_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The letters, start and end of each distinct word, the number of each word among them, offsets of the texts."""
    letters = LETTERS[raw]
    start, end, at = words(letters, offsets, np.arange(256) == 32)
    _, first, which = np.unique(span_hashes(letters, start, end), return_index=True, return_inverse=True)
    return letters, start[first], end[first], which, at


def grams(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER-grams of each word with its blanks, and the number of each key's word."""
    size = end - start + 1  # as many as letters, and one for the blank at the end
    word = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    key = np.zeros(len(word), np.int64)
    for back in range(ORDER - 1, -1, -1):
        at = place - back
        inside = (at >= 0) & (at < size[word] - 1)
        letter = np.full(len(word), 32, np.int64)
        letter[inside] = letters[(start[word] + at)[inside]]
        key = key << 8 | letter
    return key, word


def suffix(key, order: int):
    return key & ((1 << 8 * order) - 1)


def _class_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each ORDER-gram of the step, by class."""
    for batch, raw, offsets in steps(batches, "text"):
        letters, start, end, which, at = distinct_words(raw, offsets)
        key, word = grams(letters, start, end)
        toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False) == 1, np.diff(at))
        every, where = np.unique(key, return_inverse=True)
        cols = [np.bincount(where, np.bincount(which[mine], minlength=len(start))[word], len(every)).astype(np.int64)
                for mine in (~toxic, toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(every), *map(pa.array, cols)], ["key", "n0", "n1"])


def _shared_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each SHARED-gram of the partition."""
    total: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.int64), np.zeros(0)
    for _, raw, offsets in steps(batches, "text"):
        letters, start, end, which, _ = distinct_words(raw, offsets)
        key, word = grams(letters, start, end)
        times = np.bincount(which, minlength=len(start))[word]
        keys, where = np.unique(np.concatenate([total[0], suffix(key, SHARED)]), return_inverse=True)
        total = keys, np.bincount(where, np.concatenate([total[1], times]), len(keys))
    yield pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1].astype(np.int64))], ["key", "n"])


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.bool_)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Level:
    """One order: log-ratios of the grams that either class kept, and of the backoff weights of their contexts."""

    keys: np.ndarray
    gain: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    levels: list[Level]               # from ORDER down to SHARED + 1
    shape: np.ndarray | None = None   # centre, scale and weights of the logistic map

    def word_gains(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        key, word = grams(letters, start, end)
        gain, todo = np.zeros(len(key)), np.arange(len(key))
        for order, level in zip(range(ORDER, SHARED, -1), self.levels):
            mine = suffix(key[todo], order)
            at, found = look_up(level.keys, mine)
            if found.any():
                gain[todo[found]] += level.gain[at[found]]
            todo, mine = todo[~found], mine[~found]
            at, found = look_up(level.contexts, mine >> 8)
            if found.any():
                gain[todo[found]] += level.backoff[at[found]]
        return np.bincount(word, gain, len(start))

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text the root of the mean gain over each floor, and the mean gain."""
        letters, start, end, which, at = distinct_words(raw, offsets)
        out, n = np.zeros((len(offsets) - 1, len(FLOORS) + 1)), np.diff(at)
        gains = self.word_gains(letters, start, end)[which] if len(start) else np.zeros(0)
        for j, floor in enumerate(FLOORS):
            run = np.concatenate([[0], np.cumsum(np.maximum(gains - floor, 0))])
            out[:, j] = np.sqrt(np.maximum(run[at[1:]] - run[at[:-1]], 0) / np.maximum(n, 1))
        run = np.concatenate([[0], np.cumsum(gains)])
        out[:, -1] = (run[at[1:]] - run[at[:-1]]) / np.maximum(n, 1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.shape is None:
            return np.zeros(len(x))
        k = x.shape[1]
        z = self.shape[2 * k] + ((x - self.shape[:k]) / self.shape[k:2 * k]) @ self.shape[2 * k + 1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sample(labels: DataFrame, allowed: Column, rows: int, ratio: int, id_col: str, label: str) -> DataFrame:
    """doc_id and label, by hash of the id: at most `rows` of class 1, and at most `ratio` times as many of class 0."""
    known = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
             .filter(allowed & F.col("label").isin(0, 1)).dropDuplicates(["doc_id"]))
    ones = min(rows, known.filter("label = 1").count())
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    return (known.filter("label = 1").orderBy(*order).limit(ones)
            .unionByName(known.filter("label = 0").orderBy(*order).limit(ratio * ones)))


def _levels(top: DataFrame, shared: pa.Table, discount: float) -> list[Level]:
    """Models of all orders from the counts of ORDER-grams by class.

    Lower orders count the different letters before a gram. Grams that neither class kept and contexts that kept nothing are
    not collected: their value follows from the lower order.
    """
    base_keys, n = shared["key"].to_numpy(), shared["n"].to_numpy().astype(float)
    order = np.argsort(base_keys)
    base_keys, n = base_keys[order], n[order]
    contexts, where = np.unique(base_keys >> 8, return_inverse=True)
    total = np.bincount(where, n)

    def base(wanted):
        at, found = look_up(base_keys, wanted)
        c_at, c_found = look_up(contexts, wanted >> 8)
        seen = np.where(found, n[at], 0) if len(n) else np.zeros(len(wanted))
        over = np.where(c_found, total[c_at], 0) if len(n) else np.zeros(len(wanted))
        p = (seen + 0.5 / 256) / (over + 0.5)
        return np.stack([p, p])

    counted = {ORDER: top}
    for k in range(ORDER - 1, SHARED, -1):
        above = counted[k + 1]
        counted[k] = (above.groupBy(F.expr(f"key & {(1 << 8 * k) - 1}").alias("key"))
                      .agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("n0", "n1")]))
    below, levels = base, []
    for k in range(SHARED + 1, ORDER + 1):
        df = counted[k]
        kept = [F.greatest(F.col(c) - discount, F.lit(0)) for c in ("n0", "n1")]
        rows = df.filter((F.col("n0") > discount) | (F.col("n1") > discount)).orderBy("key").toArrow()
        ctx = (df.groupBy(F.shiftright("key", 8).alias("key"))
               .agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.sum(kept[0]).alias("k0"), F.sum(kept[1]).alias("k1"))
               .filter("k0 > 0 OR k1 > 0").orderBy("key").toArrow())
        keys, c_keys = rows["key"].to_numpy(), ctx["key"].to_numpy()
        t = np.stack([ctx["t0"].to_numpy(), ctx["t1"].to_numpy()]).astype(float)
        left = 1 - np.stack([ctx["k0"].to_numpy(), ctx["k1"].to_numpy()]).astype(float) / np.maximum(t, 1)
        c_at, _ = look_up(c_keys, keys >> 8)
        some = np.maximum(np.stack([rows["n0"].to_numpy(), rows["n1"].to_numpy()]) - discount, 0)
        p = some / np.maximum(t[:, c_at], 1) + left[:, c_at] * below(suffix(keys, k - 1))
        levels.append(Level(keys, np.log(p[1]) - np.log(p[0]), c_keys, np.log(left[1]) - np.log(left[0])))

        def below(wanted, keys=keys, p=p, c_keys=c_keys, left=left, lower=below, k=k):
            at, found = look_up(keys, wanted)
            c_at, c_found = look_up(c_keys, wanted >> 8)
            out = lower(suffix(wanted, k - 1))
            if len(c_keys):
                out = np.where(c_found, left[:, c_at], 1) * out
            return np.where(found, p[:, at], out) if len(keys) else out
    return levels[::-1]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5,
          rows: int = 8000, ratio: int = 4, discount: float = DISCOUNT) -> Model | None:
    """Models from labelled rows whose id isn't held out (crc32 of the id modulo `folds` is not 0).

    The classifier's sample has at most `rows` toxic rows and `ratio` times as many ordinary ones, a documented bound: all but
    one remainder of crc32 are counted, that one fits the logistic map. The shared counts cover all documents. None if
    no allowed row is labelled toxic, or none ordinary.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    chosen = cut_lineage(sample(labels, fold != 0, rows, ratio, id_col, label), "labelled")
    if chosen.select("label").distinct().count() < 2:
        return None
    texts = cut_lineage(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
        .join(F.broadcast(chosen), "doc_id")  # at most (1 + ratio) * rows rows
        .select("text", F.col("label").alias("toxic"), (fold == folds - 1).alias("fit")), "labelled_texts")
    shared = (spread(docs.select(F.col(f"`{text_col}`").alias("text"))).mapInArrow(_shared_grams, "key long, n long")
              .groupBy("key").agg(F.sum("n").alias("n")).toArrow())
    top = cut_lineage(spread(texts.filter("NOT fit").select("text", "toxic")).mapInArrow(_class_grams, "key long, n0 long, n1 long")
                      .groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "class_grams")
    model = Model(_levels(top, shared, discount))
    names = [f"x{j}" for j in range(len(FLOORS) + 1)]
    fit = (spread(texts.filter("fit").select("text", "toxic"))
           .mapInArrow(_measured(spark.sparkContext.broadcast(model), names), "toxic int, " + ", ".join(f"{c} double" for c in names))
           .orderBy("toxic", *names).toArrow())  # the same order on every run
    model.shape = _logistic(np.column_stack([fit[c].to_numpy() for c in names]), fit["toxic"].to_numpy())
    return model


def _measured(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in steps(batches, "text"):
            x = shared.value.features(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), *map(pa.array, x.T)], ["toxic", *names])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Centre, scale and weights by Newton's method with a ridge."""
    k = x.shape[1]
    if not len(x):
        return np.concatenate([np.zeros(k), np.ones(k), [-3.0], np.full(k, 3.0)])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w, penalty = np.zeros(k + 1), np.diag([1e-6] + [ridge] * k)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + penalty
        w -= np.linalg.solve(h, a.T @ (p - y) + penalty @ w)
    return np.concatenate([centre, scale, w])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch, raw, offsets in steps(batches, "text"):
            s = model.score(model.features(raw, offsets)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])
    return run


def score(docs: DataFrame, model: Model | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of `docs`; other columns are not read.

    Null, empty and wordless texts get the score of a text without evidence. Without a model every score is 0.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return spread(rows).mapInArrow(_scorer(spark.sparkContext.broadcast(model)),
                                   f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def filter_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that a model learned from them doesn't predict to be toxic, with their columns."""
    model = train(docs, labels, id_col, text_col, **how)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = flagged(docs, text_col, lambda raw, offsets: shared.value.score(shared.value.features(raw, offsets)) >= 0.5)
    return rows.filter("flag = 0").select("row.*")
