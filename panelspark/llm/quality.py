"""Quality by a byte-level convolutional network in numpy.

A text is cut into segments of SEGMENT bytes; a chunk is a segment and the next one, so chunks overlap by
half and cover the whole text. Filters of WIDTH bytes over byte embeddings are max-pooled in each chunk, the
chunks' values are averaged and max-pooled over the text, and one logistic unit combines both. The network is
trained by Adam on whole texts of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, spread, steps
from panelspark.session import cut_lineage

WIDTH, DEPTH, FILTERS, SEGMENT = 6, 6, 16, 256
STEP = 1 << 19


@dataclass
class Network:
    embed: np.ndarray    # 256 x DEPTH
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray     # FILTERS
    out: np.ndarray      # 2 * FILTERS + 1: of the mean, of the maximum, constant

    @staticmethod
    def start(seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        return Network(rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
                       rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
                       np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out]

    def forward(self, raw: np.ndarray, offsets: np.ndarray, keep: bool = False):
        """Scores of the texts; with `keep`, also what the backward pass needs. Filters see zeros behind a text's end."""
        sizes = np.diff(offsets)
        cells = -(-(sizes + WIDTH - 1) // SEGMENT)  # segments of each text, with room for a filter behind its end
        first = np.concatenate([[0], np.cumsum(cells)])
        shift = np.repeat(first[:-1] * SEGMENT - offsets[:-1], sizes)
        grid = np.full(first[-1] * SEGMENT + WIDTH, 256, np.int64)  # 256: no byte
        grid[np.arange(len(raw)) + shift] = raw
        table = np.vstack([self.embed, np.zeros((1, DEPTH), np.float32)])
        x = table[grid]
        n = first[-1] * SEGMENT
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(-1), WIDTH * DEPTH)[::DEPTH][:n]
        z = (view @ self.filters).reshape(first[-1], SEGMENT, FILTERS)
        # places behind the end of a text don't count, except for a text's first byte (an empty text has one place)
        gone = (grid[:n] == 256).reshape(first[-1], SEGMENT)
        gone[first[:-1], 0] = False
        z[gone] = -np.inf
        peak = np.maximum(z.max(1) + self.bias, 0)
        last = np.zeros(first[-1], np.bool_)
        last[first[1:] - 1] = True
        after = np.vstack([peak[1:], peak[-1:]])
        after[last] = peak[last]
        chunk = np.maximum(peak, after)
        mean = np.add.reduceat(chunk, first[:-1], axis=0) / cells[:, None]
        top = np.maximum.reduceat(chunk, first[:-1], axis=0)
        h = np.hstack([mean, top, np.ones((len(sizes), 1), np.float32)])
        p = 1 / (1 + np.exp(-np.clip(h @ self.out, -30, 30)))
        return (p, h, z, peak, chunk, top, first, cells, last, grid, view) if keep else p

    def gradients(self, raw: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        p, h, z, peak, chunk, top, first, cells, last, grid, view = self.forward(raw, offsets, True)
        d = ((p - y) / len(y)).astype(np.float32)
        g_out = h.T @ d
        dh = d[:, None] * self.out[None, :-1]
        text = np.repeat(np.arange(len(cells)), cells)
        dchunk = (dh[:, :FILTERS] / cells[:, None])[text]
        # the maximum's gradient goes to one of the chunks that reach it
        rows, cols = np.nonzero(chunk == top[text])
        _, one = np.unique(text[rows] * FILTERS + cols, return_index=True)
        dchunk[rows[one], cols[one]] += dh[:, FILTERS:][text[rows[one]], cols[one]]
        own = (peak >= chunk) | last[:, None]
        dpeak = dchunk * own
        dpeak[1:] += (dchunk * ~own)[:-1]
        dpeak *= peak > 0
        at = z.argmax(1)  # segments x FILTERS
        cell, f = np.nonzero(dpeak)
        place = cell * SEGMENT + at[cell, f]
        value = dpeak[cell, f]
        seen = view[place]
        g_filters, g_bias = np.zeros_like(self.filters), np.zeros_like(self.bias)
        g_embed = np.zeros((257, DEPTH), np.float32)
        for k in range(FILTERS):
            mine = f == k
            g_filters[:, k] = seen[mine].T @ value[mine]
            g_bias[k] = value[mine].sum()
        back = (value[:, None] * self.filters.T[f]).reshape(-1, WIDTH, DEPTH)
        for j in range(WIDTH):
            np.add.at(g_embed, grid[place + j], back[:, j])
        return [g_embed[:256], g_filters, g_bias, g_out.astype(np.float32)]


def fit(texts: list[bytes], y: np.ndarray, updates: int = 800, batch: int = 24, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam for a fixed number of updates, whatever the number of texts; the rate falls to zero."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    base = np.clip(y.mean(), 0.01, 0.99)
    net.out[-1] = np.log(base / (1 - base))
    m = [np.zeros_like(p) for p in net.parameters()]
    v = [np.zeros_like(p) for p in net.parameters()]
    for t in range(1, updates + 1):
        pick = rng.integers(0, len(texts), batch)
        data = [texts[i] for i in pick]
        grads = net.gradients(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]), y[pick])
        lr = rate * (1 - t / (updates + 1))
        for p, g, a, b in zip(net.parameters(), grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= lr * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-6)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 5,
          rows: int = 1200, longest: int = 16384, **how) -> Network | None:
    """A network from labelled rows whose id isn't held out (crc32 of the id modulo `folds` is not 0).

    The sample, by hash of the id, has at most `rows` rows, and of these only texts of at most `longest` bytes: a documented
    bound on what the driver gets and on the training time. None if nothing is labelled.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    known = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
             .filter((fold != 0) & F.col("label").isin(0, 1)).dropDuplicates(["doc_id"])
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    known = cut_lineage(known, "labelled")
    got = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("data"))
           .filter(F.length("data") <= longest).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])  # at most `rows` rows
           .select("doc_id", "data", "label").orderBy("doc_id").collect())
    if not got:
        return None
    return fit([bytes(r.data) for r in got], np.array([r.label for r in got], np.float32), **how)


def _scorer(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = shared.value
        for batch, raw, offsets in steps(batches, "text", STEP):
            s = net.forward(raw, offsets).astype(float) if net else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s),
                                              pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return run


def score(docs: DataFrame, net: Network | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of `docs`; other columns are not read.

    A null text counts as empty, and the network scores an empty text too. Without a network every score is 0.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return spread(rows).mapInArrow(_scorer(spark.sparkContext.broadcast(net), threshold),
                                   f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")
