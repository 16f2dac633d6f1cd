"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier over hashed byte
trigrams (naive Bayes from counts of all training texts) tells the languages on one side from those on the
other; its margin is the mean log-odds of a text's trigrams. Loss-weighted decoding takes the language
whose codeword has the least logistic loss and flags texts whose runner-up is near.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, spread, steps

BUCKETS = 1 << 16
STEP = 1 << 20
#: Letters in lower case; other ASCII is a blank.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around each byte; texts are padded by blanks, so as many trigrams as bytes."""
    n, sizes = len(raw), np.diff(offsets)
    padded = np.full(n + 2 * len(sizes), 32, np.uint8)
    shift = np.repeat(2 * np.arange(len(sizes)) + 1, sizes)
    at = np.arange(n) + shift
    padded[at] = LETTERS[raw]
    key = (padded[at - 1].astype(np.uint32) << 16) | (padded[at].astype(np.uint32) << 8) | padded[at + 1]
    key *= np.uint32(2654435761)
    return key >> np.uint32(16)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch, raw, offsets in steps(batches, "text", STEP):
        langs = np.array(batch.column("lang").to_pylist(), object)
        key, sizes = trigrams(raw, offsets), np.diff(offsets)
        for lang in set(langs):
            mine = np.repeat(langs == lang, sizes)
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            counts[lang] += np.bincount(key[mine], minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                          pa.array(c[at])], ["lang", "bucket", "n"])


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all ways to split up to seven languages, else the best of some random codes."""
    if k <= 7:
        bits = np.arange(1, 1 << max(k - 1, 0))
        return np.array([[-1 if j and (b >> (j - 1)) & 1 else 1 for b in bits] for j in range(k)]).reshape(k, len(bits))
    width, best = 8 + 5 * int(np.ceil(np.log2(k))), None
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1, 1], (k, width))
        apart = (width - code @ code.T) / 2 + width * np.eye(k)
        score = (apart.min(), np.abs(code.sum(0)).max() < k)
        if best is None or score > best[0]:
            best = score, code
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # buckets x bits: log-odds

    def decode(self, margins: np.ndarray, sharpness: float) -> np.ndarray:
        """Loss of each text against each codeword."""
        z = -sharpness * margins[:, None, :] * self.code[None]
        return np.logaddexp(0, z).sum(2)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Counts of trigrams by language over all rows with text and language, then one classifier for each bit.

    The driver gets at most BUCKETS counts for each language.
    """
    bound_batches(docs.sparkSession)
    rows = (docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
            .filter("text IS NOT NULL AND lang IS NOT NULL"))
    counts = (spread(rows).mapInArrow(_counter, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(counts["lang"].to_pylist()))
    table = np.full((len(langs), BUCKETS), smoothing)
    which = np.array([langs.index(x) for x in counts["lang"].to_pylist()], int)
    np.add.at(table, (which, counts["bucket"].to_numpy()), counts["n"].to_numpy())
    table /= table.sum(1, keepdims=True) if langs else 1
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for j in range(code.shape[1]):
        weights[:, j] = np.log(table[code[:, j] > 0].mean(0)) - np.log(table[code[:, j] < 0].mean(0))
    return Model(langs, code, weights)


def _predictor(shared, sharpness: float, near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        ascii_letter = np.zeros(256, np.bool_)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        for batch, raw, offsets in steps(batches, "text", STEP):
            n, sizes = batch.num_rows, np.diff(offsets)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
            spoken = sums(ascii_letter[raw]) > 0
            for i in np.flatnonzero(~spoken & (sums(raw >= 128) > 0)):
                spoken[i] = any(c.isalpha() for c in raw[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            spoken &= bool(m.langs)
            margins = np.zeros((n, m.code.shape[1]))
            full = np.flatnonzero(sizes)
            if len(full) and margins.size:
                each = m.weights[trigrams(raw, offsets)]
                margins[full] = np.add.reduceat(each, offsets[:-1][full], axis=0, dtype=np.float64) / sizes[full, None]
            if m.langs:
                loss = m.decode(margins, sharpness)
                order = np.argsort(loss, axis=1, kind="stable")
                p = np.exp(loss.min(1, keepdims=True) - loss)
                best, score = order[:, 0], 1 / p.sum(1)
                gap = loss[np.arange(n), order[:, 1]] - loss[np.arange(n), best] if len(m.langs) > 1 else np.full(n, np.inf)
            else:
                best, score, gap = np.zeros(n, int), np.zeros(n), np.zeros(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.array([m.langs[b] if s else "und" for b, s in zip(best, spoken)], pa.string()),
                 pa.array(np.where(spoken, score, 0.0)), pa.array(spoken & (gap < near))],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])
    return run


def identify(docs: DataFrame, model: Model, held_out, id_col: str = "doc_id", text_col: str = "text",
             sharpness: float = 4.0, near: float = 1.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row for each row of `docs`; other columns are not read.

    A text that is null, empty or without a letter gets `und` and score 0, as does any text if nothing was learned. With one
    language learned, all others get it. Ties go to the language that sorts first.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return spread(rows).mapInArrow(
        _predictor(spark.sparkContext.broadcast(model), sharpness, near),
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean")
