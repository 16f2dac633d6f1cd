"""Byte-level BPE by recursive queries in DuckDB, run per partition.

Texts are split into pieces in numpy; the distinct pieces that a partition hasn't met yet go to DuckDB. There
each piece is a list of tokens, one for each byte at first. A round of the recursive query unfolds it into
token-position rows, joins neighbouring pairs with the merge table, and contracts each piece's
leftmost pair of least rank; pieces that nothing merges leave. An ordered aggregation over the tokens' bytes decodes.

A merge applies to any two tokens whose joined bytes are a token, and a piece that is a token is taken as it is.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, span_hashes, spread, steps

#: Pieces of more bytes (runs of junk) are merged in Python with a heap: a query takes a round for each merge.
LONG = 192
#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Bytes of text in a step, which takes some fifty times as much memory.
STEP = 1 << 19

# The splitting pattern that `split` implements, and the Unicode white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

ENCODE = """
WITH RECURSIVE step(w, t, live) AS (
  SELECT w, t, true FROM fresh
  UNION ALL
  SELECT s.w, CASE WHEN b.best IS NULL THEN s.t
                   ELSE list_concat(list_append(s.t[:(b.best & 255) - 1], CAST(b.best >> 8 AS INTEGER)), s.t[(b.best & 255) + 2:]) END,
         b.best IS NOT NULL
  FROM (SELECT w, t FROM step WHERE live) s
  LEFT JOIN (
    SELECT w, min((CAST(m.merged AS BIGINT) << 8) | p) AS best
    FROM (SELECT w, p, (CAST(t[p] AS BIGINT) << 32) | t[p + 1] AS pair
          FROM (SELECT w, t, unnest(range(1, len(t))) AS p FROM step WHERE live)) n
    JOIN merges m USING (pair)
    GROUP BY w) b USING (w))
SELECT w, t FROM step WHERE NOT live ORDER BY w"""

DECODE = """
SELECT string_agg(v.hex, '' ORDER BY p)
FROM (SELECT w, unnest(t) AS id, unnest(range(1, len(t) + 1)) AS p FROM coded) c JOIN vocab v USING (id)
GROUP BY w ORDER BY w"""

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    if not _CLASSES:
        first = {"L": 1, "N": 2}
        table = np.fromiter((first.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
        table[SPACES] = 3
        _CLASSES.append(table)
    return _CLASSES[0]


def split(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the matches of PATTERN in each text, given the code points of all texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, np.bool_)  # a text starts here; n ends the last one
    head[offsets] = True
    start = head.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # white space before something else: its last character stands apart, and a blank joins what follows
    at = np.flatnonzero(start[1:n] & ~head[1:n] & (kind[:-1] == 3)) + 1
    start[at - 1] = True
    start[at[points[at - 1] == 32]] = False
    # contractions
    quote = np.flatnonzero((points == 39) & start[:n])
    following = np.concatenate([points, [0, 0]])
    inner = np.concatenate([~head[:n], [False, False]])
    a, b = following[quote + 1], following[quote + 2]
    two = inner[quote + 1] & np.isin(a, [ord(c) for c in "stmd"])
    three = inner[quote + 1] & inner[quote + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    for found, size in ((quote[two], 2), (quote[three & ~two], 3)):
        start[found + 1] = False
        after = found + size
        start[after] = True
    return np.flatnonzero(start[:n])


@dataclass
class Vocabulary:
    """Ranks of a vocabulary file and the merges that follow from them."""

    ranks: dict[bytes, int]
    pair: np.ndarray
    merged: np.ndarray

    @staticmethod
    def read(data: bytes) -> "Vocabulary":
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        pair, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pair.append(left << 32 | right)
                    merged.append(rank)
        return Vocabulary(ranks, np.array(pair, np.int64), np.array(merged, np.int32))


@dataclass
class Coder:
    """Codes pieces in one worker, and remembers those it has met."""

    vocab: Vocabulary
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))    # sorted hashes
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))    # the piece of each hash
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))      # tokens of all pieces
    ids_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    data: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))     # decoded bytes of all pieces
    data_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def __post_init__(self):
        import duckdb
        self.byte = np.array([self.vocab.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "320MB"})
        self.con.execute("SET temp_directory = ''")
        self._table("merges", pair=pa.array(self.vocab.pair), merged=pa.array(self.vocab.merged))
        self._table("vocab", id=pa.array(list(self.vocab.ranks.values()), pa.int32()), hex=pa.array([t.hex() for t in self.vocab.ranks]))
        self.merge: dict[int, int] | None = None

    def _table(self, name: str, **columns) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def forget(self) -> None:
        self.seen, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.data = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.ids_at = self.data_at = np.zeros(1, np.int64)

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encode and decode new pieces, whose hashes are given."""
        known = [self.vocab.ranks.get(p) for p in pieces]
        coded: list = [None if k is None else [k] for k in known]
        fresh = [i for i, (k, p) in enumerate(zip(known, pieces)) if k is None and len(p) <= LONG]
        if fresh:
            sizes = np.fromiter((len(pieces[i]) for i in fresh), np.int64, len(fresh))
            tokens = self.byte[np.frombuffer(b"".join(pieces[i] for i in fresh), np.uint8)]
            self._table("fresh", w=pa.array(np.array(fresh, np.int32)), t=pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(tokens)))
            for w, t in zip(*self.con.execute(ENCODE).fetchnumpy().values()):
                coded[w] = t
        for i, p in enumerate(pieces):
            if coded[i] is None:
                coded[i] = self.long(p)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.concatenate([np.asarray(c, np.int32) for c in coded]) if coded else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self._table("coded", w=pa.array(np.arange(len(coded), dtype=np.int32)),
                    t=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
        texts = [r[0] for r in self.con.execute(DECODE).fetchall()]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) // 2
        base = len(self.ids_at) - 1
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + ends[1:]])
        self.data_at = np.concatenate([self.data_at, self.data_at[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, flat])
        self.data = np.concatenate([self.data, np.frombuffer(bytes.fromhex("".join(texts)), np.uint8)])
        seen = np.concatenate([self.seen, hashes])
        order = np.argsort(seen, kind="stable")
        self.place = np.concatenate([self.place, base + np.arange(len(hashes))])[order]
        self.seen = seen[order]

    def long(self, piece: bytes) -> list[int]:
        """The same contraction for a long piece: a linked list and a heap of (rank, position)."""
        if self.merge is None:
            self.merge = dict(zip(self.vocab.pair.tolist(), self.vocab.merged.tolist()))
        merge = self.merge
        t = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(t)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i) for i in range(n - 1) if (m := merge.get(t[i] << 32 | t[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if t[i] < 0 or j < 0 or merge.get(t[i] << 32 | t[j]) != m:
                continue
            t[i], t[j] = m, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := merge.get(t[i] << 32 | t[k])) is not None:
                    heapq.heappush(heap, (m, i))
            h = before[i]
            if h >= 0 and (m := merge.get(t[h] << 32 | t[i])) is not None:
                heapq.heappush(heap, (m, h))
        return [x for x in t if x >= 0]

    def code(self, raw: np.ndarray, offsets: np.ndarray):
        """Tokens and decoded bytes of all texts, and n + 1 offsets into either."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each code point
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.append(lead, len(raw))
        text_at = np.searchsorted(lead, offsets)
        start = split(points, text_at)
        end = np.append(start[1:], len(points))
        h = span_hashes(points, start, end) if len(start) else np.zeros(0, np.uint64)
        every, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.seen) + len(every) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(~np.isin(every, self.seen, assume_unique=True))
        if len(new):
            data, lo, hi = raw.tobytes(), lead[start[first[new]]].tolist(), lead[end[first[new]]].tolist()
            self.learn(every[new], [data[a:b] for a, b in zip(lo, hi)])
        piece = (self.place[np.searchsorted(self.seen, every)] if len(every) else every.astype(np.int64))[which]
        at = np.searchsorted(start, text_at)
        return (*_gathered(self.ids, self.ids_at, piece, at), *_gathered(self.data, self.data_at, piece, at))


def _gathered(values: np.ndarray, bounds: np.ndarray, piece: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the pieces one after another, and the offsets of the texts, which begin at pieces `at`."""
    size = bounds[piece + 1] - bounds[piece]
    ends = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(ends[-1]) + np.repeat(bounds[piece] - ends[:-1], size)
    return values[index], ends[at]


_CODERS: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """One coder for each worker process and vocabulary."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(Vocabulary.read(shared.value))
    return _CODERS[key]


def _runner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch, raw, offsets in steps(batches, "text", STEP):
            coder = coder or _coder(shared)
            ids, ids_at, data, data_at = coder.code(raw, offsets)
            pack = lambda x, at, w: pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * w).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ids_at)), pack(ids.astype("<u4"), ids_at, 4).cast(pa.binary()),
                 pack(data, data_at, 1).cast(pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
    return run


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers), decoded (the bytes of these tokens).

    `vocabulary` is a file of base64 tokens and ranks, read by the driver. One row for each row of `docs`; a null text counts as
    empty and has no tokens. Special tokens are ordinary text. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return spread(rows).mapInArrow(_runner(shared), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """SHA-256 (lowercase hex) of the tokens and of the decoded bytes."""
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
