"""Two tokenizers' tokens of the same text, lined up by bytes.

A byte-level BPE (A) and a piece model with byte fallback (B) code the text behind a blank. Where tokens of both end at the same byte,
the text can be cut. The cuts are found by divide and conquer: the end of an interval's middle A token is looked up among B's
ends by bisection, then its neighbours' to either side, until one is shared; there the interval falls into two halves. Intervals without a shared end are
the leaves, one group each. All intervals of all texts of a step are taken a level at a time, so a level is one bisection in numpy.

Both models code words apart: A's splitting pattern and B's pieces never cross from a letter or sign to a blank. So words are the
segments that are coded, once in a worker as long as it remembers them, and a very long text is taken in parts.

Tokens that end together are linked, and one of them is then a suffix of the other. So the vocabularies alone say which pairs can
be linked: some hundred thousand, whatever the corpus, and counts of all links fit into a table of that size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, span_hashes, spread, steps
from panelspark.session import cut_lineage

#: Bytes of text in a step and in a part of a long text, and words that a worker remembers.
STEP = 1 << 20
REMEMBERED = 400_000
#: Words that the models are given in one line.
TOGETHER = 256
BLANK = 32
#: Bytes that end a character of white space: alone, or after the given bytes.
SPACE_ENDS = {(): (9, 10, 11, 12, 13, 28, 29, 30, 31, 32), (0xC2,): (0x85, 0xA0), (0xE1, 0x9A): (0x80,), (0xE1, 0xA0): (0x8E,),
              (0xE2, 0x80): (*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F, 0xA0), (0xE3, 0x80): (0x80,), (0xEF, 0xBB): (0xBF,)}


# --- vocabularies -----------------------------------------------------------------------

def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it shows, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def bytes_of_a(tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level BPE."""
    of = byte_characters()
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def bytes_of_b(pieces) -> list[bytes]:
    """Bytes of each id of a piece model."""
    return [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in range(pieces.get_piece_size())]


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """a << 32 | b, sorted, for all tokens of which one ends with the other: at most a pair for each suffix of each token."""
    def suffixes_in(tokens, others):
        for i, t in enumerate(tokens):
            for k in range(len(t)):
                yield from ((i, j) for j in others.get(t[k:], ()))

    def by_bytes(tokens):
        out: dict[bytes, list[int]] = {}
        for i, t in enumerate(tokens):
            out.setdefault(t, []).append(i)
        return out

    found = {(i << 32) | j for i, j in suffixes_in(a, by_bytes(b))} | {(i << 32) | j for j, i in suffixes_in(b, by_bytes(a))}
    return np.array(sorted(found), np.int64)


@dataclass
class Models:
    """Both tokenizers, what their ids stand for, and the pairs that can be linked."""

    a: object
    b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    pairs: np.ndarray

    @staticmethod
    def read(a: str, b: bytes) -> "Models":
        import sentencepiece
        from tokenizers import Tokenizer
        first, second = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        first.encode_special_tokens = True  # their strings in a text are ordinary text
        if any("▁" in p.lstrip("▁") for p in map(second.id_to_piece, range(second.get_piece_size()))):
            raise ValueError("pieces of B cross from a word to a blank, so words can't be coded apart")
        kind = json.loads(a)
        if kind.get("normalizer") or (kind.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or kind["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("A has to be a byte-level BPE that takes texts as they are")
        x, y = bytes_of_a(first), bytes_of_b(second)
        return Models(first, second, x, y, possible_pairs(x, y))


# --- coding -----------------------------------------------------------------------------

def word_starts(raw: np.ndarray) -> np.ndarray:
    """Places of blanks that follow a character which is no white space."""
    at = np.flatnonzero(raw == BLANK)
    at = at[at > 0]
    space = np.zeros(len(at), np.bool_)
    for before, ends in SPACE_ENDS.items():
        hit = np.isin(raw[at - 1], ends)
        for i, byte in enumerate(reversed(before)):
            hit &= raw[np.maximum(at - 2 - i, 0)] == byte
        space |= hit
    return at[~space]


@dataclass
class Side:
    """Tokens of remembered words for one tokenizer: ids and their lengths in bytes, one word after another."""

    sizes: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def add(self, ids: np.ndarray, n: np.ndarray) -> None:
        """`n` tokens for each new word."""
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])

    def of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words, and n + 1 offsets."""
        n = self.at[word + 1] - self.at[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.arange(ends[-1]) + np.repeat(self.at[word] - ends[:-1], n)], ends


class Coder:
    """Codes words by both models in one worker, and remembers them."""

    def __init__(self, models: Models):
        self.m = models
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (models.bytes_a, models.bytes_b))
        self.blank = models.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.seen, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.fit = np.zeros(0, np.bool_)
        self.a, self.b = Side(self.sizes_a), Side(self.sizes_b)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Words begin with a blank. A word fits if both models' tokens spell it.

        Words are coded as lines of TOGETHER words, which the models code apart unless one ends with white space; those are coded
        one by one, like a line that isn't spelled.
        """
        joined = np.frombuffer(b"".join(words) + b" ", np.uint8)
        apart = np.isin(np.cumsum([len(w) for w in words]), word_starts(joined), assume_unique=True)
        order = np.argsort(~apart, kind="stable")
        hashes, words = hashes[order], [words[i] for i in order.tolist()]
        n = int(apart.sum())
        lines = [words[i:min(i + TOGETHER, n)] for i in range(0, n, TOGETHER)]
        texts = [b"".join(line) for line in lines]
        decoded = [t.decode("utf-8", "replace") for t in texts]
        a = [e.ids for e in self.m.a.encode_batch_fast(decoded, add_special_tokens=False)]
        b = self.m.b.encode([t[1:] for t in decoded], num_threads=1)
        base, found = len(self.fit), []
        for line, text, x, y in zip(lines, texts, a, b):
            x, y = np.asarray(x, np.int32), np.asarray(y, np.int32)
            ends = np.cumsum([len(w) for w in line])
            n_x, n_y = self._apart(x, self.sizes_a, ends), self._apart(y, self.sizes_b, ends)
            spelled = lambda ids, of: b"".join([of[i] for i in ids.tolist()]) == text
            if n_x is not None and n_y is not None and spelled(x, self.m.bytes_a) and spelled(y, self.m.bytes_b):
                found.append((x, n_x, y, n_y, np.ones(len(line), np.bool_)))
            else:
                found.append(self._one_by_one(line))
        if n < len(words):
            found.append(self._one_by_one(words[n:]))
        x, n_x, y, n_y, fit = map(np.concatenate, zip(*found))
        self.a.add(x, n_x)
        self.b.add(y, n_y)
        self.fit = np.concatenate([self.fit, fit])
        seen = np.concatenate([self.seen, hashes])
        order = np.argsort(seen, kind="stable")
        self.place = np.concatenate([self.place, base + np.arange(len(hashes))])[order]
        self.seen = seen[order]

    @staticmethod
    def _apart(ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """How many tokens each word has, if tokens end where words do."""
        stop = np.cumsum(sizes[ids])
        at = np.searchsorted(stop, ends)
        if not len(stop) or stop[-1] != ends[-1] or (stop[np.minimum(at, len(stop) - 1)] != ends).any():
            return None
        return np.diff(at + 1, prepend=0)

    def _one_by_one(self, words: list[bytes]):
        texts = [w.decode("utf-8", "replace") for w in words]
        a = [e.ids for e in self.m.a.encode_batch(texts, add_special_tokens=False)]
        # B puts a blank before what it gets, unless it gets nothing
        b = [c if len(t) > 1 else [self.blank] for c, t in zip(self.m.b.encode([t[1:] for t in texts], num_threads=1), texts)]
        spell = lambda coded, of, w: b"".join([of[i] for i in coded]) == w
        fit = [spell(x, self.m.bytes_a, w) and spell(y, self.m.bytes_b, w) for x, y, w in zip(a, b, words)]
        flat = lambda coded: (np.array([i for c in coded for i in c], np.int32), np.array([len(c) for c in coded], np.int64))
        return *flat(a), *flat(b), np.array(fit, np.bool_)

    def words(self, raw: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The number of each word; words lie from each start to the next."""
        end = np.append(start[1:], len(raw))
        every, first, which = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        if len(self.seen) + len(every) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(~np.isin(every, self.seen, assume_unique=True))
        if len(new):
            data = raw.tobytes()
            self.learn(every[new], [data[x:y] for x, y in zip(start[first[new]].tolist(), end[first[new]].tolist())])
        return self.place[np.searchsorted(self.seen, every)][which]


# --- cuts -------------------------------------------------------------------------------

def shared_ends(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Indexes of the ends in a[lo:hi], for all intervals, that are also in b; a and b are sorted.

    An interval looks its middle end up in b by bisection. If b has it, it is a cut and both halves go on; if not, the ends next to
    those already looked up follow, the side with more left first. An interval is done when it has no end left.
    """
    cuts = [np.zeros(0, np.int64)]
    left = right = (lo + hi) // 2  # ends in [left, right) have been looked up and aren't shared
    live = lo < hi
    lo, hi, left, right = lo[live], hi[live], left[live], right[live]
    while len(lo):
        up = hi - right >= left - lo
        probe = np.where(up, right, left - 1)
        at = np.searchsorted(b, a[probe])
        found = b[np.minimum(at, len(b) - 1)] == a[probe]
        cuts.append(probe[found])
        left, right = np.where(up, left, probe), np.where(up, probe + 1, right)
        below = np.where(up, left, probe)[found]     # the lower half ends before the ends that were looked up
        above = np.where(up, probe + 1, right)[found]
        halves_lo, halves_hi = np.concatenate([lo[found], above]), np.concatenate([below, hi[found]])
        middle = (halves_lo + halves_hi) // 2
        miss = ~found
        lo, hi = np.concatenate([lo[miss], halves_lo]), np.concatenate([hi[miss], halves_hi])
        left, right = np.concatenate([left[miss], middle]), np.concatenate([right[miss], middle])
        live = (left > lo) | (right < hi)
        lo, hi, left, right = lo[live], hi[live], left[live], right[live]
    return np.sort(np.concatenate(cuts))


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. most-1 in one row, and their offsets."""
    if most not in _DIGITS:
        texts = [str(i).encode() for i in range(most)]
        _DIGITS[most] = (np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    return _DIGITS[most]


def written(a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray, last: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, a1,a2|b1;a3|b2,b3: the bytes and the offset behind each group.

    Group g has a[a_stop[g-1]:a_stop[g]] and b likewise; `last` tells groups that end a text, which no semicolon follows.
    """
    n_a, n_b = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    place_a, place_b = np.arange(len(a)) + (b_stop - n_b)[group_a], np.arange(len(b)) + a_stop[group_b]
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[a_stop - 1]] = ord("|")
    behind = place_b[b_stop - 1]
    mark[behind] = ord(";")
    digits, at = _digits(most)
    size = at[ids + 1] - at[ids]
    closed = np.ones(len(ids), np.int64)
    closed[behind[last]] = 0
    ends = np.cumsum(size + closed)
    starts = ends - size - closed
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    out[np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)] = digits[np.arange(size.sum()) + np.repeat(at[ids] - (np.cumsum(size) - size), size)]
    out[(starts + size)[closed > 0]] = mark[closed > 0]
    return out, ends[behind]


def _parts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts with a blank before each, and n + 1 offsets; a text beyond STEP comes alone, in parts that begin with a blank.

    A part ends where a word does, so tokens of both models end there too.
    """
    texts = len(offsets) - 1
    own = np.insert(raw, offsets[:-1], BLANK)
    offsets = offsets + np.arange(texts + 1)
    if texts != 1 or len(own) <= STEP:
        yield own, offsets
        return
    starts = word_starts(own)
    lo = 0
    while lo < len(own):
        cut = starts[np.searchsorted(starts, lo + STEP)] if len(starts) and starts[-1] >= lo + STEP else len(own)
        yield own[lo:cut], np.array([0, cut - lo])
        lo = int(cut)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted arrays as one, each value once."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


def _aligned(coder: Coder, raw: np.ndarray, offsets: np.ndarray):
    """n_a, n_b, n_groups, groups (bytes, offsets) and links (pair numbers, offsets) of each text, and whether all of its words fit."""
    n = len(offsets) - 1
    most = max(len(coder.m.bytes_a), len(coder.m.bytes_b))
    start = _merged(word_starts(raw), offsets[:-1])
    word = coder.words(raw, start)
    at = np.searchsorted(start, offsets)
    misfit = np.concatenate([[0], np.cumsum(~coder.fit[word])])
    fits = (misfit[at[1:]] == misfit[at[:-1]]) & (np.diff(offsets) > 1)
    kept = np.repeat(fits, np.diff(at))
    word = word[kept]
    at = np.concatenate([[0], np.cumsum(np.where(fits, np.diff(at), 0))])
    a, a_word = coder.a.of(word)
    b, b_word = coder.b.of(word)
    a_at, b_at = a_word[at], b_word[at]
    a_end, b_end = np.cumsum(coder.sizes_a[a]), np.cumsum(coder.sizes_b[b])
    # the last end of a text is shared; what lies before it is divided
    lasts = a_at[1:][fits] - 1
    inner = shared_ends(a_end, b_end, a_at[:-1][fits], lasts)
    cut = np.sort(np.concatenate([inner, lasts]), kind="stable")  # none is in both
    a_stop, b_stop = cut + 1, np.searchsorted(b_end, a_end[cut]) + 1
    text, behind = written(a, b, a_stop, b_stop, np.isin(cut, lasts, assume_unique=True), most)
    links = np.searchsorted(coder.m.pairs, a[cut].astype(np.int64) << 32 | b[b_stop - 1]).astype(np.int32)
    group_at = np.searchsorted(cut, a_at)
    text_at = np.concatenate([[0], behind])[group_at]
    return np.diff(a_at), np.diff(b_at), np.diff(group_at), (text, text_at), (links, group_at), fits


def _binary(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    data, width = np.ascontiguousarray(values).tobytes(), values.itemsize
    return [data[x * width:y * width] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


_CODERS: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """One coder for each worker process and pair of models."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(Models.read(*shared.value))
    return _CODERS[key]


def load(spark: SparkSession, a: str, b: str) -> Broadcast:
    """Both model files (paths that the driver can read), for all workers."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return spark.sparkContext.broadcast((f.read(), g.read()))


def align(docs: DataFrame, models: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, links: one row for each row of `docs`.

    `groups` is the text a1,a2|b1;a3|b2,b3 of ids; `links` has the number of each linked pair in `Models.pairs`, in order, as
    little-endian 32-bit integers. Texts that are null, empty or not spelled by both models' tokens have zeros and nothing. Ids may
    be null or repeat; other columns are not read. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    schema = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("links", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        coder = None
        for batch, raw, offsets in steps(batches, "text", STEP):
            coder = coder or _coder(models)
            n_a = n_b = n_groups = 0
            groups, links, fits = None, None, None
            for part, ends in _parts(raw, offsets):
                x, y, g, text, pair, fit = _aligned(coder, part, ends)
                n_a, n_b, n_groups = n_a + x, n_b + y, n_groups + g
                text, pair = _binary(*text), _binary(pair[0].astype("<i4"), pair[1])
                if groups is None:
                    groups, links, fits = text, pair, fit
                else:  # more of the batch's only text
                    groups, links, fits = groups + text, links + pair, fits & fit
            if len(groups) > batch.num_rows:
                groups, links = [b";".join(groups)], [b"".join(links)]
            if not fits.all():
                n_a, n_b, n_groups = (np.where(fits, v, 0) for v in (n_a, n_b, n_groups))
                groups, links = ([v if f else b"" for v, f in zip(values, fits.tolist())] for values in (groups, links))
            out = [pa.array(v, pa.int64()) for v in (n_a, n_b, n_groups)] + [pa.array(groups, pa.binary()).cast(pa.string()), pa.array(links, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], ["doc_id", *schema.names])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, links binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of the whole corpus hold each pair. A task hands on one row a pair, so sums stay as small as the vocabularies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for links in batch.column(0):
                n = np.bincount(np.frombuffer(links.as_buffer(), "<i4")) if links.is_valid else total[:0]
                if len(n) > len(total):
                    total, n = n.astype(np.int64), total
                total[:len(n)] += n
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], ["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_scores(aligned: DataFrame, counts: DataFrame, models: Broadcast) -> DataFrame:
    """`aligned` without its links, with n_links, n_best (links whose pair is its B id's most frequent, ties too) and count_sum.

    `counts` has at most a row for each pair that the vocabularies allow, so it goes to the driver and to all workers.
    """
    spark = aligned.sparkSession
    pairs = Models.read(*models.value).pairs
    found = counts.toArrow()
    n = np.zeros(len(pairs), np.int64)
    n[found["pair"].to_numpy()] = found["n"].to_numpy()
    best = np.zeros(int((pairs & 0xFFFFFFFF).max(initial=0)) + 1, np.int64)
    np.maximum.at(best, pairs & 0xFFFFFFFF, n)
    shared = spark.sparkContext.broadcast((n, n == best[pairs & 0xFFFFFFFF]))
    names = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, top = shared.value
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("links")]
            sums = [[len(x) for x in each], [int(top[x].sum()) for x in each], [int(count[x].sum()) for x in each]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(s, pa.int64()) for s in sums)],
                                             [*names, "n_links", "n_best", "count_sum"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links")
    return aligned.mapInArrow(run, f"{schema}, n_links long, n_best long, count_sum long")


def digests(docs: DataFrame, models: Broadcast, **columns) -> DataFrame:
    """The alignment's figures and the SHA-256 (lowercase hex) of its groups; '' for texts without tokens."""
    hashed = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    found = cut_lineage(align(docs, models, **columns).select("doc_id", "n_a", "n_b", "n_groups", hashed.alias("groups_sha256"), "links"), "token-align")
    return link_scores(found, pair_counts(found), models).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
