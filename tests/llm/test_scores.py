"""Language ID, toxicity and quality: the mathematics against plain versions, edges, and accuracy on held-out rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import TEXTS, rows_of
from pyspark.sql import functions as F

from panelspark.llm import language_id, quality, toxicity
from panelspark.llm.common import held_out, span_hashes, steps, words
from panelspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(pairs):
    ones, zeros = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def held_out_scores(spark, name, label):
    got = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"))
    return [(r[label], r.score, r.predicted) for r in got.filter("held_out").collect()]


def test_words_and_hashes():
    texts = [b"", b"ab cd", b" x", b"y ", b"zz", b"", b"cd"]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, end, at = words(raw, offsets, np.arange(256) == 32)
    got = [bytes(raw[a:b]) for a, b in zip(start, end)]
    assert got == [b"ab", b"cd", b"x", b"y", b"zz", b"cd"] and at.tolist() == [0, 0, 2, 3, 4, 5, 5, 6]
    h = span_hashes(raw, start, end)
    assert h[1] == h[5] and len(set(h.tolist())) == 5


def test_steps_bound_their_bytes():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "", "b" * 3, "c" * 40, "é"])}).slice(1)
    got = [(b.num_rows, raw.tobytes(), offsets.tolist()) for b, raw, offsets in steps(iter([batch]), "text", 8)]
    assert got == [(3, b"bbb", [0, 0, 0, 3]), (1, b"c" * 40, [0, 40]), (1, "é".encode(), [0, 2])]


# --- language

def test_languages_of_edge_texts(edge):
    model = language_id.train(edge.filter(F.col("doc_id") > 4))
    assert model.langs == ["en"]
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(edge, model, held_out(F.col("doc_id"))).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (9, "und"), (10, "en"), (5, "en"), (15, "en")} <= got
    assert language_id.identify(edge, model, held_out(F.col("doc_id"))).count() == len(TEXTS)


def test_languages_without_rows(edge, nothing):
    fold = held_out(F.col("doc_id"))
    empty = language_id.train(nothing)
    assert {(r.lang_pred, r.score) for r in language_id.identify(edge, empty, fold).collect()} == {("und", 0.0)}
    assert language_id.identify(nothing, empty, fold).count() == 0


def test_language_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "lang"), F.col("doc_id") == F.col("id"))
    rows = got.filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_codewords_are_apart():
    for k in (1, 2, 3, 5, 8, 40):
        code = language_id.codewords(k)
        assert len(code) == k and set(np.unique(code)) <= {-1, 1}
        if k > 1:
            apart = (code[:, None, :] != code[None]).sum(2) + 10**6 * np.eye(k, dtype=int)
            assert apart.min() >= max(1, code.shape[1] // 6)
            assert (np.abs(code.sum(0)) < k).all()


def test_ambiguity_is_flagged(spark):
    rows = [(i, "der die das und nicht " * 5, "de") for i in range(3)] + [(i + 3, "the and of that with " * 5, "en") for i in range(3)]
    docs = spark.createDataFrame([*rows, (9, "zzz", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs), F.lit(False)).collect()}
    assert got[0].lang_pred == "de" and got[4].lang_pred == "en" and not got[0].ambiguous and got[9].ambiguous


# --- toxicity

def kneser_ney(by_class, shared, discount):
    """log p(toxic) - log p(ordinary) of a padded word, in plain dictionaries."""
    n, top = toxicity.ORDER, []
    for texts in by_class:
        c = Counter()
        for w in texts:
            padded = b" " * (n - 1) + w + b" "
            c.update(padded[i:i + n] for i in range(len(padded) - n + 1))
        top.append({n: c})
    every = set(top[0][n]) | set(top[1][n])
    for c in top:
        for k in range(n - 1, toxicity.SHARED, -1):
            c[k] = Counter(g[1:] for g in c[k + 1])
    base, context = Counter(), Counter()
    for w in shared:
        padded = b" " * (n - 1) + w + b" "
        for i in range(len(padded) - n + 1):
            g = padded[i + n - toxicity.SHARED:i + n]
            base[g] += 1
            context[g[:-1]] += 1

    def p(c, g):
        if len(g) == toxicity.SHARED:
            return (base[g] + 0.5 / 256) / (context[g[:-1]] + 0.5)
        counts = {x: v for x, v in c[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(counts.values())
        if not total:
            return p(c, g[1:])
        kept = {x: max(v - discount, 0) for x, v in counts.items()}
        return kept.get(g, 0) / total + (1 - sum(kept.values()) / total) * p(c, g[1:])

    def gain(w):
        padded = b" " * (n - 1) + w + b" "
        return sum(np.log(p(top[1], padded[i:i + n])) - np.log(p(top[0], padded[i:i + n])) for i in range(len(padded) - n + 1))
    assert every
    return gain


def test_gains_are_kneser_ney(spark):
    rng = random.Random(2)
    make = lambda letters: bytes(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    ordinary, toxic = [make(b"aabbc") for _ in range(300)], [make(b"abcc") for _ in range(200)] + [b"abcab"] * 9
    text = lambda ws: " ".join(w.decode() for w in ws)
    docs = spark.createDataFrame([(text(ordinary), 0), (text(toxic), 1), (text([b"zzz"] * 3), None)], "text string, toxic int")
    top = (docs.filter("toxic IS NOT NULL").mapInArrow(toxicity._class_grams, "key long, n0 long, n1 long")
           .groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    shared = docs.mapInArrow(toxicity._shared_grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    model = toxicity.Model(toxicity._levels(top, shared, 2))
    gain = kneser_ney([ordinary, toxic], ordinary + toxic + [b"zzz"] * 3, 2)
    ask = [b"abcab", b"a", b"ccc", b"bbabab", b"zzz", b"xyz", b"abca", b"q", *[make(b"abcz") for _ in range(40)]]
    raw = np.frombuffer(b"".join(ask), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(w) for w in ask])])
    got = model.word_gains(raw, ends[:-1], ends[1:])
    assert np.allclose(got, [gain(w) for w in ask], atol=1e-9)


def test_toxicity_of_edge_texts_and_without_labels(spark, edge, nothing):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(20)] + [(5, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, toxic int, quality int")
    fold = held_out(F.col("doc_id"))
    for docs, marks in ((edge, labels), (edge, labels.limit(0)), (nothing, labels), (edge, labels.filter("toxic = 1"))):
        got = toxicity.score(docs, toxicity.train(docs, marks), fold).collect()
        assert len(got) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.filter_toxic(edge, labels).columns == edge.columns
    assert toxicity.filter_toxic(edge, labels.limit(0)).count() == len(TEXTS)


def test_toxicity_on_held_out_rows(spark):
    rows = held_out_scores(spark, "op7_toxicity", "toxic")
    assert auc([(y, s) for y, s, _ in rows]) > 0.85
    flagged = [y for y, _, p in rows if p]
    assert flagged and sum(flagged) / len(flagged) > 0.8


# --- quality

def test_gradients():
    rng = np.random.default_rng(0)
    net = quality.Network.start()
    net.out[:], net.bias[:] = rng.normal(0, 0.3, net.out.shape), 0.05  # off the bend at zero
    texts = [rng.integers(32, 120, k).astype(np.uint8) for k in (5, 300, 700, 0, 1)]
    raw, offsets = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    y = np.array([1, 0, 1, 0, 1.0])

    def loss():
        p = net.forward(raw, offsets)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    for p, g in zip(net.parameters(), net.gradients(raw, offsets, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, step = p[at], 2e-3
        p[at] = keep + step
        up = loss()
        p[at] = keep - step
        assert abs((up - loss()) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3
        p[at] = keep


def test_scores_don_t_depend_on_the_batch():
    net = quality.Network.start()
    net.out[:] = np.linspace(-1, 1, len(net.out))
    texts = [b"", b"a", b"abc" * 200, bytes(range(256)) * 9, b"x" * quality.SEGMENT, b"y" * (quality.SEGMENT + 1)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = net.forward(np.frombuffer(b"".join(texts), np.uint8), offsets)
    alone = [net.forward(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)
    # the end of a long text counts
    a, b = b"a" * 5000 + b"zq" * 200, b"a" * 5400
    assert net.forward(np.frombuffer(a, np.uint8), np.array([0, len(a)])) != net.forward(np.frombuffer(b, np.uint8), np.array([0, len(b)]))


def test_quality_of_edge_texts_and_without_labels(spark, edge, nothing):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(5, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, toxic int, quality int")
    fold = held_out(F.col("doc_id"))
    for docs, marks in ((edge, labels), (edge, labels.limit(0)), (nothing, labels)):
        got = quality.score(docs, quality.train(docs, marks, updates=5), fold).collect()
        assert len(got) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_on_held_out_rows(spark):
    rows = held_out_scores(spark, "op8_quality", "quality")
    assert auc([(y, s) for y, s, _ in rows]) > 0.9


def test_folds(edge):
    import zlib
    got = rows_of(edge.select("doc_id", held_out(F.col("doc_id")).alias("h")), "doc_id", "h")
    assert got == sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in TEXTS), key=repr)
