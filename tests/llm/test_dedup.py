"""Suffix-array dedup and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import TEXTS, rows_of

from panelspark.llm import ngram_join, suffix_dedup
from panelspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- suffix arrays

def expected_rest(texts):
    owner = {}
    for i, t in texts:
        b = (t or "").encode()
        for k in range(len(b) - 49) if i is not None else ():
            w = b[k:k + 50]
            owner[w] = min(owner.get(w, i), i)
    out = []
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49) if i is not None else ():
            if owner[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def rest(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeats_are_removed_whatever_is_hot(edge, hot):
    short = [(i, t) for i, t in TEXTS]
    assert rest(suffix_dedup.remove_repeats(edge, hot=hot)) == expected_rest(short)


def test_repeats_of_passages_in_random_texts(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(rng.randint(40, 200)) for _ in range(6)]
    docs = [(rng.randint(-5, 10**12) if i % 9 else -i, "".join(rng.choice([text(rng.randint(0, 120)), rng.choice(passages)]) for _ in range(6))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rest(suffix_dedup.remove_repeats(df)) == expected_rest(docs)
    assert rest(suffix_dedup.remove_repeats(df, hot=2)) == expected_rest(docs)


def test_suffix_query(spark):
    got = rows_of(QUERIES["op4_suffix_dedup"](spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == expected_rest(documents(spark))


def test_suffix_dedup_of_nothing(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_bytes_are_sent_for_shared_anchors_only_and_spans_come_packed():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = text(300)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": [text(300) + passage + text(300) for _ in range(200)]})
    # of one half of the documents at a time, as by two tasks; a single bucket
    sent = pa.Table.from_batches([b for lo in (0, 100) for b in suffix_dedup._dealt(1)(iter([batch.slice(lo, 100)]))])
    assert sent["hashes"].nbytes < 0.9 * batch["text"].nbytes  # the pieces' own bytes are some four times the text
    found = suffix_dedup._matched(suffix_dedup.HOT, 3)(None, sent)
    assert found.num_rows <= 3 and len(set(found["part"].to_pylist())) == found.num_rows  # not one for each document
    rows = suffix_dedup._merged(None, found).to_pylist()
    assert sorted(r["doc"] for r in rows) == list(range(200))
    whole = [np.frombuffer(r["spans"], np.uint32).reshape(-1, 2) for r in rows if r["doc"]]
    assert all((s[:, 0] >= 300 - 2 * suffix_dedup.LENGTH).all() and (s[:, 1] <= 600 + 2 * suffix_dedup.LENGTH).all() and len(s) == 1 for s in whole)
    asked = sum(int(np.diff(np.frombuffer(r["wanted"], np.uint32).reshape(-1, 2).astype(int), axis=1).sum()) for r in rows)
    assert 0 < asked < 0.35 * 900 * 200  # where the passage begins and ends; every piece before, once the filter was full


def test_texts_are_shuffled_once(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = suffix_dedup.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet"))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plan.count("FileScan parquet [doc_id") <= 1 and "ReusedExchange" in plan


def test_column_wise_order_and_prefixes():
    rng = random.Random(1)
    for size in (1, 2, 9, 30):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 25))).encode() for _ in range(size)]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        piece, length, common = suffix_dedup.column_wise(np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16), ends)
        got = [strings[p][len(strings[p]) - n:] for p, n in zip(piece, length)]
        assert got == sorted(got) and len(got) == sum(len(s) + 1 for s in strings)
        assert len(set(zip(piece.tolist(), length.tolist()))) == len(got)
        for a, b, c in zip(got, got[1:], common[1:].tolist()):
            assert c == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


# --- n-gram join

def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.setdefault(i, []).append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i in sorted(x for x in sets if x is not None):
        for s in sets[i]:
            seen = Counter(j for g in s for j in where[g])
            for (j, n), c in seen.items():
                if 100 * c >= 75 * (len(s) + n - c):
                    a, b = sorted((find(i), find(j)))
                    up[b] = a
            for g in s:
                where[g].append((i, len(s)))
    return sorted(((i, len(s), find(i) if i is not None else None) for i in sets for s in sets[i]), key=repr)


def test_components_of_edge_texts(edge):
    assert rows_of(ngram_join.link(edge), "doc_id", "n_shingles", "component_id") == expected_components(TEXTS)


def test_ngram_query(spark):
    got = rows_of(QUERIES["op6_ngram_join"](spark, SF), "doc_id", "n_shingles", "component_id")
    assert got == expected_components(documents(spark))


def family(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_large_groups_and_common_passages(spark):
    """Near copies by the dozen and texts that share most of a passage, but not enough: hot keys of either kind."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(500)}"
    docs, passage = [], [word() for _ in range(60)]
    for size in (8, 20, 45, 90, 200, 400):
        for _ in range(2):
            base = [word() for _ in range(size)]
            docs += [family(rng, base, rng.randint(0, size // 18 + 1)) for _ in range(25)]
    for share in (10, 14, 18, 25, 40):
        docs += [" ".join(passage + [word() for _ in range(share)]) for _ in range(40)]
        docs += [" ".join([word() for _ in range(share // 2)] + passage + [word() for _ in range(share // 2)]) for _ in range(20)]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = rows_of(ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), "doc_id", "n_shingles", "component_id")
    assert got == expected_components(rows)


def test_chains_reach_their_least_id(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[3 * k:3 * k + 60])) for k in range(60)]
    got = rows_of(ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == expected_components(rows) and {r[2] for r in got} == {41}


def test_ngram_join_of_nothing(nothing):
    assert ngram_join.link(nothing).count() == 0
    assert ngram_join.keep_one(nothing).count() == 0


def test_one_of_each_component_stays(edge):
    got = ngram_join.keep_one(edge)
    assert got.columns == edge.columns
    want = sorted(((i,) for i, _, c in expected_components(TEXTS) if i == c), key=repr)
    assert rows_of(got, "doc_id") == want


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for n, m, both in ((5, 6, 5), (100, 120, 90), (700, 400, 300), (64, 64, 0)):
        every = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
        a, b = np.sort(every[:n]), np.sort(every[n - both:])
        x, y = ngram_join.fold(np.concatenate([a, b]), np.array([0, n, n + m]))
        assert ngram_join.distance(x, y) <= n + m - 2 * both
