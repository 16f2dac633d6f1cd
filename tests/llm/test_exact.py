"""Exact dedup, decontamination and URL filters against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, exact_dedup, url_filter
from panelspark.llm.queries import ORACLE, QUERIES
from cases import TEXTS, rows_of

SF = "/root/testdata/sf0.001"
LOWER = {chr(c): chr(c + 32) for c in range(65, 91)}


def low(text):
    return "".join(LOWER.get(c, c) for c in text or "")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toArrow(), con.sql(ORACLE[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    assert sorted(zip(*[got[c].to_pylist() for c in cols]), key=repr) == sorted(zip(*[want[c].to_pylist() for c in cols]), key=repr)


def expected_groups(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[low(t)].append(i)
    out = []
    for i, t in texts:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[low(t)]), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"share": 3}, {"k": 2, "share": 100}, {"share": 1}])
def test_exact_groups_whatever_is_hot(edge, how):
    got = rows_of(exact_dedup.exact_groups(edge, **how), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == expected_groups(TEXTS)


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.deduplicate(nothing).count() == 0


def test_deduplicate_keeps_columns_and_one_of_repeated_rows(edge):
    got = exact_dedup.deduplicate(edge)
    assert got.columns == edge.columns
    kept = sorted(r.doc_id for r in got.select("doc_id").collect())
    assert kept == sorted({keep for _, keep, *_ in expected_groups(TEXTS)})


def test_hot_group_of_a_third(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Same")).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(df.repartition(7))
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 AND keep_id = 2997").count() == 1000
    assert "hot" not in got.columns
    found = exact_dedup.winners(exact_dedup.digests(df), share=100).collect()
    assert [(r.hot_size, r.hot_keep) for r in found] == [(1000, 2997)]


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected_hits(texts, items, window=13):
    windows = defaultdict(set)
    for name, t in items:
        w = WORD.findall(low(t))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i:i + k])].add(name)
    sizes = sorted({len(w) for w in windows})
    out = []
    for i, t in texts:
        w, hit, names = WORD.findall(low(t)), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                found = windows.get(tuple(w[a:a + k]))
                if found:
                    hit.update(range(a, a + k))
                    names |= {str(x) for x in found if x is not None}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away from the big, bad wolf"), (2, None), (3, ""), (4, "???"),
         (5, "Straße àé"), (10, "two THREE four"), (10, "two three four"), (None, "word5 word6"), (6, "word5"), (7, "zzz " * 40),
         (8, " ".join(f"word{i}" for i in range(100, 140)))]
COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_decontamination_by_any_shards(spark, edge, shard_bytes):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    want = expected_hits(TEXTS, ITEMS)
    assert rows_of(decontaminate.report(decontaminate.scan(edge, items, shard_bytes=shard_bytes)), *COLS) == want
    clean = decontaminate.decontaminate(edge, items, shard_bytes=shard_bytes)
    assert clean.columns == edge.columns
    assert rows_of(clean, "doc_id") == sorted(((r[0],) for r in want if not r[5]), key=repr)


def test_decontamination_of_random_words(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 30]) + 4)) for i in range(12)]
    docs = [(i, text(rng.randint(0, 300)) + " " + rng.choice(items)[1]) for i in range(80)]
    got = decontaminate.report(decontaminate.scan(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")))
    assert rows_of(got, *COLS) == expected_hits(docs, items)


def test_decontamination_takes_one_shard_at_a_time(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, text(rng.randint(2, 16))) for i in range(12)]
    items += [(100 + i, items[0][1]) for i in range(30)] + [(None, items[1][1])]
    docs = [(i, text(rng.randint(20, 150)) + " " + rng.choice(items)[1]) for i in range(60)]
    docs.append((60, " ".join([*(t for _, t in items[:12]), text(200)])))  # hits of all shards add up
    steps, cut, build = [], decontaminate.cut_lineage, decontaminate.Automaton.__init__
    monkeypatch.setattr(decontaminate, "cut_lineage", lambda *a: steps.append("cut") or cut(*a))
    monkeypatch.setattr(decontaminate.Automaton, "__init__", lambda self, rows, window: steps.append([t for _, t in rows]) or build(self, rows, window))
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    want = expected_hits(docs, items)
    clean = decontaminate.decontaminate(d, b, shard_bytes=60)
    assert rows_of(clean, "doc_id") == sorted(((r[0],) for r in want if not r[5]), key=repr) and 0 < clean.count() < len(docs)
    built = [x for x in steps if x != "cut"]
    assert len(built) > 2 and steps.count("cut") == len(built) - 1 and steps[2] == "cut"
    assert sorted(t for x in built for t in x) == sorted({t.encode() for _, t in items})  # an entry for each text
    steps.clear()
    assert rows_of(decontaminate.report(decontaminate.scan(d, b, shard_bytes=60)), *COLS) == want
    assert sorted(t for x in steps if x != "cut" for t in x) == sorted({t.encode() for _, t in items})


def test_decontamination_without_rows(spark, edge, nothing):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert decontaminate.scan(nothing, items).count() == 0
    assert {r.n_hit for r in decontaminate.scan(edge, items.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(edge, items.limit(0)).count() == len(TEXTS)


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Well, one two THREE four! five"), (2, "one two"), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "two three four")], "item_id int, text string")
    assert rows_of(decontaminate.remove_spans(docs, items), "doc_id", "text") == [(1, "Well, one ! five"), (2, "one two"), (3, None)]
    whole = decontaminate.remove_spans(docs, items, longer_than=3)
    assert rows_of(whole, "doc_id", "text") == [(1, "Well, one two THREE four! five"), (2, "one two"), (3, None)]


# --- URL filters

LOG = [("evil.com", "domain", "block", 100, 1), ("good.evil.com", "host", "allow", 200, 2), ("good.evil.com", "host", "none", 300, 3),
       ("good.evil.com/x", "prefix", "block", 250, 4), ("a.b.c.org", "host", "block", 100, 5), ("a.b.c.org", "host", "allow", 100, 6),
       (None, "host", "block", 1, 7), ("c.org", None, "block", 1, 8), ("c.org", "domain", "block", None, 9), ("evil.com", "domain", "none", 10**7, 10)]
CAPTURES = [(1, "http://good.evil.com/y", 150), (2, "https://user:pw@GOOD.evil.com:80/x/z?q#f", 250), (3, "http://good.evil.com", 299), (4, "http://good.evil.com/", 300),
            (5, "http://a.b.c.org/", 100), (6, "http://a.b.c.org/", 99), (7, None, 5), (8, "nonsense", 5), (9, "http://x.org", None), (10, "http://www.evil.com", 10**7),
            (11, "http://www.evil.com", 10**7 - 1), (12, "", 3)]
WANT = [(1, "block", "domain", "evil.com"), (2, "block", "prefix", "good.evil.com/x"), (3, "allow", "host", "good.evil.com"),
        (4, "block", "domain", "evil.com"), (5, "allow", "host", "a.b.c.org"), (6, "allow", None, None), (7, "unknown", None, None),
        (8, "unknown", None, None), (9, "unknown", None, None), (10, "allow", None, None), (11, "block", "domain", "evil.com"), (12, "unknown", None, None)]


@pytest.mark.parametrize("bucket_s", [1, 7, 604800])
def test_url_filter(spark, bucket_s):
    if bucket_s == 1:
        captures, log = [c for c in CAPTURES if not c[2] or c[2] < 1000], LOG[:-1]
    else:
        captures, log = (CAPTURES, LOG) if bucket_s > 7 else (CAPTURES[:9], LOG)
    caps = spark.createDataFrame(captures, "capture_id int, url string, ts long").withColumn("verdict", F.lit("x"))
    entries = spark.createDataFrame(log, "pattern string, kind string, verdict string, ts long, seq int")
    ids = {c[0] for c in captures}
    assert rows_of(url_filter.evaluate(caps, entries, bucket_s=bucket_s), "capture_id", "verdict", "kind", "pattern") == sorted((w for w in WANT if w[0] in ids), key=repr)


def test_url_filter_long_prefixes_and_own_domain(spark):
    log = [("a.org/1/2/3", "prefix", "block", 1, 1), ("a.org/1", "prefix", "allow", 1, 2), ("a.org/1/2/3/4/5", "prefix", "allow", 1, 3),
           ("example.com", "domain", "block", 1, 4), ("localhost", "domain", "block", 1, 5), ("b.c.org", "domain", "allow", 1, 6), ("c.org", "domain", "block", 1, 7),
           ("com", "domain", "block", 1, 8)]
    captures = [(1, "http://a.org/1/2/3/x"), (2, "http://a.org/1/2/"), (3, "http://a.org/1//2/3/4/5/6"), (4, "http://example.com/"), (5, "http://www.example.com"),
                (6, "http://localhost:80/"), (7, "http://b.c.org"), (8, "http://c.org/1"), (9, "http://a.org"), (10, "http://notexample.com")]
    want = [(1, "block", "prefix", "a.org/1/2/3"), (2, "allow", "prefix", "a.org/1"), (3, "allow", "prefix", "a.org/1/2/3/4/5"), (4, "block", "domain", "example.com"),
            (5, "block", "domain", "example.com"), (6, "block", "domain", "localhost"), (7, "allow", "domain", "b.c.org"), (8, "block", "domain", "c.org"),
            (9, "allow", None, None), (10, "allow", None, None)]
    caps = spark.createDataFrame([(i, u, 5) for i, u in captures], "capture_id int, url string, ts long")
    entries = spark.createDataFrame(log, "pattern string, kind string, verdict string, ts long, seq int")
    assert rows_of(url_filter.evaluate(caps, entries), "capture_id", "verdict", "kind", "pattern") == sorted(want, key=repr)
    assert sorted(r.capture_id for r in url_filter.block(caps, entries).collect()) == [2, 3, 7, 9, 10]
    hosts = entries.filter("kind = 'domain'")
    assert sorted(r.capture_id for r in url_filter.block(caps, hosts).collect()) == [1, 2, 3, 7, 9, 10]


def test_url_filter_without_rows(spark):
    caps = spark.createDataFrame(CAPTURES, "capture_id int, url string, ts long")
    entries = spark.createDataFrame(LOG, "pattern string, kind string, verdict string, ts long, seq int")
    assert url_filter.evaluate(caps.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.evaluate(caps, entries.limit(0)).collect()} == {"allow", "unknown"}
    assert sorted(r.capture_id for r in url_filter.block(caps, entries).collect()) == [w[0] for w in WANT if w[1] != "block"]
