"""Byte-level BPE, HTML extraction and the pipeline."""

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from cases import TEXTS, rows_of
from test_dedup import expected_components
from test_exact import expected_groups, expected_hits

import corpus_pipeline
from panelspark.llm import byte_bpe, html_extract, toxicity
from panelspark.llm.common import steps
from panelspark.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    with open(vocabulary(), "rb") as f:
        return byte_bpe.Coder(byte_bpe.Vocabulary.read(f.read()))


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.vocab.ranks, special_tokens={})


def expected_codes(reference, texts):
    out = []
    for i, t in texts:
        ids = reference.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


CODED = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_split_is_the_pattern():
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    pattern, rng = regex.compile(byte_bpe.PATTERN), random.Random(4)
    parts = ["'s", "'re", "'", "'ll", " ", "  ", "\n", "\t", "\xa0", "　", "a", "bc", "É", "1", "²", "!", "%%", "日", "🙂", "'S", "\r\n", "\x1c", "\x85", "_", "Ⅷ", "d"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [o + m.start() for o, t in zip(offsets, texts) for m in pattern.finditer(t)]
    assert byte_bpe.split(points, offsets).tolist() == want


def test_codes_of_random_texts(coder, reference):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["ab", "the", " ", "ing", "é", "x", "\n", "'t", "99", "!!"]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 4000, "".join(chr(rng.randint(97, 122)) for _ in range(2000)), "!?" * 800, "é" * 300, "x" * byte_bpe.LONG, "x" * (byte_bpe.LONG + 1)]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    coder.forget()
    for _ in range(2):  # new pieces, then remembered ones
        ids, at, decoded, d_at = coder.code(np.frombuffer(b"".join(data), np.uint8), offsets)
        for k, t in enumerate(texts):
            assert ids[at[k]:at[k + 1]].tolist() == reference.encode_ordinary(t)
            assert decoded[d_at[k]:d_at[k + 1]].tobytes() == data[k]


def test_pieces_are_forgotten(coder, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    for t in ("one two three four", "five six seven eight nine", "one nine ten eleven"):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert coder.code(raw, np.array([0, len(raw)]))[0].tolist() == reference.encode_ordinary(t)


def test_a_step_takes_a_bounded_part_of_a_worker(coder):
    rng = random.Random(6)
    some = [f"word{rng.randrange(5000)}" for _ in range(60_000)]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(some[k:k + 600]) for k in range(0, 60_000, 600)] * 8})
    coder.forget()
    tracemalloc.start()
    try:
        for _, raw, offsets in steps(iter([batch]), "text", byte_bpe.STEP):
            coder.code(raw, offsets)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20, peak >> 20  # two workers share an executor with a JVM that has filled its heap


def test_codes_of_edge_texts(edge, reference):
    got = byte_bpe.digests(byte_bpe.encode(edge, vocabulary()))
    assert rows_of(got, *CODED) == expected_codes(reference, TEXTS)


def test_codes_of_nothing(nothing):
    assert byte_bpe.encode(nothing, vocabulary()).count() == 0


def test_bpe_query(spark, reference):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op3_byte_bpe"](spark, SF), *CODED) == expected_codes(reference, texts)


# --- pages

PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/x>y'>Menu</a></nav><article><h1>A &amp; B</h1><p>one <b>t</b>wo<br>three"
     "<p>four&nbsp;&#233;</p><script>var a='</p>';</script><!-- x --><div class=\"ad\">buy</div></article><footer>f</footer></body></html>", "A & B one two three four é"),
    ("<body><header>H</header><main><section><p>x</p></section><aside>s</aside><form><p>f</p></form><div id='comments'><article>c</article></div></main>", "x"),
    ("<article><header><h2>Head</h2><p>by me</p></header><p>text</p><ul><li>1<li>2</ul><table><tr><td>c1<td>c2</table></article>", "Head text 1 2 c1 c2"),
    ("<article><p>unclosed <i>inline<p>next", "unclosed inline next"),
    ("<ARTICLE><P>upper</P></DIV><p>still</p></ARTICLE><div>out</div>", "upper still"),
    ("", ""), (None, ""), ("   ", ""), ("<", "<"), ("<article></article>", ""), ("<script>x", ""), ("plain", "plain"),
    ("<div class='cookie-notice'>c</div><p>open</p><div hidden>h</div><div role=navigation>n</div>", "open"),
]


def test_main_text_of_pages(spark):
    rows = [(k, f"http://h{k}.org/", p, "x") for k, (p, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = rows_of(html_extract.extract(pages), "page_id", "text")
    assert got == sorted(((k, t) for k, (_, t) in enumerate(PAGES)), key=repr)
    assert html_extract.extract(pages.limit(0)).count() == 0


SLUGS = [
    ('<article class="post category-social tag-search comments-open"><p>a</p><section id="discussion"><p>b</p></section><h2 id="search-and-rescue">c</h2>'
     '<section id="related-work"><h2>d</h2><p>e</p></section><div class="section" id="share-price">f</div><h3 id="notice">g</h3></article>', "a b c d e f g"),
    ('<article class="social"><p>a</p></article>', "a"),
    ('<div class="layout has-comments no-sidebar" id="search-page"><article><p>a</p></article></div>', "a"),
    ('<article><section id="navbar"><h2>Navbar</h2><p>a</p></section><section id="ad-slots"><h2>Ad <i>slots</i></h2><p>b</p></section></article>', "Navbar a Ad slots b"),
    ('<article><p>a</p><div class="ad">x</div><div class="ad-container-2">x</div><ul class="share-buttons"><li>x</li></ul><div id="comments"><p>x</p></div>'
     '<section id="comments"><h2>Comments</h2></section><div id="sidebar">x</div><div id="cookie-banner">x</div><div class="related-posts">x</div><p>b</p></article>', "a b"),
    ('<main><article class="post"><p>a</p><article class="comment"><p>x</p></article></article><article class="ad">x</article></main>', "a"),
    ('<main><p>a</p></main><div class="sidebar"><article class="teaser">x</article></div><div class="comment-list"><article>x</article></div>', "a"),
    ('<div class="category-social">a</div><p id="related-work">b</p><div class="cookie-banner">x</div><div id="menu">x</div>', "a b"),
    ('<section id="discussion"><article>a</article></section>', "a"),
]


def test_slugs_are_not_chrome(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}.org/", p) for k, (p, _) in enumerate(SLUGS)], "page_id long, url string, html string")
    assert rows_of(html_extract.extract(pages), "page_id", "text") == [(k, t) for k, (_, t) in enumerate(SLUGS)]


@pytest.mark.parametrize("group", [html_extract.GROUP_TOKENS, 5])
def test_boilerplate_of_a_host_is_cut(spark, monkeypatch, group):
    monkeypatch.setattr(html_extract, "GROUP_TOKENS", group)
    line = "we use this very long line on each of our many pages"
    pages = [(k, "http://a.org/p" if k != 3 else "http://b.org", f"<div><p>unique text number {k} here</p><p>{line}</p><p>short</p></div>") for k in range(4)]
    pages += [(4, "http://a.org", f"<article>{line}</article>"), (4, "http://a.org", f"<article>{line}</article>"), (None, None, "<p>no address</p>")]
    got = rows_of(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id", "text")
    want = [(k, f"unique text number {k}") for k in range(3)]  # `here` and `short` stand beside the line on each of them
    assert got == sorted([*want, (3, f"unique text number 3 here {line} short"), (4, line), (4, line), (None, "no address")], key=repr)


@pytest.mark.parametrize("group", [html_extract.GROUP_TOKENS, 5])
def test_copies_of_a_page_are_one_page(spark, monkeypatch, group):
    monkeypatch.setattr(html_extract, "GROUP_TOKENS", group)
    line = "we use this very long line on each of our many pages"
    one, two = "<p>this page without any article was captured more than once</p>", f"<p>a second page that also has copies and a notice</p><p>{line}</p>"
    three = f"<p>{line}</p><p>the third page has the notice of the second one in front</p>"
    pages = [(0, "http://a.org/p", one), (1, "http://a.org/p", one), (2, "http://a.org/q", "<nav>at noon</nav>" + one.replace("<p>", "<div> ")), (3, "http://b.org", two),
             (4, "http://b.org", two), (5, "http://b.org", three), (6, "http://c.org", two), (7, "http://c.org", two)]
    got = rows_of(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id", "text")
    texts = [re.sub("<[^>]*>", " ", p).split() for p in (one, two, three)]
    want = [" ".join(texts[0])] * 3 + ["a second page that also has copies and a notice"] * 2 + ["the third page has the notice of the second one in front"]
    assert got == list(enumerate([*want, *[" ".join(texts[1])] * 2]))


NOTICE = "sign up to get all of our stories by mail each day"


@pytest.mark.parametrize("group", [html_extract.GROUP_TOKENS, 5])
def test_notices_inside_articles_are_cut(spark, monkeypatch, group):
    monkeypatch.setattr(html_extract, "GROUP_TOKENS", group)
    def own(k, n=20):
        return " ".join(f"w{k}x{j}" for j in range(n))
    shared = "a sentence of the prose that three of the pages quote word by word"
    pages = [(k, "http://a.org/p", f"<article><p>{own(k)}</p><div><p>{NOTICE}</p></div>{f'<p>{shared}</p>' if k < 3 else ''}<p>{own(k + 50)}</p></article>") for k in range(6)]
    pages += [(6, "http://a.org/q", f"<nav>other menu</nav>{pages[5][2]}")]  # a copy
    pages += [(7, "http://a.org", f"<main><p>{NOTICE}<p>{own(7, 9)}</main>"), (8, "http://a.org", f"<article><p>he said {NOTICE} and left {own(8)}</p></article>")]
    pages += [(20 + k, "http://b.org", p) for k, (_, _, p) in enumerate(pages[:4])]  # too few pages
    pages += [(30 + k, "http://c.org", f"<article><p>{own(90)}</p><p>{own(91)}</p><p>{own(k)}</p></article>") for k in range(6)]  # versions of one article
    pages += [(40 + k, "http://d.org", f"<article><p>{own(k)}</p><p>{NOTICE}</p></article>") for k in range(5) for _ in range(3)]
    pages += [(50 + k, "http://d.org", f"<article><p>{own(k + 50)}</p></article>") for k in range(5)]  # half of the texts, most of the rows
    got = rows_of(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id", "text")

    def text(p):
        return " ".join(re.sub("<nav>.*?</nav>|<[^>]*>", " ", p).split())
    want = [(k, text(p.replace(f"<p>{NOTICE}</p>", "") if k < 7 else p)) for k, _, p in pages]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("group", [html_extract.GROUP_TOKENS, 50])
def test_main_texts_against_windows(spark, monkeypatch, group):
    monkeypatch.setattr(html_extract, "GROUP_TOKENS", group)
    rng = np.random.default_rng(8)
    stock = [" ".join(f"s{rng.integers(0, 9)}" for _ in range(rng.integers(3, 14))) for _ in range(12)]
    pages = []
    for k in range(160):
        blocks = [" ".join(f"t{rng.integers(0, 40)}" for _ in range(rng.integers(1, 60))) for _ in range(rng.integers(1, 5))]
        some = rng.permutation(12)[:rng.integers(0, 5)] // 3
        for j in [*some, 11, 11][:rng.integers(0, 7)]:
            blocks.insert(rng.integers(0, len(blocks) + 1), stock[j])
        pages.append((f"h{rng.integers(0, 9) ** 2 // 9}", blocks))
    pages += [pages[j] for j in rng.integers(0, 160, 60)]
    texts, where = defaultdict(set), defaultdict(set)
    for host, blocks in pages:
        t = " ".join(blocks).split()
        texts[host].add(" ".join(t))
        for k in range(len(t) - 7):
            where[host, tuple(t[k:k + 8])].add(" ".join(t))
    want, n_cut = [], 0
    for host, blocks in pages:
        t, least = " ".join(blocks).split(), max(5, len(texts[host]) // 2 + 1)
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 7):
            if len(where[host, tuple(t[k:k + 8])]) >= least:
                gone[k:k + 8] = True
        kept, at = [], 0
        for b in blocks:
            n = len(b.split())
            if not gone[at:at + n].all():
                kept.append(b)
            at += n
        whole = 2 * len(" ".join(kept).split()) < len(t)
        n_cut += not whole and len(kept) < len(blocks)
        want.append(" ".join(blocks if whole else kept))
    assert 20 < n_cut < 200
    rows = [(k, f"http://{h}.org/{k}", f"<article>{''.join(f'<p>{b}</p>' for b in blocks)}</article>") for k, (h, blocks) in enumerate(pages)]
    got = rows_of(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)), "page_id", "text")
    assert sorted(got) == list(enumerate(want))


def test_repeated_runs_against_windows():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sequences = [rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint64) for _ in range(8)]
        page = rng.integers(0, 5, 8)
        where = defaultdict(set)
        for s, p in zip(sequences, page):
            for k in range(len(s) - 7):
                where[s[k:k + 8].tobytes()].add(p)
        for s, got in zip(sequences, html_extract.repeated_runs(sequences, page, page)):
            want = np.zeros(len(s), bool)
            for k in range(len(s) - 7):
                if len(where[s[k:k + 8].tobytes()]) > 1:
                    want[k:k + 8] = True
            assert (got == want).all()


def test_html_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op10_html_extract"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", pages[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inside)
        assert r.text == " ".join(html_extract.entities.unescape(plain).split()) and r.n_chars == len(r.text)


# --- pipeline

def test_pipeline_against_plain_stages(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert clean.columns == docs.columns
    model = toxicity.train(docs, labels)
    bad = {r.doc_id for r in toxicity.score(docs, model, toxicity.F.lit(False)).collect() if r.predicted}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rest = [(i, t) for i, t in texts if i not in bad]
    assert sorted(i for i, _ in rest) == sorted(r.doc_id for r in clean.collect())
    keep = {r[0] for r in expected_groups(rest) if r[3]}
    rest = [(i, t) for i, t in rest if i in keep]
    keep = {i for i, _, c in expected_components(rest) if i == c}
    rest = [(i, t) for i, t in rest if i in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keep = {r[0] for r in expected_hits(rest, items) if not r[5]}
    rest = [(i, t) for i, t in rest if i in keep]
    assert 0 < len(rest) < len(texts)
    assert rows_of(corpus_pipeline.run(spark, SF), *CODED) == expected_codes(reference, rest)


def test_stages_on_edge_rows(spark, edge, nothing):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge, nothing):
            got = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == docs.columns
            assert got.count() <= docs.count()


def test_every_operator_is_registered():
    from __spark_entry__ import queries
    names = list(queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
