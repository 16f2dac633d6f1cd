"""Filter audit, chat formatting and token alignment against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import chat_format, filter_audit, token_align
from panelspark.llm.chat_template import Const, For, Output, TemplateError, Text, compile_template, fold_body, parse
from panelspark.llm.queries import ORACLE, QUERIES
from cases import LONG, TEXTS, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_chat_format", "op13_filter_audit"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toArrow(), con.sql(ORACLE[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    assert sorted(zip(*[got[c].to_pylist() for c in cols]), key=repr) == sorted(zip(*[want[c].to_pylist() for c in cols]), key=repr)


# --- filter audit -----------------------------------------------------------------------

def expected_masks(rows):
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, lang, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 bool(re.search(r"[#$%&*|]", text)), i is not None and i > least[text]]
        out.append((i, lang or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def expected_audit(masks, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {m[1] for m in masks}:
        mine = [m for m in masks if m[1] == part]
        shapley = collections.Counter()
        rows = []
        for order in itertools.permutations("ABCDE"):
            alive = list(mine)
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                removed, kept = [m for m in alive if m[2] & bit], [m for m in alive if not m[2] & bit]
                shapley[name] += len(removed)
                rows.append((part, "".join(order), step, len(kept), len(removed), sum(1 for m in mine if m[2] & bit) - len(removed),
                             sum(m[2] == bit for m in mine), sum(m[0] in good for m in removed), sum(m[0] in toxic for m in removed)))
                alive = kept
        for r in rows:
            out[r[:3]] = r[3:] + (shapley[r[1][r[2] - 1]],)
    return out


AUDIT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("bits", [None, 2])
def test_audit_equals_plain_filters(spark, monkeypatch, bits):
    if bits:  # a sketch so small that nothing is cleared
        monkeypatch.setattr(filter_audit, "MOST_BITS", 16)
        monkeypatch.setattr(filter_audit, "HASHES", 1)
    rng = random.Random(4)
    words = ["Aa", "b", "c#", "d", "E", "ff", "g|", "h"] + [f"w{i}" for i in range(300)]
    texts = [t for _, t in TEXTS] + [" ".join(rng.choices(words[:rng.choice([3, 8, 308])], k=rng.choice([3, 199, 200, 300]))) for _ in range(60)]
    rows = [(rng.choice([None, i, i, i, 7]), rng.choice(["en", "de", None, ""]), rng.choice(texts)) for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.choices([*range(0, 250, 2), None], k=150)]
    docs = spark.createDataFrame([r + (1, "x") for r in rows], "doc_id long, lang string, text string, mask int, sha string").repartition(5)
    flagged = filter_audit.flags(docs)
    masks = expected_masks(rows)
    assert rows_of(flagged, "doc_id", "part", "mask") == sorted(masks, key=repr)
    counts = filter_audit.mask_counts(flagged, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in AUDIT) for r in filter_audit.audit(counts).collect()}
    assert got == expected_audit(masks, labels)


def test_audit_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_counts(filter_audit.flags(nothing), labels)).count() == 0


def test_sketch_clears_unique_texts_and_no_other(spark):
    rows = (spark.range(30000).withColumn("t", F.when(F.col("id") < 10000, F.lit("hot")).when(F.col("id") < 11000, (F.col("id") % 500).cast("string")).otherwise(F.col("id").cast("string")))
            .select("id", F.unhex(F.sha2(F.col("t").cast("string"), 256)).alias("sha")).repartition(7))
    counters = filter_audit.sketch(rows, 18)
    sha = rows.toArrow()
    maybe = filter_audit.may_repeat(counters, filter_audit._positions(sha["sha"].combine_chunks(), 18))
    ids = sha["id"].to_numpy()
    assert maybe[ids < 11000].all()
    assert maybe[ids >= 11000].mean() < 0.06


# --- templates --------------------------------------------------------------------------

def rendered(source, **variables):
    return compile_template(source)(variables)[0]


def test_template_language():
    people = [{"name": "Ann", "age": 3}, {"name": "Bo", "age": None}]
    assert rendered("{% for p in people %}{{ loop.index }}:{{ p.name }}{% if not loop.last %}, {% endif %}{% endfor %}", people=people) == "1:Ann, 2:Bo"
    assert rendered("{{ people[1]['name'] | upper }}{{ people[-1].age | default('?') }}", people=people) == "BO?"
    assert rendered("a  {%- if 1 < 2 and 'x' in 'xyz' -%}  b  {%- else -%} c {%- endif %} d") == "ab d"
    assert rendered("{% if n == 1 %}one{% elif n == 2 %}two{% else %}many{% endif %}", n=2) == "two"
    assert rendered("{{ 'y' if n not in [1, 2] else 'n' }}{# nothing #}{{ 2 + 3 * 4 }}{{ 'a' ~ 1 ~ true ~ none }}", n=3) == "y14a1true"
    assert rendered("{% set x = 'out' %}{% for i in [1, 2] %}{% set x = x ~ i %}{{ x }} {% endfor %}{{ x }}") == "out1 out12 out"
    assert rendered("{{ missing }}{{ missing.field[3] | length }}{{ 'a%}b' }}".replace("%}", "")) == "0ab"
    assert rendered("{{ not not 'x' }}{{ -3 + 1 }}{{ 7 % 4 }}") == "true-23"


def test_spans_are_code_points_and_nested_marks_are_one():
    text, spans = compile_template("🙂{% generation %}{{ a }}{% generation %}b{% endgeneration %}{% endgeneration %}c{% generation %}{% endgeneration %}")({"a": "é🙂"})
    assert (text, [text[x:y] for x, y in spans]) == ("🙂é🙂bc", ["é🙂b", ""])


def test_constants_are_folded():
    tree = fold_body(parse("a{{ 'b' ~ (1 + 1) }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{% if false %}{{ y }}{% endif %}{{ ['p'][0] | upper }}"))
    assert tree == (Text("ab2cP"),)
    loop, = fold_body(parse("{% for x in [1, 2] %}{{ 'k' }}{{ x if true else 0 }}{% endfor %}"))
    assert isinstance(loop, For) and loop.over == Const([1, 2]) and loop.body[0] == Text("k") and isinstance(loop.body[1], Output)


@pytest.mark.parametrize("source", ["{{ a", "{% if a %}", "{% endfor %}", "{{ a | exec }}", "{{ a.b( }}", "{{ f(1) }}", "{{ 1 + }}", "{% for x of y %}{% endfor %}",
                                    "{{ " + "(" * 40 + "1" + ")" * 40 + " }}", "{% if 1 %}" * 30 + "{% endif %}" * 30, "{{ a ! b }}", "{% macro %}"])
def test_bad_templates_are_refused(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_templates_see_no_python_objects():
    class Thing:
        secret = "s"
    assert rendered("{{ x.secret }}{{ x.__class__ }}{{ 'a'.__class__ }}{{ x['secret'] }}", x=Thing()) == ""
    for source, error in (("{{ x }}", "not a text"), ("{{ 'a' * 9 }}", "numbers"), ("{{ 1 % 0 }}", "remainder"), ("{% for i in 3 %}{% endfor %}", "list"),
                          ("{{ 'a' < 1 }}", "order"), ("{{ 'a' | replace('b') }}", "replace")):
        with pytest.raises(TemplateError, match=error):
            compile_template(source)({"x": Thing()})


def test_rendering_is_the_same_from_several_threads():
    write = compile_template(chat_format.TEMPLATE, escape=chat_format.escape, escape_name=chat_format.escape_name)
    out = {}
    run = lambda k: out.update({k: [write({"messages": [{"role": "user", "text": str(k)}]})[0] for _ in range(200)]})
    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert all(set(v) == {f"### user:\n{k}\n</turn>\n"} for k, v in out.items())


# --- conversations ----------------------------------------------------------------------

def hard_texts(rng, n):
    bits = ["### ", "</turn>", "\\", "\\\\", "\n", "#", "/turn>", "<", "user:", "### user:\n", "\n</turn>\n", "é🙂", "x", " ", ":\n"]
    return ["".join(rng.choices(bits, k=rng.randrange(8))) for _ in range(n)]


def test_escaping_is_reversible():
    for t in hard_texts(random.Random(1), 5000):
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t
        assert not re.search(r"(?<!\\)(\\\\)*(### |</turn>)", e)
        assert chat_format.unescape_name(chat_format.escape_name(t)) == t and not re.search(r"\n|(?<!\\)(\\\\)*:", chat_format.escape_name(t))


def expected_conversations(rows):
    groups = collections.defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in groups.items():
        turns = [t[2:] for t in sorted(turns)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def test_conversations_read_back(spark):
    rng = random.Random(2)
    texts = hard_texts(rng, 300) + [None, "", LONG]
    roles = ["user", "assistant", "system", None, "", "a:b", "x\ny", "\\", "Assistant"]
    rows = [(rng.choice([None, -7, *range(20), 5, 5, 5, 5]), rng.choice([None, 0, 1, 2, 3]), rng.choice(roles), rng.choice(texts)) for _ in range(900)]
    rows += rows[:20]
    turns = spark.createDataFrame([r + ("x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss int").repartition(6)
    read = chat_format.read_back(chat_format.render(turns))
    got = rows_of(chat_format.digests(read), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == expected_conversations(rows)


def test_conversations_with_text_ids_and_own_template(spark):
    turns = spark.createDataFrame([("a", 1, "q", "two"), ("a", 0, "p", "one")], "c string, n int, who string, said string")
    row = chat_format.render(turns, "{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %}|{% endfor %}", "c", "n", "who", "said").collect()
    assert [(r.conv_id, r.formatted, [tuple(s) for s in r.loss]) for r in row] == [("a", "one|two|", [(0, 3), (4, 7)])]


def test_conversations_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.read_back(chat_format.render(turns))).count() == 0


# --- alignment --------------------------------------------------------------------------

def vocabularies():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_plainly(a, b, of_a, of_b, text):
    """Groups and links from both tokenizers' codes of the whole text; None if they don't spell it."""
    if not text:
        return None
    x, y, want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    if b"".join(of_a[i] for i in x) != want or b"".join(of_b[i] for i in y) != want:
        return None
    ends = lambda ids, of: list(itertools.accumulate(len(of[i]) for i in ids))
    behind = {e: j for j, e in enumerate(ends(y, of_b))}
    groups, links, i0, j0 = [], [], 0, 0
    for i, e in enumerate(ends(x, of_a)):
        if e in behind:
            j = behind[e]
            groups.append(",".join(map(str, x[i0:i + 1])) + "|" + ",".join(map(str, y[j0:j + 1])))
            links.append((x[i], y[j]))
            i0, j0 = i + 1, j + 1
    return len(x), len(y), len(groups), ";".join(groups), links


def expected_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    one, two = vocabularies()
    a, b = Tokenizer.from_file(one), sentencepiece.SentencePieceProcessor(model_file=two)
    a.encode_special_tokens = True
    of_a, of_b = token_align.bytes_of_a(a), token_align.bytes_of_b(b)
    done = {t: aligned_plainly(a, b, of_a, of_b, t) for t in {t for _, t in rows}}
    counts = collections.Counter(link for _, t in rows if done[t] for link in done[t][4])
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for i, t in rows:
        if not done[t]:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, groups, links = done[t]
        out.append((i, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=repr)


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
HARD = ["<|endoftext|> <s> </s> <unk> <0x0A>", "▁ a▁b", "a\0b", " ", "  ", "\n", "a \n b", "a\n  b", "x  y　 z  w", "tail  ", " lead", "é lá ñ 日本 語 🙂👍🏽",
        "a​ b", "﻿ b", "it's we'll  'tis", "\x1c x\x85 y", "ﬁ ①² Ⅷ", "=" * 700, "ab" * 3000]


def test_alignment_equals_whole_texts(spark, edge):
    rng = random.Random(8)
    bits = [" ", "  ", "\n", "\t", "the", "é", "'s", "日本", "x", "1", "…", " ", " ", "-", "A", "🙂", "ing"]
    rows = TEXTS + [(100 + i, t) for i, t in enumerate(HARD + ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(200)])]
    docs = spark.createDataFrame([r + (1, "x", 2.0) for r in rows], "doc_id long, text string, n_a int, links string, n double").repartition(5)
    got = rows_of(token_align.digests(docs, token_align.load(spark, *vocabularies())), *ALIGNED)
    assert got == expected_alignment(rows)


def test_long_texts_are_taken_in_parts(spark):
    base = "Straße, it's a  word\n\n and 12 more… "
    one, two = vocabularies()
    models = token_align.Models.read(open(one, encoding="utf-8").read(), open(two, "rb").read())
    coder = token_align.Coder(models)
    text = (base * 40000).encode()
    parts = list(token_align._parts(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    assert len(parts) > 1 and max(len(p[0]) for p in parts) < token_align.STEP + 100
    assert b"".join(p[0].tobytes() for p in parts) == b" " + text
    whole = token_align._aligned(coder, np.insert(np.frombuffer(text, np.uint8), 0, 32), np.array([0, len(text) + 1]))
    each = [token_align._aligned(coder, *p) for p in parts]
    assert b";".join(e[3][0].tobytes() for e in each) == whole[3][0].tobytes()
    assert sum(int(e[0][0]) for e in each) == whole[0][0]
    spelled = "".join(models.a.decode([int(x) for g in whole[3][0].tobytes().decode().split(";") for x in g.split("|")[0].split(",")]))
    assert spelled == " " + text.decode()


def test_alignment_of_nothing(spark, nothing):
    assert token_align.digests(nothing, token_align.load(spark, *vocabularies())).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_shared_ends_by_halves(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    a, b = (np.unique(rng.integers(0, n * int(rng.integers(1, 9)), n)) for _ in range(2))
    bounds = np.unique(rng.integers(0, len(a) + 1, 7))
    lo, hi = bounds[:-1], bounds[1:]
    want = [i for x, y in zip(lo, hi) for i in range(x, y) if a[i] in set(b.tolist())]
    assert token_align.shared_ends(a, b, lo, hi).tolist() == want
