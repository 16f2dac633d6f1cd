"""The registered queries of this subpackage and their SQL twins."""

from pyspark.sql import functions as F

from panelspark.llm import byte_bpe, chat_format, decontaminate, exact_dedup, filter_audit, html_extract, language_id, ngram_join, quality, suffix_dedup, token_align, toxicity, url_filter
from panelspark.llm.common import held_out

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def vocabulary() -> str:
    """Where the installed ranks of a public tokenizer lie."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op5_exact_dedup", """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
                  AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""")
def op5(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


# A capture is a page; its fetch time is arithmetic on its id, over the month that the events cover. Each event is a
# list entry for the host of the page whose id is the event's user_id: who adds, removes or allows follows its type.
FETCHED = "1704067200 + (page_id * 7919) % 2592000"


def list_log(spark, sf):
    pages = (table(spark, sf, "pages")
             .select(F.col("page_id").alias("user_id"), url_filter.host(F.col("url")).alias("host"),
                     F.filter(F.split(url_filter.path(F.col("url")), "/"), lambda x: x != "").alias("parts")))
    first = F.when(F.size("parts") > 0, F.col("parts")[0])
    kind = F.expr("CASE event_type WHEN 'error' THEN 'domain' WHEN 'click' THEN 'prefix' ELSE 'host' END")
    return (table(spark, sf, "events").join(pages, "user_id").filter("host <> ''")
            .select(kind.alias("kind"),
                    F.when(F.col("event_type") == "error", F.regexp_replace("host", r"^[^.]*\.", ""))
                    .when(F.col("event_type") == "click", F.concat_ws("/", "host", first)).otherwise(F.col("host")).alias("pattern"),
                    F.expr("CASE WHEN event_type = 'view' THEN 'none' WHEN event_type IN ('purchase') OR event_type = 'error' "
                           "AND value < 20 THEN 'allow' ELSE 'block' END").alias("verdict"),
                    F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq")))


@query("op9_url_filter", f"""
WITH p AS (
  SELECT page_id, url, {FETCHED} AS ts, lower(coalesce(regexp_extract(url, '{url_filter.HOST}', 1), '')) AS host,
         coalesce(list_filter(string_split(regexp_extract(url, '{url_filter.PATH}', 1), '/'), lambda x: x <> ''), []) AS parts
  FROM pages),
log AS (
  SELECT CASE event_type WHEN 'error' THEN 'domain' WHEN 'click' THEN 'prefix' ELSE 'host' END AS kind,
         CASE WHEN event_type = 'error' THEN regexp_replace(host, '^[^.]*\\.', '')
              WHEN event_type = 'click' THEN concat_ws('/', host, parts[1]) ELSE host END AS pattern,
         CASE WHEN event_type = 'view' THEN 'none' WHEN event_type = 'purchase' OR event_type = 'error' AND value < 20
              THEN 'allow' ELSE 'block' END AS verdict,
         CAST(floor(epoch(e.ts)) AS BIGINT) AS ts, event_id AS seq
  FROM events e JOIN p ON e.user_id = p.page_id WHERE host <> ''),
held AS (
  SELECT *, lead(ts) OVER (PARTITION BY kind, pattern ORDER BY ts, seq) AS to_s FROM log),
asked AS (
  SELECT page_id, ts, 'host' AS kind, host AS pattern, 1000 AS rank FROM p WHERE host <> ''
  UNION ALL
  SELECT page_id, ts, 'domain', list_aggregate(string_split(host, '.')[i:], 'string_agg', '.'), len(string_split(host, '.')) - i
  FROM (SELECT *, unnest(range(2, len(string_split(host, '.')))) AS i FROM p WHERE host <> '')
  UNION ALL
  SELECT page_id, ts, 'prefix', concat_ws('/', host, list_aggregate(parts[:i], 'string_agg', '/')), i + 2000
  FROM (SELECT *, unnest(range(1, least(len(parts), 2) + 1)) AS i FROM p WHERE host <> '')),
best AS (
  SELECT page_id, verdict, a.kind, a.pattern, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC) AS n
  FROM asked a JOIN held h ON a.kind = h.kind AND a.pattern = h.pattern AND a.ts >= h.ts AND (h.to_s IS NULL OR a.ts < h.to_s)
  WHERE verdict <> 'none')
SELECT p.page_id, p.url, CAST(p.ts AS BIGINT) AS fetched_s,
       CASE WHEN p.host = '' THEN 'unknown' ELSE coalesce(b.verdict, 'allow') END AS verdict, b.kind, b.pattern
FROM p LEFT JOIN best b ON p.page_id = b.page_id AND b.n = 1""")
def op9(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched_s"))
    said = url_filter.evaluate(pages.select(F.col("page_id").alias("capture_id"), "url", F.col("fetched_s").alias("ts")),
                               list_log(spark, sf))
    return (pages.join(said.withColumnRenamed("capture_id", "page_id"), "page_id")
            .select("page_id", "url", "fetched_s", "verdict", "kind", "pattern"))


@query("op2_decontaminate", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, w[i:i + k - 1] AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
pos AS (SELECT doc_id, k, i, w[i:i + k - 1] AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM win))),
hit AS (SELECT doc_id, k, i, item_id FROM pos JOIN win USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""")
def op2(spark, sf):
    return decontaminate.report(decontaminate.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


@query("op1_language_id")
def op1(spark, sf):
    docs = table(spark, sf, "documents")
    fold = held_out(F.col("doc_id"))
    return language_id.identify(docs, language_id.train(docs.filter(~fold)), fold)


@query("op7_toxicity")
def op7(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels), held_out(F.col("doc_id")))


@query("op8_quality")
def op8(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return quality.score(docs, quality.train(docs, labels), held_out(F.col("doc_id")))


@query("op3_byte_bpe")
def op3(spark, sf):
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf, "documents"), vocabulary()))


@query("op10_html_extract")
def op10(spark, sf):
    return html_extract.extract(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op6_ngram_join")
def op6(spark, sf):
    return ngram_join.link(table(spark, sf, "documents"))


@query("op4_suffix_dedup")
def op4(spark, sf):
    return (suffix_dedup.remove_repeats(table(spark, sf, "documents"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


@query("op11_token_align")
def op11(spark, sf):
    import public_tokenizers
    models = token_align.load(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_align.digests(table(spark, sf, "documents"), models)


#: A conversation whose texts look like a template's own marks.
HARD_TURNS = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


@query("op12_chat_format", r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)),
e AS (SELECT *, length(regexp_replace(text, '(\\*)(### |</turn>)', '\1\1\\\2', 'g')) AS n_text,
             length(role) + length(regexp_replace(role, '[^\\:\n]', '', 'g')) AS n_role FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             CAST(sum(n_text + n_role + 15) AS BIGINT) AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c""")
def op12(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD_TURNS, turns.schema)
    return chat_format.digests(chat_format.read_back(chat_format.render(turns.unionByName(hard))))


@query("op13_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
              100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
              regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > least, false)] AS fails
      FROM d JOIN least USING (text) LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o, substr('ABCDE', a.x, 1) || substr('ABCDE', b.x, 1) || substr('ABCDE', c.x, 1)
             || substr('ABCDE', d.x, 1) || substr('ABCDE', e.x, 1) AS filter_order
      FROM i a, i b, i c, i d, i e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (SELECT part, filter_order, step, n, good, toxic, fails[o[step]] AS own, o[step] AS letter,
             len(list_filter(fails, lambda x: x)) AS n_fails, len(list_filter(o[:step - 1], lambda x: fails[x])) > 0 AS before
      FROM m, s),
t AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT own AND NOT before), 0) AS kept,
             coalesce(sum(n) FILTER (own AND NOT before), 0) AS removed, coalesce(sum(n) FILTER (own AND before), 0) AS redundant,
             coalesce(sum(n) FILTER (own AND n_fails = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (own AND NOT before), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (own AND NOT before), 0) AS toxic_lost
      FROM r GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM t""")
def op13(spark, sf):
    flagged = filter_audit.flags(table(spark, sf, "documents"))
    return filter_audit.audit(filter_audit.mask_counts(flagged, table(spark, sf, "labels")))
