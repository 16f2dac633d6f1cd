"""URL filtering against lists that change over time. DataFrame functions only.

A list is a log of dated entries (pattern, kind, verdict, ts); an entry holds until the next one
for the same pattern and kind, so the log turns into validity intervals. Each capture asks for its
host, as a host and as a domain, its parent domains and its path prefixes, as long as the longest of the log, and an as-of join finds the entry that was active
when it was fetched. Intervals are cut at bucket borders, so a join key is (pattern, bucket) and
meets only the entries of one bucket; captures of hot patterns are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import LOWER, UPPER, heavy_hitters
from panelspark.session import cut_lineage

#: Kinds by precedence: a more specific one wins.
KINDS = ("domain", "host", "prefix")
#: Verdicts of log entries: the last one ends what was said before.
VERDICTS = ("block", "allow", "none")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """Host of a URL in lower case, '' if it has none or is null."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """Path without query and fragment, '' if it has none or is null."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def intervals(log: DataFrame) -> DataFrame:
    """pattern, kind, verdict, from_s, to_s (null: still holds) from a log with ts in seconds and a tie-breaking seq.

    Entries without pattern, kind or ts say nothing. Of entries at one second, the one with the largest seq holds.
    """
    order = Window.partitionBy("kind", "pattern").orderBy("ts", "seq")
    return (log.filter("pattern IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL")
            .select("pattern", "kind", "verdict", F.col("ts").alias("from_s"), F.lead("ts").over(order).alias("to_s"))
            .filter("(to_s IS NULL OR to_s > from_s) AND verdict IN ('block', 'allow')"))


def longest_prefix(entries: DataFrame) -> int:
    """Path segments of the longest pattern of kind prefix, 0 without one."""
    segments = F.size(F.filter(F.split("pattern", "/"), lambda x: x != "")) - 1
    return entries.filter("kind = 'prefix'").agg(F.max(segments)).first()[0] or 0


def asked(captures: DataFrame, depth: int = 2) -> DataFrame:
    """A row for each pattern that could name a capture: host, the host and its parents of two labels and more as domains, path prefixes."""
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"),
                           (F.size(labels) - i).alias("rank")))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    prefixes = F.when((F.size(parts) > 0) & (F.lit(depth) > 0), F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))),
        lambda i: F.struct(F.lit("prefix").alias("kind"),
                           F.concat_ws("/", "host", F.array_join(F.slice(parts, 1, i), "/")).alias("pattern"),
                           (i + 2000).alias("rank"))))
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern"), F.lit(1000).alias("rank")))
    none = F.expr("CAST(array() AS array<struct<kind:string,pattern:string,rank:int>>)")
    every = F.concat(own, domains, F.coalesce(prefixes, none))
    return (captures.filter("host <> '' AND ts IS NOT NULL").select("capture_id", "ts", F.explode(every).alias("k"))
            .select("capture_id", "ts", "k.kind", "k.pattern", "k.rank"))


def evaluate(captures: DataFrame, log: DataFrame, bucket_s: int = 7 * 86400, depth: int | None = None, salts: int = 32,
             k: int = 64) -> DataFrame:
    """capture_id, verdict, kind, pattern for every row of `captures` (capture_id, url, ts in seconds).

    The most specific active entry decides: prefix before host before domain, longer before shorter. Without an active
    entry the verdict is 'allow' with null kind and pattern; without host or ts it is 'unknown'. Repeated rows get a row
    each if their capture_id differs, and one row if it repeats (ids name captures); a null id is an id. Empty tables on
    either side work. Columns beyond the named ones are ignored. Path prefixes are asked for up to `depth` segments, by
    default those of the longest prefix in the log.
    """
    caps = cut_lineage(captures.select("capture_id", "ts", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")),
                       "captures")
    entries = intervals(log)
    if depth is None:
        entries = cut_lineage(entries, "entries")
        depth = longest_prefix(entries)
    want = asked(caps, depth).withColumn("bucket", F.floor(F.col("ts") / bucket_s))
    first, last = (x or 0 for x in caps.agg(F.min("ts"), F.max("ts")).first())
    held = (entries.filter(f"from_s <= {last} AND (to_s IS NULL OR to_s > {first})")
            .withColumn("to_s", F.coalesce("to_s", F.lit(last + 1)))
            .withColumn("bucket", F.explode(F.expr(f"sequence(floor(greatest(from_s, {first}) / {bucket_s}), "
                                                   f"floor(least(to_s - 1, {last}) / {bucket_s}))")))
            .select("kind", "pattern", "verdict", "from_s", "to_s", "bucket"))
    hot = heavy_hitters(want.select("pattern"), "pattern", k).withColumn("hot", F.lit(True))  # at most k rows
    want = (want.join(F.broadcast(hot), "pattern", "left")
            .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("capture_id", "ts"), F.lit(salts))).otherwise(0).cast("int")))
    held = (held.join(F.broadcast(hot), "pattern", "left")
            .withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))))
    w, h = want.alias("w"), held.alias("h")
    hits = (w.join(h, (F.col("w.pattern") == F.col("h.pattern")) & (F.col("w.kind") == F.col("h.kind"))
                   & (F.col("w.bucket") == F.col("h.bucket")) & (F.col("w.salt") == F.col("h.salt"))
                   & (F.col("w.ts") >= F.col("h.from_s")) & (F.col("w.ts") < F.col("h.to_s")))
            .select("capture_id", F.struct(F.col("w.rank").alias("rank"), F.col("h.verdict").alias("verdict"),
                                           F.col("w.kind").alias("kind"), F.col("w.pattern").alias("pattern")).alias("best")))
    default = caps.select("capture_id", F.struct(
        F.lit(-1).alias("rank"), F.when((F.col("host") == "") | F.col("ts").isNull(), "unknown").otherwise("allow").alias("verdict"),
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("pattern")).alias("best"))
    return (hits.unionByName(default).groupBy("capture_id").agg(F.max("best").alias("best"))
            .select("capture_id", "best.verdict", "best.kind", "best.pattern"))


def block(captures: DataFrame, log: DataFrame, **how) -> DataFrame:
    """The captures that no active entry blocks, with their columns."""
    bad = evaluate(captures, log, **how).filter("verdict = 'block'").select(F.col("capture_id").alias("__bad"))
    return captures.join(bad, F.col("capture_id").eqNullSafe(F.col("__bad")), "left_anti")
