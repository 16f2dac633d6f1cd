"""Exact deduplication by a heavy-hitter split. DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Misra-Gries counters propose the frequent
digests; exact counts verify them; the verified winners, at most `k`, are broadcast and settle
their rows on the map side. All other digests take an ordinary shuffle, in which no group is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import LOWER, UPPER, heavy_hitters
from panelspark.session import cut_lineage


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the SHA-256 (lowercase hex) of the normalised text; a null text counts as empty."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))


def winners(keys: DataFrame, k: int = 256, share: int = 4096) -> DataFrame:
    """The digests that hold over 1/share of all rows, with exact group size and largest doc_id: at most k rows."""
    found = heavy_hitters(keys, "text_sha256", k)
    return (keys.join(F.broadcast(found), "text_sha256")
            .groupBy("text_sha256").agg(F.count(F.lit(1)).alias("hot_size"), F.max("doc_id").alias("hot_keep"))
            .filter(F.col("hot_size") > keys.count() / share))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 256,
                 share: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs`.

    Of equal texts the row with the largest doc_id stays. Repeated rows count in group_size and get
    a row each; all rows that carry the keep_id are `kept` (`deduplicate` leaves one of them). A null
    doc_id is smaller than any other; in a group of null ids only, keep_id is null and the rows are kept. Other
    columns are not read, so their names don't matter. An empty table gives no rows.
    """
    keys = cut_lineage(digests(docs, id_col, text_col), "digests")
    hot = cut_lineage(winners(keys, k, share), "winners")
    tagged = keys.join(F.broadcast(hot), "text_sha256", "left")
    settled = (tagged.filter("hot_size IS NOT NULL")
               .select("doc_id", F.col("hot_keep").alias("keep_id"), F.col("hot_size").alias("group_size"), "text_sha256"))
    group = Window.partitionBy("text_sha256")
    shuffled = (tagged.filter("hot_size IS NULL")
                .select("doc_id", F.max("doc_id").over(group).alias("keep_id"),
                        F.count(F.lit(1)).over(group).alias("group_size"), "text_sha256"))
    return (settled.unionByName(shuffled)
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that stay, with their columns; of rows that repeat a kept id one stays.

    Ids name documents: a null id is dropped if any row with a null id is a copy of a kept one.
    """
    groups = cut_lineage(exact_groups(docs, id_col, text_col, **how).select("doc_id", "kept"), "exact_groups")
    gone = groups.filter("NOT kept").select(F.col("doc_id").alias("__gone"))
    again = (groups.filter("kept").groupBy("doc_id").count().filter("count > 1")
             .select(F.col("doc_id").alias("__again")))
    # a merge join at any size: its shuffle grows with the input
    rows = docs.join(gone.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col("__gone")), "left_anti")
    if not again.limit(1).count():
        return rows
    twice = F.col(f"`{id_col}`").eqNullSafe(F.col("__again"))
    return rows.join(again, twice, "left_anti").unionByName(
        rows.join(again, twice, "left_semi").dropDuplicates([id_col, text_col]))
