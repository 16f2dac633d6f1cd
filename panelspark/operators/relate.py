"""Which other series help to predict a series: correlation and distance scores.

The best candidates of each target come from `best_relations`, which visits only blocks of
candidates that can hold one. A table of all relations has a row for every target and candidate, so
there every block of targets meets every block of candidates; entities are hashed into blocks of
a bounded number of series, compared as matrix products.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.operators.best_relations import BLOCK as BEST_BLOCK, best, compared, matrix
from panelspark.operators.nearest import has_position, nearest
from panelspark.operators.skew import attach, spread
from panelspark.session import cut_lineage

BLOCK = 256


def score_columns(weight_correlation: float = 0.7):
    """Weighted score; NULL when either part is missing."""
    return F.col("r") * weight_correlation + F.col("dist_score") * (1 - weight_correlation)


def comparison_rows(targets: DataFrame, candidates: DataFrame, entity="entity_id", ts="ts",
                    value="value", deletion: str = "listwise") -> DataFrame:
    """Target rows that take part in the correlation.

    'listwise' keeps a target's observed slots on which all other candidates have values;
    'pairwise' keeps all of its observed slots.
    """
    seen = targets.filter(F.col(value).isNotNull()).select(entity, ts, value)
    if deletion == "pairwise":
        return seen
    have = candidates.filter(F.col(value).isNotNull()).select(entity, ts)
    n_all = have.agg(F.count_distinct(F.col(entity))).scalar()
    per_slot = have.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"))  # calendar-sized
    own = have.withColumn("_own", F.lit(1))
    others = F.col("_n") - F.coalesce("_own", F.lit(0))
    member = have.select(entity).distinct().withColumn("_member", F.lit(1))
    return (seen.join(F.broadcast(per_slot), ts).join(own, [entity, ts], "left").join(member, entity, "left")
            .filter(others == n_all - F.coalesce("_member", F.lit(0)))
            .select(entity, ts, value))


def _vectors(panel, entity, ts, value):
    return panel.filter(F.col(value).isNotNull()).groupBy(entity).agg(
        F.collect_list(F.unix_date(F.col(ts).cast("date"))).alias("days"),
        F.collect_list(value).alias("vals"))


def _distances(a, b):
    d = a[:, None, :] - b[None, :, :]
    return np.sqrt((d * d).sum(-1))


def _blocks(df: DataFrame, n_blocks: int, entity, own: str, other: str) -> DataFrame:
    block = F.pmod(F.xxhash64(entity), F.lit(n_blocks)).cast("int")
    return df.select("*", block.alias(own)).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))


def _pairwise(left: DataFrame, right: DataFrame, n_blocks: int, entity, compare, schema) -> DataFrame:
    # fresh column ids: both sides may come from the same table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    a = spread(_blocks(left, n_blocks, entity, "_tb", "_cb"), "_tb", "_cb").groupBy("_tb", "_cb")
    b = _blocks(right, n_blocks, entity, "_cb", "_tb").groupBy("_tb", "_cb")
    empty = pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")}, dtype=object)

    def run(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return empty if t.empty or c.empty else compare(t.reset_index(drop=True), c.reset_index(drop=True))

    return a.cogroup(b).applyInPandas(run, schema)


def _n_blocks(entities: DataFrame, block: int = BLOCK) -> int:
    return max(1, math.ceil(entities.count() / block))


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by a chain from left to right and back."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy
    sides = []
    for ordered in (xy, xy[::-1]):
        chain: list = []
        for p in ordered:
            while len(chain) > 1 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                      - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                chain.pop()
            chain.append(p)
        sides.append(chain[:-1])
    return np.array(sides[0] + sides[1])


def hull(points: DataFrame) -> DataFrame:
    """(lon, lat): corners of the convex hull, first of every partition, then of all of those."""
    def corners(batches):
        found = np.zeros((0, 2))
        for pdf in batches:
            found = _hull(np.concatenate([found, pdf[["lon", "lat"]].to_numpy(float)]))
        yield pd.DataFrame(found, columns=["lon", "lat"])

    schema = "lon double, lat double"
    some = points.filter(has_position()).select("lon", "lat").mapInPandas(corners, schema)
    return some.repartition(1).mapInPandas(corners, schema)


def farthest(points: DataFrame, entity="entity_id", block: int = 65536) -> DataFrame:
    """(entity, d_max): distance to the farthest other point, in degrees; NULL without a position.

    The farthest point is a corner of the convex hull. Corners are taken `block` at a time.
    """
    corners = cut_lineage(hull(points), "hull").withColumn("_b", F.floor(F.monotonically_increasing_id() / block))
    out = points.select(F.col(entity), F.when(has_position(), F.col("lon")).alias("lon"), F.when(has_position(), F.col("lat")).alias("lat"))
    found = None
    for b in [r[0] for r in corners.select("_b").distinct().collect()]:
        xy = corners.filter(F.col("_b") == b).select("lon", "lat").toPandas().to_numpy(float)

        def run(batches, xy=xy):
            for pdf in batches:
                at = pdf[["lon", "lat"]].to_numpy(float)
                best = np.full(len(at), np.nan)
                for i in range(0, len(at), BLOCK):
                    best[i:i + BLOCK] = _distances(at[i:i + BLOCK], xy).max(1)
                yield pd.DataFrame({entity: pdf[entity], "d_max": pd.Series(best).astype(object).where(~np.isnan(best), None)})

        part = out.mapInPandas(run, f"{entity} {points.schema[entity].dataType.simpleString()}, d_max double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return out.select(entity, F.lit(None).cast("double").alias("d_max"))
    return found.groupBy(entity).agg(F.max("d_max").alias("d_max"))


def relations(targets: DataFrame, candidates: DataFrame, points: DataFrame,
              weight_correlation: float = 0.7, top: int | None = None,
              deletion: str = "listwise", entity="entity_id", ts="ts", value="value",
              block: int = BLOCK) -> DataFrame:
    """(target, candidate, r, dist_score, score), all candidates or at least the `top` best per target.

    `targets` are observed panels with gaps, `candidates` complete ones. r is the Pearson
    correlation, dist_score is 1 - d / d_max with the target's farthest candidate at 0. Where either
    point has no position, dist_score and score are NULL.
    """
    rows = comparison_rows(targets, candidates, entity, ts, value, deletion)
    far = farthest(points, entity)
    located = points.select(entity, "lon", "lat")
    t = (targets.select(entity).distinct().join(located, entity).join(far, entity)
         .join(_vectors(rows, entity, ts, value), entity, "left").withColumnRenamed(entity, "id"))
    c = (located.join(_vectors(candidates, entity, ts, value), entity)
         .withColumnRenamed(entity, "id"))
    w = weight_correlation

    # series of a single block need no bounds
    if top is not None and 0 <= w <= 1 and points.limit(min(block, BEST_BLOCK) + 1).count() > min(block, BEST_BLOCK):
        have = candidates.filter(F.col(value).isNotNull()).select(F.unix_date(F.col(ts).cast("date")).alias("d")).distinct()
        days = np.sort(have.toArrow()["d"].to_numpy().astype(np.int64))  # a calendar
        return best(t, c, days, w, top, min(block, BEST_BLOCK))

    def compare(a, b):
        used = [np.asarray(d) for d in a["days"] if d is not None]
        days = np.unique(np.concatenate(used)) if used else np.array([], int)
        return compared(a["id"].to_numpy(), a[["lon", "lat"]].to_numpy(float), a["d_max"].to_numpy(float), matrix(a["days"], a["vals"], days),
                        b["id"].to_numpy(), b[["lon", "lat"]].to_numpy(float), matrix(b["days"], b["vals"], days), w, top)

    schema = "target string, candidate string, r double, dist_score double, score double"
    return _pairwise(t, c, _n_blocks(points, block), "id", compare, schema)


def rank_candidates(rel: DataFrame) -> DataFrame:
    """Adds rank by descending score; missing scores last, ties by candidate."""
    w = Window.partitionBy("target").orderBy(F.col("score").desc_nulls_last(), "candidate")
    return rel.withColumn("rank", F.row_number().over(w))


def max_features(num_features: int, threshold: float, weight_correlation: float) -> int:
    """Upper limit of what `adaptive_top` can ask for: the lowest score is -weight_correlation."""
    return num_features + max(0, int(threshold * 10 - math.floor(-weight_correlation * 10)))


def adaptive_top(ranked: DataFrame, num_features: int = 5, threshold: float = 0.6) -> DataFrame:
    """Best candidates per target: `num_features`, and one more per tenth that their mean
    score (floored to tenths) misses the threshold by."""
    w = Window.partitionBy("target")
    mean = F.avg(F.when(F.col("rank") <= num_features, F.col("score"))).over(w)
    extra = (F.lit(threshold * 10) - F.floor(F.col("mean_score") * 10)).cast("int")
    return (ranked.withColumn("mean_score", mean)
            .withColumn("k", F.lit(num_features) + F.when(F.lit(threshold) > F.col("mean_score"), extra).otherwise(0))
            .filter(F.col("rank") <= F.col("k")))


def top_relations(targets, candidates, points, num_features=5, threshold=0.6,
                  weight_correlation=0.7, deletion="listwise", entity="entity_id", ts="ts",
                  value="value", block: int = BLOCK) -> DataFrame:
    """relations -> rank -> adaptive selection, with only the needed best kept per block."""
    top = max_features(num_features, threshold, weight_correlation)
    rel = relations(targets, candidates, points, weight_correlation, top, deletion,
                    entity, ts, value, block)
    return adaptive_top(rank_candidates(rel), num_features, threshold)


def relation_summary(ranked: DataFrame, num_features: int = 5) -> DataFrame:
    """Per target the mean r, distance score and score of its best candidates."""
    return (ranked.filter(F.col("rank") <= num_features).groupBy("target")
            .agg(F.avg("r").alias("r"), F.avg("dist_score").alias("dist_score"),
                 F.avg("score").alias("score")))


def neighbour_features(chosen: DataFrame, candidates: DataFrame, entity="entity_id", ts="ts",
                       value="value") -> DataFrame:
    """(entity, ts, neighbours): the chosen candidates' values per slot, ordered by rank.

    Slots on which a chosen candidate has no value are dropped. A candidate's series is one
    row; a candidate chosen by very many targets is repeated over partitions.
    """
    used = chosen.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))
    series = (candidates.filter(F.col(value).isNotNull())
              .join(used, F.col(entity) == F.col("candidate"))
              .groupBy("candidate").agg(F.first("n").alias("n"),
                                        F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(value).alias("v"))).alias("_s")))
    rows = attach(chosen.select("target", "candidate", "rank"), series, "candidate", spread="target")
    per_slot = (rows.select("target", "rank", F.inline("_s"))
                .groupBy("target", "ts").agg(F.sort_array(F.collect_list(F.struct("rank", "v"))).alias("_f")))
    size = chosen.groupBy("target").agg(F.count(F.lit(1)).alias("_k"))
    return (per_slot.join(size, "target").filter(F.size("_f") == F.col("_k"))
            .select(F.col("target").alias(entity), F.col("ts").alias(ts), F.col("_f.v").alias("neighbours")))


def nearest_points(points: DataFrame, k: int = 1, entity="entity_id") -> DataFrame:
    """(target, candidate, distance, rank): the k nearest other points, ties by candidate; points without a position drop out."""
    sites = points.select(F.col(entity).alias("candidate"), "lon", "lat")
    return nearest(points.select(F.col(entity).alias("target"), "lon", "lat"), sites, k, "target", "candidate", others_only=True)
