"""Ordinary kriging of a panel to the cells of a grid.

With a nugget of zero the kriging weights do not depend on the sill, and the range depends
on positions only. So all months with the same available points share one system. It is
solved in its dual form: one coefficient per point and month, and a surface value is the sum
of the cell's covariances times these coefficients plus the month's mean level. Months are
cut into parts and cells into blocks; every (block, bucket of parts) is a task of its own.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.operators.kriging_blocks import covariance, dual_coefficients
from panelspark.operators.nearest import has_position
from panelspark.operators.skew import spread
from panelspark.operators.timeline import every_kth_time
from panelspark.session import cut_lineage

DENSE_POINTS = 4000   # most points whose explicit weights are listed
POINTS_PER_TASK = 2000
MONTHS_PER_PART = 64
CELLS_PER_BLOCK = 1024


# --- variogram ------------------------------------------------------------------------

def variogram(panel: DataFrame, points: DataFrame, influence: float = 0.125,
              entity="entity_id", ts="ts", value="value") -> DataFrame:
    """(ts, range, sill, nugget) from the points that have a value at that time."""
    seen = panel.filter(F.col(value).isNotNull()).join(points, entity)
    dx, dy = F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")
    return seen.groupBy(ts).agg((F.sqrt(dx * dx + dy * dy) * influence).alias("range"),
                                F.var_pop(value).alias("sill"), F.lit(0.0).alias("nugget"))


def position_range(xy: np.ndarray, influence: float) -> float:
    return float(np.hypot(*(xy.max(0) - xy.min(0)))) * influence


def _bordered(xy, scale, alpha):
    n = len(xy)
    k = np.ones((n + 1, n + 1))
    k[:n, :n] = covariance(xy, xy, scale, alpha)
    k[n, n] = 0.0
    return k


# --- panels ---------------------------------------------------------------------------

def complete_entities(panel: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """Rows of the entities that have a value at every time of the panel."""
    n_times = panel.agg(F.count_distinct(F.col(ts))).scalar()
    full = (panel.groupBy(entity).agg(F.count(value).alias("_n"))
            .filter(F.col("_n") == n_times).select(entity))
    return panel.join(full, entity, "left_semi")


def site_series(panel: DataFrame, points: DataFrame, entity="entity_id", ts="ts",
                value="value", months_per_part: int = MONTHS_PER_PART) -> DataFrame:
    """(part, lon, lat, days, vals): values per position, months grouped into parts.

    Months of a part have the same set of available entities. Entities at the same position
    are averaged: the pseudo-inverse of the full system gives co-located points equal weights,
    so this is the same result from a regular system. Points without a position are left out.
    """
    points = points.filter(has_position())
    panel = panel.join(points.select(entity), entity, "left_semi")
    seen = panel.filter(F.col(value).isNotNull()).select(entity, ts, value)
    # order-free fingerprint of the entities present in a month
    pattern = F.concat_ws("-", F.count(F.lit(1)).cast("string"),
                          F.sum(F.xxhash64(entity).cast("decimal(38,0)")).cast("string"),
                          F.bit_xor(F.xxhash64(F.lit(7), F.col(entity))).cast("string"))
    months = seen.groupBy(ts).agg(pattern.alias("_p"))
    turn = F.row_number().over(Window.partitionBy("_p").orderBy(ts)) - 1
    part = F.concat_ws("#", "_p", F.floor(turn / months_per_part).cast("string"))
    months = months.select(ts, part.alias("part"))  # at most one row per calendar slot
    sites = (seen.join(F.broadcast(months), ts).join(points.select(entity, "lon", "lat"), entity)
             .groupBy("part", "lon", "lat", ts).agg(F.avg(value).alias("v")))
    series = F.sort_array(F.collect_list(F.struct(F.unix_date(F.col(ts).cast("date")).alias("day"), "v")))
    return (sites.groupBy("part", "lon", "lat").agg(series.alias("_s"))
            .select("part", "lon", "lat", F.col("_s.day").alias("days"), F.col("_s.v").alias("vals")))


# --- fields -----------------------------------------------------------------------------

def evaluate(cells: DataFrame, coef: DataFrame, alpha: float, n_months: int, ts="ts",
             value="value") -> DataFrame:
    """(ts, cell_id, row, col, lon, lat, value) of all cells and months.

    A task has one block of cells that exists, one bucket of parts and one chunk of points; the partial fields of the chunks are added.
    """
    buckets = max(1, math.ceil(n_months / MONTHS_PER_PART))
    largest = coef.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, math.ceil(largest / POINTS_PER_TASK))
    cells = cells.withColumn("block", F.floor(F.col("cell_id") / CELLS_PER_BLOCK).cast("int"))
    blocks = cells.select("block").distinct()
    pairs = (blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    left = cells.join(pairs, "block")
    right = (coef.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)).cast("int"))
             .withColumn("chunk", F.when(F.col("is_level"), 0).otherwise(F.pmod(F.xxhash64("lon", "lat", F.lit(5)), F.lit(chunks)).cast("int")))
             .join(pairs, ["bucket", "chunk"]))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # fresh column ids: both sides know the pairs
    names = ["cell_id", "row", "col", "lon", "lat"]

    def run(c: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        out = []
        at = c[["lon", "lat"]].to_numpy(float)
        for _, part in k.groupby("part", sort=False):
            level = part["is_level"].to_numpy(bool)
            beta = np.stack(part["beta"].to_list())
            field = np.repeat(beta[level].sum(0, keepdims=True), len(at), axis=0)
            if not level.all():
                xy = part.loc[~level, ["lon", "lat"]].to_numpy(float)
                field = field + covariance(at, xy, part["scale"].iloc[0], alpha) @ beta[~level]
            days = np.asarray(part["days"].iloc[0], dtype="datetime64[D]")
            rows = {n: np.repeat(c[n].to_numpy(), len(days)) for n in names}
            rows[ts] = np.tile(days, len(at)).astype(object)
            out.append(pd.DataFrame({**rows, value: field.ravel()}))
        if not out:
            return pd.DataFrame({n: [] for n in (*names, ts, value)}, dtype=object)
        return pd.concat(out, ignore_index=True)

    schema = f"cell_id bigint, row int, col int, lon double, lat double, {ts} date, {value} double"
    by = ("block", "bucket", "chunk")
    fields = spread(left, *by).groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, schema)
    return fields if chunks == 1 else fields.groupBy(*names, ts).agg(F.sum(value).alias(value))


def surfaces(panel: DataFrame, points: DataFrame, cells: DataFrame, influence: float = 0.125,
             alpha: float = 1.5, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """Surface of every month from the entities that have a value in that month."""
    n_months = panel.agg(F.count_distinct(F.col(ts))).first()[0]
    sites = cut_lineage(site_series(panel, points, entity, ts, value), "krige-series")
    coef = dual_coefficients(sites, influence, alpha)
    return evaluate(cells, coef, alpha, n_months, ts, value)


def krige_panel(panel: DataFrame, points: DataFrame, cells: DataFrame, influence: float = 0.125,
                alpha: float = 1.5, monthly_step: int = 1, entity="entity_id", ts="ts",
                value="value") -> DataFrame:
    """Complete entities -> every k-th month -> surfaces."""
    kept = every_kth_time(complete_entities(panel, entity, ts, value), monthly_step, ts)
    return surfaces(kept, points, cells, influence, alpha, entity, ts, value)


# --- explicit weights -----------------------------------------------------------------

def kriging_weights(cells: DataFrame, points: DataFrame, influence: float = 0.125,
                    alpha: float = 1.5, entity="entity_id", scale: float | None = None) -> DataFrame:
    """(cell_id, entity, w) for every cell and point; the weights of a cell sum to 1.

    The table has cells x points rows and each task inverts the system again, so this serves
    inspection and small point sets; `surfaces` never builds it.
    """
    if points.limit(DENSE_POINTS + 1).count() > DENSE_POINTS:
        raise ValueError(f"weights need at most {DENSE_POINTS} points; surfaces() has no such limit")
    cells = cells.select("cell_id", "lon", "lat",
                         F.floor(F.col("cell_id") / CELLS_PER_BLOCK).cast("int").alias("block"))
    last = cells.agg(F.max("block")).first()[0] or 0
    right = points.select(entity, "lon", "lat",
                          F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"))

    def run(c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if c.empty or p.empty:
            return pd.DataFrame({"cell_id": [], entity: [], "w": []}, dtype=object)
        xy = p[["lon", "lat"]].to_numpy(float)
        ell = position_range(xy, influence) if scale is None else scale
        inverse = np.linalg.pinv(_bordered(xy, ell, alpha), hermitian=True)
        rhs = np.ones((len(c), len(xy) + 1))
        rhs[:, :-1] = covariance(c[["lon", "lat"]].to_numpy(float), xy, ell, alpha)
        w = (rhs @ inverse)[:, :-1]
        return pd.DataFrame({"cell_id": np.repeat(c["cell_id"].to_numpy(), len(xy)),
                             entity: np.tile(p[entity].to_numpy(), len(c)), "w": w.ravel()})

    return (spread(cells, "block").groupBy("block").cogroup(right.groupBy("block"))
            .applyInPandas(run, f"cell_id bigint, {entity} string, w double"))


def apply_weights(weights: DataFrame, panel: DataFrame, entity="entity_id", ts="ts",
                  value="value") -> DataFrame:
    """(cell_id, ts, value): weighted sums, an ordinary join and aggregate."""
    return (weights.join(panel, entity).groupBy("cell_id", ts)
            .agg(F.sum(F.col("w") * F.col(value)).alias(value)))
