"""Dual kriging coefficients for any number of positions.

A part (months with the same positions) that fits into a tile is one dense solve. Larger ones take conjugate gradients: positions are cut into
tiles by a tree, the covariance matrix multiplies all months at once through `cluster_matrix` (about n log n), and the preconditioner solves
each tile with the positions around it exactly and adds the solutions, so the number of steps hardly grows with n (some 25 to 40). A row of a table is a
tile with all of its months as one matrix. A step is two writes: the new residuals with their preconditioned form z, and the matrix's product with
z, from which the directions and their products follow without another one. So both sums that a step needs are taken at once.
Every month, and the unit vector that fixes the mean level, has its own relative residual.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelspark.operators.cluster_matrix import block_pairs, columns, contributions, covariance, far_pieces, packed, positions, product_of
from panelspark.operators.skew import spread
from panelspark.operators.tree import all_nodes, grow
from panelspark.session import cut_lineage

BLOCK = 512        # positions of a tile, at most
OVERLAP = 0.3      # by which a tile is widened for its solve, of its width and height
TOLERANCE = 1e-10  # residual against the right side, by month
PATIENCE = 100     # steps without a better residual, after which rounding is what is left

COEF_SCHEMA = "part string, is_level boolean, lon double, lat double, scale double, days array<int>, beta array<double>"


def dual_coefficients(sites: DataFrame, influence: float, alpha: float, block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """(part, is_level, lon, lat, scale, days, beta); the level row of a part has the mean level of each month."""
    n = sites.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    small = sites.join(n.filter(F.col("_n") <= block).select("part"), "part", "left_semi")
    large = n.filter(F.col("_n") > block).select("part")
    done = spread(small, "part").groupBy("part").applyInPandas(_solver(influence, alpha), COEF_SCHEMA)
    if not large.limit(1).count():
        return done
    return done.unionByName(_iterated(sites.join(large, "part", "left_semi"), influence, alpha, block, tolerance))


def _solver(influence: float, alpha: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["lon", "lat"]].to_numpy(float)
        scale = float(np.hypot(*np.ptp(xy, axis=0))) * influence
        k = np.ones((len(xy) + 1,) * 2)
        k[:-1, :-1], k[-1, -1] = covariance(xy, xy, scale, alpha), 0.0
        z = np.stack(pdf["vals"].to_list())
        beta = np.linalg.solve(k, np.vstack([z, np.zeros((1, z.shape[1]))]))
        return pd.DataFrame({"part": pdf["part"].iloc[0], "is_level": [False] * len(xy) + [True], "lon": [*xy[:, 0], None], "lat": [*xy[:, 1], None],
                             "scale": scale, "days": [pdf["days"].iloc[0]] * len(beta), "beta": list(beta)})
    return run


# --- tiles ------------------------------------------------------------------------------

TILES = "part string, node long, scale double, days array<int>, xy binary, b binary"
STATE = "part string, node long, scale double, xy binary, x binary, r binary, p binary, s binary"
DOTS = "rz array<double>, rr array<double>"


def tiles_of(sites: DataFrame, influence: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(tiles, nodes): one row for each leaf of a part's tree, with its positions and right sides (months, then ones)."""
    members, levels, _ = grow(sites.select("part", "lon", "lat"), 2, block, ("part",))
    nodes = cut_lineage(all_nodes(levels), "krige-tree")
    dx, dy = F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")
    extent = sites.groupBy("part").agg((F.sqrt(dx * dx + dy * dy) * influence).alias("scale"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lon", "lat"])
        b = np.column_stack([np.stack(pdf["vals"].to_list()), np.ones(len(pdf))])
        return pdf.head(1)[["part", "node", "scale", "days"]].assign(xy=[packed(pdf[["lon", "lat"]].to_numpy(float))], b=[packed(b)])

    rows = sites.join(members, ["part", "lon", "lat"]).join(extent, "part")
    return cut_lineage(spread(rows, "part", "node").groupBy("part", "node").applyInPandas(pack, TILES), "krige-tiles"), nodes


def _surroundings(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, owner, node, x0, x1, y0, y1): a tile's widened box, and the neighbours that reach into it."""
    box = nodes.select("part", "node", "x0", "x1", "y0", "y1")
    dx, dy = (F.col("x1") - F.col("x0")) * (OVERLAP / 2), (F.col("y1") - F.col("y0")) * (OVERLAP / 2)
    wide = box.select("part", F.col("node").alias("owner"), (F.col("x0") - dx).alias("wx0"), (F.col("x1") + dx).alias("wx1"),
                      (F.col("y0") - dy).alias("wy0"), (F.col("y1") + dy).alias("wy1"))
    both = near.select("part", F.col("t").alias("owner"), F.col("s").alias("node")).join(wide, ["part", "owner"]).join(box, ["part", "node"])
    touch = (F.col("x0") <= F.col("wx1")) & (F.col("x1") >= F.col("wx0")) & (F.col("y0") <= F.col("wy1")) & (F.col("y1") >= F.col("wy0"))
    return cut_lineage(both.filter(touch).select("part", "owner", "node", *[F.col(f"w{c}").alias(c) for c in ("x0", "x1", "y0", "y1")]), "krige-members")


def _joined(own: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """`run(own row, rows)` for each tile."""
    # fresh column ids: both sides may come from one table
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    own = spread(own, "part", "node").groupBy("part", "node")

    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")}, dtype=object)
        return a.assign(**{k: [v] for k, v in run(a.iloc[0], b).items()})[[f.split()[0] for f in schema.split(", ")]]

    return own.cogroup(spread(rows, "part", "node").groupBy("part", "node")).applyInPandas(each, schema)


def _times(state: DataFrame, near: DataFrame, pieces: DataFrame, alpha: float) -> DataFrame:
    """`state` with w, the matrix's product with z, and wz, the products of both by month."""
    def run(own, rows):
        xy = positions(own["xy"])
        w = product_of(xy, own["scale"], alpha, rows)
        return {"w": packed(w), "wz": (columns(own["z"], len(xy)) * w).sum(0)}

    return _joined(state, contributions(state, near, pieces, "z"), run, f"{STATE}, z binary, {DOTS}, w binary, wz array<double>")


def _preconditioned(state: DataFrame, around: DataFrame, alpha: float) -> DataFrame:
    """`state` with z, the sum of the widened tiles' exact solutions for the residuals, and the products rz and rr by month."""
    def cut(batches):
        for pdf in batches:
            out = []
            for part, owner, node, scale, xy, r, x0, x1, y0, y1 in pdf[["part", "owner", "node", "scale", "xy", "r", "x0", "x1", "y0", "y1"]].itertuples(index=False):
                at = positions(xy)
                inside = np.flatnonzero((at[:, 0] >= x0) & (at[:, 0] <= x1) & (at[:, 1] >= y0) & (at[:, 1] <= y1))
                if len(inside):
                    out.append((part, owner, node, scale, inside.astype("<i4").tobytes(), packed(at[inside]), packed(columns(r, len(at))[inside])))
            yield pd.DataFrame(out, columns=["part", "owner", "node", "scale", "inside", "xy", "r"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = [positions(x) for x in pdf["xy"]]
        r = np.concatenate([columns(v, len(x)) for v, x in zip(pdf["r"], xy)])
        at = np.concatenate(xy)
        z = np.linalg.solve(covariance(at, at, float(pdf["scale"].iloc[0]), alpha), r)
        ends = np.cumsum([len(x) for x in xy])
        return pd.DataFrame({"part": pdf["part"], "node": pdf["node"], "inside": pdf["inside"], "z": [packed(v) for v in np.split(z, ends[:-1])]})

    def add(own, rows):
        n = len(own["xy"]) // 16
        r = columns(own["r"], n)
        z = np.zeros(r.shape)
        for inside, v in zip(rows["inside"], rows["z"]):
            inside = np.frombuffer(inside, "<i4")
            z[inside] += columns(v, len(inside))
        return {"z": packed(z), "rz": (r * z).sum(0), "rr": (r * r).sum(0)}

    met = around.join(state.select("part", "node", "scale", "xy", "r"), ["part", "node"])
    parts = met.mapInPandas(cut, "part string, owner long, node long, scale double, inside binary, xy binary, r binary")
    solved = spread(parts, "part", "owner").groupBy("part", "owner").applyInPandas(solve, "part string, node long, inside binary, z binary")
    return _joined(state, solved, add, f"{STATE}, z binary, {DOTS}")


def _totals(state: DataFrame, *names: str) -> DataFrame:
    """Per part, arrays of the sums of array columns, month by month."""
    wide = state.select("part", F.posexplode(F.arrays_zip(*names)).alias("pos", "v"))
    sums = wide.groupBy("part", "pos").agg(*[F.sum(F.col(f"v.{n}")).alias(n) for n in names])
    rows = F.sort_array(F.collect_list(F.struct("pos", *names)))
    return sums.groupBy("part").agg(rows.alias("_c")).select("part", *[F.col(f"_c.{n}").alias(n) for n in names])


def _ratio(a, b):
    return F.zip_with(a, b, lambda x, y: F.when(y != 0, x / y).otherwise(F.lit(0.0)))


def _stepped(state: DataFrame, factors: DataFrame) -> DataFrame:
    """Tiles one step on: direction p and its product s from z and w, then solution and residual along them; `factors` has alpha and beta by month."""
    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n = len(row.xy) // 16
                z, w, x, r, p, s = (columns(v, n) for v in (row.z, row.w, row.x, row.r, row.p, row.s))
                p, s = z + np.asarray(row.beta) * p, w + np.asarray(row.beta) * s
                alpha = np.asarray(row.alpha)
                out.append((row.part, row.node, row.scale, row.xy, *map(packed, (x + alpha * p, r - alpha * s, p, s))))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in STATE.split(", ")])

    return state.join(factors, "part").mapInPandas(run, STATE)


def _iterated(sites: DataFrame, influence: float, alpha: float, block: int, tolerance: float) -> DataFrame:
    tiles, nodes = tiles_of(sites, influence, block)
    near, far = block_pairs(nodes)
    pieces = cut_lineage(far_pieces(tiles, far, alpha), "krige-far")
    around = _surroundings(near, nodes)
    zero = F.expr("unhex(repeat('00', octet_length(b)))")
    state = tiles.select("part", "node", "scale", "xy", zero.alias("x"), F.col("b").alias("r"), zero.alias("p"), zero.alias("s"))
    goal, last, best, since, solved = None, None, None, 0, []
    while True:
        state = cut_lineage(_preconditioned(state, around, alpha), "krige-state")
        state = cut_lineage(_times(state, near, pieces, alpha), "krige-product")
        now = _totals(state, "rz", "rr", "wz")
        if goal is None:
            goal = last = cut_lineage(now.select("part", F.col("rr").alias("goal"), F.col("rz").alias("old"), F.lit(None).cast("array<double>").alias("step")), "krige-goal")
        # alpha and beta of this step from both sums and the step before
        now = (now.join(goal.select("part", "goal"), "part").join(last.select("part", "old", "step"), "part")
               .withColumn("beta", F.when(F.col("step").isNull(), F.transform("rz", lambda v: F.lit(0.0))).otherwise(_ratio("rz", "old")))
               .withColumn("_pq", F.when(F.col("step").isNull(), F.col("wz")).otherwise(
                   F.zip_with("wz", F.zip_with("beta", _ratio("rz", "step"), lambda b, v: b * v), lambda d, v: d - v)))
               .select("part", "rz", "beta", _ratio("rz", "_pq").alias("alpha"), F.array_max(_ratio("rr", "goal")).alias("left")))
        now = cut_lineage(now, "krige-left")
        done, worst = now.agg(F.count_if(F.col("left") <= tolerance ** 2), F.max("left")).first()
        if done:  # parts that are solved leave
            ready = now.filter(F.col("left") <= tolerance ** 2).select("part")
            solved.append(state.join(ready, "part", "left_semi").select("part", "node", "scale", "xy", "x"))
        if worst is None or worst <= tolerance ** 2:
            break
        since = 0 if best is None or worst < best / 4 or done else since + 1
        best = worst if best is None else min(best, worst)
        if since > PATIENCE:
            raise RuntimeError(f"positions so close together that rounding leaves a relative residual of {worst ** 0.5:.1e}")
        now = now.filter(F.col("left") > tolerance ** 2)
        last = now.select("part", F.col("rz").alias("old"), F.col("alpha").alias("step"))
        state = _stepped(state, now.select("part", "alpha", "beta"))
    return _coefficients(solved, tiles)


def _coefficients(solved: list[DataFrame], tiles: DataFrame) -> DataFrame:
    """Coefficients and mean levels from the solutions: a month's level is the sum of its plain solution over that of the unit vector."""
    x = solved[0]
    for more in solved[1:]:
        x = x.unionByName(more)

    def sums(batches):
        for pdf in batches:
            yield pd.DataFrame({"part": pdf["part"], "t": [columns(v, len(at) // 16).sum(0) for v, at in zip(pdf["x"], pdf["xy"])]})

    total = _totals(x.mapInPandas(sums, "part string, t array<double>"), "t")
    level = cut_lineage(total.select("part", F.transform(F.expr("slice(t, 1, size(t) - 1)"), lambda v: v / F.element_at("t", -1)).alias("level")), "krige-level")

    def unpack(batches):
        for pdf in batches:
            for part, scale, xy, v, days, mean in pdf[["part", "scale", "xy", "x", "days", "level"]].itertuples(index=False):
                at = positions(xy)
                v = columns(v, len(at))
                yield pd.DataFrame({"part": part, "is_level": False, "lon": at[:, 0], "lat": at[:, 1], "scale": scale, "days": [days] * len(at),
                                    "beta": list(v[:, :-1] - v[:, -1:] * np.asarray(mean)[None, :])})

    rows = x.join(tiles.select("part", "node", "days"), ["part", "node"]).join(level, "part")
    points = rows.mapInPandas(unpack, COEF_SCHEMA)
    none = F.lit(None).cast("double")
    first = tiles.groupBy("part").agg(F.first("days").alias("days"), F.first("scale").alias("scale"))
    levels = first.join(level, "part").select("part", F.lit(True).alias("is_level"), none.alias("lon"), none.alias("lat"), "scale", "days", F.col("level").alias("beta"))
    return cut_lineage(points.unionByName(levels), "krige-coefficients")
