"""Products with the covariance matrix of many positions, at a cost of about n log n.

Positions are the leaves' of a binary tree (`tree.grow`). Two nodes that lie farther apart than the smaller one is wide make a far block, whose
covariances are smooth: adaptive cross approximation writes it as U V' with some thirty columns. What is left are
pairs of neighbouring leaves, whose covariances are computed where they are needed. Each position is in about log n far
blocks, so a product moves a few numbers per far block and neighbour, and neither the matrix nor all positions ever come together.

The approximation of a block stops when two new columns in a row add less than `tolerance` of the block's Frobenius norm (as summed up so far).
As the covariances of a far block are smooth, the columns' norms fall geometrically, so what is left out is of the size of the last columns:
the product's error is about `tolerance` times the norm of the matrix. Tests hold it against the dense matrix.

Tables: tiles (part, node, xy, scale, ...) with one row for each leaf and its positions as little-endian doubles; near (part, t, s), both ways
and each leaf with itself; pieces (part, t, s, side, node, w), the rows of U (side 0) or V (side 1) of a far block that belong to a leaf.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelspark.operators.skew import spread
from panelspark.operators.tree import ROOT
from panelspark.session import cut_lineage

TOLERANCE = 1e-11


def covariance(a: np.ndarray, b: np.ndarray, scale: float, alpha: float) -> np.ndarray:
    """Stable covariance exp(-(h / scale)^alpha) with unit sill."""
    dx, dy = a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]
    h2 = dx * dx + dy * dy
    return np.exp(-((h2 / (scale * scale)) ** (alpha / 2))) if scale > 0 else (h2 == 0).astype(float)


def positions(xy: bytes) -> np.ndarray:
    return np.frombuffer(xy, "<f8").reshape(-1, 2)


def columns(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, -1) if rows else np.zeros((0, 0))


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<f8").tobytes()


def cross_approximation(a: np.ndarray, b: np.ndarray, scale: float, alpha: float, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """U, V with covariance(a, b) close to U V'; rows and columns are evaluated one at a time, the largest entry left is the next pivot."""
    most = min(len(a), len(b))
    u, v = np.zeros((len(a), 16)), np.zeros((len(b), 16))
    rows, cols = np.zeros(len(a), np.bool_), np.zeros(len(b), np.bool_)
    k, i, square, small = 0, 0, 0.0, 0
    while k < most and small < 2:
        rows[i] = True
        row = covariance(a[i:i + 1], b, scale, alpha)[0] - v[:, :k] @ u[i, :k]
        row[cols] = 0.0
        j = int(np.argmax(np.abs(row)))
        if row[j] == 0.0:  # this row is exact already; look at another
            small += 1
            left = np.flatnonzero(~rows)
            if not len(left):
                break
            i = int(left[len(left) // 2])
            continue
        cols[j] = True
        col = (covariance(a, b[j:j + 1], scale, alpha)[:, 0] - u[:, :k] @ v[j, :k]) / row[j]
        if k == u.shape[1]:
            u, v = np.pad(u, ((0, 0), (0, k))), np.pad(v, ((0, 0), (0, k)))
        size = float(col @ col) * float(row @ row)
        square += size + 2.0 * float((u[:, :k].T @ col) @ (v[:, :k].T @ row))
        u[:, k], v[:, k] = col, row
        k += 1
        small = small + 1 if size <= tolerance ** 2 * square else 0
        i = int(np.argmax(np.where(rows, -1.0, np.abs(col))))
    return u[:, :k], v[:, :k]


def block_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """near (part, t, s) pairs of leaves, both ways, and far (part, t, s) pairs of nodes, once. A level of pairs is one join."""
    info = lambda p: nodes.select("part", F.col("node").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "x1", "y0", "y1", "split")])
    wide = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) ** 2 + (F.col(f"{p}_y1") - F.col(f"{p}_y0")) ** 2
    gap = lambda c: F.greatest(F.col(f"t_{c}0") - F.col(f"s_{c}1"), F.col(f"s_{c}0") - F.col(f"t_{c}1"), F.lit(0.0)) ** 2
    apart = gap("x") + gap("y")
    pairs = nodes.filter(F.col("node") == ROOT).select("part", F.col("node").alias("t"), F.col("node").alias("s"))
    near, far = [], []
    while True:
        seen = pairs.join(info("t"), ["part", "t"]).join(info("s"), ["part", "s"])
        kind = F.when((apart > 0) & (F.least(wide("t"), wide("s")) <= apart), "far").when(F.col("t_split") | F.col("s_split"), "open").otherwise("near")
        seen = cut_lineage(seen.select("part", "t", "s", "t_split", "s_split", kind.alias("kind")), "krige-pairs")
        near.append(seen.filter("kind = 'near'").select("part", "t", "s"))
        far.append(seen.filter("kind = 'far'").select("part", "t", "s"))
        rest = seen.filter("kind = 'open'")
        if not rest.limit(1).count():
            break
        halves = lambda p: F.when(F.col(f"{p}_split"), F.array(F.col(p) * 2, F.col(p) * 2 + 1)).otherwise(F.array(p))
        both = rest.withColumn("_t", F.explode(halves("t"))).withColumn("_s", F.explode(halves("s")))
        pairs = both.filter((F.col("t") != F.col("s")) | (F.col("_t") <= F.col("_s"))).select("part", F.col("_t").alias("t"), F.col("_s").alias("s"))
    near, far = (_all(x) for x in (near, far))
    turned = near.filter("t <> s").select("part", F.col("s").alias("t"), F.col("t").alias("s"))
    return cut_lineage(near.unionByName(turned), "krige-near"), far


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


PIECES = "part string, t long, s long, side int, node long, w binary"


def far_pieces(tiles: DataFrame, far: DataFrame, alpha: float, tolerance: float = TOLERANCE) -> DataFrame:
    """The factors of all far blocks, cut by leaf; a task has the positions of one block."""
    depth = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    up = F.transform(F.sequence(F.lit(0), depth), lambda i: F.call_function("shiftright", F.col("node"), i))  # the leaf and all nodes above it
    under = tiles.select("part", "node", "xy", "scale", F.explode(up).alias("above"))
    sides = (far.select("part", "t", "s", F.lit(0).alias("side"), F.col("t").alias("above"))
             .unionByName(far.select("part", "t", "s", F.lit(1).alias("side"), F.col("s").alias("above"))))
    rows = sides.join(under, ["part", "above"]).drop("above")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == k].sort_values("node") for k in (0, 1)]
        at = [np.concatenate([positions(x) for x in side["xy"]]) for side in sides]
        factors = cross_approximation(*at, float(pdf["scale"].iloc[0]), alpha, tolerance)
        out = []
        for side, w in zip(sides, factors):
            ends = np.cumsum([len(x) // 16 for x in side["xy"]])
            out.append(side.assign(w=[packed(p) for p in np.split(w, ends[:-1])]))
        return pd.concat(out)[["part", "t", "s", "side", "node", "w"]]

    return spread(rows, "part", "t", "s").groupBy("part", "t", "s").applyInPandas(run, PIECES)


def contributions(state: DataFrame, near: DataFrame, pieces: DataFrame, column: str) -> DataFrame:
    """(part, node, far, w, v): what each leaf needs for the matrix's product with `column`.

    Far: its rows of a factor and the other side's sums. Near: a neighbour's positions and values.
    """
    given = state.select("part", "node", F.col(column).alias("v"))

    def reduced(batches):
        for pdf in batches:
            out = [packed(columns(w, n).T @ columns(v, n)) for w, v, n in zip(pdf["w"], pdf["v"], pdf["rows"])]
            yield pdf[["part", "t", "s", "side"]].assign(v=pd.Series(out, index=pdf.index, dtype=object))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, "<f8") for v in pdf["v"]], axis=0)
        return pdf.head(1).assign(v=[packed(total)])

    sums = "part string, t long, s long, side int, v binary"
    met = pieces.join(state.select("part", "node", (F.octet_length("xy") / 16).cast("int").alias("rows"), F.col(column).alias("v")), ["part", "node"])
    each = met.mapInPandas(reduced, sums)
    block = spread(each, "part", "t", "s", "side").groupBy("part", "t", "s", "side").applyInPandas(summed, sums)
    other = block.withColumn("side", 1 - F.col("side"))
    far = pieces.join(other, ["part", "t", "s", "side"]).select("part", "node", F.lit(True).alias("far"), "w", "v")
    beside = near.join(state.select("part", F.col("node").alias("s"), F.col("xy").alias("w"), F.col(column).alias("v")), ["part", "s"])
    return far.unionByName(beside.select("part", F.col("t").alias("node"), F.lit(False).alias("far"), "w", "v"))


def product_of(xy: np.ndarray, scale: float, alpha: float, rows: pd.DataFrame) -> np.ndarray:
    """The product's rows for the positions of one leaf, from its contributions."""
    out = 0.0
    for far, w, v in zip(rows["far"], rows["w"], rows["v"]):
        if far:
            u = columns(w, len(xy))
            if u.shape[1]:
                out = out + u @ columns(v, u.shape[1])
        else:
            at = positions(w)
            out = out + covariance(xy, at, scale, alpha) @ columns(v, len(at))
    return out
