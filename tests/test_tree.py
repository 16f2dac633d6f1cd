"""The tree over positions, nearest sites on it, and products with covariances of many positions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import cluster_matrix, nearest, tree
from panelspark.operators.kriging_blocks import dual_coefficients, tiles_of


def shapes(rng, n):
    """Positions that are spread evenly, in clusters, on a line, mostly at one place, and with one far away."""
    return {"even": rng.random((n, 2)), "clusters": np.concatenate([rng.normal(c, 1e-3, (n // 5, 2)) for c in rng.random((5, 2)) * 50]),
            "line": np.column_stack([np.full(n, 3.0), rng.random(n)]), "one place": np.vstack([np.full((n // 2, 2), 7.0), rng.random((n - n // 2, 2))]),
            "far": np.vstack([rng.random((n - 1, 2)), [[1e6, -1e6]]])}


def sites_of(spark, xy, key="site"):
    return spark.createDataFrame(pd.DataFrame({key: [f"s{i:05d}" for i in range(len(xy))], "lon": xy[:, 0], "lat": xy[:, 1]}))


@pytest.mark.parametrize("fan, leaf", [(2, 30), (64, 8)])
@pytest.mark.parametrize("shape", ["even", "one place", "far"])
def test_leaves_are_bounded_and_boxes_hold_their_rows(spark, fan, leaf, shape):
    xy = shapes(np.random.default_rng(3), 1000)[shape]
    members, levels, counts = tree.grow(sites_of(spark, xy), fan, leaf)
    members, nodes = members.toPandas(), tree.all_nodes(levels).toPandas()
    assert sorted(members.site) == [f"s{i:05d}" for i in range(len(xy))] and sum(counts) == len(nodes) == nodes.node.nunique()
    sizes = members.groupby("node").size()
    for node, n in sizes[sizes > leaf].items():
        assert len(members[members.node == node][["lon", "lat"]].drop_duplicates()) == 1
    box = nodes.set_index("node")
    assert not box.loc[sizes.index].split.any() and (box.n > 0).all()
    for node, rows in members.groupby("node"):
        up = node
        while up:
            b = box.loc[up]
            assert b.x0 <= rows.lon.min() and rows.lon.max() <= b.x1 and b.y0 <= rows.lat.min() and rows.lat.max() <= b.y1
            up //= fan


@pytest.mark.parametrize("shape", ["even", "clusters", "line", "one place", "far"])
def test_a_point_meets_few_sites_wherever_they_lie(spark, shape):
    rng = np.random.default_rng(11)
    xy = shapes(rng, 3001)[shape]
    ask = np.vstack([xy[::30], rng.random((50, 2)), [[-40.0, 80.0]]])
    sites, points = sites_of(spark, xy), sites_of(spark, ask, "entity_id")
    met = nearest.met(points, sites.selectExpr("site", "lon _x", "lat _y"), 3)
    pairs = met.groupBy("entity_id").agg(F.sum(F.size("_sites")).alias("n")).agg(F.avg("n"), F.max("n")).first()
    assert pairs[0] < 100 and pairs[1] < 1500
    got = nearest.nearest(points, sites, 3).toPandas().sort_values(["entity_id", "rank"])
    d = (ask[:, None, 0] - xy[None, :, 0]) ** 2 + (ask[:, None, 1] - xy[None, :, 1]) ** 2
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert got.site.tolist() == [f"s{i:05d}" for i in want.ravel()]


def test_cross_approximation_keeps_its_bound():
    rng = np.random.default_rng(5)
    for tolerance in (1e-4, 1e-8, 1e-11):
        for scale, alpha in ((0.2, 1.5), (1.0, 1.0), (0.01, 1.5), (5.0, 1.9)):
            a, b = rng.random((200, 2)), rng.random((150, 2)) + [2.2, 0.3]
            k = cluster_matrix.covariance(a, b, scale, alpha)
            u, v = cluster_matrix.cross_approximation(a, b, scale, alpha, tolerance)
            assert np.linalg.norm(k - u @ v.T) <= 20 * tolerance * np.linalg.norm(k)
            assert u.shape[1] <= 60


def site_rows(xy, z):
    return pd.DataFrame({"part": "m", "lon": xy[:, 0], "lat": xy[:, 1], "days": [[0, 31]] * len(xy), "vals": list(z)})


SITES = "part string, lon double, lat double, days array<int>, vals array<double>"


def test_blocks_hold_every_pair_once_and_the_product_is_the_matrix(spark):
    rng = np.random.default_rng(9)
    xy = np.vstack([rng.random((700, 2)), rng.normal(0.3, 1e-2, (300, 2))])
    sites = spark.createDataFrame(site_rows(xy, rng.normal(size=(1000, 2))), SITES).repartition(3)
    tiles, nodes = tiles_of(sites, 0.125, 40)
    near, far = cluster_matrix.block_pairs(nodes)
    size = {r.node: r.n for r in nodes.collect()}
    pairs = [(r.t, r.s) for r in near.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(s, t) for t, s in pairs}
    blocks = far.collect()
    assert blocks and sum(size[t] * size[s] for t, s in pairs) + 2 * sum(size[r.t] * size[r.s] for r in blocks) == 1000 ** 2
    pieces = cluster_matrix.far_pieces(tiles, far, 1.5)
    rows = cluster_matrix.contributions(tiles, near, pieces, "b").toPandas()
    for tile in tiles.collect():
        at = cluster_matrix.positions(tile.xy)
        got = cluster_matrix.product_of(at, tile.scale, 1.5, rows[rows.node == tile.node])
        every = np.concatenate([cluster_matrix.positions(t.xy) for t in tiles.collect()]) if tile.node == rows.node.iloc[0] else None
        if every is not None:
            b = np.concatenate([cluster_matrix.columns(t.b, len(t.xy) // 16) for t in tiles.collect()])
            want = cluster_matrix.covariance(at, every, tile.scale, 1.5) @ b
            assert np.abs(got - want).max() < 1e-8 * np.abs(want).max()


def test_parts_of_several_sizes_are_solved_together(spark):
    rng = np.random.default_rng(2)
    frames, want = [], {}
    for part, n in (("small", 20), ("middle", 90), ("large", 260)):
        xy, z = rng.random((n, 2)), rng.normal(size=(n, 2))
        frames.append(site_rows(xy, z).assign(part=part))
        scale = np.hypot(*np.ptp(xy, axis=0)) * 0.125
        k = np.ones((n + 1,) * 2)
        k[:-1, :-1], k[-1, -1] = cluster_matrix.covariance(xy, xy, scale, 1.5), 0
        want[part] = np.linalg.solve(k, np.vstack([z, np.zeros((1, 2))])), xy
    got = dual_coefficients(spark.createDataFrame(pd.concat(frames), SITES).repartition(3), 0.125, 1.5, block=40).toPandas()
    for part, (beta, xy) in want.items():
        mine = got[got.part == part]
        level, points = np.stack(mine[mine.is_level]["beta"]), mine[~mine.is_level].set_index(["lon", "lat"]).loc[[tuple(p) for p in xy]]
        assert np.abs(level - beta[-1]).max() < 1e-6 and np.abs(np.stack(points["beta"]) - beta[:-1]).max() < 1e-6 * np.abs(beta).max()
