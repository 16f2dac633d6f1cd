import numpy as np
import pandas as pd
import pytest

from panelspark.operators import surface
from panelspark.operators.kriging_blocks import covariance, dual_coefficients


def points3(spark):
    return spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0)], "entity_id string, lon double, lat double")


def panel3(spark):
    return spark.createDataFrame([("a", "2000-01-01", 1.0), ("b", "2000-01-01", 2.0), ("c", "2000-01-01", 4.0)],
                                 "entity_id string, ts string, value double").selectExpr("entity_id", "date(ts) ts", "value")


def cells(spark, *xy):
    return spark.createDataFrame([(i, 0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)],
                                 "cell_id bigint, row int, col int, lon double, lat double")


def test_weights_of_three_points(spark):
    at = cells(spark, (0.5, 0.0), (1.0, 0.0), (0.5, 0.5))
    w = surface.kriging_weights(at, points3(spark), 0.125).toPandas()
    assert w.groupby("cell_id")["w"].sum().round(9).tolist() == [1.0, 1.0, 1.0]
    v = surface.apply_weights(surface.kriging_weights(at, points3(spark), 0.125), panel3(spark)).toPandas()
    got = v.set_index("cell_id")["value"]
    assert got[0] == pytest.approx(2.3190128, abs=1e-7)
    assert got[1] == pytest.approx(2.0, abs=1e-9)
    w1 = surface.kriging_weights(at, points3(spark), scale=1.0).toPandas()
    last = w1[w1.cell_id == 2].set_index("entity_id")["w"]
    assert last["a"] == pytest.approx(0.2626278, abs=1e-7)
    assert last["b"] == pytest.approx(0.3686861, abs=1e-7)


def test_dual_surfaces_equal_weights(spark):
    at = cells(spark, (0.5, 0.0), (1.0, 0.0), (0.3, 0.4))
    dual = surface.surfaces(panel3(spark), points3(spark), at).toPandas().set_index("cell_id")["value"]
    direct = surface.apply_weights(surface.kriging_weights(at, points3(spark)), panel3(spark)).toPandas().set_index("cell_id")["value"]
    assert np.allclose(dual.sort_index(), direct.sort_index(), atol=1e-10)


def random_panel(spark, n=14, months=3, seed=5):
    rng = np.random.default_rng(seed)
    pts = pd.DataFrame({"entity_id": [f"p{i}" for i in range(n)], "lon": rng.random(n), "lat": rng.random(n)})
    pts.loc[1, ["lon", "lat"]] = pts.loc[0, ["lon", "lat"]].to_numpy()  # two wells at one place
    rows = [(e, pd.Timestamp(2000, m + 1, 1).date(), float(rng.normal())) for e in pts.entity_id for m in range(months)]
    return (spark.createDataFrame(rows, "entity_id string, ts date, value double"),
            spark.createDataFrame(pts), pts, rows)


def reference_surface(pts, values, at, influence=0.125, alpha=1.5):
    """One full system per month with the pseudo-inverse, co-located points included."""
    xy = pts[["lon", "lat"]].to_numpy()
    scale = np.hypot(*(xy.max(0) - xy.min(0))) * influence
    cov = lambda a, b: np.exp(-(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)) / scale) ** alpha)
    k = np.ones((len(xy) + 1,) * 2)
    k[:-1, :-1] = cov(xy, xy)
    k[-1, -1] = 0
    rhs = np.ones((len(at), len(xy) + 1))
    rhs[:, :-1] = cov(at, xy)
    return (rhs @ np.linalg.pinv(k))[:, :-1] @ values


def test_surfaces_match_one_solve_per_month(spark):
    panel, points, pts, rows = random_panel(spark)
    # one value missing in February: another set of points, another system
    panel = panel.filter("NOT (entity_id = 'p3' AND ts = DATE '2000-02-01')")
    at = np.array([[0.2, 0.3], [0.9, 0.1], [0.5, 0.5]])
    got = surface.surfaces(panel, points, cells(spark, *at)).toPandas()
    values = pd.DataFrame(rows, columns=["e", "ts", "v"])
    for ts, part in got.groupby("ts"):
        v = values[values.ts == ts]
        if ts.month == 2:
            v = v[v.e != "p3"]
        used = pts.set_index("entity_id").loc[v.e]
        want = reference_surface(used, v.v.to_numpy(), at)
        assert np.allclose(part.sort_values("cell_id")["value"], want, atol=1e-9)


def dense_solution(xy, z, influence=0.125, alpha=1.5):
    """Coefficients of the bordered system; the last row is the mean level."""
    scale = np.hypot(*(xy.max(0) - xy.min(0))) * influence
    k = np.ones((len(xy) + 1,) * 2)
    k[:-1, :-1] = covariance(xy, xy, scale, alpha)
    k[-1, -1] = 0
    return np.linalg.solve(k, np.vstack([z, np.zeros((1, z.shape[1]))]))


@pytest.mark.parametrize("n, block, limit", [(14, 1000, 1e-9), (14, 4, 1e-7), (120, 40, 1e-6)])
def test_blocks_equal_the_dense_solution(spark, n, block, limit):
    rng = np.random.default_rng(n)
    xy, z = rng.random((n, 2)), rng.normal(size=(n, 2))
    rows = pd.DataFrame({"part": "m", "lon": xy[:, 0], "lat": xy[:, 1], "days": [[0, 31]] * n, "vals": list(z)})
    sites = spark.createDataFrame(rows, "part string, lon double, lat double, days array<int>, vals array<double>").repartition(4)
    got = dual_coefficients(sites, 0.125, 1.5, block=block, tolerance=1e-10).toPandas()
    want = dense_solution(xy, z)
    level = np.stack(got[got.is_level]["beta"])
    assert np.abs(level - want[-1]).max() <= limit * np.abs(want[-1]).max() + limit
    points = got[~got.is_level].set_index(["lon", "lat"]).loc[[tuple(p) for p in xy]]
    assert np.abs(np.stack(points["beta"]) - want[:-1]).max() <= limit * np.abs(want).max()


def test_chunks_of_points_add_up(spark, monkeypatch):
    panel, points, _, _ = random_panel(spark)
    at = cells(spark, (0.2, 0.3), (0.9, 0.1), (0.5, 0.5))
    whole = surface.surfaces(panel, points, at).toPandas().sort_values(["ts", "cell_id"])["value"]
    monkeypatch.setattr(surface, "POINTS_PER_TASK", 4)
    parts = surface.surfaces(panel, points, at).toPandas().sort_values(["ts", "cell_id"])["value"]
    assert np.allclose(whole, parts, atol=1e-9)


def test_points_without_a_position_are_left_out(spark):
    panel, points, _, _ = random_panel(spark)
    at = cells(spark, (0.2, 0.3), (0.9, 0.1))
    blank = points.selectExpr("entity_id", "CASE WHEN entity_id <> 'p5' THEN lon END AS lon", "lat")
    got = surface.surfaces(panel, blank, at).toPandas().sort_values(["ts", "cell_id"])["value"]
    want = surface.surfaces(panel.filter("entity_id <> 'p5'"), points, at).toPandas().sort_values(["ts", "cell_id"])["value"]
    assert np.allclose(got, want, atol=1e-12)


def test_complete_entities_and_variogram(spark):
    panel = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("b", 2, None)],
                                  "entity_id string, ts int, value double")
    assert {r.entity_id for r in surface.complete_entities(panel).collect()} == {"a"}
    v = surface.variogram(panel, points3(spark)).orderBy("ts").collect()
    assert v[0]["range"] == pytest.approx(0.125) and v[0]["sill"] == pytest.approx(1.0)
    assert v[1]["range"] == 0.0 and v[1]["sill"] == 0.0
