import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.config import DROUGHT_INDEX, LAND_SURFACE, GridSpec, RunConfig
from panelspark.functions.geometry import strip_area
from panelspark.operators import grid, polygon, storage
from panelspark.session import new_path, scratch_dir
from panelspark.sources import raster as rasters, tables


def test_grid_descriptors(spark):
    assert (DROUGHT_INDEX.n_rows, DROUGHT_INDEX.n_cols) == (55, 144)
    assert (LAND_SURFACE.n_rows, LAND_SURFACE.n_cols, LAND_SURFACE.n_cells) == (600, 1440, 864000)
    assert len(LAND_SURFACE.variables) == 35
    first, last = grid.create_grid(spark, DROUGHT_INDEX).filter("cell_id IN (0, 7919)").orderBy("cell_id").collect()
    assert (first.lon, first.lat, last.lon, last.lat) == (-178.75, 76.25, 178.75, -58.75)
    with pytest.raises(ValueError):
        GridSpec(0, 0, 1, 1, 0, 1)


def points(spark, n, seed=1, spread=200.0):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-spread, spread, (n, 2)) * [1, 0.5]
    return xy, spark.createDataFrame([(str(i), float(x), float(y)) for i, (x, y) in enumerate(xy)],
                                     "entity_id string, lon double, lat double")


@pytest.mark.parametrize("k,keep", [(1, 1.0), (3, 0.02), (2, 0.002)])
def test_nearest_cells_equal_brute_force(spark, k, keep):
    xy, pts = points(spark, 60)
    cells = grid.create_grid(spark, DROUGHT_INDEX).filter((F.pmod(F.xxhash64("cell_id"), F.lit(1000)) < int(keep * 1000)))
    c = cells.toPandas()
    got = grid.nearest_cells(pts, cells, DROUGHT_INDEX, k).toPandas()
    assert len(got) == 60 * k
    for i, (x, y) in enumerate(xy):
        d = (c.lon - x) ** 2 + (c.lat - y) ** 2
        want = c.assign(d=d).sort_values(["d", "cell_id"]).cell_id.head(k).tolist()
        assert got[got.entity_id == str(i)].sort_values("rank").cell_id.tolist() == want


def test_snap_agrees_with_nearest(spark):
    _, pts = points(spark, 300, seed=2)
    snapped = grid.snap(pts, DROUGHT_INDEX).select("entity_id", (F.col("row") * 144 + F.col("col")).alias("s"))
    near = grid.nearest_cells(pts, grid.create_grid(spark, DROUGHT_INDEX), DROUGHT_INDEX)
    assert snapped.join(near, "entity_id").filter("s <> cell_id").count() == 0


def ring(poly, ring_id, pts):
    return [(poly, ring_id, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1]))]


EDGES = "poly_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double"


def test_polygon_with_hole_triangle_and_boundary(spark):
    spec = GridSpec(0.0, 0.0, 40.0, 40.0, 1.0, 1.0)
    square = ring(0, 0, [(2, 2), (20, 2), (20, 20), (2, 20)]) + ring(0, 1, [(8, 8), (14, 8), (14, 14), (8, 14)])
    triangle = ring(1, 0, [(22, 22), (38, 22), (22, 38)])
    got = {(r.lon, r.lat) for r in polygon.cells_in_polygons(spark.createDataFrame(square + triangle, EDGES), spec).collect()}
    want = set()
    for x in range(41):
        for y in range(41):
            in_square = 2 < x < 20 and 2 < y < 20 and not (8 <= x <= 14 and 8 <= y <= 14)
            in_triangle = x > 22 and y > 22 and x + y < 60
            if in_square or in_triangle:
                want.add((float(x), float(y)))
    assert got == want


def test_vertices_on_grid_rows(spark):
    # a concave star whose vertices lie on the scan lines
    star = [(10, 0), (12, 8), (20, 10), (12, 12), (10, 20), (8, 12), (0, 10), (8, 8)]
    spec = GridSpec(0.3, 0.0, 20.3, 20.0, 1.0, 1.0)
    got = {(r.lon, r.lat) for r in polygon.cells_in_polygons(spark.createDataFrame(ring(0, 0, star), EDGES), spec).collect()}
    def inside(x, y):
        hit = False
        for (x1, y1), (x2, y2) in zip(star, star[1:] + star[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit
    assert got == {(0.3 + c, float(r)) for c in range(21) for r in range(21) if inside(0.3 + c, r)}


def test_surface_axes_exclude_the_far_ends():
    spec = polygon.surface_grid_spec((0.0, 0.0, 10.0, 4.5), 5)
    assert (spec.n_cols, spec.n_rows, spec.x_max, spec.y_min) == (5, 3, 8.0, 0.5)
    exact = polygon.surface_grid_spec((0.0, 0.0, 10.0, 4.0), 5)
    assert (exact.n_rows, exact.y_min) == (2, 2.0)
    with pytest.raises(ValueError):
        polygon.surface_grid_spec((0, 0, 1, 1), 0)


def test_boxes(spark):
    edges = spark.createDataFrame(ring(0, 0, [(1, 2), (5, 2), (5, 9)]), EDGES)
    box = grid.bounding_box(edges)
    assert tuple(box.first()) == (1.0, 2.0, 5.0, 9.0)
    with pytest.raises(ValueError):
        grid.pad_box(box, 181)
    flat = spark.createDataFrame(ring(0, 0, [(1, 2), (5, 2)]), EDGES)
    with pytest.raises(Exception, match="valid bounding box"):
        grid.bounding_box(flat).collect()
    outside = spark.createDataFrame([(300.0, 0.0, 310.0, 1.0)], "x_min double, y_min double, x_max double, y_max double")
    with pytest.raises(ValueError):
        grid.intercepting_cells(spark, DROUGHT_INDEX, outside)


def test_cube_orientation_and_fill_value(spark):
    spec = GridSpec(0.0, 0.0, 2.0, 1.0, 1.0, 1.0, ("v",))
    cube = spark.createDataFrame([(0, 0, 0, 5.0), (1, 1, 2, -99.0), (1, 1, 1, float("nan"))], "t int, row int, col int, v double")
    got = {(r.cell_id, str(r.ts)): r.v for r in grid.cube_to_table(cube, spec, "1850-01-01", fill_value=-99.0).collect()}
    assert got == {(3, "1850-01-01"): 5.0, (2, "1850-02-01"): None, (1, "1850-02-01"): None}


# --- storage ----------------------------------------------------------------------------------

def test_cell_area(spark):
    one = spark.range(1).select(strip_area(F.lit(37.75), F.lit(0.005), F.lit(0.005), F.lit(1)).alias("a")).first()
    assert one.a == pytest.approx(2630847.80, abs=0.01)


def raster(spark):
    rows = [(dt.date(2000, m, 1), r, c, 10.0 + c * 0.5, 40.0 - r * 0.5, float(m * (r + 1)) if (r, c) != (1, 1) else None)
            for m in range(1, 7) for r in range(2) for c in range(2)]
    return spark.createDataFrame(rows, "ts date, row int, col int, lon double, lat double, value double")


def test_storage_curve(spark):
    r = raster(spark)
    curve = storage.storage_curve(r, 0.2).orderBy("ts").collect()
    area = storage.footprint_area(r).first().area
    strip = lambda lat, n: np.radians(0.5 * n) * (3958.8 * 5280) ** 2 * abs(np.sin(np.radians(lat - 0.25)) - np.sin(np.radians(lat + 0.25)))
    assert area == pytest.approx(strip(40.0, 2) + strip(39.5, 1))
    assert curve[0].storage_change == 0.0
    assert curve[1].storage_change == pytest.approx((1 + 1 + 2) / 3 * area * 0.2 / 1e6 / 43560)
    kept = storage.storage_curve(r, 0.2, ("1990-01-01", "2000-04-01")).orderBy("ts").collect()
    assert len(kept) == 4 and kept[0].storage_change == 0.0
    with pytest.raises(Exception, match="start date"):
        storage.storage_curve(r, 0.2, ("2001-01-01", "2002-01-01")).collect()
    with pytest.raises(ValueError):
        storage.volume(storage.mean_change(r), storage.footprint_area(r), 1.5)
    with pytest.raises(ValueError):
        storage.check_raster(r.drop("ts"))


def test_long_curve_is_clipped_and_rebased(spark):
    months = spark.sql("SELECT explode(sequence(DATE '1948-01-01', DATE '2020-01-01', interval 1 month)) ts").withColumn(
        "storage_change", F.month("ts") * 1.0)
    out = storage.filter_range(months, "1948-01-01", "1978-01-01").orderBy("ts").collect()
    assert len(out) == 361 and out[0].storage_change == 0.0


def test_raster_round_trip(spark):
    d = new_path(spark, "t")
    rasters.write_raster(raster(spark), d, "raster")
    a = sorted(map(str, rasters.read_raster(spark, d, "raster").select(*raster(spark).columns).collect()))
    assert a == sorted(map(str, raster(spark).collect()))
    raster(spark).write.parquet(f"{d}/no_time")
    with pytest.raises(ValueError, match="time dimension"):
        rasters.read_raster(spark, d, "no_time")


# --- sources ----------------------------------------------------------------------------------

def test_reading_checks(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Note,Date,Well ID,Measurement\nx,1/5/1999,375432113151401,12.5\ny,1999-02-06,7,\n")
    got = tables.readings(tables.read_readings(spark, str(tmp_path / "r.csv"))).orderBy("ts").collect()
    assert got[0].entity_id == "375432113151401" and got[0].ts == dt.datetime(1999, 1, 5) and got[0].value == 12.5
    assert got[1].value is None
    text = lambda *rows: spark.createDataFrame(rows, "Date string, `Well ID` string, Measurement string")
    with pytest.raises(Exception, match="invalid date"):
        tables.readings(text(("never", "a", "1"))).collect()
    with pytest.raises(Exception, match="not a number"):
        tables.readings(text(("2000-01-01", "a", "deep"))).collect()
    good, bad = tables.split_readings(text(("2000-01-01", "a", "1"), ("2000-13-01", "a", "1"), ("2000-01-01", "b", "x")))
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        tables.readings(text(("2000-01-01", "a", "1")).drop("Date"))
    with pytest.raises(ValueError, match="2 rows"):
        tables.require_unique(tables.readings(text(("2000-01-01", "a", "1"), ("2000-01-01", "a", "2"))))
    with pytest.raises(FileNotFoundError):
        tables.read_stage(spark, new_path(spark, "none"), "absent")


def test_wide_and_back(spark):
    long = spark.createDataFrame([("a b", 1, 1.0), ("c", 1, 2.0), ("c", 2, 3.0)], "entity_id string, ts int, value double")
    wide = tables.to_wide(long, ["a b", "c"])
    assert wide.columns == ["ts", "a b", "c"]
    back = tables.to_long(wide, ["a b", "c"]).filter("value IS NOT NULL")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_config_checks():
    for bad in (dict(storage_coefficient=2), dict(units="Metric"), dict(folds=1), dict(max_std=0), dict(anchor="x")):
        with pytest.raises(ValueError):
            RunConfig(**bad)


def test_scratch_follows_the_session(spark):
    assert scratch_dir(spark) == scratch_dir(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_nearest_on_sparse_and_odd_sets(spark):
    """One cell on a large grid, points far away, clusters and points without a position."""
    from panelspark.config import LAND_SURFACE
    from panelspark.operators import nearest
    one = grid.create_grid(spark, LAND_SURFACE).filter("cell_id = 123456")
    pts = spark.range(10000).selectExpr("CAST(id AS STRING) AS entity_id", "CAST(id % 360 - 180 AS DOUBLE) AS lon", "CAST(id % 180 - 90 AS DOUBLE) AS lat")
    got = grid.nearest_cells(pts, one, LAND_SURFACE, k=2)
    assert got.count() == 10000 and got.select("cell_id", "rank").distinct().count() == 1
    assert grid.nearest_cells(pts, one.limit(0), LAND_SURFACE).count() == 0
    rng = np.random.default_rng(6)
    xy = np.vstack([rng.normal(0, 1e-4, (300, 2)), rng.uniform(-50, 50, (100, 2)), np.full((5, 2), 7.0)])
    sites = spark.createDataFrame([(f"s{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(xy)], "site string, lon double, lat double")
    ask = [("a", 0.0, 0.0), ("b", 200.0, -80.0), ("c", 7.0, 7.0), ("d", None, 1.0), ("e", 1.0, float("nan"))]
    points = spark.createDataFrame(ask, "entity_id string, lon double, lat double")
    got = nearest.nearest(points, sites, k=4).toPandas()
    assert set(got.entity_id) == {"a", "b", "c"}
    for name, x, y in ask[:3]:
        d = np.hypot(xy[:, 0] - x, xy[:, 1] - y)
        want = np.lexsort((np.arange(len(d)), d))[:4]
        mine = got[got.entity_id == name].sort_values("rank")
        assert list(mine.site) == [f"s{i:03d}" for i in want] and np.allclose(mine.distance, d[want])
    assert {r.entity_id for r in nearest.without_position(points).collect()} == {"d", "e"}


def test_farthest_and_nearest_points_skip_blank_positions(spark):
    from panelspark.operators import relate
    rng = np.random.default_rng(8)
    xy = rng.normal(size=(200, 2))
    rows = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("blank", None, 0.5)]
    pts = spark.createDataFrame(rows, "entity_id string, lon double, lat double")
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    far = {r.entity_id: r.d_max for r in relate.farthest(pts, block=3).collect()}
    assert far.pop("blank") is None and all(np.isclose(far[f"p{i}"], d[i].max()) for i in range(200))
    near = relate.nearest_points(pts, 3).toPandas()
    assert set(near.target) == set(far) and "blank" not in set(near.candidate)
    np.fill_diagonal(d, np.inf)
    for i in range(0, 200, 17):
        mine = near[near.target == f"p{i}"].sort_values("rank")
        assert np.allclose(mine.distance, np.sort(d[i])[:3])


def test_polygon_cells_with_exclusion(spark):
    from panelspark.config import GridSpec
    from panelspark.operators import polygon
    spec = GridSpec(0.0, 0.0, 9.0, 9.0, 1.0, 1.0)
    edges = spark.createDataFrame([(0, 0, 0, 0.5, 0.5, 5.5, 0.5), (0, 0, 1, 5.5, 0.5, 5.5, 5.5), (0, 0, 2, 5.5, 5.5, 0.5, 5.5), (0, 0, 3, 0.5, 5.5, 0.5, 0.5)],
                                  "poly_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    every = {r.cell_id for r in polygon.cells_in_polygons(edges, spec).collect()}
    taken = spark.createDataFrame([(c,) for c in sorted(every)[:3]], "cell_id long")
    rest = {r.cell_id for r in polygon.cells_in_polygons(edges, spec, exclude=taken).collect()}
    assert len(every) == 25 and rest == set(sorted(every)[3:])
