from pyspark.sql import functions as F

from catalog.common import (END, JD, R, START, calendar_sql, customer_points, diamond_edges, grid_sql,
                            land_grid, pa_monthly, pb_monthly, pc_events, pchip_ctes, pd_daily, query, raster,
                            rounded, table, with_)
from panelspark.config import DROUGHT_INDEX, FEATURE_VARIABLES, LAND_SURFACE, MONTHS, RunConfig, SURFACE_WATER_VARIABLES
from panelspark.functions.dates import cf_date, cf_days, julian_day, month_from_name
from panelspark.functions.geometry import strip_area
from panelspark.operators import clean, features as feat, grid as grids, polygon, prior, storage, timeline
from panelspark.sources import tables

_SPAN = "(SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)"
_MONTHS_OF_SPAN = f"""SELECT CAST(unnest(generate_series(
    CASE WHEN date_trunc('month', lo) = lo THEN date_trunc('month', lo) ELSE date_trunc('month', lo) + INTERVAL 1 MONTH END,
    date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE) AS ts FROM {_SPAN}"""


@query("P1_month_calendar", f"""SELECT c.ts, count(o_orderkey) AS n_orders FROM ({_MONTHS_OF_SPAN}) c
    LEFT JOIN orders ON CAST(date_trunc('month', o_orderdate) AS DATE) = c.ts GROUP BY 1""")
def p1(spark, sf):
    o = table(spark, sf, "orders")
    months = timeline.panel_calendar(o, "o_orderdate")
    per_month = o.groupBy(F.trunc("o_orderdate", "MM").alias("ts")).agg(F.count("o_orderkey").alias("n_orders"))
    return months.join(per_month, "ts", "left").select("ts", F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("n_orders"))


@query("P2_date_range", f"""SELECT CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi),
    INTERVAL 1 MONTH)) AS DATE) AS ts FROM {_SPAN}""")
def p2(spark, sf):
    name = F.date_format("o_orderdate", "'GRID.A'yyyyMM'.021.nc4'")
    return timeline.panel_calendar(table(spark, sf, "orders").select(month_from_name(name).alias("ts")))


@query("P3_every_kth_month", with_("pb") + f"""SELECT entity_id, ts, {R('value', 5)} AS value FROM
    (SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS i FROM pb) WHERE i % 3 = 0""")
def p3(spark, sf):
    return rounded(timeline.every_kth_time(pb_monthly(spark, sf), 3), 5)


@query("P4_date_range_filter", with_("pd") + f"""SELECT entity_id, ts, {R('value', 4)} AS value FROM pd
    WHERE ts BETWEEN DATE '1996-03-01' AND DATE '1999-07-15'""")
def p4(spark, sf):
    return rounded(timeline.between(pd_daily(spark, sf), "1996-03-01", "1999-07-15"), 4)


@query("P5_mask_gaps", with_("pd", **pchip_ctes("pd", 365, 90)) +
       f"SELECT entity_id, ts, {R('value', 3)} AS value FROM interp")
def p5(spark, sf):
    panel = pd_daily(spark, sf)
    return rounded(clean.mask_gaps(clean.interpolate(panel), clean.gaps(panel, 365), 90), 3)


@query("P6_mask_outside_range", with_("pd") + f"""SELECT entity_id, c.ts, CASE WHEN c.ts BETWEEN lo AND hi THEN n END AS value
    FROM (SELECT entity_id, min(ts) AS lo, max(ts) AS hi, CAST(count(*) AS DOUBLE) AS n FROM pd GROUP BY 1)
    CROSS JOIN ({calendar_sql()}) c""")
def p6(spark, sf):
    panel = pd_daily(spark, sf)
    level = panel.groupBy("entity_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.trunc(F.min("ts"), "MM").alias("ts"))
    flat = timeline.densify(level.withColumn("value", F.col("n")), START, END)
    flat = flat.drop("value").join(level.select("entity_id", F.col("n").alias("value")), "entity_id")
    return clean.mask_outside_range(flat, clean.observed_range(panel)).select("entity_id", "ts", "value")


@query("P7_julian_day", """SELECT entity_id, ts, round(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 2440587.5e0
    + (hour(ts) * 3600 + minute(ts) * 60 + extract('microsecond' FROM ts) / 1e6) / 86400e0, 4) AS jd
    FROM (SELECT CAST(user_id AS VARCHAR) AS entity_id, ts FROM events)""")
def p7(spark, sf):
    return pc_events(spark, sf).select("entity_id", "ts", F.round(julian_day(F.col("ts")), 4).alias("jd"))


@query("P8_month_one_hot", with_("pb") + "SELECT entity_id, ts, " + ", ".join(
    f'CAST(month(ts) = {i + 1} AS INTEGER) AS "{m}"' for i, m in enumerate(MONTHS)) + " FROM pb")
def p8(spark, sf):
    return feat.month_one_hot(pb_monthly(spark, sf).select("entity_id", "ts"))


@query("P9_feature_subset", with_("land") + "SELECT cell_id, ts, " + ", ".join(f'"{v}"' for v in FEATURE_VARIABLES) + " FROM land")
def p9(spark, sf):
    grid = land_grid(spark, sf).withColumn("Albedo_inst", F.lit(0.5))
    return grid.select("cell_id", "ts", *FEATURE_VARIABLES)


# per part and ship month: quantities by flag and status, missing where there are none
_SPARSE = {v: f"sum(CASE WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN l_quantity END)"
           for v, (f, s) in zip(SURFACE_WATER_VARIABLES, [(f, s) for f in "ANR" for s in "FO"])}
_SPARSE_SQL = "SELECT l_partkey AS cell_id, " + ", ".join(f'{t} AS "{v}"' for v, t in _SPARSE.items()) + " FROM lineitem GROUP BY 1"


def _sparse(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg(
        *[F.expr(t).alias(v) for v, t in _SPARSE.items()])


@query("P10_surface_water", f"""SELECT cell_id, {' + '.join(f'coalesce("{v}", 0)' for v in SURFACE_WATER_VARIABLES)} AS "Surface Water"
    FROM ({_SPARSE_SQL})""")
def p10(spark, sf):
    return _sparse(spark, sf).select("cell_id", feat.surface_water().alias("Surface Water"))


_SW = " + ".join(f'"{v}"' for v in SURFACE_WATER_VARIABLES)
_GROUNDWATER = f"""SELECT cell_id, ts, {_SW} AS "Surface Water", ln("Qsb_acc") AS "ln(QSB_acc)",
    ln(sum("Rainf_tavg") OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS "ln(RW 4 Rainf_tavg)",
    sum({_SW} - "CanopInt_inst" - "SWE_inst") OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS "Sum Soil Moist"
    FROM land WINDOW w AS (PARTITION BY cell_id ORDER BY ts)"""


@query("P11_log_features", with_("land", g=_GROUNDWATER) +
       f"""SELECT cell_id, ts, {R('"ln(QSB_acc)"')} AS "ln(QSB_acc)", {R('"ln(RW 4 Rainf_tavg)"')} AS "ln(RW 4 Rainf_tavg)" FROM g""")
def p11(spark, sf):
    return rounded(feat.groundwater_features(land_grid(spark, sf)).select(
        "cell_id", "ts", "`ln(QSB_acc)`", "`ln(RW 4 Rainf_tavg)`"))


@query("P12_soil_moisture", with_("land", g=_GROUNDWATER) + 'SELECT cell_id, ts, "Surface Water", "Sum Soil Moist" FROM g')
def p12(spark, sf):
    return feat.groundwater_features(land_grid(spark, sf)).select("cell_id", "ts", "Surface Water", "Sum Soil Moist")


@query("P13_complete_rows", f"SELECT * FROM ({_SPARSE_SQL}) WHERE " + " AND ".join(f'"{v}" IS NOT NULL' for v in _SPARSE))
def p13(spark, sf):
    return feat.complete_rows(_sparse(spark, sf), list(_SPARSE))


@query("P14_split_label", with_("pam") + f"""SELECT entity_id, ts, CAST(month(ts) AS INTEGER) AS m, CAST(year(ts) AS INTEGER) AS y, NULL AS value, 'features' AS side
    FROM pam UNION ALL SELECT entity_id, ts, NULL, NULL, {R('value')}, 'label' FROM pam""")
def p14(spark, sf):
    rows = pa_monthly(spark, sf).withColumn("m", F.month("ts")).withColumn("y", F.year("ts"))
    label, features = feat.split_label(rows, "value")
    return (features.withColumn("side", F.lit("features"))
            .unionByName(rounded(label).withColumn("side", F.lit("label")), allowMissingColumns=True))


@query("P15_bounding_box", with_("diamonds", "box") + "SELECT * FROM box")
def p15(spark, sf):
    return grids.bounding_box(diamond_edges(spark, sf))


@query("P16_pad_box", with_("diamonds", "box") +
       "SELECT x_min - 1.25e0 AS x_min, y_min - 0.75e0 AS y_min, x_max + 1.25e0 AS x_max, y_max + 0.75e0 AS y_max FROM box")
def p16(spark, sf):
    return grids.pad_box(grids.bounding_box(diamond_edges(spark, sf)), 1.25, 0.75)


def _snap_sql(spec, src):
    row = f"CAST(least(greatest(ceil(({spec.y_max}e0 - lat) / {spec.res_y}e0 - 0.5e0), 0), {spec.n_rows - 1}) AS INTEGER)"
    col = f"CAST(least(greatest(ceil((lon - ({spec.x_min}e0)) / {spec.res_x}e0 - 0.5e0), 0), {spec.n_cols - 1}) AS INTEGER)"
    return f"SELECT *, {row} AS row, {col} AS col FROM {src}"


@query("P17_create_grid", with_("cpts", g=grid_sql(DROUGHT_INDEX), s=_snap_sql(DROUGHT_INDEX, "cpts")) + """SELECT cell_id, g.row, g.col,
    g.lon, g.lat, count(s.entity_id) AS n_points FROM g LEFT JOIN s ON s.row = g.row AND s.col = g.col GROUP BY ALL""")
def p17(spark, sf):
    cells = grids.create_grid(spark, DROUGHT_INDEX)
    used = (grids.snap(customer_points(spark, sf), DROUGHT_INDEX).groupBy("row", "col")
            .agg(F.count("entity_id").alias("n_points")))
    return cells.join(used, ["row", "col"], "left").withColumn(
        "n_points", F.coalesce("n_points", F.lit(0)).cast("bigint"))


@query("P18_intercepting_cells", with_("diamonds", "box", g=grid_sql(DROUGHT_INDEX)) + """SELECT g.* FROM g, box
    WHERE lon BETWEEN x_min - 1.25e0 AND x_max + 1.25e0 AND lat BETWEEN y_min - 1.25e0 AND y_max + 1.25e0""")
def p18(spark, sf):
    return grids.intercepting_cells(spark, DROUGHT_INDEX, grids.bounding_box(diamond_edges(spark, sf)))


@query("P19_cells_with_exclusion", with_("diamonds", "box", "cpts", g=grid_sql(DROUGHT_INDEX), s=_snap_sql(DROUGHT_INDEX, "cpts")) +
       """SELECT g.* FROM g, box WHERE lon BETWEEN x_min AND x_max AND lat BETWEEN y_min AND y_max
       AND NOT EXISTS (SELECT 1 FROM s WHERE s.row = g.row AND s.col = g.col)""")
def p19(spark, sf):
    taken = grids.snap(customer_points(spark, sf), DROUGHT_INDEX).select(
        (F.col("row").cast("bigint") * DROUGHT_INDEX.n_cols + F.col("col")).alias("cell_id")).distinct()
    return grids.intercepting_cells(spark, DROUGHT_INDEX, grids.bounding_box(diamond_edges(spark, sf)),
                                    pad=False, exclude=taken)


@query("P19_polygon_exclusion", with_("diamonds", "cpts", g=grid_sql(DROUGHT_INDEX), s=_snap_sql(DROUGHT_INDEX, "cpts")) + """SELECT g.* FROM g
    WHERE EXISTS (SELECT 1 FROM diamonds d WHERE abs(g.lon - d.lon) + abs(g.lat - d.lat) < d.radius
    AND NOT (d.has_hole AND abs(g.lon - d.lon) + abs(g.lat - d.lat) <= 1)) AND NOT EXISTS (SELECT 1 FROM s WHERE s.row = g.row AND s.col = g.col)""")
def p19b(spark, sf):
    taken = grids.snap(customer_points(spark, sf), DROUGHT_INDEX).select(
        (F.col("row").cast("bigint") * DROUGHT_INDEX.n_cols + F.col("col")).alias("cell_id")).distinct()
    return polygon.cells_in_polygons(diamond_edges(spark, sf), DROUGHT_INDEX, exclude=taken)


@query("P2_calendar_steps", " UNION ALL ".join(f"""SELECT '{s}' AS step, CAST(unnest(generate_series(date_trunc('{s}', lo - INTERVAL 1 DAY) + INTERVAL {n},
    date_trunc('{s}', hi), INTERVAL {n})) AS DATE) AS ts FROM (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)"""
    for s, n in (("week", "7 DAY"), ("quarter", "3 MONTH"), ("year", "1 YEAR"))))
def p2_steps(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("ts"))
    parts = [timeline.panel_calendar(days, step=s).select(F.lit(s).alias("step"), "ts") for s in ("week", "quarter", "year")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DENSE_PB = f"""SELECT e.entity_id, c.ts, p.value FROM (SELECT DISTINCT entity_id FROM pb) e CROSS JOIN
    ({calendar_sql('1993-01-01', '2003-12-01')}) c LEFT JOIN pb p ON p.entity_id = e.entity_id AND p.ts = c.ts"""


@query("P22_linear_extrapolate", with_("pb", dense=_DENSE_PB, obs="""SELECT entity_id, min(ts) AS lo, max(ts) AS hi,
    avg(value) AS m, avg(value) / 3650 AS s FROM pb GROUP BY 1""", rows=f"""SELECT *, {JD.format('ts')} AS x FROM dense JOIN obs USING (entity_id)
    WHERE ts > hi""") + f"""SELECT entity_id, ts, {R('s * (x - min(x) OVER (PARTITION BY entity_id)) + m', 4)} AS prior FROM rows""")
def p22(spark, sf):
    panel = pb_monthly(spark, sf)
    dense = timeline.densify(panel, "1993-01-01", "2003-12-01")
    fits = panel.groupBy("entity_id").agg(F.avg("value").alias("right_intercept"),
                                          (F.avg("value") / 3650).alias("right_slope"))
    return rounded(prior.extrapolate(dense, fits, "right"), 4)


_CURVE = """SELECT ts, avg(value - v0) AS delta FROM raster LEFT JOIN (SELECT row, col, value AS v0 FROM raster
    WHERE ts = (SELECT min(ts) FROM raster)) USING (row, col) GROUP BY ts"""


@query("P23_filter_range", with_("raster", curve=_CURVE, kept="""SELECT * FROM curve WHERE ts >= greatest(DATE '1996-02-01', (SELECT min(ts) FROM curve))
    AND ts <= least(DATE '2030-01-01', (SELECT max(ts) FROM curve))""") +
       f"SELECT ts, {R('delta - (SELECT delta FROM kept ORDER BY ts LIMIT 1)', 4)} AS delta FROM kept")
def p23(spark, sf):
    curve = storage.mean_change(raster(spark, sf))
    return rounded(storage.filter_range(curve, "1996-02-01", "2030-01-01", "delta"), 4)


_R2 = "(3958.8e0 * 5280) * (3958.8e0 * 5280)"


def _strip_sql(lat, dx, dy, n):
    return (f"radians({dx} * {n}) * {_R2} * abs(sin(radians({lat} - {dy} / 2)) - sin(radians({lat} + {dy} / 2)))")


@query("P24_strip_area", with_("cpts", s=_snap_sql(DROUGHT_INDEX, "cpts")) + f"""SELECT row, n_points, {R(_strip_sql('(76.25e0 - row * 2.5e0)', '2.5e0', '2.5e0', 'n_points') + ' / 1e9', 3)} AS area
    FROM (SELECT row, count(*) AS n_points FROM s GROUP BY 1)""")
def p24(spark, sf):
    rows = grids.snap(customer_points(spark, sf), DROUGHT_INDEX).groupBy("row").agg(F.count(F.lit(1)).alias("n_points"))
    lat = F.lit(76.25) - F.col("row") * 2.5
    return rounded(rows.withColumn("area", strip_area(lat, F.lit(2.5), F.lit(2.5), F.col("n_points")) / 1e9), 3)


_AREA = f"""SELECT sum({_strip_sql('lat', '30e0', '30e0', 'n')}) AS area FROM (SELECT row, lat, count(*) AS n FROM raster
    WHERE ts = (SELECT min(ts) FROM raster) AND value IS NOT NULL GROUP BY 1, 2)"""


@query("P25_volume", with_("raster", curve=_CURVE, area=_AREA) +
       f"SELECT ts, {R('delta * area * 0.2e0 / 1e15', 5)} AS storage_change FROM curve, area")
def p25(spark, sf):
    r = raster(spark, sf)
    v = storage.volume(storage.mean_change(r), storage.footprint_area(r), 0.2)
    return rounded(v.withColumn("storage_change", F.col("storage_change") / 1e15), 5)


@query("P26_unit_conversion", f"""SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, {R('sum(l_quantity) * 1e8 / 1000000 / 43560')} AS value
    FROM lineitem GROUP BY 1""")
def p26(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("entity_id")).agg(
        (F.sum("l_quantity") * 1e8).alias("value"))
    return rounded(storage.unit_conversion(v, "value"))


@query("P27_cf_time", """SELECT o_orderkey, CAST(date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 2 AS DOUBLE) AS time,
    CAST(o_orderdate AS DATE) AS decoded FROM orders""")
def p27(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", cf_days(F.col("o_orderdate").cast("date")).alias("time"))
    return t.withColumn("decoded", cf_date(F.col("time")))


_AXES = with_("diamonds", "box", "cpts", axis="SELECT *, (x_max - x_min) / 97 AS res FROM box",
              snapped="""SELECT CAST(ceil((lon - x_min) / res - 0.5e0) AS INTEGER) AS col, count(*) AS n_points
              FROM cpts, axis GROUP BY 1""")


@query("P28_surface_axes", _AXES + f"""SELECT c.col, {R('x_min + c.col * res')} AS lon, CAST(ceil((y_max - y_min) / res) AS INTEGER) AS n_rows,
    coalesce(n_points, 0) AS n_points FROM axis, (SELECT CAST(unnest(range(97)) AS INTEGER) AS col) c LEFT JOIN
    (SELECT least(greatest(col, 0), 96) AS col, CAST(sum(n_points) AS BIGINT) AS n_points FROM snapped GROUP BY 1) USING (col)""")
def p28(spark, sf):
    box = grids.bounding_box(diamond_edges(spark, sf)).first()
    spec = polygon.surface_grid_spec(tuple(box), 97)
    used = grids.snap(customer_points(spark, sf), spec).groupBy("col").agg(F.count(F.lit(1)).alias("n_points"))
    axis = grids.create_grid(spark, spec).select("col", "lon").distinct()
    return rounded(axis.join(used, "col", "left").select(
        "col", "lon", F.lit(spec.n_rows).alias("n_rows"), F.coalesce("n_points", F.lit(0)).cast("bigint").alias("n_points")))


_NATIONS = [f"NATION_{i}" for i in range(25)]


@query("P29_long_to_wide", with_("pb") + "SELECT ts, " + ", ".join(
    f"""round(max(value) FILTER (WHERE entity_id = '{n}'), 5) AS "{n}" """ for n in _NATIONS) + " FROM pb GROUP BY 1")
def p29(spark, sf):
    return rounded(tables.to_wide(pb_monthly(spark, sf), _NATIONS), 5)


@query("P29_wide_to_long", with_("pb") + f"""SELECT e.entity_id, t.ts, {R('value', 5)} AS value FROM (SELECT DISTINCT ts FROM pb) t
    CROSS JOIN (SELECT n_name AS entity_id FROM nation) e LEFT JOIN pb ON pb.ts = t.ts AND pb.entity_id = e.entity_id""")
def p29b(spark, sf):
    return rounded(tables.to_long(tables.to_wide(pb_monthly(spark, sf), _NATIONS), _NATIONS), 5)


@query("P30_run_config", with_("pd") + """SELECT entity_id, count(DISTINCT date_trunc('month', ts)) AS n_months FROM pd
    WHERE ts BETWEEN DATE '1948-01-01' AND DATE '2020-01-01' GROUP BY 1 HAVING count(DISTINCT date_trunc('month', ts)) >= 8""")
def p30(spark, sf):
    c = RunConfig(min_months=8)
    return clean.month_counts(pd_daily(spark, sf), c.start, c.end).filter(F.col("n_months") >= c.min_months)


@query("P31_grid_descriptors", with_("cpts", s=_snap_sql(LAND_SURFACE, "cpts"), d=_snap_sql(DROUGHT_INDEX, "cpts")) +
       """SELECT s.entity_id, CAST(s.row AS BIGINT) * 1440 + s.col AS land_cell, CAST(d.row AS BIGINT) * 144 + d.col AS drought_cell
       FROM s JOIN d USING (entity_id)""")
def p31(spark, sf):
    pts = customer_points(spark, sf)
    cell = lambda spec, name: (F.col("row").cast("bigint") * spec.n_cols + F.col("col")).alias(name)
    land = grids.snap(pts, LAND_SURFACE).select("entity_id", "lon", "lat", cell(LAND_SURFACE, "land_cell"))
    return grids.snap(land, DROUGHT_INDEX).select("entity_id", "land_cell", cell(DROUGHT_INDEX, "drought_cell"))
