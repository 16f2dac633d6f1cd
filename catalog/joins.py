from pyspark.sql import functions as F

from catalog.common import (COARSE, CTE, END, R, START, customer_points, dense_sql, diamond_edges,
                            drought_grid, grid_sql, land_grid, nation_points, pa_daily, pa_monthly, pb_monthly,
                            pchip_ctes, pd_daily, query, rounded, table, with_)
from catalog.projections import _snap_sql
from panelspark.config import DROUGHT_INDEX
from panelspark.operators import clean, features as feat, grid as grids, polygon, relate, report, timeline

_EXTRA = {
    "peaks": """SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
        max(l_extendedprice) AS peak FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2""",
    "parts": """SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
        count(DISTINCT l_partkey) AS n_parts FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2""",
}


def _extras(spark, sf):
    li = table(spark, sf, "lineitem")
    key = [F.col("l_suppkey").cast("string").alias("entity_id"), F.trunc("l_shipdate", "MM").alias("ts")]
    return (li.filter("l_returnflag = 'R'").groupBy(*key).agg(F.max("l_extendedprice").alias("peak")),
            li.filter("l_linestatus = 'F'").groupBy(*key).agg(F.count_distinct("l_partkey").alias("n_parts")))


@query("J1_left_join_chain", with_("pam", **_EXTRA) + f"""SELECT pam.entity_id, pam.ts, {R('value')} AS value, peak, n_parts
    FROM pam LEFT JOIN peaks USING (entity_id, ts) LEFT JOIN parts USING (entity_id, ts)""")
def j1(spark, sf):
    return rounded(feat.join_tables(pa_monthly(spark, sf), *_extras(spark, sf)))


@query("J2_label_rows", with_("pam", **_EXTRA) + f"""SELECT entity_id, ts, {R('value')} AS value, peak, n_parts
    FROM pam JOIN peaks USING (entity_id, ts) JOIN parts USING (entity_id, ts)""")
def j2(spark, sf):
    peaks, parts = _extras(spark, sf)
    features = feat.complete_rows(feat.join_tables(peaks, parts), ["peak", "n_parts"])
    return rounded(feat.label_rows(pa_monthly(spark, sf), features))


_ACCEPTED = """SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
        max(l_extendedprice) AS value FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2"""


def accepted(spark, sf):
    """Highest price of the accepted lines by supplier and month: other months than those of returned lines."""
    return (table(spark, sf, "lineitem").filter("l_returnflag = 'A'")
            .groupBy(F.col("l_suppkey").cast("string").alias("entity_id"), F.trunc("l_shipdate", "MM").alias("ts"))
            .agg(F.max("l_extendedprice").alias("value")))


@query("J3_outer_join", with_(acc=_ACCEPTED, **_EXTRA) + """SELECT entity_id, ts, value, yhat
    FROM acc FULL JOIN (SELECT entity_id, ts, peak AS yhat FROM peaks) USING (entity_id, ts)""")
def j3(spark, sf):
    return report.prediction_pairs(accepted(spark, sf), _extras(spark, sf)[0].withColumnRenamed("peak", "yhat"))


_IN_DIAMOND = """EXISTS (SELECT 1 FROM diamonds d WHERE abs(g.lon - d.lon) + abs(g.lat - d.lat) < d.radius
    AND NOT (d.has_hole AND abs(g.lon - d.lon) + abs(g.lat - d.lat) <= 1))"""


@query("J5_cells_in_polygons", with_("diamonds", g=grid_sql(DROUGHT_INDEX)) + f"SELECT g.* FROM g WHERE {_IN_DIAMOND}")
def j5(spark, sf):
    return polygon.cells_in_polygons(diamond_edges(spark, sf), DROUGHT_INDEX)


_USED_CELLS = """SELECT DISTINCT CAST(l_partkey % 55 * 144 + l_suppkey * 7 % 144 AS BIGINT) AS cell_id FROM lineitem"""


def _used_cells(spark, sf):
    used = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 55 * 144 + F.col("l_suppkey") * 7 % 144).alias("cell_id")).distinct()
    return used.select("cell_id", *grids.cell_columns(DROUGHT_INDEX, F.col("cell_id")))


@query("J6_nearest_cells", with_("cpts", g=grid_sql(DROUGHT_INDEX), used=_USED_CELLS, ranked="""SELECT entity_id, cell_id,
    sqrt((c.lon - g.lon) * (c.lon - g.lon) + (c.lat - g.lat) * (c.lat - g.lat)) AS distance,
    row_number() OVER (PARTITION BY entity_id ORDER BY (c.lon - g.lon) * (c.lon - g.lon) + (c.lat - g.lat) * (c.lat - g.lat), cell_id) AS rank
    FROM cpts c, g JOIN used USING (cell_id)""") + f"SELECT entity_id, cell_id, {R('distance')} AS distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3")
def j6(spark, sf):
    return rounded(grids.nearest_cells(customer_points(spark, sf), _used_cells(spark, sf), DROUGHT_INDEX, k=3))


_NEAREST_COARSE = """SELECT entity_id, cell_id FROM (SELECT entity_id, cell_id, row_number() OVER (PARTITION BY entity_id ORDER BY
    (c.lon - g.lon) * (c.lon - g.lon) + (c.lat - g.lat) * (c.lat - g.lat), cell_id) AS rn
    FROM {pts} c, cells g WHERE cell_id IN (SELECT cell_id FROM drought)) WHERE rn = 1"""


def coarse_cells(spark, grid):
    used = grid.select("cell_id").distinct()
    return used.select("cell_id", *grids.cell_columns(COARSE, F.col("cell_id")))


@query("J7_nearest_cell_series", with_("cpts", "cells", "drought", near=_NEAREST_COARSE.format(pts="cpts")) +
       'SELECT entity_id, cell_id, ts, "sc_PDSI_pm_filled" FROM near JOIN drought USING (cell_id)')
def j7(spark, sf):
    grid = drought_grid(spark, sf)
    return grids.nearest_cell_series(customer_points(spark, sf), coarse_cells(spark, grid), grid, COARSE,
                                     ["sc_PDSI_pm_filled"])


@query("J8_keep_located", with_("cpts", "pd") + """SELECT entity_id, lon, lat FROM cpts WHERE entity_id IN
    (SELECT entity_id FROM pd GROUP BY 1 HAVING count(*) >= 10)""")
def j8(spark, sf):
    panel = pd_daily(spark, sf)
    kept = panel.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")
    return clean.keep_located(customer_points(spark, sf), kept)


# complete candidate series: missing months get the mean, but NATION_3 stays incomplete in 1996
CTE["pbc"] = f"""SELECT entity_id, ts, CASE WHEN entity_id = 'NATION_3' AND year(ts) = 1996 THEN value
    ELSE coalesce(value, round(avg(value) OVER (PARTITION BY entity_id), 6)) END AS value FROM ({dense_sql('pb')})"""


def pb_candidates(spark, sf):
    panel = pb_monthly(spark, sf)
    dense = timeline.densify(panel, START, END)
    mean = panel.groupBy("entity_id").agg(F.round(F.avg("value"), 6).alias("_m"))
    keep_gap = (F.col("entity_id") == "NATION_3") & (F.year("ts") == 1996)
    return dense.join(mean, "entity_id").select(
        "entity_id", "ts", F.when(keep_gap, F.col("value")).otherwise(F.coalesce("value", "_m")).alias("value"))


@query("J9_other_candidates", "SELECT n_name AS target, (SELECT count(*) - 1 FROM nation) AS n_candidates FROM nation")
def j9(spark, sf):
    rel = relate.relations(pb_monthly(spark, sf), pb_candidates(spark, sf), nation_points(spark, sf))
    return (rel.filter(F.col("target") != F.col("candidate")).groupBy("target")
            .agg(F.count(F.lit(1)).alias("n_candidates")))


@query("J10_lookup_by_label", with_("cpts", "land", s=_snap_sql(COARSE, "cpts")) + """SELECT cell_id, ts, "Qsb_acc" FROM land
    WHERE cell_id IN (SELECT CAST(row AS BIGINT) * 12 + col FROM s)""")
def j10(spark, sf):
    cells = grids.snap(customer_points(spark, sf), COARSE).select(
        (F.col("row").cast("bigint") * COARSE.n_cols + F.col("col")).alias("cell_id"))
    return land_grid(spark, sf).select("cell_id", "ts", "Qsb_acc").join(cells.distinct(), "cell_id", "left_semi")


_SPARSE_GRID = """SELECT l_partkey * 4 AS cell_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
    sum(CASE WHEN l_discount > 0.05 AND l_quantity > 45 THEN l_quantity END) AS a, sum(l_quantity) AS b FROM lineitem GROUP BY 1, 2"""


def _sparse_grid(spark, sf):
    return (table(spark, sf, "lineitem").groupBy((F.col("l_partkey") * 4).alias("cell_id"), F.trunc("l_shipdate", "MM").alias("ts"))
            .agg(F.expr("sum(CASE WHEN l_discount > 0.05D AND l_quantity > 45 THEN l_quantity END)").alias("a"),
                 F.sum("l_quantity").alias("b")))


@query("J11_query_cells", f"""WITH sg AS ({_SPARSE_GRID}), g AS ({grid_sql(DROUGHT_INDEX)})
    SELECT cell_id, lon, lat, ts, a, b FROM sg JOIN g USING (cell_id)
    WHERE cell_id IN (SELECT cell_id FROM sg WHERE a IS NOT NULL)""")
def j11(spark, sf):
    cells = grids.create_grid(spark, DROUGHT_INDEX)
    rows, places = grids.query_cells(_sparse_grid(spark, sf), cells, ["a", "b"])
    return rows.join(places.select("cell_id", "lon", "lat"), "cell_id")


@query("J12_crop_grid", with_("diamonds", "box", sg=_SPARSE_GRID, g=grid_sql(DROUGHT_INDEX)) + """SELECT cell_id, ts, a, b FROM sg JOIN g USING (cell_id), box
    WHERE lon BETWEEN x_min - 1.25e0 AND x_max + 1.25e0 AND lat BETWEEN y_min - 1.25e0 AND y_max + 1.25e0
    AND cell_id IN (SELECT cell_id FROM sg WHERE a IS NOT NULL)""")
def j12(spark, sf):
    return grids.crop_grid(spark, diamond_edges(spark, sf), DROUGHT_INDEX, _sparse_grid(spark, sf), ["a", "b"])[0]


@query("J13_segment_join", with_("pa", **pchip_ctes("pa")) + f"SELECT entity_id, ts, {R('value', 7)} AS value FROM interp")
def j13(spark, sf):
    return rounded(clean.interpolate(pa_daily(spark, sf)), 7)


@query("J14_densify", with_("pb", dense=dense_sql("pb")) + f"SELECT entity_id, ts, {R('value', 5)} AS value FROM dense")
def j14(spark, sf):
    return rounded(timeline.densify(pb_monthly(spark, sf), START, END), 5)
