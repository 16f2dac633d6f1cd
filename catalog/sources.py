import functools

from pyspark.sql import DataFrame, functions as F

from catalog.common import (R, customer_points, pchip_ctes, pd_daily, query, raster, rounded, table, with_)
from panelspark.config import DROUGHT_INDEX, RunConfig
from panelspark.functions.dates import month_from_name
from panelspark.operators import grid as grids
from panelspark.plans.run import Inputs, clean_stage
from panelspark.session import new_path
from panelspark.sources import cubes, raster as rasters, tables


def readings_text(spark, sf):
    return pd_daily(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("Date"),
                                      F.col("entity_id").alias("Well ID"),
                                      F.col("value").cast("string").alias("Measurement"))


def locations_text(spark, sf):
    return customer_points(spark, sf).select(F.col("entity_id").alias("Well ID"),
                                             F.col("lon").cast("string").alias("Longitude"),
                                             F.col("lat").cast("string").alias("Latitude"))


PANEL_SQL = with_("pd") + f"SELECT entity_id, ts, {R('value', 4)} AS value FROM pd"
POINTS_SQL = with_("cpts") + "SELECT entity_id, lon, lat FROM cpts"


def _panel(df):
    return rounded(df.withColumn("ts", F.col("ts").cast("date")), 4)


@query("S1_read_readings", PANEL_SQL)
def s1(spark, sf):
    path = new_path(spark, "readings")
    readings_text(spark, sf).write.option("header", True).csv(path)
    return _panel(tables.readings(tables.read_readings(spark, path)))


@query("S2_read_locations", POINTS_SQL)
def s2(spark, sf):
    path = new_path(spark, "locations")
    locations_text(spark, sf).write.option("header", True).csv(path)
    return tables.locations(tables.read_locations(spark, path))


@query("S3_validate_locations", POINTS_SQL)
def s3(spark, sf):
    return tables.locations(locations_text(spark, sf))


@query("S4_validate_readings", PANEL_SQL)
def s4(spark, sf):
    return _panel(tables.readings(readings_text(spark, sf)))


@query("S4_quarantine", """SELECT CASE WHEN bad THEN 'quarantined' ELSE 'good' END AS outcome, count(*) AS n_rows,
    count(DISTINCT o_custkey) AS n_entities
    FROM (SELECT o_custkey, o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' AS bad FROM orders) GROUP BY 1""")
def s4_quarantine(spark, sf):
    # urgent orders get a date that does not exist, pending ones a word for a number
    o = table(spark, sf, "orders")
    text = o.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("1999-02-31"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Date"),
        F.col("o_custkey").cast("string").alias("Well ID"),
        F.when(F.col("o_orderstatus") == "P", F.lit("pending"))
         .otherwise(F.col("o_totalprice").cast("string")).alias("Measurement"))
    good, bad = tables.split_readings(text)
    both = (good.select("entity_id", F.lit("good").alias("outcome"))
            .unionByName(bad.select(F.col("`Well ID`").alias("entity_id"), F.lit("quarantined").alias("outcome"))))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count_distinct("entity_id").alias("n_entities"))


@query("S5_raw_tables", with_("pd", "cpts") + f"""SELECT pd.entity_id, pd.ts, {R('value', 4)} AS value, lon, lat
    FROM pd LEFT JOIN cpts USING (entity_id)""")
def s5(spark, sf):
    raw = tables.raw_tables(readings_text(spark, sf), locations_text(spark, sf))
    return _panel(raw["timeseries_raw"].join(raw["locations_raw"], "entity_id", "left"))


@query("S6_duplicate_keys", """SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(o_orderdate AS DATE) AS ts,
    count(*) AS n_rows FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def s6(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("entity_id"),
                                          F.col("o_orderdate").cast("date").alias("ts"))
    return tables.duplicates(o)


def _cube(spark, sf):
    """lineitem as cube(t, row, col, variable) with row 0 in the south."""
    m = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return (table(spark, sf, "lineitem")
            .groupBy(m.alias("t"), (F.col("l_partkey") % 55).cast("int").alias("row"),
                     (F.col("l_suppkey") * 7 % 144).cast("int").alias("col"))
            .agg(F.sum("l_quantity").alias("sc_PDSI_pm_filled"), F.max("l_extendedprice").alias("peak")))


_CUBE_SQL = """SELECT (54 - CAST(l_partkey % 55 AS BIGINT)) * 144 + l_suppkey * 7 % 144 AS cell_id,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, sum(l_quantity) AS "sc_PDSI_pm_filled", max(l_extendedprice) AS peak
    FROM lineitem GROUP BY 1, 2"""


@query("S7_cube_to_table", f"""SELECT cell_id, ts, CASE WHEN "sc_PDSI_pm_filled" <> 50 THEN "sc_PDSI_pm_filled" END
    AS "sc_PDSI_pm_filled" FROM ({_CUBE_SQL})""")
def s7(spark, sf):
    # 50 plays the part of the file's fill value
    return grids.cube_to_table(_cube(spark, sf), DROUGHT_INDEX, "1995-01-01", fill_value=50.0)


def _monthly_files(spark, sf):
    """The cube as one folder of files per month, named like the published monthly files."""
    path = new_path(spark, "cubes")
    name = F.date_format(F.add_months(F.lit("1995-01-01").cast("date"), F.col("t")), "'GRID.A'yyyyMM'.021.parquet'")
    (_cube(spark, sf).withColumn("file", name).drop("t").repartition("file")
     .write.partitionBy("file").parquet(path))
    return path


@query("S8_monthly_cubes_to_table", _CUBE_SQL)
def s8(spark, sf):
    cube = cubes.read_monthly_cubes(spark, _monthly_files(spark, sf))
    return grids.monthly_cubes_to_table(cube, DROUGHT_INDEX, F.col("ts"), ["sc_PDSI_pm_filled", "peak"])


@query("S9_file_months", "SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts FROM lineitem")
def s9(spark, sf):
    return cubes.file_months(spark, _monthly_files(spark, sf)).select("ts").distinct()


@query("S9_month_from_name", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, count(*) AS n_rows
    FROM orders GROUP BY 1""")
def s9b(spark, sf):
    name = F.date_format("o_orderdate", "'https://host/data/1995/GRID_025_M.A'yyyyMM'.021.nc4'")
    return (table(spark, sf, "orders").select(month_from_name(name).alias("ts"))
            .groupBy("ts").agg(F.count(F.lit(1)).alias("n_rows")))


@query("S10_read_cells", f"""WITH cube AS ({_CUBE_SQL}) SELECT cell_id, ts, "sc_PDSI_pm_filled" FROM cube
    WHERE cell_id IN (SELECT s_suppkey * 79 % 7920 FROM supplier)""")
def s10(spark, sf):
    full = grids.cube_to_table(_cube(spark, sf), DROUGHT_INDEX, "1995-01-01", ["sc_PDSI_pm_filled", "peak"])
    directory = new_path(spark, "stages")
    tables.write_stage(full, directory, "grid", sort_by=["cell_id", "ts"])
    cells = table(spark, sf, "supplier").select((F.col("s_suppkey") * 79 % 7920).alias("cell_id")).distinct()
    return tables.read_cells(spark, directory, "grid", cells, ["sc_PDSI_pm_filled"])


@query("S11_write_stage", PANEL_SQL)
def s11(spark, sf):
    path = tables.write_stage(pd_daily(spark, sf), new_path(spark, "stages"), "panel",
                              sort_by=["entity_id", "ts"])
    return _panel(spark.read.parquet(path))


@query("S12_read_stage", with_("pd") + "SELECT entity_id, count(*) AS n_rows FROM pd GROUP BY 1")
def s12(spark, sf):
    directory = new_path(spark, "stages")
    tables.write_stage(pd_daily(spark, sf), directory, "panel")
    stage = tables.read_stage(spark, directory, "panel", ["entity_id"])
    return stage.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_rows"))


RASTER_SQL = with_("raster") + f"SELECT ts, row, col, lon, lat, {R('value')} AS value FROM raster"


@query("S13_write_raster", with_("raster") + f"""SELECT CAST(date_diff('day', DATE '0001-01-01', ts) + 2 AS DOUBLE) AS time,
    CAST(year(ts) AS INTEGER) AS year, row, col, {R('value')} AS value FROM raster""")
def s13(spark, sf):
    path = rasters.write_raster(raster(spark, sf), new_path(spark, "stages"), "raster")
    return rounded(spark.read.parquet(path).select("time", "year", "row", "col", "value"))


@query("S14_read_raster", RASTER_SQL)
def s14(spark, sf):
    directory = new_path(spark, "stages")
    rasters.write_raster(raster(spark, sf), directory, "raster")
    return rounded(rasters.read_raster(spark, directory, "raster"))


@query("S15_curve_csv", with_("raster") + """, t0 AS (SELECT row, col, value AS v0 FROM raster
    WHERE ts = (SELECT min(ts) FROM raster))
    SELECT ts, round(avg(value - v0), 4) + 0e0 AS delta FROM raster LEFT JOIN t0 USING (row, col) GROUP BY ts""")
def s15(spark, sf):
    from panelspark.operators.storage import mean_change
    path = rasters.write_curve(mean_change(raster(spark, sf)), new_path(spark, "curve"))
    return rounded(spark.read.schema("ts date, delta double").option("header", True).csv(path), 4)


_S17 = with_("pd", "cpts", months="""SELECT entity_id, count(DISTINCT date_trunc('month', ts)) AS m FROM pd GROUP BY 1""",
             good="SELECT entity_id FROM months WHERE m >= 8",
             qual="SELECT * FROM pd WHERE entity_id IN (SELECT entity_id FROM good)", **pchip_ctes("qual", 365, 90))


@query("S17_stage_tables", _S17 + """SELECT 'timeseries_raw' AS name, count(DISTINCT entity_id) AS n_entities, count(*) AS n_rows FROM pd
    UNION ALL SELECT 'locations_raw', count(*), count(*) FROM cpts
    UNION ALL SELECT 'locations', count(*), count(*) FROM cpts WHERE entity_id IN (SELECT entity_id FROM good)
    UNION ALL SELECT 'timeseries', count(DISTINCT entity_id), count(*) FROM interp""")
def s17(spark, sf):
    inputs = Inputs(readings_text(spark, sf), locations_text(spark, sf), None, None, None)
    config = RunConfig(start="1995-01-01", end="2001-12-01", min_months=8, max_std=1e6)
    out = clean_stage(spark, inputs, config, new_path(spark, "run"))
    parts = [out[n].select(F.lit(n).alias("name"), "entity_id")
             for n in ("timeseries_raw", "locations_raw", "locations", "timeseries")]
    return (functools.reduce(DataFrame.unionByName, parts).groupBy("name")
            .agg(F.count_distinct("entity_id").alias("n_entities"), F.count(F.lit(1)).alias("n_rows")))
