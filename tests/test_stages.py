"""Stages notice changed inputs."""

import os

from panelspark.config import GridSpec, RunConfig
from panelspark.plans.run import Inputs, clean_stage, crop_stage
from panelspark.sources.tables import fingerprint, read_cells, write_stage


def inputs(spark, value="1.5", side=2.0):
    readings = spark.createDataFrame([("1/1/2000", "a", value), ("2/1/2000", "a", "2.5"), ("2/3/2000", "b", "7")], "Date string, `Well ID` string, Measurement string")
    places = spark.createDataFrame([("a", 0.5, 0.5), ("b", 1.5, 0.5)], "`Well ID` string, Longitude double, Latitude double")
    corners = [(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)]
    edges = spark.createDataFrame([(0, 0, i, *a, *b) for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1]))],
                                  "poly_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    grid = spark.range(16).selectExpr("id cell_id", "DATE '2000-01-01' ts", "CAST(id AS DOUBLE) v", "CAST(-id AS DOUBLE) w")
    spec = GridSpec(0.0, 0.0, 3.0, 3.0, 1.0, 1.0, ("v",))
    return Inputs(readings, places, edges, grid, grid, spec, spec), grid, spec


def test_fingerprints_tell_contents_apart_but_not_orders(spark):
    a = spark.range(100).selectExpr("id", "CASE WHEN id % 7 > 0 THEN id END v")
    same = a.orderBy("v").repartition(3)
    assert fingerprint(a) == fingerprint(same)
    others = [a.filter("id < 99"), a.unionByName(a.limit(1)), a.selectExpr("id", "CASE WHEN id = 5 THEN 6 ELSE v END v"), a.selectExpr("id", "v AS w"), a.limit(0)]
    assert len({fingerprint(x) for x in (a, *others)}) == 6


def test_changed_inputs_make_stages_of_their_own(spark, tmp_path):
    config, directory = RunConfig(start="2000-01-01", end="2000-12-01", min_months=1), str(tmp_path / "run")

    def stages(given, variables=("v",)):
        i, grid, spec = given
        out = clean_stage(spark, i, config, directory)
        series, cells, _ = crop_stage(spark, i, directory, "drought", grid, spec, list(variables))
        return out["timeseries_raw"].count(), cells.count(), series.columns, set(os.listdir(directory))

    _, n_cells, _, first = stages(inputs(spark))
    assert stages(inputs(spark))[3] == first  # nothing changed, nothing made
    _, _, _, reading = stages(inputs(spark, value="1.6"))
    assert {n.rsplit("-", 1)[0] for n in reading - first} == {"timeseries_raw", "timeseries", "locations"}
    _, fewer, _, polygon = stages(inputs(spark, side=1.0))
    assert fewer < n_cells and {n.rsplit("-", 1)[0] for n in polygon - reading} == {"drought_wanted", "drought_grid", "drought_cells"}
    _, _, columns, variables = stages(inputs(spark), ("v", "w"))
    assert "w" in columns and {n.rsplit("-", 1)[0] for n in variables - polygon} == {"drought_grid", "drought_cells"}


def test_given_versions_spare_the_scan(spark):
    i, _, _ = inputs(spark)
    i.versions["readings"] = "v7"
    i.readings = None
    assert i.version("readings") == "v7"


def scanned(df):
    """Rows that the scans of stage tables in the final plan gave, after their filters on row groups and pages."""
    def scans(plan):
        if "AdaptiveSparkPlan" in plan.nodeName():
            return scans(plan.executedPlan())
        leaves = plan.collectLeaves()
        out = []
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            out += scans(leaf.plan()) if "QueryStage" in leaf.nodeName() else [leaf]
        return out

    return sum(x.metrics().apply("numOutputRows").value() for x in scans(df._jdf.queryExecution().executedPlan()) if "Scan parquet" in x.nodeName())


def test_scattered_cells_read_a_few_row_groups(spark, tmp_path):
    grid = spark.range(200_000).selectExpr("id div 20 cell_id", "date_add(DATE '2000-01-01', CAST(id % 20 AS INT)) ts", "CAST(id AS DOUBLE) v")
    spark._jsc.hadoopConfiguration().set("parquet.block.size", str(64 << 10))
    try:
        write_stage(grid, str(tmp_path), "grid", sort_by=["cell_id", "ts"])
    finally:
        spark._jsc.hadoopConfiguration().unset("parquet.block.size")
    for wanted, most in (([0, 5000, 9999], 30_000), ([*range(10), *range(4000, 4020), 9998, 9999], 40_000)):
        got = read_cells(spark, str(tmp_path), "grid", spark.createDataFrame([(c,) for c in wanted], "cell_id long"), ["v"])
        assert len(got.collect()) == 20 * len(wanted)
        assert 0 < scanned(got) < most
    assert read_cells(spark, str(tmp_path), "grid", spark.createDataFrame([], "cell_id long"), ["v"]).count() == 0
