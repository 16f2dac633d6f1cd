"""Raster and curve files."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions.dates import cf_date, cf_days
from panelspark.operators.storage import check_raster
from panelspark.sources.tables import read_stage

FILL_VALUE = -9999.0  # fixed value: missing cells in exchanged rasters


def write_raster(raster: DataFrame, directory: str, name: str) -> str:
    """Parquet by year, with the CF time axis next to the date."""
    path = f"{directory}/{name}"
    (raster.withColumn("time", cf_days(F.col("ts"))).withColumn("year", F.year("ts"))
     .repartition("year", F.floor(F.col("row") / 256))
     .sortWithinPartitions("ts", "row", "col")
     .write.mode("overwrite").partitionBy("year").parquet(path))
    return path


def read_raster(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """(ts, row, col, lon, lat, value) with decoded time; fill values are NULL. A raster without rows has no files."""
    try:
        df = read_stage(spark, directory, name)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        df = spark.createDataFrame([], "row int, col int, lon double, lat double, value double, time double")
    if "time" not in df.columns:
        raise ValueError("raster has no time dimension")
    ok = (F.col("value") != FILL_VALUE) & ~F.isnan("value")
    return check_raster(df.select(cf_date(F.col("time")).alias("ts"), "row", "col", "lon", "lat",
                                  F.when(ok, F.col("value")).alias("value")))


def write_curve(curve: DataFrame, path: str) -> str:
    """One CSV file; a curve has one row per month."""
    curve.coalesce(1).sortWithinPartitions("ts").write.mode("overwrite").option("header", True).csv(path)
    return path
