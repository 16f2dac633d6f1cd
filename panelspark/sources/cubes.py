"""Gridded cubes whose month is part of the file name."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions.dates import month_from_name


def file_months(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts) of the files under `path`, month taken from `<product>.A<yyyymm>.<version>`."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.select(F.col("path").alias("file")).withColumn("ts", month_from_name(F.col("file")))


def read_monthly_cubes(spark: SparkSession, path: str) -> DataFrame:
    """All monthly files in one read, with `ts` from each file's path."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    return df.withColumn("ts", month_from_name(F.col("_metadata.file_path")))
