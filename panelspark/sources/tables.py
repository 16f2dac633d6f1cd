"""Readings, locations and stage tables."""

import functools
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

READINGS_COLUMNS = ("Date", "Well ID", "Measurement")
LOCATIONS_COLUMNS = ("Well ID", "Longitude", "Latitude")

# Identifiers stay strings: long digit ids would lose digits as numbers.
READINGS_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in READINGS_COLUMNS])
LOCATIONS_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in LOCATIONS_COLUMNS])


def read_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    """CSV with a header, all columns as text; columns are found by name, extra ones ignored."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    require_columns(df, columns)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, READINGS_COLUMNS)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LOCATIONS_COLUMNS)


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; expected {list(columns)}")
    return df


def _number(c, name):
    v = c.try_cast("double")
    bad = c.isNotNull() & (F.trim(c.cast("string")) != "") & v.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} is not a number: "), c.cast("string"))).cast("double")
                  ).otherwise(F.when(~F.isnan(v), v))


def locations(df: DataFrame) -> DataFrame:
    """Checked points(entity_id, lon, lat); a coordinate that is no number is an error."""
    require_columns(df, LOCATIONS_COLUMNS)
    return df.select(F.col("`Well ID`").cast("string").alias("entity_id"),
                     _number(F.col("Longitude"), "Longitude").alias("lon"),
                     _number(F.col("Latitude"), "Latitude").alias("lat"))


def readings(df: DataFrame) -> DataFrame:
    """Checked panel(entity_id, ts, value); a bad date or number is an error."""
    require_columns(df, READINGS_COLUMNS)
    ts = _timestamp(F.col("Date"))
    bad = F.raise_error(F.concat(F.lit("invalid date: "), F.coalesce(F.col("Date").cast("string"), F.lit("NULL"))))
    return df.select(F.col("`Well ID`").cast("string").alias("entity_id"),
                     F.coalesce(ts, bad.cast("timestamp_ntz")).alias("ts"),
                     _number(F.col("Measurement"), "Measurement").alias("value"))


def _timestamp(c):
    iso = c.try_cast("timestamp_ntz")
    us = F.try_to_timestamp(c.cast("string"), F.lit("M/d/yyyy")).cast("timestamp_ntz")
    return F.coalesce(iso, us)


def split_readings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lenient variant: (good rows, quarantined input rows)."""
    require_columns(df, READINGS_COLUMNS)
    ts, v = _timestamp(F.col("Date")), F.col("Measurement").try_cast("double")
    marked = df.withColumn("_ts", ts).withColumn("_v", v)
    blank = F.col("Measurement").isNull() | (F.trim(F.col("Measurement").cast("string")) == "")
    ok = F.col("_ts").isNotNull() & (blank | F.col("_v").isNotNull())
    good = marked.filter(ok).select(F.col("`Well ID`").cast("string").alias("entity_id"),
                                    F.col("_ts").alias("ts"),
                                    F.when(~F.isnan("_v"), F.col("_v")).alias("value"))
    return good, marked.filter(~ok).drop("_ts", "_v")


def raw_tables(readings_df: DataFrame, locations_df: DataFrame) -> dict[str, DataFrame]:
    """Both inputs checked, kept next to the processed tables under *_raw names."""
    return {"timeseries_raw": readings(readings_df), "locations_raw": locations(locations_df)}


def duplicates(panel: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    """(entity, ts) pairs that occur more than once, with their number of rows."""
    return (panel.groupBy(entity, ts).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def require_unique(panel: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    bad = duplicates(panel, entity, ts).first()
    if bad is not None:
        raise ValueError(f"{bad[entity]} has {bad['n_rows']} rows at {bad[ts]}")
    return panel


def to_wide(panel: DataFrame, entities, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """One column per entity, for output only. `entities` lists the columns wanted."""
    return panel.groupBy(ts).pivot(entity, list(entities)).agg(F.first(value))


def to_long(wide: DataFrame, entities, entity="entity_id", ts="ts", value="value") -> DataFrame:
    return wide.unpivot(ts, [F.col(f"`{e}`") for e in entities], entity, value).select(entity, ts, value)


# --- stage tables ---------------------------------------------------------------------

def fingerprint(df: DataFrame) -> str:
    """A text that tells a table's rows apart from others', whatever their order: number, sum and exclusive or of the rows' hashes, and the schema."""
    row = [F.col(f"`{c}`") for c in df.columns]
    n, total, mixed = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.lit(1), *row).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(2), *row))).first()
    return f"{n}-{total}-{mixed}-{zlib.crc32(df.schema.simpleString().encode()):08x}"


def write_stage(df: DataFrame, directory: str, name: str, partition_by=None, sort_by=None) -> str:
    """Write a stage table. With `sort_by`, files hold ranges of its first column and Bloom filters on it, so readers can skip files and row groups."""
    path = f"{directory}/{name}"
    if sort_by:
        df = df.repartitionByRange(sort_by[0]).sortWithinPartitions(*sort_by)
    writer = df.write.mode("overwrite")
    if sort_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{sort_by[0]}", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_stage(spark: SparkSession, directory: str, name: str, columns=None) -> DataFrame:
    path = f"{directory}/{name}"
    if not stage_exists(spark, directory, name):
        raise FileNotFoundError(f"stage table not found: {path}")
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def stage_exists(spark: SparkSession, directory: str, name: str) -> bool:
    """A stage is complete once its success marker is written."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}/_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


RANGES = 64  # pushed down, at most
FEW_CELLS = 10  # so many are looked up one by one in the Bloom filters, as Spark pushes no longer lists down


def wanted_ranges(cells: DataFrame, key: str = "cell_id"):
    """A condition on `key` that holds for all wanted cells and can be pushed to files: the few cells themselves, or at most RANGES ranges of them."""
    low, high = cells.agg(F.min(key), F.max(key)).first()
    if low is None:
        return None
    few = cells.select(key).distinct().limit(FEW_CELLS + 1).collect()
    if len(few) <= FEW_CELLS:
        return F.col(key).isin([r[0] for r in few])
    part = F.floor((F.col(key) - F.lit(low)) * RANGES / (high - low + 1))
    runs = cells.groupBy(part.alias("part")).agg(F.min(key).alias("a"), F.max(key).alias("b")).collect()
    return functools.reduce(lambda x, y: x | y, [F.col(key).between(r["a"], r["b"]) for r in sorted(runs)])


def read_cells(spark: SparkSession, directory: str, name: str, cells: DataFrame, variables) -> DataFrame:
    """Chosen cells and variables of a stage grid: only those columns, and only row groups that can hold the cells, are read."""
    grid = read_stage(spark, directory, name, ["cell_id", "ts", *variables])
    wanted = cells.select("cell_id")
    condition = wanted_ranges(wanted)
    if condition is None:
        return grid.limit(0)
    return grid.filter(condition).join(wanted, "cell_id", "left_semi")
