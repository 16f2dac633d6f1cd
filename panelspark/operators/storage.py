"""From a raster to a curve of volume change."""

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.geometry import million_acre_feet, strip_area

RASTER_COLUMNS = ("ts", "row", "col", "value")


def check_raster(raster: DataFrame) -> DataFrame:
    missing = [c for c in RASTER_COLUMNS if c not in raster.columns]
    if missing:
        raise ValueError(f"raster has no column {missing[0]!r}")
    return raster


def mean_change(raster: DataFrame, weighted: bool = False) -> DataFrame:
    """(ts, delta): mean over the cells of the change against the first time.

    Cells that are missing at the first time or at `ts` do not count. `weighted` weights each
    cell by the cosine of its latitude instead of equally.
    """
    check_raster(raster)
    t0 = raster.agg(F.min("ts")).scalar()
    first = raster.filter(F.col("ts") == t0).select("row", "col", F.col("value").alias("_v0"))
    d = F.col("value") - F.col("_v0")
    joined = raster.join(first, ["row", "col"], "left")
    if weighted:
        w = F.when(d.isNotNull(), F.cos(F.radians("lat")))
        return joined.groupBy("ts").agg((F.sum(d * w) / F.sum(w)).alias("delta"))
    return joined.groupBy("ts").agg(F.avg(d).alias("delta"))


def resolutions(raster: DataFrame) -> DataFrame:
    """One row (res_x, res_y): spacing of neighbouring columns and rows, to 7 decimals."""
    axes = raster.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"),
                      F.min("col").alias("c0"), F.max("col").alias("c1"),
                      F.min("lat").alias("y0"), F.max("lat").alias("y1"),
                      F.min("row").alias("r0"), F.max("row").alias("r1"))
    step = lambda hi, lo, b, a: F.round(F.abs((F.col(hi) - F.col(lo)) / F.nullif(F.col(b) - F.col(a), F.lit(0))), 7)
    return axes.select(step("x1", "x0", "c1", "c0").alias("res_x"),
                       step("y1", "y0", "r1", "r0").alias("res_y"))


def footprint_area(raster: DataFrame, res_x: float | None = None, res_y: float | None = None) -> DataFrame:
    """One row (area): square feet covered by the cells that have a value at the first time."""
    check_raster(raster)
    t0 = raster.agg(F.min("ts")).scalar()
    rows = (raster.filter((F.col("ts") == t0) & F.col("value").isNotNull())
            .groupBy("row", "lat").agg(F.count(F.lit(1)).alias("n_cells")))
    if res_x is None or res_y is None:
        res = resolutions(raster)
        dx, dy = res.select("res_x").scalar(), res.select("res_y").scalar()
    else:
        dx, dy = F.lit(round(res_x, 7)), F.lit(round(res_y, 7))
    return rows.agg(F.sum(strip_area(F.col("lat"), dx, dy, F.col("n_cells"))).alias("area"))


def volume(curve: DataFrame, area: DataFrame, storage_coefficient: float = 0.2,
           change: str = "delta") -> DataFrame:
    if not 0 <= storage_coefficient <= 1:
        raise ValueError("the storage coefficient must be between 0 and 1")
    return curve.select("ts", (F.col(change) * area.scalar() * storage_coefficient).alias("storage_change"))


def filter_range(curve: DataFrame, start, end, value: str = "storage_change") -> DataFrame:
    """Clip the wanted range to the available one, keep it, and let it start at 0."""
    lo = F.greatest(F.lit(start).cast("date"), curve.agg(F.min("ts")).scalar())
    hi = F.least(F.lit(end).cast("date"), curve.agg(F.max("ts")).scalar())
    valid = F.when(lo < hi, lo).otherwise(
        F.raise_error(F.lit("nothing is left of the curve: check the start date of the range")).cast("date"))
    kept = curve.filter(F.col("ts").between(valid, hi))
    first = kept.agg(F.min_by(value, "ts")).scalar()
    return kept.withColumn(value, F.col(value) - first)


def unit_conversion(curve: DataFrame, value: str = "storage_change", units: str = "English") -> DataFrame:
    """Cubic feet to million acre-feet."""
    if units != "English":
        raise ValueError("only English units are supported")
    return curve.withColumn(value, million_acre_feet(F.col(value)))


def storage_curve(raster: DataFrame, storage_coefficient: float = 0.2, date_filter=None,
                  res_x: float | None = None, res_y: float | None = None,
                  weighted: bool = False) -> DataFrame:
    """(ts, storage_change) in million acre-feet."""
    curve = volume(mean_change(raster, weighted), footprint_area(raster, res_x, res_y), storage_coefficient)
    if date_filter:
        curve = filter_range(curve, *date_filter)
    return unit_conversion(curve)
