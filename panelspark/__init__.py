"""Spark operators for sparse panels of time series, gridded covariates and surfaces.

Everything works on long DataFrames:

* panel   (entity_id STRING, ts, value DOUBLE)
* points  (entity_id STRING, lon DOUBLE, lat DOUBLE)
* grid    (cell_id BIGINT, ts DATE, <variable> DOUBLE ...)
* raster  (ts DATE, row INT, col INT, lon DOUBLE, lat DOUBLE, value DOUBLE)

Missing values are NULL, never NaN.
"""

from panelspark.config import GridSpec, RunConfig, LAND_SURFACE, DROUGHT_INDEX
from panelspark.session import get_spark, scratch_dir, cut_lineage, ship

__all__ = ["GridSpec", "RunConfig", "LAND_SURFACE", "DROUGHT_INDEX",
           "get_spark", "scratch_dir", "cut_lineage", "ship"]
