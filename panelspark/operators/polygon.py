"""Grid cells inside polygons by scan lines.

Polygons are edge tables (poly_id, ring_id, seq, x1, y1, x2, y2); one `poly_id` per polygon
part, holes are further rings of the part. Every edge is cut with the latitude rows it spans,
the cuts of a row are paired to intervals, and an interval yields its columns by arithmetic:
no cell is ever joined with an edge.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelspark.config import GridSpec
from panelspark.operators.grid import bounding_box


def _row_lat(spec: GridSpec, row: Column) -> Column:
    return F.lit(spec.y_max) - row * F.lit(spec.res_y)


def _col_lon(spec: GridSpec, col: Column) -> Column:
    return F.lit(spec.x_min) + col * F.lit(spec.res_x)


def _rows_of(spec, y_lo, y_hi):
    lo = F.greatest(F.floor((spec.y_max - y_hi) / spec.res_y), F.lit(0)).cast("int")
    hi = F.least(F.ceil((spec.y_max - y_lo) / spec.res_y), F.lit(spec.n_rows - 1)).cast("int")
    return F.when(lo <= hi, F.sequence(lo, hi))


def _cols_of(spec, x_lo, x_hi):
    lo = F.greatest(F.floor((x_lo - spec.x_min) / spec.res_x), F.lit(0)).cast("int")
    hi = F.least(F.ceil((x_hi - spec.x_min) / spec.res_x), F.lit(spec.n_cols - 1)).cast("int")
    return F.when(lo <= hi, F.sequence(lo, hi))


def cells_in_polygons(edges: DataFrame, spec: GridSpec, exclude: DataFrame | None = None) -> DataFrame:
    """(cell_id, row, col, lon, lat) of the centres inside the union of all parts, without those of `exclude` (cell_id).

    Centres on the boundary of a part are not inside that part.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    lat = F.col("_lat")
    on_rows = (edges.withColumn("row", F.explode(_rows_of(spec, F.least(y1, y2), F.greatest(y1, y2))))
               .withColumn("_lat", _row_lat(spec, F.col("row")))
               .filter(lat.between(F.least(y1, y2), F.greatest(y1, y2))))
    cut = F.when(y1 != y2, (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
    on_rows = on_rows.withColumn("_x", cut)

    # even-odd intervals between consecutive cuts of one row of one part
    cuts = on_rows.filter((y1 > lat) != (y2 > lat))
    w = Window.partitionBy("poly_id", "row").orderBy("_x", "ring_id", "seq")
    spans = (cuts.select("poly_id", "row", "_x", F.lead("_x").over(w).alias("_to"),
                         F.row_number().over(w).alias("_n"))
             .filter(F.col("_n") % 2 == 1))
    inside = (spans.withColumn("col", F.explode(_cols_of(spec, F.col("_x"), F.col("_to"))))
              .withColumn("_lon", _col_lon(spec, F.col("col")))
              .filter((F.col("_lon") > F.col("_x")) & (F.col("_lon") < F.col("_to")))
              .select("poly_id", "row", "col"))

    # centres exactly on an edge
    x_lo = F.when(y1 != y2, F.col("_x")).otherwise(F.least(x1, x2))
    x_hi = F.when(y1 != y2, F.col("_x")).otherwise(F.greatest(x1, x2))
    border = (on_rows.withColumn("_a", x_lo).withColumn("_b", x_hi)
              .withColumn("col", F.explode(_cols_of(spec, F.col("_a"), F.col("_b"))))
              .filter(_col_lon(spec, F.col("col")).between(F.col("_a"), F.col("_b")))
              .select("poly_id", "row", "col").distinct())

    cells = (inside.join(border, ["poly_id", "row", "col"], "left_anti")
             .select("row", "col").distinct())
    cells = cells.select((F.col("row").cast("bigint") * spec.n_cols + F.col("col")).alias("cell_id"),
                         "row", "col", _col_lon(spec, F.col("col")).alias("lon"),
                         _row_lat(spec, F.col("row")).alias("lat"))
    return cells if exclude is None else cells.join(exclude.select("cell_id"), "cell_id", "left_anti")


def surface_grid_spec(box, n_x_cells: int) -> GridSpec:
    """Output grid of a polygon's box: square cells, `n_x_cells` columns, both upper ends open."""
    if not isinstance(n_x_cells, int) or n_x_cells <= 0:
        raise ValueError("n_x_cells must be a positive integer")
    x_min, y_min, x_max, y_max = box
    res = abs(x_max - x_min) / n_x_cells
    n_rows = math.ceil(abs(y_max - y_min) / res)
    return GridSpec(x_min=x_min, y_min=y_max - (n_rows - 1) * res,
                    x_max=x_min + (n_x_cells - 1) * res, y_max=y_max, res_x=res, res_y=res)


def surface_grid(spark: SparkSession, edges: DataFrame, n_x_cells: int = 100
                 ) -> tuple[DataFrame, GridSpec]:
    """Cells of the output surface that lie inside the polygons, and their grid."""
    box = bounding_box(edges).first()
    spec = surface_grid_spec((box.x_min, box.y_min, box.x_max, box.y_max), n_x_cells)
    return cells_in_polygons(edges, spec), spec
