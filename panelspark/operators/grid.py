"""Regular grids: generation, cropping, cubes to tables, nearest cells."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.config import GridSpec
from panelspark.operators.nearest import has_position, nearest
from panelspark.operators.skew import attach


# --- grid generation ------------------------------------------------------------------

def cell_columns(spec: GridSpec, cell_id: Column) -> list[Column]:
    """row, col, lon, lat of a cell number, row-major from north-west."""
    row = F.floor(cell_id / spec.n_cols).cast("int")
    col = F.pmod(cell_id, F.lit(spec.n_cols)).cast("int")
    return [row.alias("row"), col.alias("col"),
            (F.lit(spec.x_min) + col * F.lit(spec.res_x)).alias("lon"),
            (F.lit(spec.y_max) - row * F.lit(spec.res_y)).alias("lat")]


def create_grid(spark: SparkSession, spec: GridSpec) -> DataFrame:
    cells = spark.range(spec.n_cells).withColumnRenamed("id", "cell_id")
    return cells.select("cell_id", *cell_columns(spec, F.col("cell_id")))


def grid_in_box(spark: SparkSession, spec: GridSpec, box: DataFrame) -> DataFrame:
    """Cells of the grid inside a one-row box (x_min, y_min, x_max, y_max).

    The rows and columns of the box follow by arithmetic, so the work grows with the cells
    kept and not with the grid.
    """
    eps = 1e-9
    def bounds(lo, hi, n):
        return (F.greatest(F.ceil(lo - eps), F.lit(0)).cast("int"),
                F.least(F.floor(hi + eps), F.lit(n - 1)).cast("int"))
    r0, r1 = bounds((spec.y_max - F.col("y_max")) / spec.res_y,
                    (spec.y_max - F.col("y_min")) / spec.res_y, spec.n_rows)
    c0, c1 = bounds((F.col("x_min") - spec.x_min) / spec.res_x,
                    (F.col("x_max") - spec.x_min) / spec.res_x, spec.n_cols)
    rows = box.select("*", F.explode(F.when(r0 <= r1, F.sequence(r0, r1))).alias("row"))
    cells = rows.select("*", F.explode(F.when(c0 <= c1, F.sequence(c0, c1))).alias("col"))
    cell_id = F.col("row").cast("bigint") * spec.n_cols + F.col("col")
    cells = cells.select(cell_id.alias("cell_id"), "x_min", "y_min", "x_max", "y_max")
    cells = cells.select("*", *cell_columns(spec, F.col("cell_id")))
    return (cells.filter(F.col("lon").between(F.col("x_min"), F.col("x_max"))
                         & F.col("lat").between(F.col("y_min"), F.col("y_max")))
            .drop("x_min", "y_min", "x_max", "y_max"))


# --- boxes ----------------------------------------------------------------------------

def bounding_box(edges: DataFrame) -> DataFrame:
    """One row x_min, y_min, x_max, y_max over all polygon edges; error when degenerate."""
    box = edges.agg(
        F.least(F.min("x1"), F.min("x2")).alias("x_min"),
        F.least(F.min("y1"), F.min("y2")).alias("y_min"),
        F.greatest(F.max("x1"), F.max("x2")).alias("x_max"),
        F.greatest(F.max("y1"), F.max("y2")).alias("y_max"))
    ok = (F.col("x_min") < F.col("x_max")) & (F.col("y_min") < F.col("y_max"))
    message = F.lit("polygon layer has no valid bounding box; is it in WGS84?")
    checked = F.when(F.coalesce(ok, F.lit(False)), F.col("x_min")).otherwise(
        F.raise_error(message).cast("double"))
    return box.withColumn("x_min", checked)


def pad_box(box: DataFrame, pad_x: float = 0.0, pad_y: float = 0.0) -> DataFrame:
    if not 0 <= pad_x <= 180:
        raise ValueError("padding in longitude must be between 0 and 180 degrees")
    if not 0 <= pad_y <= 90:
        raise ValueError("padding in latitude must be between 0 and 90 degrees")
    return box.select((F.col("x_min") - pad_x).alias("x_min"), (F.col("y_min") - pad_y).alias("y_min"),
                      (F.col("x_max") + pad_x).alias("x_max"), (F.col("y_max") + pad_y).alias("y_max"))


def intercepting_cells(spark: SparkSession, spec: GridSpec, box: DataFrame, pad: bool = True,
                       exclude: DataFrame | None = None, require: bool = True) -> DataFrame:
    """Cells whose centres lie in the box, padded by half a cell; error when there are none."""
    if not isinstance(pad, bool):
        raise ValueError("pad must be a boolean")
    padded = pad_box(box, spec.res_x / 2, spec.res_y / 2) if pad else pad_box(box)
    cells = grid_in_box(spark, spec, padded)
    if exclude is not None:
        cells = cells.join(exclude.select("cell_id"), "cell_id", "left_anti")
    if require and cells.isEmpty():
        raise ValueError("no grid cell intercepts the box")
    return cells


# --- cubes to tables ------------------------------------------------------------------

def cube_to_table(cube: DataFrame, spec: GridSpec, start: str, variables=None,
                  fill_value: float | None = None) -> DataFrame:
    """cube(t, row, col, variables), row 0 in the south -> grid(cell_id, ts, variables).

    `t` counts months from `start`. All variables come out of one pass.
    """
    ts = F.add_months(F.lit(start).cast("date"), F.col("t").cast("int"))
    return _tabular(cube, spec, ts, variables, fill_value)


def monthly_cubes_to_table(cube: DataFrame, spec: GridSpec, month: Column, variables=None,
                           fill_value: float | None = None) -> DataFrame:
    """As `cube_to_table` for one file per month; `month` is read from the file name."""
    return _tabular(cube, spec, month, variables, fill_value)


def _tabular(cube, spec, ts, variables, fill_value):
    variables = list(variables or spec.variables)
    north_down = F.lit(spec.n_rows - 1) - F.col("row")
    cell_id = (north_down.cast("bigint") * spec.n_cols + F.col("col")).alias("cell_id")
    return cube.select(cell_id, ts.alias("ts"),
                       *[missing_to_null(F.col(v), fill_value).alias(v) for v in variables])


def missing_to_null(c: Column, fill_value: float | None = None) -> Column:
    ok = ~F.isnan(c)
    if fill_value is not None:
        ok = ok & (c != F.lit(fill_value))
    return F.when(ok, c.cast("double"))


# --- cells with data ------------------------------------------------------------------

def cells_with_data(grid: DataFrame, variables) -> DataFrame:
    """Cells that have any value in the first variable."""
    return (grid.groupBy("cell_id").agg(F.count(variables[0]).alias("_n"))
            .filter(F.col("_n") > 0).select("cell_id"))


def valid_columns(grid: DataFrame, variables) -> DataFrame:
    """Per cell the number of values of each variable; cells without any value are dropped."""
    counts = grid.groupBy("cell_id").agg(*[F.count(v).alias(v) for v in variables])
    return counts.filter(F.greatest(F.lit(0), *[F.col(v) for v in variables]) > 0)


def query_cells(grid: DataFrame, cells: DataFrame, variables) -> tuple[DataFrame, DataFrame]:
    """(grid rows, locations) of the wanted cells that have data in the first variable."""
    wanted = grid.select("cell_id", "ts", *variables).join(
        cells.select("cell_id"), "cell_id", "left_semi")
    alive = cells_with_data(wanted, variables)
    return (wanted.join(alive, "cell_id", "left_semi"),
            cells.join(alive, "cell_id", "left_semi"))


def crop_grid(spark: SparkSession, edges: DataFrame, spec: GridSpec, grid: DataFrame,
              variables=None, pad: bool = True) -> tuple[DataFrame, DataFrame]:
    """Polygon layer + tabular grid -> (grid rows, locations) of the polygon's padded box."""
    variables = list(variables or spec.variables)
    cells = intercepting_cells(spark, spec, bounding_box(edges), pad, require=False)
    return query_cells(grid, cells, variables)


# --- nearest cells --------------------------------------------------------------------

def snap(points: DataFrame, spec: GridSpec, lon="lon", lat="lat") -> DataFrame:
    """Adds row and col of the nearest cell centre of the full grid (ties: lower cell number); NULL without a position."""
    def index(v, n):
        return F.when(has_position(lon, lat), F.least(F.greatest(F.ceil(v - 0.5), F.lit(0)), F.lit(n - 1)).cast("int"))
    return points.select("*",
        index((F.lit(spec.y_max) - F.col(lat)) / spec.res_y, spec.n_rows).alias("row"),
        index((F.col(lon) - F.lit(spec.x_min)) / spec.res_x, spec.n_cols).alias("col"))


def nearest_cells(points: DataFrame, cells: DataFrame, spec: GridSpec, k: int = 1,
                  key: str = "entity_id") -> DataFrame:
    """(key, cell_id, distance, rank): the `k` nearest cells of `cells` for every point with a position.

    Distances are Euclidean in degrees, ties go to the lower cell number.
    """
    return nearest(points, cells.select("cell_id", "lon", "lat"), k, key, "cell_id")


def nearest_cell_series(points: DataFrame, cells: DataFrame, grid: DataFrame, spec: GridSpec,
                        variables, key: str = "entity_id") -> DataFrame:
    """The series of the nearest cell for every point: (key, cell_id, ts, variables).

    A cell's series is one row of at most a calendar's length, so a cell that is the nearest
    one of very many points can be repeated over partitions.
    """
    link = nearest_cells(points, cells, spec, 1, key).select(key, "cell_id")
    used = link.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    series = (grid.select("cell_id", "ts", *variables).join(used, "cell_id")
              .groupBy("cell_id").agg(F.first("n").alias("n"),
                                      F.collect_list(F.struct("ts", *variables)).alias("_s")))
    return (attach(link, series, "cell_id", spread=key)
            .select(key, "cell_id", F.inline("_s")))
