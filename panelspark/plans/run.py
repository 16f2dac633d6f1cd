"""The whole chain from raw readings to the storage curve, resumable by stage."""

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from panelspark.config import DROUGHT_INDEX, LAND_SURFACE, GridSpec, RunConfig
from panelspark.operators import grid as grids
from panelspark.operators.clean import clean_panel, keep_located
from panelspark.operators.polygon import surface_grid
from panelspark.operators.storage import storage_curve
from panelspark.operators.surface import krige_panel
from panelspark.plans.imputation import satellite_imputation
from panelspark.plans.refinement import iterative_refinement
from panelspark.sources.raster import read_raster, write_curve, write_raster
from panelspark.sources.tables import fingerprint, raw_tables, read_stage, require_unique, stage_exists, write_stage


@dataclass
class Inputs:
    """Raw tables of one run: readings and locations as read from CSV, polygon edges, and the
    tabular grids (cell_id, ts, variables). `versions` may name a table's content (by field); tables without one are read
    once to fingerprint them."""

    readings: DataFrame
    locations: DataFrame
    edges: DataFrame
    drought: DataFrame
    land: DataFrame
    drought_spec: GridSpec = DROUGHT_INDEX
    land_spec: GridSpec = LAND_SURFACE
    versions: dict[str, str] = field(default_factory=dict)

    def version(self, name: str) -> str:
        if name not in self.versions:
            self.versions[name] = fingerprint(getattr(self, name))
        return self.versions[name]


def mark(*parts) -> str:
    """What a stage's name carries of what it depends on."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


def _stage(spark, directory, name, make, **options) -> DataFrame:
    """The stage table if it is complete, else compute and write it."""
    if not stage_exists(spark, directory, name):
        write_stage(make(), directory, name, **options)
    return read_stage(spark, directory, name)


def clean_stage(spark: SparkSession, inputs: Inputs, config: RunConfig, directory: str) -> dict[str, DataFrame]:
    """Raw and processed panel and locations, all four as tables."""
    raw = raw_tables(inputs.readings, inputs.locations)
    read, placed = inputs.version("readings"), inputs.version("locations")
    readings = _stage(spark, directory, f"timeseries_raw-{mark(read)}", lambda: raw["timeseries_raw"])
    places = _stage(spark, directory, f"locations_raw-{mark(placed)}", lambda: raw["locations_raw"])
    panel = _stage(spark, directory, f"timeseries-{mark(config.key('pad_days'), read)}", lambda: clean_panel(
        require_unique(readings), config.start, config.end, config.max_std, config.min_months,
        config.gap_days, config.pad_days), sort_by=["entity_id", "ts"])
    located = _stage(spark, directory, f"locations-{mark(config.key('pad_days'), read, placed)}", lambda: keep_located(places, panel))
    return {"timeseries_raw": readings, "locations_raw": places, "timeseries": panel, "locations": located}


def crop_stage(spark, inputs: Inputs, directory, name, table, spec, variables):
    """Cropped (grid, cells) of one covariate data set."""
    where = mark(inputs.version("edges"), spec)
    what = mark(where, inputs.version(name), variables)
    cells = _stage(spark, directory, f"{name}_wanted-{where}", lambda: grids.intercepting_cells(
        spark, spec, grids.bounding_box(inputs.edges)))
    series = _stage(spark, directory, f"{name}_grid-{what}", lambda: grids.query_cells(table, cells, variables)[0],
                    sort_by=["cell_id", "ts"])
    alive = _stage(spark, directory, f"{name}_cells-{what}", lambda: cells.join(
        series.select("cell_id").distinct(), "cell_id", "left_semi"))
    return series, alive, spec


def run(spark: SparkSession, inputs: Inputs, directory: str, config: RunConfig = RunConfig(),
        land_variables=None) -> dict[str, DataFrame]:
    """All stages in order. A rerun with the same directory continues after the last complete one.

    A stage's name carries a fingerprint of the parameters and of the content of the input tables it depends on, so a changed
    configuration, reading, position, polygon, grid or list of variables makes stages of its own.
    """
    from panelspark.config import FEATURE_VARIABLES
    land_variables = list(land_variables or FEATURE_VARIABLES)
    out = clean_stage(spark, inputs, config, directory)
    panel, points = out["timeseries"], out["locations"]
    drought = crop_stage(spark, inputs, directory, "drought", inputs.drought, inputs.drought_spec,
                         list(inputs.drought_spec.variables))
    land = crop_stage(spark, inputs, directory, "land", inputs.land, inputs.land_spec, land_variables)

    given = mark(*[inputs.version(n) for n in ("readings", "locations", "edges", "drought", "land")], inputs.drought_spec, inputs.land_spec, land_variables)
    done = mark(config.key("estimator"), given)
    if not stage_exists(spark, directory, f"imputed-{done}"):
        first = satellite_imputation(panel, points, drought, land, config,
                                     inputs.drought_spec.variables, land_variables)
        for name in ("metrics", "runs", "spread", "status", "history", "predictions"):
            write_stage(first[name], directory, f"imputed_{name}-{done}")
        write_stage(first["data"], directory, f"imputed-{done}")
    data = read_stage(spark, directory, f"imputed-{done}")

    # rounds don't depend on their number: a rerun goes on with the first one that is missing
    done = mark(replace(config, n_iterations=1).key("despike_window"), given)
    stage = lambda i, name="": f"refined_{i}{name}-{done}"
    have = 0
    while have < config.n_iterations and stage_exists(spark, directory, stage(have + 1)):
        have += 1
    if have < config.n_iterations:
        def keep(i, result):
            for name in ("metrics", "correlations", "status", "predictions", "locations"):
                write_stage(result[name], directory, stage(i, f"_{name}"))
            write_stage(result["data"], directory, stage(i))
        earlier = [read_stage(spark, directory, stage(i)) for i in range(1, have + 1)]
        iterative_refinement(panel, data, points, config, on_iteration=keep, done=earlier)
    refined = read_stage(spark, directory, stage(config.n_iterations))

    cells, spec = surface_grid(spark, inputs.edges, config.n_x_cells)
    raster = f"raster-{mark(config.key('monthly_step'), given)}"
    if not stage_exists(spark, directory, raster):
        write_raster(krige_panel(refined.select("entity_id", "ts", "value"), points, cells, config.influence,
                                 config.stable_alpha, config.monthly_step), directory, raster)
    raster = read_raster(spark, directory, raster)
    curve = _stage(spark, directory, f"storage-{mark(config.key(), given)}", lambda: storage_curve(
        raster, config.storage_coefficient, config.date_filter, spec.res_x, spec.res_y))
    write_curve(curve, f"{directory}/storage_csv")
    out.update(imputed=data, refined=refined, raster=raster, storage=curve)
    return out
