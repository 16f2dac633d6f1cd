"""Imputation of every series from covariates and its own long-term prior."""

from pyspark.sql import DataFrame, functions as F

from panelspark.config import RunConfig, FEATURE_VARIABLES, GridSpec
from panelspark.operators import features as feat, folds, least_squares, model
from panelspark.operators.clean import clean_panel
from panelspark.operators.grid import nearest_cell_series
from panelspark.operators.prior import prior_features
from panelspark.operators.timeline import between, densify
from panelspark.session import cut_lineage

FINAL_BATCH = 32  # fixed value: batch size of the final fit


def model_rows(rows: DataFrame, scaled, passed) -> DataFrame:
    """Pack named feature columns into the two arrays the estimators take."""
    pack = lambda cols: F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    return rows.select("entity_id", F.col("ts").cast("date").alias("ts"), "value",
                       pack(scaled).alias("scaled"), pack(passed).alias("passed"))


def fit_and_fill(panel: DataFrame, rows: DataFrame, config: RunConfig) -> dict[str, DataFrame]:
    """Cross-validate, fit the final model and fill the gaps of every entity.

    `panel` holds the observed regular series (also beyond the imputation range), `rows` the
    complete feature rows as of `model_rows`. Feature rows and fits are written once and
    re-read, since several results are taken from each of them.
    """
    rows = cut_lineage(rows, "model-rows")
    if config.estimator == "linear":
        found, status = least_squares.fit_and_predict(rows, config.folds, config.validation_split, config.seed)
        runs = cut_lineage(found, "least-squares")
        predicted = runs.filter(F.col("fold") == least_squares.FINAL)
        history = rows.sparkSession.createDataFrame([], "entity_id string, fold int, epoch int, loss double, val_loss double")
    else:
        runs, predicted, status, history = _network(rows, config)
    done = predicted.select("entity_id").distinct()
    observed = panel.join(done, "entity_id", "left_semi")
    data = between(folds.fill(observed, predicted), config.start, config.end)
    metrics = folds.fold_metrics(runs.filter(F.col("fold") > 0))
    comp = folds.complete_r2(predicted)
    return {
        "data": data,
        "predictions": between(predicted.select("entity_id", "ts", "yhat"), config.start, config.end),
        "runs": runs.select("entity_id", "ts", "fold", "yhat"),
        "splits": runs.filter("split IS NOT NULL AND fold > 0").select("entity_id", "ts", "fold", "split", "value"),
        "fold_metrics": metrics,
        "metrics": folds.wide_metrics(folds.mean_metrics(metrics, config.folds), comp),
        "spread": folds.ensemble_spread(runs),
        "history": history,
        "status": status,
    }


def _network(rows: DataFrame, config: RunConfig) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs, final predictions, status, history) of the small network, which trains in Python workers."""
    train = folds.training_rows(rows, config.folds, config.validation_split, config.seed)
    fitted = cut_lineage(model.fit_folds(train, config.epochs, config.batch_size, config.seed,
                                         config.estimator, config.folds), "fold-fits")
    warm = model.warm_starts(fitted, config.folds)
    final = cut_lineage(model.fit_final(rows, warm, FINAL_BATCH, config.seed, config.estimator), "final-fits")
    predicted = model.predictions(final)
    return (model.predictions(fitted).unionByName(predicted), predicted,
            model.status(fitted).unionByName(model.status(final)), model.history(fitted))


def satellite_rows(panel: DataFrame, points: DataFrame, drought: tuple[DataFrame, DataFrame, GridSpec],
                   land: tuple[DataFrame, DataFrame, GridSpec], config: RunConfig,
                   drought_variables, land_variables=FEATURE_VARIABLES) -> DataFrame:
    """Feature rows of the covariate model. `drought` and `land` are (grid, cells, spec)."""
    dense = densify(panel, config.start, config.end)
    priors = prior_features(dense, config.fractions, config.intercept_fraction, config.windows, config.anchor)
    d_grid, d_cells, d_spec = drought
    l_grid, l_cells, l_spec = land
    d_series = nearest_cell_series(points, d_cells, d_grid, d_spec, drought_variables)
    l_grid = feat.groundwater_features(l_grid.select("cell_id", "ts", *land_variables))
    l_series = nearest_cell_series(points, l_cells, l_grid, l_spec, [*land_variables, *feat.DERIVED])
    rows, scaled, passed = feat.climate_features(priors, d_series, l_series, drought_variables,
                                                 land_variables, windows=config.windows)
    return model_rows(rows, scaled, passed)


def satellite_imputation(panel, points, drought, land, config: RunConfig = RunConfig(),
                         drought_variables=("sc_PDSI_pm_filled",),
                         land_variables=FEATURE_VARIABLES) -> dict[str, DataFrame]:
    """Impute all entities at once; a failing series only yields a status row."""
    rows = satellite_rows(panel, points, drought, land, config, drought_variables, land_variables)
    out = fit_and_fill(panel, rows, config)
    done = out["predictions"].select("entity_id").distinct()
    out["locations"] = points.join(done, "entity_id", "left_semi")
    return out


def linear_imputation(readings: DataFrame, config: RunConfig, window: int = 24) -> DataFrame:
    """Readings -> filled monthly panel with a one-feature linear model per entity.

    Clean, extend by the long-term prior, regress the clean values on the prior's rolling mean
    and fill the gaps: (entity_id, ts, value, yhat, is_observed). The clean panel, a small
    fraction of the readings, is written once; what follows runs on one partitioning by entity.
    """
    panel = cut_lineage(clean_panel(readings, config.start, config.end, config.max_std, config.min_months,
                                    config.gap_days, config.pad_days), "clean")
    dense = densify(panel, config.start, config.end)
    rows = prior_features(dense, config.fractions, config.intercept_fraction, (window,), config.anchor)
    x = f"{window}m_rw"
    out = folds.linear_fill(rows, x)
    return out.select("entity_id", "ts", F.coalesce("value", "yhat").alias("value"), "yhat",
                      F.col("value").isNotNull().alias("is_observed"))
