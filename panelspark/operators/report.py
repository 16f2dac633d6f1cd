"""Tables behind the diagnostic plots."""

from pyspark.sql import DataFrame, functions as F

from panelspark.operators.folds import confidence_band, ensemble_spread


def prediction_pairs(panel: DataFrame, predictions: DataFrame, entity="entity_id", ts="ts",
                     value="value", yhat="yhat") -> DataFrame:
    """Observation and prediction side by side, whichever exists."""
    return panel.select(entity, ts, value).join(
        predictions.select(entity, ts, yhat), [entity, ts], "full")


def residuals(panel: DataFrame, predictions: DataFrame, entity="entity_id", ts="ts",
              value="value", yhat="yhat") -> DataFrame:
    """Prediction - observation on complete rows, with the entity's observation mean."""
    pairs = (panel.filter(F.col(value).isNotNull()).select(entity, ts, value)
             .join(predictions.filter(F.col(yhat).isNotNull()).select(entity, ts, yhat), [entity, ts]))
    mean = pairs.groupBy(entity).agg(F.avg(value).alias("obs_mean"))
    return (pairs.withColumn("residual", F.col(yhat) - F.col(value)).join(mean, entity))


def filled_band(filled: DataFrame, runs: DataFrame, ci: float = 1.96, entity="entity_id",
                ts="ts") -> DataFrame:
    """Filled series with the ensemble's confidence band."""
    return filled.join(confidence_band(ensemble_spread(runs, entity, ts), ci), [entity, ts], "left")


def split_predictions(split: DataFrame, runs: DataFrame, entity="entity_id", ts="ts",
                      yhat="yhat") -> DataFrame:
    """Observations labelled train, validation or test, with the prediction of their fold."""
    return split.join(runs.select(entity, ts, "fold", yhat), [entity, ts, "fold"], "left")


def feature_importance(importances: DataFrame, top: int = 10) -> DataFrame:
    """Mean importance per feature, the `top` largest."""
    return (importances.groupBy("feature").agg(F.avg("importance").alias("importance"))
            .orderBy(F.col("importance").desc(), "feature").limit(top))
