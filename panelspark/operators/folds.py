"""Cross-validation folds, splits, scaling and fit metrics as DataFrame operations."""

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.stats import determination, error_metrics
from panelspark.operators.skew import spread


def assign_folds(rows: DataFrame, k: int = 5, entity="entity_id", ts="ts", label=None) -> DataFrame:
    """Contiguous folds 1..k in time order; the first n % k folds get one row more.

    With `label`, rows without it take no part and get no fold.
    """
    if label is None:
        return rows.withColumn("test_fold", F.ntile(k).over(Window.partitionBy(entity).orderBy(ts)))
    seen = F.col(label).isNotNull()
    fold = F.ntile(k).over(Window.partitionBy(entity, seen).orderBy(ts))
    return rows.withColumn("test_fold", F.when(seen, fold))


def expand_folds(rows: DataFrame, k: int = 5, entity="entity_id", ts="ts", label=None) -> DataFrame:
    """Every row once per fold, with is_test for the rows of that fold (NULL without label)."""
    return (assign_folds(rows, k, entity, ts, label)
            .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
            .withColumn("is_test", F.col("fold") == F.col("test_fold")).drop("test_fold"))


def split_rows(folded: DataFrame, validation_split: float = 0.3, seed: int = 42,
               entity="entity_id", ts="ts") -> DataFrame:
    """Adds split: 'test', or a seeded choice of ceil(n * validation_split) 'validation' rows
    of the others, the rest 'train'; NULL where is_test is."""
    w = Window.partitionBy(entity, "fold", "is_test")
    lot = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(entity).cast("string"),
                            F.col("fold").cast("string"), F.col(ts).cast("date").cast("string")))
    rn = F.row_number().over(w.orderBy(lot, ts))
    n = F.count(F.lit(1)).over(w)
    split = (F.when(F.col("is_test"), F.lit("test"))
             .when(~F.col("is_test"), F.when(
                 F.col("_rn") <= F.ceil(F.col("_n") * F.lit(float(validation_split))), F.lit("validation"))
                 .otherwise(F.lit("train"))))
    return (folded.withColumn("_rn", rn).withColumn("_n", n)
            .withColumn("split", split).drop("_rn", "_n"))


def training_rows(rows: DataFrame, k: int = 5, validation_split: float = 0.3, seed: int = 42,
                  entity="entity_id", ts="ts", label="value") -> DataFrame:
    """Every row once per fold with its split; rows without label have none.

    One exchange by entity serves the folds, the splits and the grouped fit that follows; rows
    are repeated per fold only after it.
    """
    folded = expand_folds(spread(rows, entity), k, entity, ts, label)
    return split_rows(folded, validation_split, seed, entity, ts).drop("is_test")


def fit_scaler(train: DataFrame, columns, by=("entity_id", "fold")) -> DataFrame:
    """Mean and population standard deviation of each column; a zero deviation becomes 1."""
    aggs = []
    for c in columns:
        aggs += [F.avg(F.col(f"`{c}`")).alias(f"{c}__mean"),
                 F.coalesce(F.nullif(F.stddev_pop(F.col(f"`{c}`")), F.lit(0.0)), F.lit(1.0)).alias(f"{c}__std")]
    return train.groupBy(*by).agg(*aggs)


def scale(rows: DataFrame, scaler: DataFrame, columns, by=("entity_id", "fold"),
          inverse: bool = False) -> DataFrame:
    """Standardise `columns` with a fitted scaler, or undo it; other columns pass through."""
    joined = rows.join(scaler, list(by))
    def mapped(c):
        m, s, v = F.col(f"`{c}__mean`"), F.col(f"`{c}__std`"), F.col(f"`{c}`")
        return (v * s + m) if inverse else (v - m) / s
    return joined.select(*[mapped(c).alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns])


def standardize(rows: DataFrame, columns, by=("entity_id", "fold"), split="split") -> DataFrame:
    """Standardise with the training rows of each group, in one window pass.

    Groups are (entity, fold) of a regular panel, so they are bounded by the calendar.
    """
    w = Window.partitionBy(*by)
    train = lambda c: F.when(F.col(split) == "train", F.col(f"`{c}`"))
    def mapped(c):
        mean = F.avg(train(c)).over(w)
        std = F.coalesce(F.nullif(F.stddev_pop(train(c)).over(w), F.lit(0.0)), F.lit(1.0))
        return ((F.col(f"`{c}`") - mean) / std).alias(c)
    return rows.select(*[mapped(c) if c in columns else F.col(f"`{c}`") for c in rows.columns])


def fold_metrics(pairs: DataFrame, entity="entity_id", y="value", yhat="yhat") -> DataFrame:
    """(entity, fold, split, me, rmse, mae, n, r) of the rows with label and prediction."""
    ok = pairs.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return ok.groupBy(entity, "fold", "split").agg(*error_metrics(F.col(y), F.col(yhat)))


def mean_metrics(metrics: DataFrame, k: int = 5, entity="entity_id") -> DataFrame:
    """Mean over the folds, one row per entity and split.

    A fold without any row of a split contributes 0 points and no errors.
    """
    return metrics.groupBy(entity, "split").agg(
        F.avg("me").alias("me"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"),
        (F.sum("n") / F.lit(k)).alias("n"), F.avg("r").alias("r"))


def wide_metrics(mean: DataFrame, comp: DataFrame, entity="entity_id") -> DataFrame:
    """The 16 named metrics of the compatible output; the columns called r2 hold Pearson's r."""
    names = {"train": "Train", "validation": "Validation", "test": "Test"}
    parts = {"me": "ME", "rmse": "RMSE", "mae": "MAE", "n": "Points", "r": "r2"}
    cols = [F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{label} {p}")
            for s, label in names.items() for c, p in parts.items()]
    return mean.groupBy(entity).agg(*cols).join(
        comp.select(entity, F.col("comp_r2").alias("Comp R2")), entity, "left")


def complete_r2(pairs: DataFrame, entity="entity_id", y="value", yhat="yhat") -> DataFrame:
    """(entity, comp_r2): coefficient of determination over all rows."""
    return pairs.groupBy(entity).agg(determination(F.col(y), F.col(yhat)).alias("comp_r2"))


def ensemble_spread(runs: DataFrame, entity="entity_id", ts="ts", yhat="yhat") -> DataFrame:
    """Mean and sample deviation of all runs (folds and final) per slot."""
    return runs.groupBy(entity, ts).agg(F.avg(yhat).alias("mean"), F.stddev_samp(yhat).alias("std"))


def confidence_band(spread: DataFrame, ci: float = 1.96) -> DataFrame:
    return spread.withColumns({"lower": F.col("mean") - ci * F.col("std"),
                               "upper": F.col("mean") + ci * F.col("std")})


def fill(panel: DataFrame, predictions: DataFrame, entity="entity_id", ts="ts", value="value",
         yhat="yhat") -> DataFrame:
    """Observed value, else prediction: (entity, ts, value, is_observed)."""
    both = panel.select(entity, ts, value).join(predictions.select(entity, ts, yhat), [entity, ts], "full")
    return both.select(entity, ts, F.coalesce(value, yhat).alias(value),
                       F.col(value).isNotNull().alias("is_observed"))


# --- one-feature linear estimator, as aggregates ---------------------------------------

def linear_fit(rows: DataFrame, x: str, y="value", by=("entity_id",), only=None) -> DataFrame:
    """Least-squares line per group; a constant feature gives slope 0."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    if only is not None:
        ok = ok & only
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    slope = F.coalesce(F.covar_pop(a, b) / F.nullif(F.var_pop(a), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy(*by).agg(slope.alias("slope"), F.avg(a).alias("_mx"), F.avg(b).alias("_my"),
                                 F.count(a).alias("n_points")).select(
        *by, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), "n_points")


def linear_predict(rows: DataFrame, fits: DataFrame, x: str, by=("entity_id",)) -> DataFrame:
    return (rows.join(fits.select(*by, "slope", "intercept"), list(by), "left")
            .withColumn("yhat", F.col("intercept") + F.col("slope") * F.col(x))
            .drop("slope", "intercept"))


def linear_fill(rows: DataFrame, x: str, y="value", by=("entity_id",), only=None) -> DataFrame:
    """Adds yhat of each group's own least-squares line, in one window pass.

    For groups bounded by the calendar; nothing is joined or computed twice. `only` restricts
    the rows that are fitted.
    """
    w = Window.partitionBy(*by)
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    if only is not None:
        ok = ok & only
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    slope = F.coalesce(F.covar_pop(a, b).over(w) / F.nullif(F.var_pop(a).over(w), F.lit(0.0)), F.lit(0.0))
    return (rows.withColumn("_s", slope)
            .withColumn("_i", F.avg(b).over(w) - F.col("_s") * F.avg(a).over(w))
            .withColumn("yhat", F.col("_i") + F.col("_s") * F.col(x)).drop("_s", "_i"))
