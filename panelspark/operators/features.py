"""Climate and calendar features on (entity, ts) rows of a regular panel."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.config import FEATURE_VARIABLES, MONTHS, SURFACE_WATER_VARIABLES
from panelspark.functions.stats import null_skipping_sum, safe_log


def month_dummies(ts: Column) -> list[Column]:
    """0/1 column per month name, in alphabetical order."""
    return [(F.month(ts) == i).cast("int").alias(name)
            for name, i in sorted((m, i + 1) for i, m in enumerate(MONTHS))]


def month_one_hot(df: DataFrame, ts="ts") -> DataFrame:
    return df.select("*", *month_dummies(F.col(ts)))


def trailing(window: int, key: str, ts: str = "ts"):
    return Window.partitionBy(key).orderBy(ts).rowsBetween(-(window - 1), 0)


def trailing_sum(df: DataFrame, window: int, value: str, out: str, key="entity_id", ts="ts") -> DataFrame:
    """Rolling sum of the current and the `window` - 1 rows before, NULLs skipped."""
    return df.withColumn(out, F.sum(value).over(trailing(window, key, ts)))


def surface_water(variables=SURFACE_WATER_VARIABLES) -> Column:
    return null_skipping_sum(*[F.col(v) for v in variables])


def groundwater_features(grid: DataFrame, key="cell_id", ts="ts") -> DataFrame:
    """Adds Surface Water, ln(QSB_acc), ln(RW 4 Rainf_tavg) and Sum Soil Moist per cell.

    Computed once per cell and month, before cells are attached to entities.
    """
    stored = F.col("Surface Water") - F.col("CanopInt_inst") - F.col("SWE_inst")
    return (grid.withColumn("Surface Water", surface_water())
            .withColumn("_moist", stored)
            .select("*",
                    safe_log(F.col("Qsb_acc")).alias("ln(QSB_acc)"),
                    safe_log(F.sum("Rainf_tavg").over(trailing(4, key, ts))).alias("ln(RW 4 Rainf_tavg)"),
                    F.sum("_moist").over(trailing(3, key, ts)).alias("Sum Soil Moist"))
            .drop("_moist"))


DERIVED = ("Surface Water", "ln(QSB_acc)", "ln(RW 4 Rainf_tavg)", "Sum Soil Moist")


def complete_rows(df: DataFrame, columns) -> DataFrame:
    """Rows without a missing feature."""
    return df.dropna(how="any", subset=[f"`{c}`" for c in columns])


def join_tables(first: DataFrame, *others: DataFrame, on=("entity_id", "ts")) -> DataFrame:
    """Left equi-join chain on entity and time."""
    for other in others:
        first = first.join(other, list(on), "left")
    return first


def label_rows(panel: DataFrame, features: DataFrame, value="value", on=("entity_id", "ts")) -> DataFrame:
    """Rows with a label and all features.

    The outer join followed by dropping incomplete rows is an inner join of observed labels.
    """
    return panel.filter(F.col(value).isNotNull()).join(features, list(on), "inner")


def climate_features(prior_rows: DataFrame, drought: DataFrame, land: DataFrame,
                     drought_variables, land_variables=FEATURE_VARIABLES, entity="entity_id",
                     ts="ts", windows=(18, 24, 36, 60)) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, scaled feature names, pass-through feature names) of the satellite model.

    `drought` and `land` are (entity, ts, variables) series of each entity's nearest cells;
    `land` already holds the derived columns. Rows with a missing feature are dropped.
    """
    rolling = [f"{n}m_rw" for n in windows]
    scaled = [*drought_variables, *land_variables, *rolling, *DERIVED]
    dummies = sorted(MONTHS)
    rows = (prior_rows
            .join(drought.select(entity, ts, *drought_variables), [entity, ts], "left")
            .join(land.select(entity, ts, *[f"`{c}`" for c in (*land_variables, *DERIVED)]),
                  [entity, ts], "left"))
    rows = month_one_hot(complete_rows(rows, scaled), ts)
    return rows, scaled, dummies


def split_label(df: DataFrame, label: str, keys=("entity_id", "ts")) -> tuple[DataFrame, DataFrame]:
    """(label, features), both with the key columns."""
    return df.select(*keys, label), df.drop(label)
