"""Calendars and row selection in time."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelspark.functions.dates import slot_start, slots_between
from panelspark.operators.skew import spread


def _date(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("date")


def calendar(spark: SparkSession, start, end, step: str = "month") -> DataFrame:
    """Slot starts from `start` (rounded up) to `end`, both inclusive."""
    return spark.range(1).select(
        F.explode(slots_between(_date(start), _date(end), step)).alias("ts"))


def panel_calendar(panel: DataFrame, ts: str = "ts", step: str = "month") -> DataFrame:
    """Slot starts between the first and the last row of a panel."""
    span = panel.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return span.select(F.explode(slots_between(F.col("lo"), F.col("hi"), step)).alias("ts"))


def between(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Rows with start <= ts <= end."""
    return df.filter(F.col(ts).between(_date(start), _date(end)))


def every_kth_time(df: DataFrame, k: int, ts: str = "ts") -> DataFrame:
    """Keep times number 0, k, 2k ... of the distinct times of `df`.

    Numbering runs over the distinct times (calendar-sized), not over the rows.
    """
    if k <= 1:
        return df
    times = (df.select(ts).distinct()
             .withColumn("_i", F.row_number().over(Window.orderBy(ts)) - 1)
             .filter(F.col("_i") % k == 0).drop("_i"))
    return df.join(times, ts, "left_semi")


def densify(panel: DataFrame, start, end, step: str = "month", entity: str = "entity_id",
            ts: str = "ts", value: str = "value") -> DataFrame:
    """Every entity of a regular panel on every slot of [start, end]; missing slots get NULL.

    An entity's values travel as one map, at most a calendar's length, and are looked up while
    the calendar is exploded. So one exchange by entity does it, and per-entity windows that
    follow need no other.
    """
    day = F.col(ts).cast("date")
    on_slot = (F.col(ts) == slot_start(F.col(ts), step)) & day.between(_date(start), _date(end))
    known = F.collect_list(F.when(on_slot & F.col(value).isNotNull(), F.struct(day, F.col(value))))
    packed = (spread(panel.select(entity, ts, value), entity)
              .groupBy(entity).agg(F.map_from_entries(known).alias("_known")))
    slots = packed.select(entity, "_known", F.explode(slots_between(_date(start), _date(end), step)).alias(ts))
    return slots.select(entity, ts, F.col("_known")[F.col(ts)].alias(value))
