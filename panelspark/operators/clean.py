"""From irregular readings to a clean regular panel.

Readings of one entity are unbounded, so nothing here sorts or collects an entity's raw
readings in one task: statistics are partial aggregates, the join back spreads hot entities,
and `slot_edges` keeps at most four readings per entity and calendar slot before any
per-entity window runs.
"""

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.dates import LONGEST_SLOT, julian_day, slot_ceil, slot_start, slots_between
from panelspark.functions.hermite import add_segment_slopes, segment_value
from panelspark.operators.skew import attach, spread
from panelspark.operators.timeline import densify, _date


def outlier_bounds(panel: DataFrame, k: float = 3.0, entity="entity_id", value="value") -> DataFrame:
    """Per entity: mean -/+ k sample standard deviations, and the number of rows."""
    if k <= 0:
        raise ValueError("k must be greater than 0")
    mean, std = F.avg(value), F.stddev_samp(value)
    return panel.groupBy(entity).agg(
        (mean - k * std).alias("lower"), (mean + k * std).alias("upper"),
        F.count(F.lit(1)).alias("n"))


def remove_outliers(panel: DataFrame, k: float = 3.0, entity="entity_id", ts="ts",
                    value="value") -> DataFrame:
    """Values strictly outside the bounds become NULL; a single reading is kept."""
    rows = attach(panel, outlier_bounds(panel, k, entity, value), entity, spread=ts)
    v = F.col(value)
    outside = (v < F.col("lower")) | (v > F.col("upper"))
    return rows.withColumn(value, F.when(outside, F.lit(None)).otherwise(v)).drop("lower", "upper")


def _in_slot_range(ts, start, end, step):
    """`ts` between the first and the last slot start of [start, end]."""
    return F.col(ts).between(slot_ceil(_date(start), step), slot_start(_date(end), step))


def month_counts(panel: DataFrame, start, end, step="month", entity="entity_id", ts="ts",
                 value="value") -> DataFrame:
    """Number of distinct slots with a value between `start` and `end`, per entity."""
    observed = panel.filter(F.col(value).isNotNull() & _in_slot_range(ts, start, end, step))
    return (observed.select(entity, slot_start(F.col(ts), step).alias("_slot"))
            .distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("n_months")))


def qualifying(panel: DataFrame, start, end, min_months: int = 50, step="month",
               entity="entity_id", ts="ts", value="value") -> DataFrame:
    """All rows of the entities with at least `min_months` observed slots in the range.

    The range only decides who qualifies; rows outside of it are returned too.
    """
    rows_per_entity = panel.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    keep = (month_counts(panel, start, end, step, entity, ts, value)
            .filter(F.col("n_months") >= min_months)
            .join(rows_per_entity, entity).select(entity, "n"))
    return attach(panel, keep, entity, spread=ts)


def gaps(panel: DataFrame, gap_days: int = 365, step="month", entity="entity_id", ts="ts",
         value="value") -> DataFrame:
    """Pairs of consecutive readings more than `gap_days` days apart.

    A gap of at least one slot length has its two ends in different slots, so the slot
    edges hold every such pair; gaps that fit into a slot are looked for on the days.
    """
    step = step if gap_days >= LONGEST_SLOT[step] else "day"
    w = Window.partitionBy(entity).orderBy("x")
    pairs = (slot_edges(panel, step, entity, ts, value)
             .select(entity, F.col(ts).alias("gap_start"), F.lead(ts).over(w).alias("gap_end"),
                     _whole_days(F.lead("x").over(w) - F.col("x")).alias("gap_days")))
    return pairs.filter(F.col("gap_days") > gap_days)


def _whole_days(x):
    # Julian days carry about 1e-9 days of rounding
    return F.floor(F.round(x, 8))


def slot_edges(panel: DataFrame, step="month", entity="entity_id", ts="ts",
               value="value") -> DataFrame:
    """First two and last two readings of every (entity, slot), with their Julian day `x`.

    They are all that interpolation at slot starts can depend on: a slot start lies
    between the last reading of one slot and the first of a later one, and the cubic
    needs one more knot on either side. Spark limits each group before the shuffle, so
    a hot entity sends at most two rows per slot and input partition.
    """
    knots = panel.filter(F.col(value).isNotNull()).select(
        entity, ts, value, slot_start(F.col(ts), step).alias("_slot"))

    def end(order):
        w = Window.partitionBy(entity, "_slot").orderBy(order)
        return (knots.withColumn("_rn", F.row_number().over(w))
                .filter(F.col("_rn") <= 2).drop("_rn"))

    # the exchange by entity also serves the deduplication and every window that follows
    edges = spread(end(F.col(ts).asc()).unionByName(end(F.col(ts).desc())), entity)
    edges = edges.dropDuplicates([entity, "_slot", ts])
    is_date = dict(panel.dtypes)[ts] == "date"
    return edges.withColumn("x", julian_day(F.col(ts), is_date))


def _segments(edges: DataFrame, entity, ts, value) -> DataFrame:
    w = Window.partitionBy(entity).orderBy("x")
    knot = {"x0": F.lag("x").over(w), "y0": F.lag(value).over(w),
            "x2": F.lead("x").over(w), "y2": F.lead(value).over(w),
            "x3": F.lead("x", 2).over(w), "y3": F.lead(value, 2).over(w),
            "next_ts": F.lead(ts).over(w)}
    return (edges.select("*", *[c.alias(k) for k, c in knot.items()])
            .filter(F.col("x2").isNotNull())
            .withColumnsRenamed({"x": "x1", value: "y1"}))


def interpolate(panel: DataFrame, step="month", gap_days: int | None = None,
                pad_days: int = 90, entity="entity_id", ts="ts", value="value",
                edges: DataFrame | None = None) -> DataFrame:
    """Monotone cubic (PCHIP) values at the slot starts between first and last reading.

    With `gap_days`, slots inside a longer gap that are at least `pad_days` away from both
    of its readings get NULL. Entities with fewer than two readings yield no rows.
    """
    if edges is None:
        edges = slot_edges(panel, step, entity, ts, value)
    seg = _segments(edges, entity, ts, value)
    # a slot start that is a knot belongs to the segment it opens; the last knot to its own
    slots = slots_between(F.col(ts), F.col("next_ts"), step)
    seg = (add_segment_slopes(seg)
           .withColumn("_slots", slots).filter(F.col("_slots").isNotNull())
           .select("*", F.explode("_slots").alias("_q")))
    xq = julian_day(F.col("_q"), is_date=True)
    seg = seg.withColumn("_xq", xq).filter((F.col("_xq") < F.col("x2")) | F.col("x3").isNull())
    v = segment_value(F.col("_xq"))
    if gap_days is not None:
        q, a, b, prev = (F.col(c) for c in ("_xq", "x1", "x2", "x0"))
        in_gap = (_whole_days(b - a) > gap_days) & (q >= a + pad_days) & (q <= b - pad_days)
        # with no padding the reading that ends the previous gap is masked as well
        if pad_days == 0:
            in_gap = in_gap | F.coalesce((_whole_days(a - prev) > gap_days) & (q == a), F.lit(False))
        v = F.when(~in_gap, v)
    return seg.select(entity, F.col("_q").alias(ts), v.alias(value))


def interpolate_regular(dense: DataFrame, out: str, entity="entity_id", ts="ts",
                        value="value") -> DataFrame:
    """Adds `out`: the value itself, or PCHIP between the surrounding values of a regular panel.

    Every row looks up its two knots on either side with windows over one partitioning, so
    nothing is exploded or joined. Rows outside the observed range stay NULL.
    """
    is_knot = F.col(value).isNotNull()
    x = julian_day(F.col(ts), dict(dense.dtypes)[ts] == "date")
    forward = Window.partitionBy(entity).orderBy(F.col(ts).asc())
    backward = Window.partitionBy(entity).orderBy(F.col(ts).desc())

    def latest(c, w, to):
        return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, to))

    def neighbours(rows, w, near, far):
        """Columns x/y of the nearest and second nearest knot before each row of `w`."""
        rows = rows.withColumns({f"x{near}": latest("_x", w, -1), f"y{near}": latest(F.col(value), w, -1)})
        return rows.withColumns({f"{c}{far}": latest(F.when(is_knot, F.col(f"{c}{near}")), w, 0) for c in "xy"})

    rows = dense.withColumn("_x", F.when(is_knot, x))
    rows = neighbours(rows, forward, 1, 0)
    rows = neighbours(rows, backward, 2, 3)
    knots = [f"{c}{i}" for i in range(4) for c in "xy"]
    between = ~is_knot & F.col("x1").isNotNull() & F.col("x2").isNotNull()
    rows = add_segment_slopes(rows.withColumns({k: F.when(between, F.col(k)) for k in knots}))
    v = F.when(between, segment_value(x)).otherwise(F.col(value))
    return rows.withColumn(out, v).drop("_x", "d1", "d2", *knots)


def mask_outside_range(panel: DataFrame, ranges: DataFrame, entity="entity_id", ts="ts",
                       value="value") -> DataFrame:
    """NULL for slots outside [first_obs, last_obs] of the entity's raw readings."""
    inside = F.col(ts).between(F.col("first_obs"), F.col("last_obs"))
    return (panel.join(ranges, entity, "left")
            .withColumn(value, F.when(inside, F.col(value))).drop("first_obs", "last_obs"))


def mask_gaps(panel: DataFrame, gap_list: DataFrame, pad_days: int = 90, step="month",
              entity="entity_id", ts="ts", value="value") -> DataFrame:
    """NULL for slots in [gap_start + pad, gap_end - pad] of any listed gap."""
    pad = F.make_dt_interval(F.lit(pad_days))
    slots = slots_between(F.col("gap_start") + pad, F.col("gap_end") - pad, step)
    hidden = (gap_list.select(entity, F.explode(slots).alias(ts)).distinct()
              .withColumn("_hidden", F.lit(True)))
    return (panel.join(hidden, [entity, ts], "left")
            .withColumn(value, F.when(F.col("_hidden").isNull(), F.col(value))).drop("_hidden"))


def observed_range(panel: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """First and last time with a value, per entity."""
    seen = F.when(F.col(value).isNotNull(), F.col(ts))
    return panel.groupBy(entity).agg(F.min(seen).alias("first_obs"), F.max(seen).alias("last_obs"))


def regularize(panel: DataFrame, gap_days: int = 365, pad_days: int = 90, step="month",
               entity="entity_id", ts="ts", value="value") -> DataFrame:
    """Regular panel of every entity on the whole panel's calendar."""
    body = interpolate(panel, step, gap_days, pad_days, entity, ts, value)
    span = panel.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return densify(body, span.select("lo").scalar(), span.select("hi").scalar(), step,
                   entity, ts, value)


def clean_panel(panel: DataFrame, start, end, k: float = 3.0, min_months: int = 50,
                gap_days: int = 365, pad_days: int = 90, step="month",
                entity="entity_id", ts="ts", value="value") -> DataFrame:
    """Outliers -> qualification -> monthly interpolation with gap masking.

    The slot edges carry everything the later steps need: the first reading of each slot
    tells whether the slot counts for qualification, so the raw readings are touched once
    after the outlier bounds are known.
    """
    kept = remove_outliers(panel, k, entity, ts, value)
    edges = slot_edges(kept, step, entity, ts, value)
    by_time = Window.partitionBy(entity).orderBy("x")
    opens_slot = ~F.col("_slot").eqNullSafe(F.lag("_slot").over(by_time))
    counted = opens_slot & _in_slot_range(ts, start, end, step)
    edges = (edges.withColumn("_new", counted.cast("int"))
             .withColumn("_months", F.sum("_new").over(Window.partitionBy(entity)))
             .filter(F.col("_months") >= min_months).drop("_months", "_new"))
    return interpolate(panel, step, gap_days, pad_days, entity, ts, value, edges=edges)


def keep_located(points: DataFrame, panel: DataFrame, entity="entity_id") -> DataFrame:
    """Locations of the entities that are still in the panel."""
    return points.join(panel.select(entity).distinct(), entity, "left_semi")


def despike(panel: DataFrame, window: int = 7, n_sigma: float = 3.0, entity="entity_id",
            ts="ts", value="value") -> DataFrame:
    """Hampel filter on a regular panel: values further than `n_sigma` scaled MADs from the
    centred rolling median are replaced by that median. Opt-in."""
    half = (window - 1) // 2
    w = Window.partitionBy(entity).orderBy(ts).rowsBetween(-(window - 1 - half), half)
    near = (panel.withColumn("_med", F.percentile(value, F.lit(0.5)).over(w))
            .withColumn("_near", F.collect_list(value).over(w)))
    # the deviations of a frame refer to the median of that same frame
    mid = F.sort_array(F.transform("_near", lambda x: F.abs(x - F.col("_med"))))
    n = F.size("_near")
    mad = (F.get(F.col("_dev"), ((n - 1) / 2).cast("int")) + F.get(F.col("_dev"), (n / 2).cast("int"))) / 2
    limit = n_sigma * 1.4826 * mad
    v = F.col(value)
    return (near.withColumn("_dev", mid)
            .withColumn(value, F.when(F.abs(v - F.col("_med")) > limit, F.col("_med")).otherwise(v))
            .drop("_med", "_near", "_dev"))
