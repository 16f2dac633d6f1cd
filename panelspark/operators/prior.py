"""Long-term priors of a regular panel.

A regular panel has at most one value per entity and calendar slot, so everything per entity
is bounded by the calendar's length and ordinary per-entity windows are safe here.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.dates import julian_day
from panelspark.operators.clean import interpolate_regular
from panelspark.operators.skew import spread

DIRECT_PAIRS = 2_000_000


@lru_cache(maxsize=256)
def _pairs(n: int):
    return np.triu_indices(n, 1)


def median_slope(x: np.ndarray, y: np.ndarray) -> float | None:
    """Exact median of (y_j - y_i) / (x_j - x_i) over all i < j, for increasing x.

    Short series look at all slopes at once. Longer ones narrow an interval around the
    middle ranks with histograms, so memory stays linear in the length.
    """
    n = len(x)
    pairs = n * (n - 1) // 2
    if pairs == 0:
        return None
    def slopes(i):
        return (y[i + 1:] - y[i]) / (x[i + 1:] - x[i])
    if pairs <= DIRECT_PAIRS:
        i, j = _pairs(n) if n <= 256 else np.triu_indices(n, 1)
        return float(np.median((y[j] - y[i]) / (x[j] - x[i])))
    lo = min(slopes(i).min() for i in range(n - 1))
    hi = max(slopes(i).max() for i in range(n - 1))
    below, inside = 0, pairs
    ranks = ((pairs - 1) // 2, pairs // 2)
    while inside > DIRECT_PAIRS and lo < hi:
        cuts = np.linspace(lo, hi, 4097)
        counts = np.zeros(4096, np.int64)
        for i in range(n - 1):
            counts += np.histogram(slopes(i), cuts)[0]
        upto = below + np.cumsum(counts)
        a, b = (int(np.searchsorted(upto, r, side="right")) for r in ranks)
        if (cuts[a], cuts[b + 1]) == (lo, hi):
            break
        lo, hi = cuts[a], cuts[b + 1]
        below, inside = 0, 0
        for i in range(n - 1):
            s = slopes(i)
            below += int((s < lo).sum())
            inside += int(((s >= lo) & (s <= hi)).sum())
    middle = []
    for i in range(n - 1):
        s = slopes(i)
        middle.append(s[(s >= lo) & (s <= hi)])
    middle = np.sort(np.concatenate(middle))
    return float((middle[ranks[0] - below] + middle[ranks[1] - below]) / 2)


def entity_arrays(panel: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """(entity, xs, ys): the values of a regular panel in time order, as arrays."""
    is_date = dict(panel.dtypes)[ts] == "date"
    knots = panel.filter(F.col(value).isNotNull()).select(
        entity, F.struct(julian_day(F.col(ts), is_date).alias("x"), F.col(value).alias("y")).alias("_k"))
    return (spread(knots, entity).groupBy(entity).agg(F.sort_array(F.collect_list("_k")).alias("_k"))
            .select(entity, F.col("_k.x").alias("xs"), F.col("_k.y").alias("ys")))


def theil_slope(panel: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """(entity, slope): Theil-Sen slope per day."""
    @F.pandas_udf("double")
    def slope(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([median_slope(np.asarray(x), np.asarray(y)) for x, y in zip(xs, ys)],
                         dtype="float64")
    return entity_arrays(panel, entity, ts, value).select(entity, slope("xs", "ys").alias("slope"))


def first_fraction(panel: DataFrame, fraction: float, entity="entity_id", ts="ts",
                   value="value", from_end: bool = False) -> DataFrame:
    """The first (or last) floor(n * fraction) values of every entity."""
    order = F.col(ts).desc() if from_end else F.col(ts).asc()
    seen = panel.filter(F.col(value).isNotNull())
    return (seen.withColumn("_rn", F.row_number().over(Window.partitionBy(entity).orderBy(order)))
            .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(entity)))
            .filter(F.col("_rn") <= F.floor(F.col("_n") * F.lit(float(fraction))))
            .drop("_rn", "_n"))


def trend_candidates(panel: DataFrame, fractions, entity="entity_id", ts="ts", value="value",
                     at_least: int = 0) -> DataFrame:
    """(entity, side, fraction, n_points, slope) for each fraction and both ends of the series.

    With fewer than two points a slope is NULL; `at_least` widens short fractions instead.
    """
    fractions = [float(f) for f in fractions]

    @F.pandas_udf("array<struct<side:string,fraction:double,n_points:bigint,slope:double>>")
    def fit(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(x, y):
            out = []
            for f in fractions:
                m = min(max(int(len(x) * f), at_least), len(x))
                for side, cut in (("left", slice(0, m)), ("right", slice(len(x) - m, len(x)))):
                    out.append({"side": side, "fraction": f, "n_points": m,
                                "slope": median_slope(x[cut], y[cut])})
            return out
        return pd.Series([one(np.asarray(x), np.asarray(y)) for x, y in zip(xs, ys)])

    return entity_arrays(panel, entity, ts, value).select(entity, F.inline(fit("xs", "ys")))


def trend_slopes(panel: DataFrame, fractions, intercept_fraction: float, entity="entity_id",
                 ts="ts", value="value", at_least: int = 0) -> DataFrame:
    """(entity, left_slope, right_slope, left_intercept, right_intercept, status).

    A slope is the mean over all fractions, an intercept the mean of the first or last
    `intercept_fraction` values. A fraction with too few points makes both NULL
    (status 'insufficient').
    """
    fractions = [float(f) for f in fractions]

    @F.pandas_udf("left_slope double, right_slope double, left_intercept double, right_intercept double")
    def fit(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(xs, ys):
            x, y = np.asarray(x), np.asarray(y)
            size = [min(max(int(len(x) * f), at_least), len(x)) for f in fractions]
            k = min(max(int(len(x) * intercept_fraction), min(at_least, 1)), len(x))
            if min(size) < 2 or k < 1:
                rows.append((None,) * 4)
                continue
            left = [median_slope(x[:m], y[:m]) for m in size]
            # the whole series is the same from both ends
            right = [s if m == len(x) else median_slope(x[len(x) - m:], y[len(x) - m:])
                     for m, s in zip(size, left)]
            rows.append((np.mean(left), np.mean(right), y[:k].mean(), y[len(x) - k:].mean()))
        return pd.DataFrame(rows, columns=["left_slope", "right_slope", "left_intercept",
                                           "right_intercept"], dtype="float64")

    ok = F.col("_f.left_slope").isNotNull()
    return (entity_arrays(panel, entity, ts, value).withColumn("_f", fit("xs", "ys"))
            .select(entity, "_f.*", F.when(ok, F.lit("ok")).otherwise(F.lit("insufficient")).alias("status")))


def segments(panel: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """Dense panel plus first_obs, last_obs and segment in (left, center, right)."""
    w = Window.partitionBy(entity)
    seen = F.when(F.col(value).isNotNull(), F.col(ts))
    first, last = F.col("first_obs"), F.col("last_obs")
    return (panel.withColumn("first_obs", F.min(seen).over(w))
            .withColumn("last_obs", F.max(seen).over(w))
            .withColumn("segment", F.when(F.col(ts) < first, F.lit("left"))
                        .when(F.col(ts) > last, F.lit("right"))
                        .when(first.isNotNull(), F.lit("center"))))


def extrapolate(dense: DataFrame, fits: DataFrame, side: str, anchor: str = "range_start",
                entity="entity_id", ts="ts", value="value") -> DataFrame:
    """Linear continuation of each series on its left or right segment.

    The right side starts at its intercept in the first slot after the last reading. The left
    side starts at its intercept in the first slot of the range (`range_start`), or reaches it
    in the last slot before the first reading (`boundary`).
    """
    rows = segments(dense, entity, ts, value).filter(F.col("segment") == side)
    x = julian_day(F.col(ts), dict(dense.dtypes)[ts] == "date")
    w = Window.partitionBy(entity)
    at_start = not (side == "left" and anchor == "boundary")
    x0 = (F.min(x) if at_start else F.max(x)).over(w)
    line = F.col(f"{side}_slope") * F.col("_dx") + F.col(f"{side}_intercept")
    return (rows.withColumn("_dx", x - x0).join(fits, entity)
            .select(entity, ts, line.alias("prior")))


def prior(dense: DataFrame, fractions, intercept_fraction: float = 0.10,
          anchor: str = "range_start", entity="entity_id", ts="ts", value="value",
          at_least: int = 0) -> DataFrame:
    """(entity, ts, segment, prior): interpolated centre and extrapolated ends."""
    rows = interpolate_regular(segments(dense, entity, ts, value), "_centre", entity, ts, value)
    fits = trend_slopes(dense, fractions, intercept_fraction, entity, ts, value, at_least)
    x = julian_day(F.col(ts), dict(dense.dtypes)[ts] == "date")
    w = Window.partitionBy(entity, "segment")
    left0 = (F.min(x) if anchor == "range_start" else F.max(x)).over(w)
    dx = F.when(F.col("segment") == "left", x - left0).otherwise(x - F.min(x).over(w))
    joined = rows.withColumn("_dx", dx).join(fits, entity, "left")
    line = lambda side: F.col(f"{side}_slope") * F.col("_dx") + F.col(f"{side}_intercept")
    value_at = (F.when(F.col("segment") == "left", line("left"))
                .when(F.col("segment") == "right", line("right"))
                .otherwise(F.col("_centre")))
    return joined.select(entity, ts, value, "segment", value_at.alias("prior"), "status")


def rolling_frame(window: int) -> tuple[int, int]:
    """Row offsets of a centred frame; even windows reach one row further back."""
    after = (window - 1) // 2
    return -(window - 1 - after), after


def rolling_means(panel: DataFrame, windows, entity="entity_id", ts="ts",
                  value="prior") -> DataFrame:
    """Centred rolling means, one column `<w>m_rw` per window, over the rows that exist."""
    w = Window.partitionBy(entity).orderBy(ts)
    return panel.select("*", *[F.avg(value).over(w.rowsBetween(*rolling_frame(n))).alias(f"{n}m_rw")
                               for n in windows])


def prior_features(dense: DataFrame, fractions, intercept_fraction: float, windows,
                   anchor="range_start", entity="entity_id", ts="ts", value="value",
                   at_least: int = 0) -> DataFrame:
    """Prior and its rolling means."""
    p = prior(dense, fractions, intercept_fraction, anchor, entity, ts, value, at_least)
    return rolling_means(p, windows, entity, ts, "prior")
