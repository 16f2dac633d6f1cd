"""Monotone cubic (PCHIP) segments over neighbouring knots.

Segment [x1, x2] with knots x0 < x1 < x2 < x3; x0 or x3 is NULL at an end of
the series. The four knots fix both slopes, so one window pass is enough.
"""

from pyspark.sql import Column, DataFrame, functions as F

KNOTS = ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3")
_HELPERS = ("h", "s", "hl", "sl", "hr", "sr", "e1", "e2")


def _inner_slope(h_left, h_right, s_left, s_right) -> Column:
    wl = 2 * h_right + h_left
    wr = h_right + 2 * h_left
    return F.when(s_left * s_right <= 0, F.lit(0.0)).otherwise(
        (wl + wr) / (wl / s_left + wr / s_right))


def _end_estimate(h, h_next, s, s_next) -> Column:
    return ((2 * h + h_next) * s - h * s_next) / (h + h_next)


def _end_slope(d, s, s_next) -> Column:
    return (F.when(F.signum(d) != F.signum(s), F.lit(0.0))
            .when((F.signum(s) != F.signum(s_next)) & (F.abs(d) > 3 * F.abs(s)), 3 * s)
            .otherwise(d))


def add_segment_slopes(df: DataFrame) -> DataFrame:
    """Adds d1 and d2, the slopes at x1 and x2, from the knot columns x0 ... y3.

    Widths and secant slopes become columns first, so each is computed once per row.
    """
    c = {n: F.col(n) for n in (*KNOTS, *_HELPERS)}
    df = df.withColumns({
        "h": c["x2"] - c["x1"], "s": (c["y2"] - c["y1"]) / (c["x2"] - c["x1"]),
        "hl": c["x1"] - c["x0"], "sl": (c["y1"] - c["y0"]) / (c["x1"] - c["x0"]),
        "hr": c["x3"] - c["x2"], "sr": (c["y3"] - c["y2"]) / (c["x3"] - c["x2"])})
    df = df.withColumns({"e1": _end_estimate(c["h"], c["hr"], c["s"], c["sr"]),
                         "e2": _end_estimate(c["h"], c["hl"], c["s"], c["sl"])})
    first, last = c["x0"].isNull(), c["x3"].isNull()
    left = (F.when(first & last, c["s"])
            .when(first, _end_slope(c["e1"], c["s"], c["sr"]))
            .otherwise(_inner_slope(c["hl"], c["h"], c["sl"], c["s"])))
    right = (F.when(first & last, c["s"])
             .when(last, _end_slope(c["e2"], c["s"], c["sl"]))
             .otherwise(_inner_slope(c["h"], c["hr"], c["s"], c["sr"])))
    return df.withColumns({"d1": left, "d2": right}).drop(*_HELPERS)


def segment_value(xq: Column) -> Column:
    """Value at xq from the columns x1, y1, d1, x2, y2, d2."""
    x1, y1, d1, x2, y2, d2 = (F.col(c) for c in ("x1", "y1", "d1", "x2", "y2", "d2"))
    h = x2 - x1
    t = (xq - x1) / h
    u = 1 - t
    return ((1 + 2 * t) * u * u * y1 + t * u * u * h * d1
            + t * t * (3 - 2 * t) * y2 + t * t * (t - 1) * h * d2)
