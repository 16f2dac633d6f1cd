from pyspark.sql import functions as F

from catalog.aggregates import cv_split, FRACTIONS, _CV
from catalog.common import (JD, R, calendar_sql, land_grid, pa_monthly, pb_monthly, pchip_ctes, pd_daily,
                            query, rounded, with_)
from panelspark.operators import clean, features as feat, folds, prior, timeline


@query("W1_rolling_means", with_("pam") + "SELECT entity_id, ts, " + ", ".join(
    f"""{R(f"avg(value) OVER (w ROWS BETWEEN {n - 1 - (n - 1) // 2} PRECEDING AND {(n - 1) // 2} FOLLOWING)", 5)} AS "{n}m_rw" """
    for n in (18, 24, 36, 60)) + "FROM pam WINDOW w AS (PARTITION BY entity_id ORDER BY ts)")
def w1(spark, sf):
    out = prior.rolling_means(pa_monthly(spark, sf), (18, 24, 36, 60), value="value")
    return rounded(out.drop("value"), 5)


def _trailing(name, n, var):
    sql = with_("land") + f"""SELECT cell_id, ts, sum("{var}") OVER (PARTITION BY cell_id ORDER BY ts
        ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS total FROM land"""

    @query(name, sql)
    def run(spark, sf):
        grid = land_grid(spark, sf).select("cell_id", "ts", var)
        return feat.trailing_sum(grid, n, var, "total", key="cell_id").select("cell_id", "ts", "total")


_trailing("W2_trailing_sum_4", 4, "Rainf_tavg")
_trailing("W3_trailing_sum_3", 3, "SWE_inst")

# a calendar wider than the data, so that all three segments exist
WIDE = ("1993-01-01", "2003-12-01")


def middle(spark, sf):
    return timeline.densify(pb_monthly(spark, sf), *WIDE)


SEGMENTS = {"mid": f"""SELECT e.entity_id, c.ts, p.value FROM (SELECT DISTINCT entity_id FROM pb) e CROSS JOIN
    ({calendar_sql(*WIDE)}) c LEFT JOIN pb p ON p.entity_id = e.entity_id AND p.ts = c.ts""",
            "seg": """SELECT *, min(CASE WHEN value IS NOT NULL THEN ts END) OVER (PARTITION BY entity_id) AS first_obs,
                max(CASE WHEN value IS NOT NULL THEN ts END) OVER (PARTITION BY entity_id) AS last_obs FROM mid"""}


@query("W4_segments", with_("pb", **SEGMENTS) + f"""SELECT entity_id, ts, {R('value', 5)} AS value, first_obs, last_obs,
    CASE WHEN ts < first_obs THEN 'left' WHEN ts > last_obs THEN 'right' WHEN first_obs IS NOT NULL THEN 'center' END AS segment FROM seg""")
def w4(spark, sf):
    return rounded(prior.segments(middle(spark, sf)), 5)


@query("W5_pchip_months", with_("pd", **pchip_ctes("pd")) + f"SELECT entity_id, ts, {R('value', 3)} AS value FROM interp")
def w5(spark, sf):
    return rounded(clean.interpolate(pd_daily(spark, sf)), 3)


_WHOLE = """SELECT e.entity_id, c.ts, i.value FROM (SELECT DISTINCT entity_id FROM interp) e CROSS JOIN
    (SELECT CAST(unnest(generate_series(CASE WHEN date_trunc('month', lo) = lo THEN date_trunc('month', lo) ELSE date_trunc('month', lo) + INTERVAL 1 MONTH END,
     date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE) AS ts FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM pd)) c
    LEFT JOIN interp i ON i.entity_id = e.entity_id AND i.ts = c.ts"""


@query("W6_regularize", with_("pd", **pchip_ctes("pd", 365, 90), whole=_WHOLE) + f"SELECT entity_id, ts, {R('value', 3)} AS value FROM whole")
def w6(spark, sf):
    return rounded(clean.regularize(pd_daily(spark, sf), 365, 90), 3)


@query("W7_folds", with_("pam") + "SELECT entity_id, ts, CAST(ntile(5) OVER (PARTITION BY entity_id ORDER BY ts) AS INTEGER) AS test_fold FROM pam")
def w7(spark, sf):
    return folds.assign_folds(pa_monthly(spark, sf).select("entity_id", "ts"), 5)


@query("W8_validation_split", _CV + f"SELECT entity_id, ts, {R('value')} AS value, {R('x', 4)} AS x, fold, split FROM split")
def w8(spark, sf):
    return rounded(cv_split(spark, sf), 6, x=4)


@query("W9_despike", with_("pam", med="""SELECT *, quantile_cont(value, 0.5) OVER w AS med, list(value) OVER w AS near FROM pam
    WINDOW w AS (PARTITION BY entity_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
                           mads="SELECT *, list_median(list_transform(near, lambda x: abs(x - med))) AS mad FROM med") +
       f"SELECT entity_id, ts, {R('CASE WHEN abs(value - med) > 3.0e0 * 1.4826e0 * mad THEN med ELSE value END', 7)} AS value FROM mads")
def w9(spark, sf):
    return rounded(clean.despike(pa_monthly(spark, sf), 7), 7)


@query("T2_nearest_by_distance", with_("spts", d="""SELECT a.entity_id AS target, b.entity_id AS candidate,
    sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS distance FROM spts a JOIN spts b ON a.entity_id <> b.entity_id""") +
       f"""SELECT target, candidate, {R('distance')} AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
       (PARTITION BY target ORDER BY distance, candidate) AS rank FROM d) WHERE rank <= 4""")
def t2(spark, sf):
    from catalog.common import supplier_points
    from panelspark.operators.relate import nearest_points
    return rounded(nearest_points(supplier_points(spark, sf), 4))


# --- priors -----------------------------------------------------------------------------

from catalog.aggregates import trend_ctes  # noqa: E402

PRIOR = {**SEGMENTS, **trend_ctes("mid"), **pchip_ctes("mid", prefix="c_"),
         "prior": f"""SELECT s.entity_id, s.ts, s.value, CASE WHEN s.ts < first_obs THEN 'left' WHEN s.ts > last_obs THEN 'right' ELSE 'center' END AS segment,
            CASE WHEN s.ts < first_obs THEN left_slope * ({JD.format('s.ts')} - min({JD.format('s.ts')}) OVER (PARTITION BY s.entity_id)) + left_intercept
                 WHEN s.ts > last_obs THEN right_slope * ({JD.format('s.ts')} - min(CASE WHEN s.ts > last_obs THEN {JD.format('s.ts')} END) OVER (PARTITION BY s.entity_id)) + right_intercept
                 ELSE coalesce(s.value, c.value) END AS prior
            FROM seg s LEFT JOIN fits USING (entity_id) LEFT JOIN c_interp c ON c.entity_id = s.entity_id AND c.ts = s.ts"""}
_PRIOR = with_("pb", **PRIOR)


@query("U1_prior_union", _PRIOR + f"SELECT entity_id, ts, segment, {R('prior', 4)} AS prior FROM prior")
def u1(spark, sf):
    return rounded(prior.prior(middle(spark, sf), FRACTIONS).select("entity_id", "ts", "segment", "prior"), 4)


@query("M1_left_extrapolation", _PRIOR + f"SELECT entity_id, ts, {R('prior', 4)} AS prior FROM prior WHERE segment = 'left'")
def m1(spark, sf):
    dense = middle(spark, sf)
    return rounded(prior.extrapolate(dense, prior.trend_slopes(dense, FRACTIONS, 0.10), "left"), 4)


@query("M1_left_extrapolation_boundary", _PRIOR + f"""SELECT entity_id, ts, {R(f"left_slope * ({JD.format('ts')} - max({JD.format('ts')}) OVER (PARTITION BY entity_id)) + left_intercept", 4)} AS prior
    FROM prior JOIN fits USING (entity_id) WHERE segment = 'left'""")
def m1b(spark, sf):
    dense = middle(spark, sf)
    return rounded(prior.extrapolate(dense, prior.trend_slopes(dense, FRACTIONS, 0.10), "left", "boundary"), 4)


@query("M2_right_extrapolation", _PRIOR + f"SELECT entity_id, ts, {R('prior', 4)} AS prior FROM prior WHERE segment = 'right'")
def m2(spark, sf):
    dense = middle(spark, sf)
    return rounded(prior.extrapolate(dense, prior.trend_slopes(dense, FRACTIONS, 0.10), "right"), 4)


@query("M3_prior_features", _PRIOR + f"SELECT entity_id, ts, segment, {R('prior', 4)} AS prior, " + ", ".join(
    f"""{R(f"avg(prior) OVER (w ROWS BETWEEN {n - 1 - (n - 1) // 2} PRECEDING AND {(n - 1) // 2} FOLLOWING)", 4)} AS "{n}m_rw" """
    for n in (18, 24, 36, 60)) + "FROM prior WINDOW w AS (PARTITION BY entity_id ORDER BY ts)")
def m3(spark, sf):
    out = prior.prior_features(middle(spark, sf), FRACTIONS, 0.10, (18, 24, 36, 60))
    return rounded(out.drop("value", "status"), 4)


@query("U3_imputation_range", with_("pam") + f"""SELECT entity_id, ts, {R('value')} AS value FROM pam JOIN
    ({calendar_sql('1996-01-01', '2000-06-15')}) USING (ts)""")
def u3(spark, sf):
    return rounded(timeline.between(pa_monthly(spark, sf), "1996-01-01", "2000-06-15"))


# --- the cleaning chain ---------------------------------------------------------------------

CLEAN = {"b": "SELECT entity_id, avg(value) AS m, stddev_samp(value) AS s FROM pd GROUP BY 1",
         "kept": """SELECT entity_id, ts, CASE WHEN value < m - 1.5e0 * s OR value > m + 1.5e0 * s THEN NULL ELSE value END AS value FROM pd JOIN b USING (entity_id)""",
         "good": """SELECT entity_id FROM kept WHERE value IS NOT NULL AND ts BETWEEN DATE '1995-02-01' AND DATE '2001-06-01'
            GROUP BY 1 HAVING count(DISTINCT date_trunc('month', ts)) >= 8""",
         "qual": "SELECT * FROM kept WHERE entity_id IN (SELECT entity_id FROM good)"}


@query("M15_clean_panel", with_("pd", **CLEAN, **pchip_ctes("qual", 365, 90)) + f"SELECT entity_id, ts, {R('value', 3)} AS value FROM interp")
def m15(spark, sf):
    return rounded(clean.clean_panel(pd_daily(spark, sf), "1995-01-20", "2001-06-30", k=1.5, min_months=8), 3)
