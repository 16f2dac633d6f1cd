from pyspark.sql import functions as F

from catalog.common import (END, JD, R, START, dense_sql, nation_points, pa_daily, pa_monthly,
                            pb_monthly, pd_daily, query, raster, rounded, supplier_points, table, with_)
from catalog.joins import _SPARSE_GRID, _sparse_grid, pb_candidates
from catalog.projections import _AREA, _CURVE
from panelspark.operators import clean, folds, grid as grids, prior, relate, report, storage, surface, timeline
from panelspark.session import cut_lineage


@query("A1_qualifying", with_("pd") + f"""SELECT entity_id, ts, {R('value', 4)} AS value FROM pd WHERE entity_id IN (SELECT entity_id FROM pd
    WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-06-01' GROUP BY 1 HAVING count(DISTINCT date_trunc('month', ts)) >= 8)""")
def a1(spark, sf):
    return rounded(clean.qualifying(pd_daily(spark, sf), "1995-12-15", "2000-06-20", 8), 4)


@query("A2_outliers", with_("pa", b="SELECT entity_id, avg(value) AS m, stddev_samp(value) AS s FROM pa GROUP BY 1") +
       f"""SELECT entity_id, ts, {R('CASE WHEN value < m - 2 * s OR value > m + 2 * s THEN NULL ELSE value END')} AS value
       FROM pa JOIN b USING (entity_id)""")
def a2(spark, sf):
    return rounded(clean.remove_outliers(pa_daily(spark, sf), 2.0))


@query("A3_gaps", with_("pd", n="SELECT entity_id, ts AS gap_start, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts) AS gap_end FROM pd") +
       "SELECT *, gap_end - gap_start AS gap_days FROM n WHERE gap_end - gap_start > 365")
def a3(spark, sf):
    return clean.gaps(pd_daily(spark, sf), 365)


@query("A3_short_gaps", with_("pd", n="SELECT entity_id, ts AS gap_start, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts) AS gap_end FROM pd") +
       "SELECT *, gap_end - gap_start AS gap_days FROM n WHERE gap_end - gap_start > 14")
def a3_short(spark, sf):
    return clean.gaps(pd_daily(spark, sf), 14)


@query("A4_cells_with_data", f"""WITH sg AS ({_SPARSE_GRID}) SELECT DISTINCT cell_id FROM sg WHERE a IS NOT NULL""")
def a4(spark, sf):
    return grids.cells_with_data(_sparse_grid(spark, sf), ["a", "b"])


@query("A4_valid_columns", f"""WITH sg AS ({_SPARSE_GRID}) SELECT cell_id, count(a) AS a, count(b) AS b FROM sg GROUP BY 1
    HAVING count(a) > 0 OR count(b) > 0""")
def a4b(spark, sf):
    return grids.valid_columns(_sparse_grid(spark, sf), ["a", "b"])


def _knots(src):
    return f"""SELECT entity_id, {JD.format('ts')} AS x, value AS y, row_number() OVER w AS rn,
        row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC) AS rd, count(*) OVER (PARTITION BY entity_id) AS n
        FROM {src} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY ts)"""


@query("A5_theil_slope", with_("pam", k=_knots("pam")) + f"""SELECT e.entity_id, {R('slope', 8)} AS slope FROM (SELECT DISTINCT entity_id FROM k) e
    LEFT JOIN (SELECT a.entity_id, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM k a JOIN k b
    ON a.entity_id = b.entity_id AND a.x < b.x GROUP BY 1) s USING (entity_id)""")
def a5(spark, sf):
    return rounded(prior.theil_slope(pa_monthly(spark, sf)), 8)


@query("A6_first_fraction", with_("pam", k="""SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts) AS rn,
    count(*) OVER (PARTITION BY entity_id) AS n FROM pam""") +
       f"SELECT entity_id, ts, {R('value')} AS value FROM k WHERE rn <= floor(n * 0.15e0)")
def a6(spark, sf):
    return rounded(prior.first_fraction(pa_monthly(spark, sf), 0.15))


FRACTIONS = (0.10, 0.15, 0.25, 0.5, 1.0)


def trend_ctes(src, fractions=FRACTIONS, intercept=0.10):
    """CTEs that end in `fits` (entity_id, left_slope, right_slope, left_intercept, right_intercept)."""
    values = ", ".join(f"({f}e0)" for f in fractions)
    return {
        "k": _knots(src),
        "fr": f"SELECT f FROM (VALUES {values}) v(f)",
        "cand": """SELECT a.entity_id, f, side, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM k a
            JOIN k b ON a.entity_id = b.entity_id AND a.x < b.x CROSS JOIN fr CROSS JOIN (VALUES ('left'), ('right')) s(side)
            WHERE CASE WHEN side = 'left' THEN greatest(a.rn, b.rn) ELSE greatest(a.rd, b.rd) END <= floor(a.n * f)
            GROUP BY 1, 2, 3""",
        "fits": f"""SELECT entity_id, CASE WHEN l = {len(fractions)} THEN left_slope END AS left_slope,
            CASE WHEN l = {len(fractions)} THEN right_slope END AS right_slope,
            CASE WHEN l = {len(fractions)} THEN left_intercept END AS left_intercept,
            CASE WHEN l = {len(fractions)} THEN right_intercept END AS right_intercept
            FROM (SELECT entity_id, avg(CASE WHEN rn <= floor(n * {intercept}e0) THEN y END) AS left_intercept,
                avg(CASE WHEN rd <= floor(n * {intercept}e0) THEN y END) AS right_intercept FROM k GROUP BY 1)
            LEFT JOIN (SELECT entity_id, avg(CASE WHEN side = 'left' THEN slope END) AS left_slope,
                avg(CASE WHEN side = 'right' THEN slope END) AS right_slope,
                count(CASE WHEN side = 'left' THEN slope END) AS l FROM cand GROUP BY 1) USING (entity_id)""",
    }


@query("A7_trend_slopes", with_("pam", **trend_ctes("pam")) + f"""SELECT entity_id, {R('left_slope', 8)} AS left_slope, {R('right_slope', 8)} AS right_slope,
    {R('left_intercept', 8)} AS left_intercept, {R('right_intercept', 8)} AS right_intercept,
    CASE WHEN left_slope IS NULL THEN 'insufficient' ELSE 'ok' END AS status FROM fits""")
def a7(spark, sf):
    return rounded(prior.trend_slopes(pa_monthly(spark, sf), FRACTIONS, 0.10), 8)


# target and candidate series side by side, on the slots where all other candidates have values
RELATION = {
    "whole": "SELECT entity_id, ts, value FROM pbc WHERE value IS NOT NULL",
    "slots": "SELECT ts, count(*) AS n FROM whole GROUP BY 1",
    "rows": """SELECT pb.entity_id, pb.ts, pb.value FROM pb JOIN slots USING (ts) LEFT JOIN whole o ON o.entity_id = pb.entity_id AND o.ts = pb.ts
        WHERE n - CASE WHEN o.value IS NULL THEN 0 ELSE 1 END = (SELECT count(DISTINCT entity_id) FROM whole) - 1""",
    "corr": """SELECT t.entity_id AS target, c.entity_id AS candidate, covar_pop(t.value, c.value)
        / nullif(stddev_pop(t.value) * stddev_pop(c.value), 0) AS r FROM rows t JOIN whole c ON c.ts = t.ts AND c.entity_id <> t.entity_id GROUP BY 1, 2""",
    "dist": """SELECT a.entity_id AS target, b.entity_id AS candidate,
        sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS d FROM npts a JOIN npts b ON a.entity_id <> b.entity_id""",
    "rel": """SELECT target, candidate, r, 1 - d / max(d) OVER (PARTITION BY target) AS dist_score FROM dist JOIN corr USING (target, candidate)""",
    "scored": "SELECT *, r * 0.7e0 + dist_score * 0.3e0 AS score FROM rel",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST, candidate) AS rank FROM scored",
    "means": "SELECT target, avg(score) AS mean_score FROM ranked WHERE rank <= 5 GROUP BY 1",
    "chosen": """SELECT ranked.*, mean_score, 5 + CASE WHEN 0.6e0 > mean_score THEN CAST(trunc(6e0 - floor(mean_score * 10)) AS INTEGER) ELSE 0 END AS k
        FROM ranked JOIN means USING (target)
        WHERE rank <= 5 + CASE WHEN 0.6e0 > mean_score THEN CAST(trunc(6e0 - floor(mean_score * 10)) AS INTEGER) ELSE 0 END""",
}
_REL = with_("pb", "pbc", "npts", **RELATION)


def _relations(spark, sf):
    return relate.relations(pb_monthly(spark, sf), pb_candidates(spark, sf), nation_points(spark, sf))


def chosen_relations(spark, sf):
    return relate.top_relations(pb_monthly(spark, sf), pb_candidates(spark, sf), nation_points(spark, sf))


@query("A8_feature_correlations", _REL + f"SELECT target, candidate, {R('r')} AS r FROM corr")
def a8(spark, sf):
    return rounded(_relations(spark, sf).select("target", "candidate", "r"))


@query("A9_distance_scores", _REL + f"SELECT target, candidate, {R('dist_score')} AS dist_score FROM rel")
def a9(spark, sf):
    return rounded(_relations(spark, sf).select("target", "candidate", "dist_score"))


@query("A10_weighted_scores", _REL + f"SELECT target, candidate, {R('score')} AS score FROM scored")
def a10(spark, sf):
    return rounded(_relations(spark, sf).select("target", "candidate", "score"))


@query("A11_adaptive_selection", _REL + f"""SELECT target, candidate, {R('score')} AS score, {R('mean_score')} AS mean_score,
    CAST(rank AS INTEGER) AS rank, CAST(k AS INTEGER) AS k FROM chosen""")
def a11(spark, sf):
    return rounded(chosen_relations(spark, sf).select("target", "candidate", "score", "mean_score", "rank", "k"))


@query("T1_top_candidates", with_("pam", "spts", c=f"""SELECT entity_id, ts, coalesce(value, round(avg(value) OVER (PARTITION BY entity_id), 6)) AS value
    FROM ({dense_sql('pam')})""", **{k: v.replace("pbc", "c").replace("pb.", "pam.").replace("FROM pb ", "FROM pam ").replace("npts", "spts")
                                 for k, v in RELATION.items()}) +
       f"SELECT target, candidate, {R('score')} AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def t1(spark, sf):
    panel = cut_lineage(pa_monthly(spark, sf), "monthly")  # both panels are read several times
    mean = panel.groupBy("entity_id").agg(F.round(F.avg("value"), 6).alias("_m"))
    full = cut_lineage(timeline.densify(panel, START, END).join(mean, "entity_id").select(
        "entity_id", "ts", F.coalesce("value", "_m").alias("value")), "monthly-full")
    rel = relate.relations(panel, full, supplier_points(spark, sf), top=5)
    return rounded(relate.rank_candidates(rel).filter("rank <= 5").select("target", "candidate", "score", "rank"))


@query("A11_relation_summary", _REL + f"""SELECT target, {R('avg(r)')} AS r, {R('avg(dist_score)')} AS dist_score, {R('avg(score)')} AS score
    FROM ranked WHERE rank <= 5 GROUP BY 1""")
def a11b(spark, sf):
    return rounded(relate.relation_summary(chosen_relations(spark, sf)))


# --- cross-validated one-feature model: quantity against the supplier's rolling mean -----------

# the feature: mean of the 24 surrounding months, rounded so that both engines fit the same numbers
CV = {
    "feat": """SELECT entity_id, ts, value, round(avg(value) OVER (PARTITION BY entity_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), 4) AS x FROM pam""",
    "folded": """SELECT f.*, fold, test_fold = fold AS is_test FROM (SELECT *, ntile(5) OVER (PARTITION BY entity_id ORDER BY ts) AS test_fold FROM feat) f
        CROSS JOIN (SELECT unnest(range(1, 6)) AS fold)""",
    "lots": """SELECT *, row_number() OVER (PARTITION BY entity_id, fold, is_test ORDER BY md5(concat_ws('|', '42', entity_id, CAST(fold AS VARCHAR), CAST(ts AS VARCHAR))), ts) AS rn,
        count(*) OVER (PARTITION BY entity_id, fold, is_test) AS n FROM folded""",
    "split": """SELECT entity_id, ts, value, x, CAST(fold AS INTEGER) AS fold, CASE WHEN is_test THEN 'test' WHEN rn <= ceil(n * 0.3e0) THEN 'validation' ELSE 'train' END AS split FROM lots""",
    "lines": """SELECT entity_id, fold, slope, my - slope * mx AS intercept FROM (SELECT entity_id, fold, coalesce(covar_pop(x, value) / nullif(var_pop(x), 0), 0) AS slope,
        avg(x) AS mx, avg(value) AS my FROM split WHERE split = 'train' GROUP BY 1, 2)""",
    "pairs": "SELECT s.*, intercept + slope * x AS yhat FROM split s LEFT JOIN lines USING (entity_id, fold)",
    "metrics": """SELECT entity_id, fold, split, avg(yhat - value) AS me, sqrt(avg((yhat - value) * (yhat - value))) AS rmse, avg(abs(yhat - value)) AS mae, count(*) AS n,
        covar_pop(value, yhat) / nullif(stddev_pop(value) * stddev_pop(yhat), 0) AS r FROM pairs WHERE yhat IS NOT NULL GROUP BY 1, 2, 3""",
}
_CV = with_("pam", **CV)


def cv_split(spark, sf):
    rows = prior.rolling_means(pa_monthly(spark, sf), [24], value="value")
    rows = rows.select("entity_id", "ts", "value", F.round("24m_rw", 4).alias("x"))
    return folds.split_rows(folds.expand_folds(rows, 5), 0.3, 42).drop("is_test")


def cv_pairs(spark, sf):
    return folds.linear_fill(cv_split(spark, sf), "x", by=("entity_id", "fold"), only=F.col("split") == "train")


@query("A12_fold_metrics", _CV + f"""SELECT entity_id, fold, split, {R('me', 5)} AS me, {R('rmse', 5)} AS rmse, {R('mae', 5)} AS mae, n,
    CASE WHEN abs(r) <= 1.0001e0 THEN {R('r', 4)} END AS r FROM metrics""")
def a12(spark, sf):
    m = folds.fold_metrics(cv_pairs(spark, sf))
    return rounded(m, 5, r=4)


@query("A13_mean_metrics", _CV + f"""SELECT entity_id, split, {R('avg(me)', 5)} AS me, {R('avg(rmse)', 5)} AS rmse, {R('avg(mae)', 5)} AS mae,
    sum(n) / 5 AS n, {R('avg(r)', 4)} AS r FROM metrics GROUP BY 1, 2""")
def a13(spark, sf):
    return rounded(folds.mean_metrics(folds.fold_metrics(cv_pairs(spark, sf))), 5, r=4)


@query("A13_wide_metrics", _CV + "SELECT entity_id, " + ", ".join(
    f"""{R(f"sum(CASE WHEN split = '{s}' THEN {c} END)" + (" / 5" if c == 'n' else f" / count(CASE WHEN split = '{s}' THEN {c} END)"), 4)} AS "{label} {p}" """
    for s, label in (("train", "Train"), ("validation", "Validation"), ("test", "Test"))
    for c, p in (("me", "ME"), ("rmse", "RMSE"), ("mae", "MAE"), ("n", "Points"), ("r", "r2"))) +
       f""", any_value(comp) AS "Comp R2" FROM metrics JOIN (SELECT entity_id, {R('1 - sum((value - yhat) * (value - yhat)) / nullif(var_pop(value) * count(*), 0)', 4)} AS comp
       FROM pairs GROUP BY 1) USING (entity_id) GROUP BY 1""")
def a13b(spark, sf):
    pairs = cv_pairs(spark, sf)
    return rounded(folds.wide_metrics(folds.mean_metrics(folds.fold_metrics(pairs)), folds.complete_r2(pairs)), 4)


@query("A14_complete_r2", _CV + f"""SELECT entity_id, {R('1 - sum((value - yhat) * (value - yhat)) / nullif(var_pop(value) * count(*), 0)', 5)} AS comp_r2
    FROM pairs WHERE yhat IS NOT NULL GROUP BY 1""")
def a14(spark, sf):
    return rounded(folds.complete_r2(cv_pairs(spark, sf)), 5)


@query("A15_ensemble_spread", _CV + f"SELECT entity_id, ts, {R('avg(yhat)', 5)} AS mean, {R('stddev_samp(yhat)', 5)} AS std FROM pairs GROUP BY 1, 2")
def a15(spark, sf):
    return rounded(folds.ensemble_spread(cv_pairs(spark, sf)), 5)


@query("A16_confidence_band", _CV + f"""SELECT entity_id, ts, {R('avg(yhat)', 5)} AS mean, {R('stddev_samp(yhat)', 5)} AS std,
    {R('avg(yhat) - 1.96e0 * stddev_samp(yhat)', 5)} AS lower, {R('avg(yhat) + 1.96e0 * stddev_samp(yhat)', 5)} AS upper FROM pairs GROUP BY 1, 2""")
def a16(spark, sf):
    return rounded(folds.confidence_band(folds.ensemble_spread(cv_pairs(spark, sf))), 5)


@query("A17_standard_scaling", _CV + f"""SELECT entity_id, ts, fold, split, {R('value')} AS value, {R('(x - m) / coalesce(nullif(s, 0), 1)', 4)} AS x
    FROM split JOIN (SELECT entity_id, fold, avg(x) AS m, stddev_pop(x) AS s FROM split WHERE split = 'train' GROUP BY 1, 2) USING (entity_id, fold)""")
def a17(spark, sf):
    return rounded(folds.standardize(cv_split(spark, sf), ["x"]), 6, x=4)


@query("A17_inverse_scaling", _CV + f"SELECT entity_id, ts, fold, split, {R('value')} AS value, {R('x', 4)} AS x FROM split")
def a17b(spark, sf):
    rows = cv_split(spark, sf)
    scaler = folds.fit_scaler(rows.filter("split = 'train'"), ["x"])
    return rounded(folds.scale(folds.scale(rows, scaler, ["x"]), scaler, ["x"], inverse=True), 6, x=4)


@query("A18_variogram", with_("pb", "npts") + f"""SELECT ts, {R('sqrt((max(lon) - min(lon)) * (max(lon) - min(lon)) + (max(lat) - min(lat)) * (max(lat) - min(lat))) * 0.125e0')} AS range,
    {R('var_pop(value)', 4)} AS sill, 0e0 AS nugget FROM pb JOIN npts USING (entity_id) GROUP BY 1""")
def a18(spark, sf):
    return rounded(surface.variogram(pb_monthly(spark, sf), nation_points(spark, sf)), 6, sill=4)


@query("A19_mean_change", with_("raster", curve=_CURVE) + f"SELECT ts, {R('delta', 5)} AS delta FROM curve")
def a19(spark, sf):
    return rounded(storage.mean_change(raster(spark, sf)), 5)


@query("A19_weighted_change", with_("raster") + f"""SELECT ts, {R('sum((value - v0) * cos(radians(lat))) / sum(CASE WHEN v0 IS NOT NULL THEN cos(radians(lat)) END)', 5)} AS delta
    FROM raster LEFT JOIN (SELECT row, col, value AS v0 FROM raster WHERE ts = (SELECT min(ts) FROM raster)) USING (row, col) GROUP BY ts""")
def a19b(spark, sf):
    return rounded(storage.mean_change(raster(spark, sf), weighted=True), 5)


@query("A20_footprint_area", with_("raster", area=_AREA) + f"SELECT {R('area / 1e12')} AS area FROM area")
def a20(spark, sf):
    return rounded(storage.footprint_area(raster(spark, sf)).select((F.col("area") / 1e12).alias("area")))


@query("A21_storage_curve", with_("raster", curve=_CURVE, area=_AREA, kept="SELECT * FROM curve WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1999-01-01'") +
       f"""SELECT ts, {R('(delta - (SELECT delta FROM kept ORDER BY ts LIMIT 1)) * area * 0.2e0 / 1000000 / 43560 / 1000', 4)} AS storage_change FROM kept, area""")
def a21(spark, sf):
    c = storage.storage_curve(raster(spark, sf), 0.2, ("1996-01-01", "1999-01-01"))
    return rounded(c.withColumn("storage_change", F.col("storage_change") / 1000), 4)


_DRIVERS = {"price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "CAST(l_linenumber AS DOUBLE)",
            "part": "CAST(l_partkey AS DOUBLE)", "month": "CAST(month(l_shipdate) AS DOUBLE)"}


@query("A22_feature_importance", "WITH i AS (" + " UNION ALL ".join(
    f"SELECT l_suppkey, '{n}' AS feature, abs(covar_pop({e}, l_quantity) / nullif(stddev_pop({e}) * stddev_pop(l_quantity), 0)) AS importance FROM lineitem GROUP BY 1"
    for n, e in _DRIVERS.items()) + f") SELECT feature, {R('avg(importance)', 5)} AS importance FROM i GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
def a22(spark, sf):
    from panelspark.functions.stats import pearson
    li = table(spark, sf, "lineitem")
    wide = li.groupBy("l_suppkey").agg(*[F.abs(pearson(F.expr(e), F.col("l_quantity"))).alias(n) for n, e in _DRIVERS.items()])
    return rounded(report.feature_importance(wide.unpivot("l_suppkey", list(_DRIVERS), "feature", "importance"), 10), 5)


@query("A23_residuals", _CV + f"""SELECT entity_id, ts, {R('value')} AS value, {R('yhat', 5)} AS yhat, {R('yhat - value', 5)} AS residual,
    {R('avg(value) OVER (PARTITION BY entity_id)', 5)} AS obs_mean FROM pairs WHERE split = 'test'""")
def a23(spark, sf):
    pairs = cv_pairs(spark, sf).filter("split = 'test'")
    return rounded(report.residuals(pairs.select("entity_id", "ts", "value"), pairs.select("entity_id", "ts", "yhat")), 5, value=6)
