from pyspark.sql import functions as F

from catalog.aggregates import FRACTIONS, _CV, _knots, cv_pairs, cv_split
from catalog.common import R, pa_monthly, query, rounded, with_
from catalog.joins import _ACCEPTED, accepted
from panelspark.operators import prior, report


_SIDES = """SELECT a.entity_id, f AS fraction, side, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM k a
    JOIN k b ON a.entity_id = b.entity_id AND a.x < b.x CROSS JOIN fr CROSS JOIN (VALUES ('left'), ('right')) s(side)
    WHERE CASE WHEN side = 'left' THEN greatest(a.rn, b.rn) ELSE greatest(a.rd, b.rd) END <= floor(a.n * f) GROUP BY 1, 2, 3"""


@query("V2_trend_candidates", with_("pam", k=_knots("pam"), fr="SELECT f FROM (VALUES " + ", ".join(f"({f}e0)" for f in FRACTIONS) + ") v(f)",
                                    s=_SIDES, ent="SELECT entity_id, max(n) AS n FROM k GROUP BY 1") +
       f"""SELECT ent.entity_id, side, f AS fraction, CAST(floor(n * f) AS BIGINT) AS n_points, {R('slope', 8)} AS slope
       FROM ent CROSS JOIN fr CROSS JOIN (VALUES ('left'), ('right')) x(side) LEFT JOIN s USING (entity_id, side) WHERE s.fraction = f OR s.fraction IS NULL""")
def v2(spark, sf):
    return rounded(prior.trend_candidates(pa_monthly(spark, sf), FRACTIONS), 8)


@query("V3_prediction_pairs", _CV + f""", acc AS ({_ACCEPTED}) SELECT entity_id, ts, {R('p.value')} AS value, {R('q.yhat', 5)} AS yhat FROM acc p
    FULL JOIN (SELECT entity_id, ts, yhat FROM pairs WHERE split = 'test') q USING (entity_id, ts)""")
def v3(spark, sf):
    pred = cv_pairs(spark, sf).filter("split = 'test'").select("entity_id", "ts", "yhat")
    return rounded(report.prediction_pairs(accepted(spark, sf), pred), 6, yhat=5)


@query("V4_filled_band", _CV + f"""SELECT entity_id, ts, {R('any_value(value)')} AS value, {R('avg(yhat)', 5)} AS mean, {R('stddev_samp(yhat)', 5)} AS std,
    {R('avg(yhat) - 1.96e0 * stddev_samp(yhat)', 5)} AS lower, {R('avg(yhat) + 1.96e0 * stddev_samp(yhat)', 5)} AS upper FROM pairs GROUP BY 1, 2""")
def v4(spark, sf):
    return rounded(report.filled_band(pa_monthly(spark, sf), cv_pairs(spark, sf)), 5, value=6)


@query("V5_split_predictions", _CV + f"SELECT entity_id, ts, fold, split, {R('value')} AS value, {R('yhat', 5)} AS yhat FROM pairs")
def v5(spark, sf):
    return rounded(report.split_predictions(cv_split(spark, sf).drop("x"), cv_pairs(spark, sf)), 6, yhat=5)


@query("V6_residual_summary", _CV + f"""SELECT entity_id, count(*) AS n, {R('avg(yhat - value)', 5)} AS residual, {R('avg(value)', 5)} AS obs_mean
    FROM pairs WHERE split = 'test' GROUP BY 1""")
def v6(spark, sf):
    pairs = cv_pairs(spark, sf).filter("split = 'test'")
    r = report.residuals(pairs.select("entity_id", "ts", "value"), pairs.select("entity_id", "ts", "yhat"))
    return rounded(r.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("residual"),
                                              F.first("obs_mean").alias("obs_mean")), 5)
