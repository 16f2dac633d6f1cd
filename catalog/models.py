from pyspark.sql import functions as F

from catalog.aggregates import CV, FRACTIONS, _CV, _REL, chosen_relations, cv_pairs, cv_split, trend_ctes
from catalog.common import (COARSE, END, R, START, dense_sql, diamond_edges, drought_grid, grid_sql, land_grid,
                            nation_points, pa_monthly, pb_monthly, pchip_ctes, pd_daily, query, rounded, supplier_points, table, with_)
from catalog.joins import _NEAREST_COARSE, coarse_cells, pb_candidates
from catalog.projections import _GROUNDWATER
from catalog.windows import CLEAN, PRIOR, middle
from panelspark.config import DROUGHT_INDEX, FEATURE_VARIABLES, MONTHS, GridSpec, RunConfig
from panelspark.operators import features as feat, folds, grid as grids, least_squares, model, polygon, prior, relate, surface, timeline
from panelspark.operators.nearest import without_position
from panelspark.plans.imputation import fit_and_fill, linear_imputation, model_rows, satellite_rows
from panelspark.plans.refinement import iterative_refinement
from panelspark.plans.run import Inputs, run
from panelspark.session import cut_lineage, new_path

NET = RunConfig(start=START, end=END, estimator="linear", min_months=50)


# --- feature table --------------------------------------------------------------------------

WINDOWS = (18, 24, 36, 60)
_CLIMATE = {**PRIOR, **{
    "rolled": "SELECT *, " + ", ".join(
        f'avg(prior) OVER (w ROWS BETWEEN {n - 1 - (n - 1) // 2} PRECEDING AND {(n - 1) // 2} FOLLOWING) AS "{n}m_rw"' for n in WINDOWS)
        + " FROM prior WINDOW w AS (PARTITION BY entity_id ORDER BY ts)",
    "g": _GROUNDWATER,
    "near": _NEAREST_COARSE.format(pts="npts"),
}}


@query("M4_climate_features", with_("pb", "npts", "cells", "drought", "land", **_CLIMATE) +
       "SELECT entity_id, ts, " + ", ".join(f'{R(f"{c}", 4)} AS {c}' for c in [f'"{n}m_rw"' for n in WINDOWS] + [f'"{v}"' for v in FEATURE_VARIABLES]
                                            + ['"sc_PDSI_pm_filled"', '"ln(QSB_acc)"', '"ln(RW 4 Rainf_tavg)"', '"Surface Water"', '"Sum Soil Moist"'])
       + ", " + ", ".join(f'CAST(month(ts) = {i + 1} AS INTEGER) AS "{m}"' for i, m in enumerate(MONTHS)) +
       " FROM rolled JOIN near USING (entity_id) JOIN drought USING (cell_id, ts) JOIN land USING (cell_id, ts) JOIN g USING (cell_id, ts) WHERE prior IS NOT NULL")
def m4(spark, sf):
    priors = prior.prior_features(middle(spark, sf), FRACTIONS, 0.10, WINDOWS)
    points = nation_points(spark, sf)
    d, l = drought_grid(spark, sf), land_grid(spark, sf)
    cells = coarse_cells(spark, d)
    drought = grids.nearest_cell_series(points, cells, d, COARSE, ["sc_PDSI_pm_filled"])
    land = grids.nearest_cell_series(points, cells, feat.groundwater_features(l), COARSE,
                                     [*FEATURE_VARIABLES, *[f"`{c}`" for c in feat.DERIVED]])
    rows, scaled, dummies = feat.climate_features(priors, drought, land, ["sc_PDSI_pm_filled"])
    return rounded(rows.select("entity_id", "ts", *[f"`{c}`" for c in (*scaled, *dummies)]), 4)


# --- estimators -----------------------------------------------------------------------------

@query("M5_linear_folds", _CV + f"SELECT entity_id, ts, fold, split, {R('value')} AS value, {R('x', 4)} AS x, {R('yhat', 5)} AS yhat FROM pairs")
def m5_linear(spark, sf):
    return rounded(cv_pairs(spark, sf), 6, x=4, yhat=5)


def _satellite_rows(spark, sf):
    d, l = drought_grid(spark, sf), land_grid(spark, sf)
    cells = coarse_cells(spark, d)
    return satellite_rows(pb_monthly(spark, sf), nation_points(spark, sf), (d, cells, COARSE), (l, cells, COARSE),
                          NET, ["sc_PDSI_pm_filled"])


# least squares on all features in SQL: correlations of each fold's training rows (fold -1: all labelled rows), solved by elimination without
# exchange of rows; a feature that the ones before it determine gets coefficient 0
_FEATURES = [f'"{c}"' for c in ["sc_PDSI_pm_filled", *FEATURE_VARIABLES, *[f"{n}m_rw" for n in WINDOWS], *feat.DERIVED]]
_INDICATORS = [f"CAST(month(ts) = {MONTHS.index(m) + 1} AS DOUBLE)" for m in sorted(MONTHS)]


def least_squares_ctes(src, p):
    """CTEs that end in `runs` (entity_id, ts, fold, split, value, yhat) from `src` (entity_id, ts, value, x)."""
    return {
        "labelled": f"SELECT *, ntile(5) OVER (PARTITION BY entity_id ORDER BY ts) AS test_fold FROM {src} WHERE value IS NOT NULL",
        "folded": "SELECT l.*, fold, test_fold = fold AS is_test FROM labelled l CROSS JOIN (SELECT unnest(range(1, 6)) AS fold)",
        "lots": CV["lots"],
        "split": """SELECT entity_id, ts, fold, CASE WHEN is_test THEN 'test' WHEN rn <= ceil(n * 0.3e0) THEN 'validation' ELSE 'train' END AS split FROM lots
            UNION ALL SELECT entity_id, ts, -1, 'all' FROM labelled""",
        "fitted": f"SELECT s.entity_id, s.fold, s.ts, f.value, f.x FROM split s JOIN {src} f USING (entity_id, ts) WHERE split IN ('train', 'all')",
        "long": f"SELECT entity_id, fold, ts, value, unnest(x) AS v, unnest(range(1, {p + 1})) AS i FROM fitted",
        "mom": "SELECT entity_id, fold, i, count(*) AS n, avg(v) AS m, avg(value) AS my, avg(v * v) AS q FROM long GROUP BY 1, 2, 3",
        "cen": "SELECT entity_id, fold, ts, i, v - m AS c, value - my AS cy, n, q FROM long JOIN mom USING (entity_id, fold, i)",
        "dev": "SELECT entity_id, fold, i, CASE WHEN avg(c * c) > 1e-20 * any_value(q) THEN sqrt(avg(c * c)) ELSE 0e0 END AS sd, avg(c * cy) AS cy FROM cen GROUP BY 1, 2, 3",
        "cov": """SELECT entity_id, fold, a.i, b.i AS j, avg(a.c * b.c) AS c FROM cen a JOIN cen b USING (entity_id, fold, ts) WHERE a.i <= b.i GROUP BY 1, 2, 3, 4""",
        "cor": """SELECT entity_id, fold, i, j, CASE WHEN a.sd > 0 AND b.sd > 0 THEN c / (a.sd * b.sd) ELSE 0e0 END AS r FROM
            (SELECT * FROM cov UNION ALL SELECT entity_id, fold, j, i, c FROM cov WHERE i < j) JOIN dev a USING (entity_id, fold, i)
            JOIN (SELECT entity_id, fold, i AS j, sd FROM dev) b USING (entity_id, fold, j)""",
        "lines": """SELECT entity_id, fold, i, list_append(list(r ORDER BY j), any_value(CASE WHEN sd > 0 THEN cy / sd ELSE 0e0 END)) AS line FROM cor JOIN dev USING (entity_id, fold, i)
            GROUP BY 1, 2, 3""",
        "start": "SELECT entity_id, fold, list(line ORDER BY i) AS m FROM lines GROUP BY 1, 2",
        "steps": f"""SELECT entity_id, fold, CAST(0 AS BIGINT) AS k, m FROM start UNION ALL
            SELECT entity_id, fold, k + 1, list_transform(m, lambda line, i: CASE WHEN i = k + 1 THEN prow ELSE list_transform(line, lambda x, j: x - line[k + 1] * prow[j]) END)
            FROM (SELECT *, list_transform(m[k + 1], lambda x: CASE WHEN m[k + 1][k + 1] > 1e-9 THEN x / m[k + 1][k + 1] ELSE 0e0 END) AS prow FROM steps WHERE k < {p})""",
        "beta": f"""SELECT entity_id, fold, list(CASE WHEN sd > 0 THEN b / sd ELSE 0e0 END ORDER BY i) AS b, list(m ORDER BY i) AS m, any_value(my) AS my FROM
            (SELECT entity_id, fold, unnest(list_transform(m, lambda line: line[{p + 1}])) AS b, unnest(range(1, {p + 1})) AS i FROM steps WHERE k = {p})
            JOIN dev USING (entity_id, fold, i) JOIN mom USING (entity_id, fold, i) GROUP BY 1, 2""",
        "runs": f"""SELECT f.entity_id, f.ts, CAST(b.fold AS INTEGER) AS fold, s.split, f.value,
            my + list_sum(list_transform(list_zip(f.x, b.m, b.b), lambda z: (z[1] - z[2]) * z[3])) AS yhat
            FROM {src} f JOIN beta b USING (entity_id) LEFT JOIN split s ON s.entity_id = f.entity_id AND s.ts = f.ts AND s.fold = b.fold""",
    }


_LEAST = {**_CLIMATE, "mid": dense_sql("pb"),
          "wide": "SELECT *, [" + ", ".join([*_FEATURES, *_INDICATORS]) + "] AS x FROM rolled JOIN near USING (entity_id) JOIN drought USING (cell_id, ts) "
                  "JOIN land USING (cell_id, ts) JOIN g USING (cell_id, ts)",
          "feat": "SELECT entity_id, ts, value, x FROM wide WHERE len(list_filter(x, lambda v: v IS NULL)) = 0"}
_LEAST = with_("pb", "npts", "cells", "drought", "land", **_LEAST, **least_squares_ctes("feat", len(_FEATURES) + len(_INDICATORS))).replace("WITH ", "WITH RECURSIVE ", 1)


def _fitted(spark, sf):
    return least_squares.fit_and_predict(cut_lineage(_satellite_rows(spark, sf), "rows"), NET.folds, NET.validation_split, NET.seed)[0]


@query("M5_least_squares_folds", _LEAST + f"SELECT entity_id, ts, fold, split, {R('value', 4)} AS value, {R('yhat', 3)} AS yhat FROM runs WHERE fold > 0")
def m5_ls(spark, sf):
    return rounded(_fitted(spark, sf).filter("fold > 0"), 4, yhat=3)


@query("M6_final_fit", _LEAST + f"SELECT entity_id, ts, fold, split, {R('value', 4)} AS value, {R('yhat', 3)} AS yhat FROM runs WHERE fold = -1")
def m6(spark, sf):
    return rounded(_fitted(spark, sf).filter("fold = -1"), 4, yhat=3)


def plane(src, y, by, only):
    """CTE: least-squares plane of `y` over x and z in each group."""
    return f"""SELECT *, my - bx * mx - bz * mz AS b0 FROM (SELECT *, (cxy * vz - czy * cxz) / (vx * vz - cxz * cxz) AS bx, (czy * vx - cxy * cxz) / (vx * vz - cxz * cxz) AS bz
        FROM (SELECT {by}, var_pop(x) AS vx, var_pop(z) AS vz, covar_pop(x, z) AS cxz, covar_pop(x, {y}) AS cxy, covar_pop(z, {y}) AS czy,
        avg(x) AS mx, avg(z) AS mz, avg({y}) AS my FROM {src} WHERE {only} GROUP BY {by}))"""


def _pair_rows(rows, x):
    return rows.withColumns({"scaled": F.array(F.col(f"`{x}`"), F.month("ts").cast("double")), "passed": F.array().cast("array<double>")})


@query("M5_two_feature_folds", with_("pam", **{k: CV[k] for k in ("feat", "folded", "lots", "split")}, wide="SELECT *, CAST(month(ts) AS DOUBLE) AS z FROM split",
    line=plane("wide", "value", "entity_id, fold", "split = 'train'")) + f"""SELECT entity_id, ts, fold, split, {R('value')} AS value, {R('b0 + bx * x + bz * z', 4)} AS yhat
    FROM wide JOIN line USING (entity_id, fold)""")
def m5_two(spark, sf):
    return rounded(model.predictions(model.fit_folds(_pair_rows(cv_split(spark, sf), "x"), estimator="linear")), 6, yhat=4)


_PAIR = {**PRIOR, "rolled": "SELECT *, CAST(month(ts) AS DOUBLE) AS z, avg(prior) OVER (PARTITION BY entity_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS x FROM prior",
         "line": plane("rolled", "value", "entity_id", "x IS NOT NULL AND value IS NOT NULL")}


def _final_pair(spark, sf):
    panel = middle(spark, sf)
    rows = prior.prior_features(panel, FRACTIONS, 0.10, (24,))
    rows = model_rows(_pair_rows(rows, "24m_rw").filter("`24m_rw` IS NOT NULL").withColumn("_m", F.month("ts").cast("double")), ["24m_rw", "_m"], [])
    warm = middle(spark, sf).select("entity_id").distinct().select("entity_id", F.lit(0).alias("epochs"), F.lit(None).cast("array<double>").alias("weights"))
    return panel, model.predictions(model.fit_final(rows, warm, estimator="linear"))


@query("M6_two_feature_final", with_("pb", **_PAIR) + f"""SELECT entity_id, ts, {R('value', 4)} AS value, {R('b0 + bx * x + bz * z', 2)} AS yhat
    FROM rolled JOIN line USING (entity_id) WHERE x IS NOT NULL""")
def m6_two(spark, sf):
    return rounded(_final_pair(spark, sf)[1].select("entity_id", "ts", "value", "yhat"), 4, yhat=2)


@query("M8_two_feature_fill", with_("pb", **_PAIR) + f"""SELECT entity_id, ts, {R('coalesce(value, b0 + bx * x + bz * z)', 2)} AS value, value IS NOT NULL AS is_observed
    FROM rolled LEFT JOIN line USING (entity_id)""")
def m8_two(spark, sf):
    panel, predicted = _final_pair(spark, sf)
    return rounded(folds.fill(panel, predicted), 2)


@query("M7_fill", with_("pam", lines="""SELECT entity_id, regr_slope(value, x) AS s, regr_intercept(value, x) AS i FROM
    (SELECT *, CAST(date_diff('day', DATE '1998-01-01', ts) AS DOUBLE) / 365 AS x FROM pam) GROUP BY 1""") +
       f"""SELECT entity_id, d.ts, {R("coalesce(value, i + s * (CAST(date_diff('day', DATE '1998-01-01', d.ts) AS DOUBLE) / 365))", 4)} AS value, value IS NOT NULL AS is_observed
       FROM ({dense_sql('pam')}) d JOIN lines USING (entity_id) ORDER BY 1""")
def m7(spark, sf):
    panel = pa_monthly(spark, sf)
    x = (F.datediff("ts", F.lit("1998-01-01").cast("date")) / 365).alias("x")
    dense = timeline.densify(panel, START, END).select("*", x)
    fits = folds.linear_fit(dense, "x")
    pred = folds.linear_predict(dense, fits, "x")
    return rounded(folds.fill(panel.filter(F.col("ts").between(F.lit(START).cast("date"), F.lit(END).cast("date"))), pred), 4)


LINEAR = {"kept": CLEAN["kept"].replace("1.5e0", "3e0"),
          "b": CLEAN["b"],
          "good": CLEAN["good"].replace("1995-02-01", START).replace("2001-06-01", END),
          "qual": CLEAN["qual"]}
LINEAR = {k: LINEAR[k] for k in ("b", "kept", "good", "qual")}


@query("M8_linear_imputation", with_("pd", **LINEAR, **pchip_ctes("qual", 365, 90, prefix="i_"),
    mid=f"""SELECT e.entity_id, c.ts, i.value FROM (SELECT DISTINCT entity_id FROM i_interp) e CROSS JOIN
        (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH)) AS DATE) AS ts) c
        LEFT JOIN i_interp i ON i.entity_id = e.entity_id AND i.ts = c.ts""",
    seg=PRIOR["seg"], **trend_ctes("mid"), **pchip_ctes("mid", prefix="c_"), prior=PRIOR["prior"],
    rolled="SELECT *, avg(prior) OVER (PARTITION BY entity_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS x FROM prior",
    line="""SELECT entity_id, slope, my - slope * mx AS intercept FROM (SELECT entity_id, coalesce(covar_pop(x, value) / nullif(var_pop(x), 0), 0) AS slope,
        avg(x) AS mx, avg(value) AS my FROM rolled WHERE x IS NOT NULL AND value IS NOT NULL GROUP BY 1)""") +
    f"""SELECT entity_id, ts, {R('coalesce(value, intercept + slope * x)', 2)} AS value, {R('intercept + slope * x', 2)} AS yhat, value IS NOT NULL AS is_observed
    FROM rolled LEFT JOIN line USING (entity_id)""")
def m8_linear(spark, sf):
    return rounded(linear_imputation(pd_daily(spark, sf), RunConfig(start=START, end=END, min_months=8)), 2)


@query("M8_satellite_imputation", _LEAST + f"""SELECT entity_id, ts, {R('coalesce(pb.value, yhat)', 3)} AS value, pb.value IS NOT NULL AS is_observed
    FROM (SELECT * FROM pb WHERE entity_id IN (SELECT entity_id FROM beta) AND ts BETWEEN DATE '{START}' AND DATE '{END}') pb
    FULL JOIN (SELECT entity_id, ts, yhat FROM runs WHERE fold = -1) USING (entity_id, ts)""")
def m8(spark, sf):
    return rounded(fit_and_fill(pb_monthly(spark, sf), _satellite_rows(spark, sf), NET)["data"], 3)


# --- neighbours -----------------------------------------------------------------------------

@query("M9_neighbour_features", _REL + f"""SELECT target AS entity_id, ts, CAST(rank AS INTEGER) - 1 AS pos, {R('value', 4)} AS neighbour
    FROM (SELECT *, count(value) OVER (PARTITION BY target, ts) AS have FROM chosen JOIN pbc ON pbc.entity_id = candidate) WHERE have = k""")
def m9(spark, sf):
    rows = relate.neighbour_features(chosen_relations(spark, sf), pb_candidates(spark, sf))
    return rounded(rows.select("entity_id", "ts", F.posexplode("neighbours").alias("pos", "neighbour")), 4)


@query("M10_iterative_refinement")
def m10(spark, sf):
    data = cut_lineage(pb_candidates(spark, sf), "imputed")
    return iterative_refinement(pb_monthly(spark, sf), data, nation_points(spark, sf), NET)[-1]["data"]


# --- surfaces -------------------------------------------------------------------------------

@query("M11_surface_grid", with_("diamonds", "box", axis="SELECT *, (x_max - x_min) / 97 AS res, CAST(ceil((y_max - y_min) / ((x_max - x_min) / 97)) AS INTEGER) AS n_rows FROM box",
    g="""SELECT r AS row, c AS col, x_min + c * res AS lon, y_max - r * res AS lat FROM axis, (SELECT CAST(unnest(range(97)) AS INTEGER) AS c),
        (SELECT CAST(unnest(range(2000)) AS INTEGER) AS r) WHERE r < n_rows""") + f"""SELECT CAST(row AS BIGINT) * 97 + col AS cell_id, row, col, {R('lon')} AS lon, {R('lat')} AS lat FROM g
    WHERE EXISTS (SELECT 1 FROM diamonds d WHERE abs(g.lon - d.lon) + abs(g.lat - d.lat) < d.radius
    AND NOT (d.has_hole AND abs(g.lon - d.lon) + abs(g.lat - d.lat) <= 1))""")
def m11(spark, sf):
    return rounded(polygon.surface_grid(spark, diamond_edges(spark, sf), 97)[0])


def point_cells(spark, sf):
    """The nations' own positions as cells."""
    key = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("bigint")
    return nation_points(spark, sf).select(key.alias("cell_id"), F.lit(0).alias("row"), key.cast("int").alias("col"),
                                           "lon", "lat")


@query("S3_without_position", """SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, 'no position' AS status FROM supplier WHERE s_acctbal < 0""")
def s3_missing(spark, sf):
    # suppliers in debt have lost one of their coordinates
    lost = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id"), (F.col("s_acctbal") < 0).alias("_lost"))
    points = supplier_points(spark, sf).join(lost, "entity_id")
    gone = F.when(~F.col("_lost"), F.col("lon"))
    return without_position(points.withColumn("lon", gone))


@query("J6_nearest_with_positions", with_("spts", near="""SELECT s.entity_id, g.cell_id, row_number() OVER (PARTITION BY s.entity_id
    ORDER BY (s.lon - g.lon) * (s.lon - g.lon) + (s.lat - g.lat) * (s.lat - g.lat), g.cell_id) AS rank
    FROM spts s JOIN supplier p ON s.entity_id = CAST(p.s_suppkey AS VARCHAR) CROSS JOIN g WHERE p.s_acctbal >= 0""").replace("WITH ", f"WITH g AS ({grid_sql(COARSE)}),\n", 1) +
    "SELECT entity_id, cell_id, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 2")
def j6_positions(spark, sf):
    lost = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id"), (F.col("s_acctbal") < 0).alias("_lost"))
    points = supplier_points(spark, sf).join(lost, "entity_id").withColumn("lat", F.when(~F.col("_lost"), F.col("lat")))
    return grids.nearest_cells(points, grids.create_grid(spark, COARSE), COARSE, 2).select("entity_id", "cell_id", "rank")


@query("M12_weights_sum_to_one", with_("npts", g=grid_sql(DROUGHT_INDEX)) +
       "SELECT cell_id, 1e0 AS total, (SELECT count(*) FROM npts) AS n_points FROM g")
def m12(spark, sf):
    w = surface.kriging_weights(grids.create_grid(spark, DROUGHT_INDEX), nation_points(spark, sf))
    return rounded(w.groupBy("cell_id").agg(F.sum("w").alias("total"), F.count("w").alias("n_points")))


@query("M12_exact_at_points", with_("pb", "pbc") + f"""SELECT entity_id, ts, {R('value', 3)} AS value FROM pbc WHERE entity_id <> 'NATION_3'""")
def m12b(spark, sf):
    # the weights of a point's own position give back its value
    panel = surface.complete_entities(pb_candidates(spark, sf))
    points = nation_points(spark, sf).join(panel.select("entity_id").distinct(), "entity_id", "left_semi")
    cells = point_cells(spark, sf)
    out = surface.apply_weights(surface.kriging_weights(cells, points), panel)
    names = F.concat(F.lit("NATION_"), F.col("cell_id").cast("string"))
    return rounded(out.select(names.alias("entity_id"), "ts", "value").filter("entity_id <> 'NATION_3'"), 3)


@query("M13_surfaces", with_("pb") + f"SELECT entity_id, ts, {R('value', 4)} AS value FROM pb")
def m13(spark, sf):
    # months differ in the nations they have; at the available points a surface equals the panel
    panel = pb_monthly(spark, sf)
    out = surface.surfaces(panel, nation_points(spark, sf), point_cells(spark, sf))
    names = F.concat(F.lit("NATION_"), F.col("cell_id").cast("string"))
    out = out.select(names.alias("entity_id"), "ts", "value")
    return rounded(out.join(panel.select("entity_id", "ts"), ["entity_id", "ts"], "left_semi"), 4)


# kriging in SQL: each time has a bordered system, solved by elimination without exchange of rows
KRIGING = {
    "sites": "SELECT *, row_number() OVER (PARTITION BY ts ORDER BY lon, lat) AS i, count(*) OVER (PARTITION BY ts) AS n FROM (SELECT ts, lon, lat, avg(value) AS v FROM seen JOIN npts USING (entity_id) GROUP BY ts, lon, lat)",
    "wide": "SELECT ts, 0.125e0 * sqrt((max(lon) - min(lon)) * (max(lon) - min(lon)) + (max(lat) - min(lat)) * (max(lat) - min(lat))) AS s FROM sites GROUP BY ts",
    "lines": """SELECT a.ts, a.i, a.n, list_concat(list(CASE WHEN s > 0 THEN exp(-pow(sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) / s, 1.5e0)) ELSE 1e0 END ORDER BY b.i), [1e0, a.v]) AS line
        FROM sites a JOIN sites b USING (ts) JOIN wide USING (ts) GROUP BY a.ts, a.i, a.n, a.v
        UNION ALL SELECT ts, n + 1, n, list_concat(list_transform(range(n), lambda x: 1e0), [0e0, 0e0]) FROM (SELECT DISTINCT ts, n FROM sites)""",
    "start": "SELECT ts, CAST(n + 1 AS BIGINT) AS size, list(line ORDER BY i) AS m FROM lines GROUP BY ts, n",
    "steps": """SELECT ts, size, CAST(0 AS BIGINT) AS k, m FROM start UNION ALL
        SELECT ts, size, k + 1, list_transform(m, lambda line, i: CASE WHEN i = k + 1 THEN prow ELSE list_transform(line, lambda x, j: x - line[k + 1] * prow[j]) END)
        FROM (SELECT *, list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1]) AS prow FROM steps WHERE k < size)""",
    "solved": "SELECT ts, size, list_transform(m, lambda line: line[size + 1]) AS beta FROM steps WHERE k = size",
    "field": """SELECT c.cell_id, p.ts, any_value(beta[size]) + sum(beta[i] * CASE WHEN s > 0 THEN exp(-pow(sqrt((c.lon - p.lon) * (c.lon - p.lon) + (c.lat - p.lat) * (c.lat - p.lat)) / s, 1.5e0))
        WHEN c.lon = p.lon AND c.lat = p.lat THEN 1e0 ELSE 0e0 END) AS value
        FROM sites p JOIN solved USING (ts) JOIN wide USING (ts) CROSS JOIN g c GROUP BY 1, 2""",
}


def kriging_sql(seen, *names):
    return with_(*names, "npts", g=grid_sql(COARSE), seen=seen, **KRIGING).replace("WITH ", "WITH RECURSIVE ", 1) + (
        f"SELECT cell_id, ts, {R('value', 3)} AS value FROM field")


@query("M13_full_surfaces", kriging_sql("SELECT * FROM pb", "pb"))
def m13b(spark, sf):
    out = surface.surfaces(pb_monthly(spark, sf), nation_points(spark, sf), grids.create_grid(spark, COARSE))
    return rounded(out.select("cell_id", "ts", "value"), 3)


@query("M13_supplier_surfaces")
def m13_suppliers(spark, sf):
    # the complete suppliers on the grid of the polygons; from sf0.1 on there are more than one tile of them
    cells = polygon.surface_grid(spark, diamond_edges(spark, sf), 97)[0]
    out = surface.krige_panel(pa_monthly(spark, sf), supplier_points(spark, sf), cells, monthly_step=12)
    return rounded(out.select("cell_id", "ts", "value"), 3)


@query("M14_krige_panel", kriging_sql("""SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS t FROM pbc
    WHERE entity_id IN (SELECT entity_id FROM pbc GROUP BY 1 HAVING count(value) = (SELECT count(DISTINCT ts) FROM pbc))) WHERE t % 3 = 0""", "pb", "pbc"))
def m14(spark, sf):
    out = surface.krige_panel(pb_candidates(spark, sf), nation_points(spark, sf), grids.create_grid(spark, COARSE), monthly_step=3)
    return rounded(out.select("cell_id", "ts", "value"), 3)


# --- everything -----------------------------------------------------------------------------

@query("M16_full_run")
def m16(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    daily = (o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .groupBy("n_name", F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("v")))
    readings = daily.select(F.date_format("day", "M/d/yyyy").alias("Date"), F.col("n_name").alias("Well ID"),
                            F.col("v").cast("string").alias("Measurement"))
    places = nation_points(spark, sf).select(F.col("entity_id").alias("Well ID"), F.col("lon").alias("Longitude"),
                                             F.col("lat").alias("Latitude"))
    spec = GridSpec(COARSE.x_min, COARSE.y_min, COARSE.x_max, COARSE.y_max, 30.0, 30.0, ("sc_PDSI_pm_filled",))
    inputs = Inputs(readings, places, diamond_edges(spark, sf), drought_grid(spark, sf), land_grid(spark, sf), spec, COARSE)
    config = RunConfig(start=START, end=END, estimator="linear", min_months=20, date_filter=("1995-01-01", "1999-01-01"))
    return run(spark, inputs, new_path(spark, "run"), config)["storage"]
