import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import folds, model, prior, relate
from panelspark.plans.imputation import fit_and_fill, linear_imputation
from panelspark.plans.refinement import iterative_refinement
from panelspark.config import METRIC_NAMES, RunConfig


def months(n, start=dt.date(2000, 1, 1)):
    return [dt.date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1) for i in range(n)]


def monthly(spark, series):
    rows = [(e, t, None if v is None or np.isnan(v) else float(v)) for e, vs in series.items() for t, v in zip(months(len(vs)), vs)]
    return spark.createDataFrame(rows, "entity_id string, ts date, value double")


@pytest.mark.parametrize("window,first", [(18, [4.0, 4.5, 4.5]), (4, [0.5, 1.0, 1.5])])
def test_rolling_frames(spark, window, first):
    out = prior.rolling_means(monthly(spark, {"a": np.arange(10.0)}), [window], value="value").orderBy("ts").collect()
    assert [r[f"{window}m_rw"] for r in out[:3]] == first


def test_fold_sizes_and_splits(spark):
    rows = monthly(spark, {"a": np.arange(23.0), "b": [1.0, None, 2.0, 3.0, None, 4.0, 5.0, 6.0]})
    sizes = folds.assign_folds(rows.filter("entity_id = 'a'")).groupBy("test_fold").count().orderBy("test_fold").collect()
    assert [r["count"] for r in sizes] == [5, 5, 5, 4, 4]
    t = folds.training_rows(rows, 5, 0.3, 42).toPandas()
    a = t[(t.entity_id == "a") & (t.fold == 1)].split.value_counts()
    assert a.to_dict() == {"train": 12, "validation": 6, "test": 5}
    b = t[t.entity_id == "b"]
    assert b[b.value.isna()].split.isna().all() and b[b.value.notna()].split.notna().all()
    again = folds.training_rows(rows.repartition(3), 5, 0.3, 42).toPandas()
    key = ["entity_id", "fold", "ts"]
    pd.testing.assert_frame_equal(t.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


def test_median_slope_long_series_is_exact(monkeypatch):
    rng = np.random.default_rng(0)
    for n in (2, 3, 50, 301):
        x, y = np.sort(rng.choice(5000, n, replace=False)).astype(float), rng.normal(size=n).round(2)
        want = np.median([(y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(i + 1, n)])
        assert prior.median_slope(x, y) == pytest.approx(want, abs=1e-15)
        monkeypatch.setattr(prior, "DIRECT_PAIRS", 500)
        assert prior.median_slope(x, y) == pytest.approx(want, abs=1e-15)
        monkeypatch.undo()
    assert prior.median_slope(np.array([1.0]), np.array([1.0])) is None


def test_short_series_is_insufficient(spark):
    fits = prior.trend_slopes(monthly(spark, {"a": np.arange(9.0), "b": np.arange(40.0)}), (0.1, 1.0), 0.1)
    got = {r.entity_id: r for r in fits.collect()}
    assert got["a"].status == "insufficient" and got["a"].left_slope is None
    assert got["b"].status == "ok" and got["b"].left_intercept == 1.5 and got["b"].right_intercept == 37.5
    wide = prior.trend_slopes(monthly(spark, {"a": np.arange(9.0)}), (0.1, 1.0), 0.1, at_least=2).first()
    assert wide.status == "ok"


def test_prior_passes_observations_and_continues(spark):
    v = np.full(60, np.nan)
    v[20:41] = np.arange(21.0)
    v[25] = np.nan
    out = prior.prior(monthly(spark, {"a": v}), (0.5, 1.0), 0.1).orderBy("ts").collect()
    assert [r.segment for r in out] == ["left"] * 20 + ["center"] * 21 + ["right"] * 19
    assert all(r.prior == r.value for r in out if r.value is not None)
    assert 4.0 < out[25].prior < 6.0
    assert out[41].prior == pytest.approx(19.5) and out[0].prior == pytest.approx(0.5)
    near = prior.prior(monthly(spark, {"a": v}), (0.5, 1.0), 0.1, anchor="boundary").orderBy("ts").collect()
    assert near[19].prior == pytest.approx(0.5) and near[0].prior < -15


def test_scaler_round_trip_and_constant(spark):
    rows = spark.createDataFrame([("a", 1, "train", 1.0, 7.0), ("a", 1, "train", 3.0, 7.0), ("a", 1, "test", 5.0, 7.0)],
                                 "entity_id string, fold int, split string, x double, c double")
    s = folds.fit_scaler(rows.filter("split = 'train'"), ["x", "c"])
    scaled = folds.scale(rows, s, ["x", "c"])
    assert sorted(r.x for r in scaled.collect()) == [-1.0, 1.0, 3.0] and {r.c for r in scaled.collect()} == {0.0}
    back = folds.scale(scaled, s, ["x", "c"], inverse=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, folds.standardize(rows, ["x", "c"]).collect())) == sorted(map(tuple, scaled.collect()))


def test_constant_series_has_no_correlation(spark):
    rows = spark.createDataFrame([("a", 1, "test", 1.0, 1.0), ("a", 1, "test", 1.0, 2.0)],
                                 "entity_id string, fold int, split string, value double, yhat double")
    m = folds.fold_metrics(rows).first()
    assert m.r is None and m.n == 2 and m.me == 0.5
    assert folds.complete_r2(rows).first().comp_r2 is None


def test_linear_fill_equals_fit_and_predict(spark):
    rng = np.random.default_rng(2)
    rows = monthly(spark, {e: np.where(rng.random(30) < 0.3, np.nan, rng.normal(size=30)) for e in "ab"})
    rows = rows.withColumn("x", F.sin(F.month("ts")))
    a = folds.linear_predict(rows, folds.linear_fit(rows, "x"), "x").toPandas().sort_values(["entity_id", "ts"])
    b = folds.linear_fill(rows, "x").toPandas().sort_values(["entity_id", "ts"])
    assert np.allclose(a.yhat, b.yhat, atol=1e-12)
    one = a[a.entity_id == "a"]
    ok = one.value.notna()
    assert np.allclose(one.yhat, np.polyval(np.polyfit(one.x[ok], one.value[ok], 1), one.x))


# --- networks ---------------------------------------------------------------------------------

def test_network_learns_and_stops_early():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = x[:, 0] - 0.5 * x[:, 1]
    net = model.Mlp(3, np.random.default_rng(1))
    start = net.loss(x[200:], y[200:])
    history = net.fit(x[:200], y[:200], 300, 32, x[200:], y[200:])
    assert len(history) < 300
    assert np.corrcoef(net.predict(x[200:]), y[200:])[0, 1] > 0.95 and net.loss(x[200:], y[200:]) < start
    assert net.loss(x[200:], y[200:]) == pytest.approx(min(h[2] for h in history))


def test_network_gradient(monkeypatch):
    monkeypatch.setattr(model, "DROPOUT", 0.0)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(20, 2)), rng.normal(size=20)
    net = model.Mlp(2, np.random.default_rng(2))
    before = [p.copy() for p in net.p]
    net.step(x, y, 0.0)
    for i, (row, col) in ((0, (1, 3)), (2, (5, 7)), (4, (9, 0))):
        grad = net.m[i][row, col] / 0.1
        bump = 1e-6
        net.p = [p.copy() for p in before]
        net.p[i][row, col] += bump
        up = net.loss(x, y)
        net.p[i][row, col] -= 2 * bump
        assert grad == pytest.approx((up - net.loss(x, y)) / (2 * bump), rel=1e-4, abs=1e-7)


def feature_rows(spark, n=60):
    rng = np.random.default_rng(9)
    rows = []
    for e in ("a", "b", "short"):
        for i, t in enumerate(months(n)):
            f = float(np.sin(i / 6))
            v = 3 * f + rng.normal() * 0.05 if (i % 7 and (e != "short" or i == 1)) else None
            rows.append((e, t, v, [f, i / n], [1.0 if t.month == 1 else 0.0]))
    return spark.createDataFrame(rows, "entity_id string, ts date, value double, scaled array<double>, passed array<double>")


@pytest.mark.parametrize("estimator", ["mlp", "linear"])
def test_fit_and_fill(spark, estimator):
    rows = feature_rows(spark)
    config = RunConfig(start="2000-01-01", end="2004-12-01", epochs=150, estimator=estimator)
    panel = rows.select("entity_id", "ts", "value").filter("value IS NOT NULL")
    out = fit_and_fill(panel, rows, config)
    data = out["data"].toPandas()
    assert set(data.entity_id) == {"a", "b"} and len(data) == 120 and data.value.notna().all()
    merged = data.merge(panel.toPandas(), on=["entity_id", "ts"], suffixes=("", "_obs"))
    assert (merged.value == merged.value_obs).all() and merged.is_observed.all()
    status = {(r.entity_id, r.fold): r.status for r in out["status"].collect()}
    assert status[("a", -1)] == "ok" and all(s.startswith("failed") for (e, _), s in status.items() if e == "short")
    m = out["metrics"].toPandas().set_index("entity_id")
    assert set(m.columns) == set(METRIC_NAMES) and m.loc["a", "Comp R2"] > (0.8 if estimator == "mlp" else 0.95)
    assert out["spread"].filter("std IS NULL").count() == 0
    if estimator == "mlp":
        assert out["history"].groupBy("entity_id", "fold").count().count() == 10


# --- neighbours -------------------------------------------------------------------------------

def neighbour_world(spark, n=9):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3, 48)).cumsum(1)
    full = {f"e{i}": base[i % 3] + 0.3 * rng.normal(size=48) for i in range(n)}
    full["e8"] = np.full(48, 2.0)
    gappy = {k: np.where(rng.random(48) < 0.3, np.nan, v) for k, v in full.items()}
    pts = spark.createDataFrame([(f"e{i}", float(rng.random()), float(rng.random())) for i in range(n)],
                                "entity_id string, lon double, lat double")
    return gappy, full, pts


@pytest.mark.parametrize("block", [256, 4])
def test_relations_equal_pandas(spark, block):
    gappy, full, pts = neighbour_world(spark)
    rel = relate.relations(monthly(spark, gappy), monthly(spark, full), pts, block=block).toPandas()
    assert len(rel) == 72 and (rel.target != rel.candidate).all()
    g, f, p = pd.DataFrame(gappy), pd.DataFrame(full), pts.toPandas().set_index("entity_id")
    for r in rel.itertuples():
        both = pd.concat([g[r.target].rename("t"), f.drop(columns=r.target)], axis=1).dropna()
        want = both["t"].corr(both[r.candidate]) if "e8" not in (r.target, r.candidate) else np.nan
        d = np.hypot(*(p.drop(r.target) - p.loc[r.target]).to_numpy().T)
        near = 1 - np.hypot(*(p.loc[r.candidate] - p.loc[r.target])) / d.max()
        assert (pd.isna(want) and pd.isna(r.r)) or r.r == pytest.approx(want, abs=1e-10)
        assert r.dist_score == pytest.approx(near, abs=1e-12)


def test_top_relations_keep_what_is_needed(spark):
    gappy, full, pts = neighbour_world(spark)
    a = relate.top_relations(monthly(spark, gappy), monthly(spark, full), pts, num_features=2, block=3)
    all_rel = relate.relations(monthly(spark, gappy), monthly(spark, full), pts)
    b = relate.adaptive_top(relate.rank_candidates(all_rel), 2, 0.6)
    key = lambda df: sorted((r.target, r.rank, r.candidate, r.k) for r in df.collect())
    assert key(a) == key(b)


def test_refinement_runs_and_keeps_observations(spark):
    gappy, full, pts = neighbour_world(spark)
    panel, data = monthly(spark, gappy), monthly(spark, full)
    config = RunConfig(start="2000-01-01", end="2003-12-01", estimator="linear", n_iterations=2)
    out = iterative_refinement(panel, data, pts, config)
    last = out[-1]["data"].toPandas()
    assert len(out) == 2 and len(last) >= 8 * 48
    merged = last.merge(panel.toPandas().dropna(), on=["entity_id", "ts"], suffixes=("", "_obs"))
    assert (merged.value == merged.value_obs).all()


def test_linear_imputation_fills_the_calendar(spark):
    rng = np.random.default_rng(6)
    rows = [("a", dt.datetime(2000 + i // 12, i % 12 + 1, 1 + int(rng.integers(27))), float(i)) for i in range(60) if i % 5]
    df = spark.createDataFrame(rows, "entity_id string, ts timestamp_ntz, value double")
    out = linear_imputation(df, RunConfig(start="1999-01-01", end="2005-12-01", min_months=20)).toPandas()
    assert len(out) == 84 and out.value.notna().all() and out.is_observed.sum() > 50
