"""Least squares from aggregates against NumPy."""

import datetime as dt

import numpy as np
import pytest

from panelspark.operators import folds, least_squares


def world(spark, collinear):
    """Entities with four and six features (twelve month indicators beside them), large offsets, one constant feature, one with too few labels."""
    rng = np.random.default_rng(4)
    rows = []
    for name, p, n in (("a", 4, 90), ("b", 6, 80), ("short", 4, 3), ("none", 4, 0)):
        x = rng.normal(size=(96, p)) * [1.0, 0.01, 30.0, 1.0, 2.0, 0.5][:p] + [5000.0, -3.0, 0.0, 280.0, 1.0, 9.0][:p]
        x[:, 3] = 280.0
        if collinear:
            x[:, 2] = x[:, 0] - 2 * x[:, 1]
        y = x @ rng.normal(size=p) + np.arange(96) % 12 + 0.1 * rng.normal(size=96) + 1e4
        seen = set(rng.choice(96, n, replace=False).tolist())
        for i in range(96):
            month = [float(i % 12 == m) for m in range(12)]
            rows.append((name, dt.date(2000 + i // 12, i % 12 + 1, 1), float(y[i]) if i in seen else None, x[i].tolist(), month))
    return spark.createDataFrame(rows, "entity_id string, ts date, value double, scaled array<double>, passed array<double>").repartition(3)


@pytest.mark.parametrize("collinear", [False, True])
def test_equals_least_squares_of_numpy(spark, collinear):
    rows = world(spark, collinear)
    found, status = least_squares.fit_and_predict(rows)
    got = found.toPandas()
    split = folds.training_rows(rows, 5, 0.3, 42).toPandas()
    assert set(got[got.entity_id == "short"].fold) == {4, 5}  # the folds with two rows to train on
    mine = got[(got.fold > 0) & got.entity_id.isin(["a", "b"])].merge(split, on=["entity_id", "ts", "fold"], suffixes=("", "_w"))
    assert len(mine) == 2 * 96 * 5 and (mine.split.fillna("") == mine.split_w.fillna("")).all()
    finals = got[got.fold == -1].merge(split[split.fold == 1][["entity_id", "ts", "scaled", "passed"]], on=["entity_id", "ts"])
    for (entity, fold), part in [*mine.groupby(["entity_id", "fold"]), *finals.groupby(["entity_id", "fold"])]:
        x = np.array([[*a, *b] for a, b in zip(part["scaled"], part["passed"])])
        fit = (part["split"] == ("train" if fold > 0 else "all")).to_numpy()
        mean, sd = x[fit].mean(0), np.where(x[fit].std(0) < 1e-9, 1.0, x[fit].std(0))
        z = (x - mean) / sd
        y = part["value"].to_numpy(float)
        w = np.linalg.lstsq(z[fit], y[fit] - y[fit].mean(), rcond=1e-9)[0]
        inside = fit if collinear else slice(None)  # outside of the fitted rows' span the solutions may differ
        assert np.allclose(part["yhat"].to_numpy(float)[inside], (z @ w + y[fit].mean())[inside], atol=1e-6)
    said = {(r.entity_id, r.fold): r.status for r in status.collect()}
    assert said[("a", -1)] == said[("b", 5)] == "ok" and said[("none", 2)].startswith("failed") and ("none", -1) not in said and ("short", -1) not in said


def test_nothing_gives_nothing(spark):
    found, status = least_squares.fit_and_predict(world(spark, False).limit(0))
    assert found.count() == 0 and status.count() == 0
