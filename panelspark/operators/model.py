"""One small regressor per (entity, fold), fitted in parallel by `applyInPandas`.

A group holds the rows of one entity on the calendar, so its size is bounded by the calendar.
"""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelspark.operators.skew import spread

# The network and its training.
HIDDEN = (64, 128)
L2 = 0.1
DROPOUT = 0.2
LEARNING_RATE = 1e-3
PATIENCE = 5
PLATEAU_PATIENCE, PLATEAU_FACTOR, PLATEAU_DELTA = 10, 0.1, 1e-4

OUT_SCHEMA = ("entity_id string, fold int, kind string, ts date, split string, value double, "
              "yhat double, epoch int, loss double, val_loss double, weights array<double>, status string")


class Mlp:
    """Two hidden ReLU layers with dropout, squared error, Adam."""

    def __init__(self, n_in: int, rng, weights=None):
        self.rng = rng
        sizes = (n_in, *HIDDEN, 1)
        self.shapes = [s for a, b in zip(sizes, sizes[1:]) for s in ((a, b), (b,))]
        if weights is None:
            self.p = [self._glorot(s) if len(s) == 2 else np.zeros(s) for s in self.shapes]
        else:
            ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
            self.p = [w.reshape(s).copy() for w, s in zip(np.split(np.asarray(weights, float), ends[:-1]), self.shapes)]
        self.m = [np.zeros(s) for s in self.shapes]
        self.v = [np.zeros(s) for s in self.shapes]
        self.t = 0

    def _glorot(self, shape):
        limit = np.sqrt(6.0 / sum(shape))
        return self.rng.uniform(-limit, limit, shape)

    def flat(self):
        return np.concatenate([p.ravel() for p in self.p])

    def predict(self, x):
        w1, b1, w2, b2, w3, b3 = self.p
        h = np.maximum(np.maximum(x @ w1 + b1, 0) @ w2 + b2, 0)
        return (h @ w3 + b3).ravel()

    def loss(self, x, y):
        return float(np.mean((self.predict(x) - y) ** 2) + L2 * np.sum(self.p[0] ** 2))

    def step(self, x, y, lr):
        w1, b1, w2, b2, w3, b3 = self.p
        keep = 1.0 - DROPOUT
        a1 = x @ w1 + b1
        k1 = (self.rng.random(a1.shape) < keep) / keep
        h1 = np.maximum(a1, 0) * k1
        a2 = h1 @ w2 + b2
        k2 = (self.rng.random(a2.shape) < keep) / keep
        h2 = np.maximum(a2, 0) * k2
        g = (2.0 / len(y)) * ((h2 @ w3 + b3) - y[:, None])
        g2 = (g @ w3.T) * k2 * (a2 > 0)
        g1 = (g2 @ w2.T) * k1 * (a1 > 0)
        grads = [x.T @ g1 + 2 * L2 * w1, g1.sum(0), h1.T @ g2, g2.sum(0), h2.T @ g, g.sum(0)]
        self.t += 1
        rate = lr * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for p, m, v, d in zip(self.p, self.m, self.v, grads):
            m *= 0.9
            m += 0.1 * d
            v *= 0.999
            v += 0.001 * d * d
            p -= rate * m / (np.sqrt(v) + 1e-7)

    def fit(self, x, y, epochs, batch, x_val=None, y_val=None):
        """Train; with validation rows stop early and restore the best weights."""
        lr, history = LEARNING_RATE, []
        best, best_w, wait = np.inf, None, 0
        plateau, plateau_wait = np.inf, 0
        for epoch in range(1, epochs + 1):
            order = self.rng.permutation(len(y))
            for i in range(0, len(y), batch):
                part = order[i:i + batch]
                self.step(x[part], y[part], lr)
            val = self.loss(x_val, y_val) if x_val is not None else None
            history.append((epoch, self.loss(x, y), val))
            if val is None:
                continue
            if val < plateau - PLATEAU_DELTA:
                plateau, plateau_wait = val, 0
            else:
                plateau_wait += 1
                if plateau_wait >= PLATEAU_PATIENCE:
                    lr, plateau_wait = lr * PLATEAU_FACTOR, 0
            if val < best:
                best, best_w, wait = val, [p.copy() for p in self.p], 0
            else:
                wait += 1
                if wait >= PATIENCE:
                    break
        if best_w is not None:
            self.p = best_w
        return history


def _scaler(a):
    mean, std = a.mean(0), a.std(0)
    return mean, np.where(std == 0, 1.0, std)


def _seed(seed, entity, fold):
    return np.random.default_rng(zlib.crc32(f"{seed}|{entity}|{fold}".encode()))


def _inputs(pdf, fit_rows):
    """(x, y, y scaled, mean of y, deviation of y), standardised with `fit_rows`."""
    x, passed = (np.array(pdf[c].tolist(), dtype=float) for c in ("scaled", "passed"))
    y = pdf["value"].to_numpy(float)
    fit = fit_rows(y)
    mean, std = _scaler(x[fit])
    my, sy = _scaler(y[fit])
    return np.hstack([(x - mean) / std, passed]), y, (y - my) / sy, my, sy


def fit_folds(folded: DataFrame, epochs: int = 700, batch: int = 32, seed: int = 42,
              estimator: str = "mlp", last_fold: int = 5) -> DataFrame:
    """Fit every (entity, fold) on its 'train' rows and predict all its rows.

    Input rows: entity_id, ts, value (label or NULL), scaled ARRAY<DOUBLE> (features that are
    standardised with the training rows), passed ARRAY<DOUBLE> (features taken as they are),
    fold, split (NULL for rows without label). Output `kind` is 'prediction', 'epoch' (training history), 'weights'
    (network of the last fold) or 'status'; a failing group yields only its status row.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        entity, fold = pdf["entity_id"].iloc[0], int(pdf["fold"].iloc[0])
        try:
            return _fit_fold(pdf.sort_values("ts"), entity, fold, epochs, batch, seed,
                             estimator, fold == last_fold)
        except Exception as e:  # one bad series must not stop the others
            return _frame([dict(kind="status", status=f"failed: {type(e).__name__}: {e}")], entity, fold)

    return folded.groupBy("entity_id", "fold").applyInPandas(run, OUT_SCHEMA)


def _frame(rows, entity, fold):
    names = ("kind", "ts", "split", "value", "yhat", "epoch", "loss", "val_loss", "weights", "status")
    out = {n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names}
    keys = {"entity_id": pd.Series([entity] * len(rows), dtype=object),
            "fold": pd.Series([fold] * len(rows), dtype=object)}
    return pd.DataFrame({**keys, **out})


def _fit_fold(pdf, entity, fold, epochs, batch, seed, estimator, keep_weights):
    train = (pdf["split"] == "train").to_numpy()
    val = (pdf["split"] == "validation").to_numpy()
    if train.sum() < 2 or not val.any():
        raise ValueError("too few labelled rows")
    x, y, ys, my, sy = _inputs(pdf, lambda _: train)
    history, weights = [], None
    if estimator == "mlp":
        net = Mlp(x.shape[1], _seed(seed, entity, fold))
        history = net.fit(x[train], ys[train], epochs, batch, x[val], ys[val])
        yhat = net.predict(x)
        weights = net.flat() if keep_weights else None
    else:
        yhat = _least_squares(x[train], ys[train], x)
    yhat = yhat * sy + my
    rows = [dict(kind="prediction", ts=t, split=s, value=None if np.isnan(v) else v, yhat=p)
            for t, s, v, p in zip(pdf["ts"], pdf["split"], y, yhat)]
    rows += [dict(kind="epoch", epoch=e, loss=a, val_loss=b) for e, a, b in history]
    if weights is not None:
        rows.append(dict(kind="weights", weights=weights))
    rows.append(dict(kind="status", epoch=len(history), status="ok"))
    return _frame(rows, entity, fold)


def _least_squares(x, y, x_all):
    # of all solutions the shortest: defined also for collinear month indicators
    mean = x.mean(0)
    w = np.linalg.lstsq(x - mean, y - y.mean(), rcond=1e-9)[0]
    return (x_all - mean) @ w + y.mean()


def fit_final(rows: DataFrame, warm: DataFrame, batch: int = 32, seed: int = 42,
              estimator: str = "mlp") -> DataFrame:
    """Final model per entity: the last fold's network trained on over all labelled rows.

    `warm` is (entity_id, epochs, weights): how many epochs to train (mean over the folds) and
    the weights to start from. Same output as `fit_folds` with fold -1.
    """
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _frame([], "", -1)
        entity = left["entity_id"].iloc[0]
        try:
            return _fit_final(left.sort_values("ts"), right.iloc[0], entity, batch, seed, estimator)
        except Exception as e:
            return _frame([dict(kind="status", status=f"failed: {type(e).__name__}: {e}")], entity, -1)

    return (spread(rows, "entity_id").groupBy("entity_id").cogroup(warm.groupBy("entity_id"))
            .applyInPandas(run, OUT_SCHEMA))


def _fit_final(pdf, warm, entity, batch, seed, estimator):
    x, y, ys, my, sy = _inputs(pdf, lambda v: ~np.isnan(v))
    seen = ~np.isnan(y)
    if estimator == "mlp":
        net = Mlp(x.shape[1], _seed(seed, entity, -1), warm["weights"])
        net.fit(x[seen], ys[seen], int(warm["epochs"]), batch)
        yhat = net.predict(x)
    else:
        yhat = _least_squares(x[seen], ys[seen], x)
    yhat = yhat * sy + my
    rows = [dict(kind="prediction", ts=t, split="all" if s else None, value=v if s else None, yhat=p)
            for t, s, v, p in zip(pdf["ts"], seen, y, yhat)]
    rows.append(dict(kind="status", epoch=int(warm["epochs"]), status="ok"))
    return _frame(rows, entity, -1)


def predictions(fitted: DataFrame) -> DataFrame:
    return fitted.filter(F.col("kind") == "prediction").select(
        "entity_id", "ts", "fold", "split", "value", "yhat")


def history(fitted: DataFrame) -> DataFrame:
    """Training and validation loss per epoch."""
    return fitted.filter(F.col("kind") == "epoch").select(
        "entity_id", "fold", "epoch", "loss", "val_loss")


def status(fitted: DataFrame) -> DataFrame:
    return fitted.filter(F.col("kind") == "status").select("entity_id", "fold", "status")


def warm_starts(fitted: DataFrame, folds: int) -> DataFrame:
    """(entity_id, epochs, weights) for the final fit; entities with a failed fold drop out."""
    ok = (F.col("kind") == "status") & (F.col("status") == "ok")
    return (fitted.filter(F.col("kind").isin("status", "weights")).groupBy("entity_id")
            .agg(F.sum(F.when(ok, F.col("epoch"))).alias("_e"), F.count(F.when(ok, 1)).alias("_ok"),
                 F.max("weights").alias("weights"))
            .filter(F.col("_ok") == folds)
            .select("entity_id", F.floor(F.col("_e") / folds).cast("int").alias("epochs"), "weights"))
