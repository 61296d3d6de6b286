"""Evaluation tables against independent numpy implementations."""

import numpy as np
from pyspark.sql import functions as F

from sparkprep.operators import evaluate as V


def _scored(spark, n=3000):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 2)   # ties on purpose
    yhat = (p >= 0.5).astype(int)
    rows = [(int(i), int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(y, yhat, p))]
    return spark.createDataFrame(rows, "id long, y int, y_hat int, p double"), y, yhat, p


def _binary_curve(y, p):
    order = np.argsort(-p, kind="mergesort")
    ys, ps = y[order], p[order]
    idx = np.where(np.diff(ps))[0]
    ends = np.r_[idx, len(ys) - 1]
    tps = np.cumsum(ys)[ends]
    fps = 1 + ends - tps
    return fps, tps


def test_roc_points(spark):
    df, y, _, p = _scored(spark)
    fps, tps = _binary_curve(y, p)
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    fps, tps = np.r_[0, fps[keep]], np.r_[0, tps[keep]]
    want = sorted(zip(fps / fps[-1], tps / tps[-1]))
    got = sorted((r.fpr, r.tpr) for r in V.roc_curve(df, "m").collect())
    assert np.allclose(np.array(got), np.array(want))


def test_pr_points(spark):
    df, y, _, p = _scored(spark)
    fps, tps = _binary_curve(y, p)
    prec, rec = tps / (tps + fps), tps / tps[-1]
    last = tps.searchsorted(tps[-1])
    want = sorted(list(zip(prec[: last + 1], rec[: last + 1])) + [(1.0, 0.0)])
    got = V.pr_curve(df, "m").collect()
    assert np.allclose(np.array(sorted((r.precision, r.recall) for r in got)), np.array(want))
    assert abs(got[0].proportion_1 - y.mean()) < 1e-12


def test_auc_score_pairwise(spark):
    df, y, _, p = _scored(spark, 800)
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(V.auc_score(df).first().auc_score - want) < 1e-12


def test_scores_and_report(spark):
    df, y, yhat, p = _scored(spark)
    s = V.classification_scores(df, "m").first()
    tp = ((y == 1) & (yhat == 1)).sum()
    assert abs(s.accuracy - (y == yhat).mean()) < 1e-12
    assert abs(s.precision_binary - tp / (yhat == 1).sum()) < 1e-12
    assert abs(s.recall_binary - tp / (y == 1).sum()) < 1e-12
    tpr, tnr = tp / (y == 1).sum(), ((y == 0) & (yhat == 0)).sum() / (y == 0).sum()
    assert abs(s.auc - (tpr + tnr) / 2) < 1e-12
    pt = np.clip(np.where(y == 1, p, 1 - p), 1e-15, 1 - 1e-15)
    assert abs(s.log_loss - (-np.log(pt)).mean()) < 1e-9
    rep = {r["class"]: r for r in V.classification_report(df).collect()}
    assert set(rep) == {"0", "1", "macro avg", "weighted avg"}
    assert rep["weighted avg"].support == len(y)


def test_confusion_matrix_union_of_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 0)], "y int, y_hat int")
    cm = {r.label: tuple(r[1:]) for r in V.confusion_matrix(df).collect()}
    assert cm == {"True: 0": (1, 0, 1), "True: 1": (1, 1, 0), "True: 2": (0, 0, 0)}


def test_regression_scores(spark):
    rows = [(float(a), float(b)) for a, b in [(1, 1.5), (2, 1.5), (3, 3.5), (4, 3.0)]]
    df = spark.createDataFrame(rows, "y double, y_hat double")
    r = V.regression_scores(df, "m").first()
    y, yh = np.array([1, 2, 3, 4.0]), np.array([1.5, 1.5, 3.5, 3.0])
    assert abs(r.mse - ((y - yh) ** 2).mean()) < 1e-12
    assert abs(r.r2 - (1 - ((y - yh) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-12
    assert abs(r.explained_variance - (1 - np.var(y - yh) / np.var(y))) < 1e-12
    assert abs(r.mae - np.abs(y - yh).mean()) < 1e-12


def test_single_class_curve_guard(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, p double")
    pts = V.pr_curve(df, "m").collect()
    assert (1.0, 0.0) in [(r.precision, r.recall) for r in pts]
    _ = F


def test_degenerate_inputs_do_not_raise(spark):
    one_class = spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.7)], "y int, y_hat int, p double")
    roc = V.roc_curve(one_class, "m").collect()
    assert all(r.fpr is None for r in roc)
    assert V.auc_score(one_class).first().auc_score is None
    const = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, y_hat double")
    r = V.regression_scores(const, "m").first()
    assert r.r2 is None and r.mse == 1.0
