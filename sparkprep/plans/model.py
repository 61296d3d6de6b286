"""Estimator registry, training, prediction, persistence, search,
learning curves and model comparison on Spark ML.

Every fit is a distributed Spark ML job.  The driver only orchestrates: it
loops over *parameter settings* (search, budgeted choice, learning-curve
sizes), never over data rows.
"""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.operators import evaluate as V
from sparkprep.operators.explain import kernel_shapley_values, shapley_values
from sparkprep.operators.features import (OneHotModel, ScalerModel, check_features, class_weights,
                                          fit_one_hot, fit_scaler)
from sparkprep.operators.neighbors import NeighborIndex, build_index, knn_shares
from sparkprep.operators.order import union_all
from sparkprep.operators.rows import feature_names
from sparkprep.operators.sampling import class_counts, kfold, split_random, split_stratified, with_cuts
from sparkprep.session import cut_lineage

MAX_TREE_DEPTH = 30  # Spark ML limit (fixed value)
MAP_BYTES = 64 << 20  # Fourier features of a task's rows (fixed value)

TREE_PARAMS = {"max_depth", "min_samples_leaf", "max_bins", "max_features", "criterion", "random_state"}
LINEAR_PARAMS = {"max_iter", "tol", "reg", "C", "class_weight"}
PARAMS = {"DT": TREE_PARAMS | {"class_weight"}, "RFC": TREE_PARAMS | {"class_weight", "n_estimators"},
          "RFR": TREE_PARAMS | {"n_estimators"}, "LR": LINEAR_PARAMS, "SVM": LINEAR_PARAMS | {"kernel", "gamma", "n_components", "random_state"}}
OTHER_PARAMS = {"KNN": {"n_neighbors"}, "Auto-Classification": {"time_budget", "metric", "class_weight"},
                "Auto-Regression": {"time_budget", "metric"}}

CLASSIFIERS = ("DT", "RFC", "LR", "SVM", "KNN", "Auto-Classification")
REGRESSORS = ("RFR", "Auto-Regression")


def estimator(model_type: str, params: Mapping | None = None, label: str = "label",
              features: str = "features", weight: str | None = None, n_rows: int | None = None):
    """M1 - M5 registry with the reference's parameter names mapped to Spark ML.

    ``max_depth`` (an error above 30), ``min_samples_leaf`` -> minInstancesPerNode,
    ``max_features`` -> featureSubsetStrategy, ``n_estimators`` -> numTrees,
    ``criterion`` -> impurity, ``random_state`` -> seed,
    ``class_weight='balanced'`` -> a weight column (see :func:`train`).  A name
    that a model has no counterpart for, or a value Spark can't follow, is an error.
    A decision tree that asks for feature sampling becomes a one-tree forest
    without bootstrap (Spark's tree has no per-split feature sampling).
    """
    p = {k: v for k, v in dict(params or {}).items() if v is not None}
    if model_type not in PARAMS:
        raise ValueError(f"Unsupported model type specified: {model_type!r}")
    unknown = sorted(set(p) - PARAMS[model_type])
    if unknown:
        raise ValueError(f"{model_type} has no counterpart for {unknown}")
    if p.get("class_weight", "balanced") != "balanced":
        raise ValueError("class_weight can only be 'balanced'")
    common = {"labelCol": label, "featuresCol": features}
    tree = {}
    if "criterion" in p:
        tree["impurity"] = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy", "squared_error": "variance"}[p["criterion"]]
    if "max_depth" in p:
        if int(p["max_depth"]) > MAX_TREE_DEPTH:
            raise ValueError(f"max_depth {p['max_depth']} is beyond Spark ML's limit of {MAX_TREE_DEPTH}")
        tree["maxDepth"] = int(p["max_depth"])
    if "min_samples_leaf" in p:
        tree["minInstancesPerNode"] = int(p["min_samples_leaf"])
    if "max_bins" in p:
        tree["maxBins"] = int(p["max_bins"])
    seed = p.get("random_state")
    if seed is not None:
        tree["seed"] = int(seed)
    wcol = {"weightCol": weight} if weight else {}
    if model_type == "DT":
        mf = p.get("max_features")
        if mf and mf != "all":
            return RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy=str(mf),
                                          **common, **tree, **wcol)
        tree.pop("seed", None)
        return DecisionTreeClassifier(**common, **tree, **wcol)
    if model_type == "RFC":
        return RandomForestClassifier(numTrees=int(p.get("n_estimators", 20)),
                                      featureSubsetStrategy=str(p.get("max_features", "auto")),
                                      **common, **tree, **wcol)
    if model_type == "RFR":
        return RandomForestRegressor(numTrees=int(p.get("n_estimators", 20)),
                                     featureSubsetStrategy=str(p.get("max_features", "auto")),
                                     **common, **tree, **wcol)
    # linear models: L2 penalty C (default 1) as Spark's averaged-loss
    # regParam = 1 / (C * n), and the reference library's default tolerance
    reg = float(p["reg"]) if "reg" in p else (1.0 / (float(p.get("C", 1.0)) * n_rows) if n_rows else 0.0)
    if model_type == "LR":
        return LogisticRegression(maxIter=int(p.get("max_iter", 100)), regParam=reg,
                                  tol=float(p.get("tol", 1e-4)), **common, **wcol)
    if model_type == "SVM":
        if p.get("kernel", "linear") != "linear":
            raise ValueError("the kernel needs a feature map, which train() makes")
        return LinearSVC(maxIter=int(p.get("max_iter", 100)), regParam=reg,
                         tol=float(p.get("tol", 1e-4)), **common, **wcol)
    raise ValueError(f"Unsupported model type specified: {model_type!r}")


def fourier_map(df: DataFrame, feats: Sequence[str], n_components: int = 256, gamma: float | str = "scale", seed: int = 0) -> list:
    """Pipeline stages from the features to random Fourier features, whose
    inner products approximate exp(-gamma * squared distance).

    cos(w x + b) for seeded normal w and uniform b, as SQL expressions, so the
    map is saved with the pipeline and runs without Python.  ``gamma``
    'scale': 1 over the features' number times their overall variance."""
    if gamma == "scale":
        x = [F.col(f).cast("double") for f in feats]
        both = df.agg(*[F.avg(c) for c in x], *[F.avg(c * c) for c in x]).first()
        n = len(feats)
        spread = sum(both[n:]) / n - (sum(both[:n]) / n) ** 2
        gamma = 1 / (n * spread) if spread > 0 else 1.0
    rng = random.Random(seed)
    terms = []
    for k in range(n_components):
        w = " + ".join(f"cast(`{f}` as double) * ({rng.gauss(0, math.sqrt(2 * float(gamma)))!r}D)" for f in feats)
        terms.append(f"cos({w} + ({rng.uniform(0, 2 * math.pi)!r}D)) * ({math.sqrt(2 / n_components)!r}D) as _rff{k}")
    cosines = SQLTransformer(statement=f"select *, {', '.join(terms)} from __THIS__")
    return [cosines, VectorAssembler(inputCols=[f"_rff{k}" for k in range(n_components)], outputCol="features", handleInvalid="keep")]


@dataclass
class Bundle:
    """Trained model + everything scoring needs (M13 persists it)."""
    model_type: str
    target: str
    features: list
    pipeline: PipelineModel | None
    classes: list = field(default_factory=list)
    onehot: OneHotModel | None = None
    scaler: ScalerModel | None = None
    raw_features: list = field(default_factory=list)
    # KNN keeps an index of its (prepared) training rows instead of a fitted stage
    neighbors: NeighborIndex | None = None
    k: int = 5
    # every setting the automatic choice tried
    trials: list = field(default_factory=list)

    @property
    def is_classifier(self) -> bool:
        return self.model_type in CLASSIFIERS


def _prepare(df: DataFrame, b: Bundle, with_label: bool) -> DataFrame:
    out = df
    if b.onehot:
        out = b.onehot.transform(out)
    if b.scaler:
        out = b.scaler.transform(out)
    if with_label and b.is_classifier:
        out = out.withColumn("label", _encode(F.col(b.target), b.classes))
    elif with_label:
        out = out.withColumn("label", F.col(b.target).cast("double"))
    return out


def _encode(col, classes):
    expr = None
    for i, c in enumerate(classes):
        cond = col.cast("string") == F.lit(str(c))
        expr = F.when(cond, F.lit(float(i))) if expr is None else expr.when(cond, F.lit(float(i)))
    return expr.otherwise(F.raise_error(F.concat(F.lit("unseen label: "), col.cast("string"))))


def train(df: DataFrame, target: str, model_type: str, params: Mapping | None = None,
          key: Sequence[str] = (), onehot_cols: Sequence[str] = (), scaler: str | None = "minmax",
          test_size: float = 0.2, seed: int = 2, split: bool = True,
          balanced: bool | None = None) -> tuple[Bundle, DataFrame, DataFrame]:
    """M9: feature/target split -> label encoding -> one-hot -> split ->
    scaling (fit on train) -> fit.  Returns (bundle, train, test).

    One-hot categories come from the whole table, as the encoding precedes
    the split, so a category that falls only in the test part can be scored.
    A NULL target is an error, as is a parameter without a counterpart."""
    if model_type not in CLASSIFIERS + REGRESSORS:
        raise ValueError(f"Unsupported model type specified: {model_type!r}")
    params = dict(params or {})
    unknown = sorted(set(params) - (PARAMS | OTHER_PARAMS)[model_type])
    if unknown:
        raise ValueError(f"{model_type} has no counterpart for {unknown}")
    is_clf = model_type in CLASSIFIERS
    raw = feature_names(df, target)
    if key:
        raw = [c for c in raw if c not in key]
    if df.where(F.col(target).isNull()).limit(1).count():
        raise ValueError(f"NULL in target {target}: drop or fill these rows before training")
    classes = sorted(str(c) for c in class_counts(df.select(F.col(target).cast("string")), target)) if is_clf else []
    oh = fit_one_hot(df, onehot_cols) if onehot_cols else None
    if split:
        parts = (split_stratified(df, target, test_size, seed, key) if is_clf
                 else split_random(df, test_size, seed, key))
        train_df = parts.where(F.col("split") == "train").drop("split")
        test_df = parts.where(F.col("split") == "test").drop("split")
    else:
        train_df, test_df = df, None
    tmp = oh.transform(train_df) if oh else train_df
    feats = [c for c in feature_names(tmp, target) if c not in key]
    sc = fit_scaler(tmp, feats, scaler) if scaler else None
    b = Bundle(model_type, target, feats, None, classes, oh, sc, raw)
    prepared = _prepare(train_df, b, with_label=True)
    weight = None
    if is_clf and (balanced or (balanced is None and params.get("class_weight") == "balanced")):
        prepared = class_weights(prepared, "label", "weight")
        weight = "weight"
    if model_type == "KNN":
        # lazy learner: the "model" is an index of the prepared training table,
        # built once (and written by save_bundle); prediction only reads it
        b.k = int(params.get("n_neighbors", 5))
        # distance ties go to the smallest key, or (without one) to the smallest label
        ident = F.struct(*[F.col(c) for c in key]) if key else F.struct("label", *feats)
        b.neighbors = build_index(prepared.select(*feats, F.col("label"), ident.alias("_nid")), feats, b.k, "_nid", "label", seed)
        return b, train_df, test_df
    # Spark ML makes many passes over its input (one per tree level or
    # optimizer iteration): keep the assembled training table cached for the
    # fit only (recomputed from lineage if an executor is lost).
    front = [VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")]
    if model_type == "SVM":
        kernel, shape = params.pop("kernel", "linear"), {"gamma": params.pop("gamma", "scale"), "n_components": params.pop("n_components", 256),
                                                         "seed": params.pop("random_state", seed)}
        if kernel not in ("linear", "rbf"):
            raise ValueError(f"SVM has no kernel {kernel!r}")
        if kernel == "rbf":
            # the fit keeps the mapped rows as blocks of its own, so only the plain rows are cached here,
            # dealt so that a task maps MAP_BYTES at a time
            prepared = prepared.select(*feats, "label", *(["weight"] if weight else []))
            tasks = -(-prepared.count() * 8 * int(shape["n_components"]) // MAP_BYTES)
            prepared = prepared.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))
            front = fourier_map(prepared, feats, **shape)
    mapped = len(front) > 1
    cols = ["features", "label"] + (["weight"] if weight else [])
    keys = [f"_key{i}" for i in range(len(key))] if model_type.startswith("Auto") else []
    cols += [F.col(c).alias(name) for c, name in zip(key, keys)]
    fit_input = PipelineModel(stages=front).transform(prepared).select(*cols)
    cached = (prepared if mapped else fit_input).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if model_type.startswith("Auto"):
            est, b.trials = auto_search(fit_input, feats, is_clf, params.get("time_budget", 30), seed, assembled=True,
                                        metric=params.get("metric"), weight=weight, key=keys)
        else:
            est = estimator(model_type, params, weight=weight, n_rows=fit_input.count())
        b.pipeline = PipelineModel(stages=[*front, est.fit(fit_input)])
    finally:
        cached.unpersist()
    return b, train_df, test_df


def predict(b: Bundle, df: DataFrame) -> DataFrame:
    """Adds ``predicted_label`` and, when the model has them,
    ``proba`` (array of class probabilities) and ``p`` (positive class)."""
    if b.model_type == "KNN":
        q = _prepare(df, b, with_label=False).withColumn("_qid", F.struct(*[F.col(f).cast("double").alias(f) for f in b.features]))
        # the vote depends on the features alone: rows of one vector share it
        vectors = cut_lineage(q.select("_qid").distinct())
        votes = knn_shares(b.neighbors, vectors.select("_qid", "_qid.*"), b.features, len(b.classes), "_qid")
        scored = q.join(votes, "_qid").drop("_qid")
        # the most votes; a tie goes to the smallest class
        scored = scored.withColumn("prediction", (F.array_position("proba", F.array_max("proba")) - 1).cast("double"))
        labels = F.array(*[F.lit(str(c)) for c in b.classes])
        scored = scored.withColumn("predicted_label", F.element_at(labels, F.col("prediction").cast("int") + 1))
        return scored.withColumn("p", F.col("proba")[1]) if len(b.classes) == 2 else scored
    scored = b.pipeline.transform(_prepare(df, b, with_label=False))
    scored = scored.drop(*[c for c in scored.columns if c.startswith("_rff")])
    if b.is_classifier:
        labels = F.array(*[F.lit(str(c)) for c in b.classes])
        scored = scored.withColumn("predicted_label", F.element_at(labels, F.col("prediction").cast("int") + 1))
        if "probability" in scored.columns:
            scored = scored.withColumn("proba", vector_to_array("probability"))
            if len(b.classes) == 2:
                scored = scored.withColumn("p", F.col("proba")[1])
    else:
        scored = scored.withColumn("predicted_label", F.col("prediction"))
    return scored


def predict_proba(b: Bundle, df: DataFrame) -> DataFrame:
    """M11."""
    return predict(b, df)


def evaluate(b: Bundle, df: DataFrame, n_samples: int = 20, seed: int = 2, key: Sequence[str] = (),
             name: str | None = None) -> dict:
    """The six-table result dict (regressors get ``None`` where the
    reference has no table)."""
    name = name or b.model_type
    scored = predict(b, df).withColumn("true_label", F.col(b.target).cast("string") if b.is_classifier
                                       else F.col(b.target).cast("double"))
    # every table below reads the predictions: score once, materialize the
    # needed columns in the shared checkpoint folder, derive all tables from it
    keep = [*key, *b.features, "true_label", "predicted_label"] + (["p"] if "p" in scored.columns else [])
    scored = cut_lineage(scored.select(*dict.fromkeys(keep)))
    out = {}
    if b.is_classifier:
        ev = scored.select(F.col("true_label").alias("y"), F.col("predicted_label").alias("y_hat"),
                           *(["p"] if "p" in scored.columns else []))
        binary = len(b.classes) == 2
        pos = str(b.classes[-1]) if binary else None
        evb = ev.withColumns({"y": (F.col("y") == F.lit(pos)).cast("int"),
                              "y_hat": (F.col("y_hat") == F.lit(pos)).cast("int")}) if binary else ev
        has_p = "p" in ev.columns
        out["scores"] = V.classification_scores(evb, name, p="p" if has_p else None)
        out["classification_report"] = V.classification_report(ev)
        out["confusion_matrix"] = V.confusion_matrix(ev)
        out["roc_curve"] = V.roc_curve(evb, name) if binary and has_p else None
        out["pr_curve"] = V.pr_curve(evb, name) if binary and has_p else None
    else:
        ev = scored.select(F.col("true_label").alias("y"), F.col("predicted_label").alias("y_hat"))
        out["scores"] = V.regression_scores(ev, name)
        out["classification_report"] = out["confusion_matrix"] = None
        out["roc_curve"] = out["pr_curve"] = None
    shown = scored
    if b.scaler:
        shown = b.scaler.inverse(shown)
    shown = shown.select(*key, *b.features, "true_label", "predicted_label")
    out["predicted_samples"] = V.prediction_samples(shown, n_samples, seed, key or b.features,
                                                    classifier=b.is_classifier)
    return out


def write_reports(results: Mapping[str, DataFrame | None], folder: str, tag: str) -> list[str]:
    """One CSV folder per present table: ``{folder}/{table}_{tag}``."""
    written = []
    for name, table in results.items():
        if table is None:
            continue
        path = f"{folder.rstrip('/')}/{name}_{tag}"
        table.write.mode("overwrite").option("header", True).csv(path)
        written.append(path)
    return written


# ---------------------------------------------------------------- M13 / M12


def save_bundle(b: Bundle, path: str) -> None:
    """Spark ML directory (or, for KNN, the neighbour index as Parquet) +
    JSON side file (names, classes, encoders, scaler)."""
    if b.model_type == "KNN":
        b.neighbors.save(f"{path}/neighbors")
    else:
        b.pipeline.write().overwrite().save(f"{path}/pipeline")
    meta = {"model_type": b.model_type, "target": b.target, "features": b.features,
            "classes": b.classes, "raw_features": b.raw_features, "k": b.k,
            "onehot": b.onehot.values if b.onehot else None,
            "scaler": ({"kind": b.scaler.kind, "center": b.scaler.center, "scale": b.scaler.scale}
                       if b.scaler else None)}
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")


def load_bundle(spark, path: str) -> Bundle:
    """M13."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    sc = meta["scaler"]
    knn = meta["model_type"] == "KNN"
    return Bundle(meta["model_type"], meta["target"], meta["features"],
                  None if knn else PipelineModel.load(f"{path}/pipeline"),
                  meta["classes"], OneHotModel(meta["onehot"]) if meta["onehot"] else None,
                  ScalerModel(sc["kind"], sc["center"], sc["scale"]) if sc else None, meta["raw_features"],
                  NeighborIndex.load(spark, f"{path}/neighbors") if knn else None, int(meta.get("k", 5)))


def score_batch(spark, df: DataFrame, path: str, key: Sequence[str] = ()) -> DataFrame:
    """M12 + F9: load a stored bundle, check the feature list (key columns
    pass through), score."""
    b = load_bundle(spark, path)
    check_features(df.drop(*key), b.raw_features, target=b.target)
    return predict(b, df)


# ---------------------------------------------------------------- M14 - M18


SPARK_NAMES = {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "max_features": "featureSubsetStrategy",
               "n_estimators": "numTrees", "max_bins": "maxBins", "random_state": "seed", "max_iter": "maxIter",
               "criterion": "impurity"}
CV_THREADS = 4  # fits of a search at a time, at most (fixed value)
FIT_BYTES = 128 << 20  # rows of a task of a search's table, as a fit keeps them (fixed value)
METRICS = {"roc_auc": "areaUnderROC", "average_precision": "areaUnderPR", "f1_weighted": "f1"}


@dataclass(frozen=True)
class Range:
    """A continuous range of a parameter, on a log scale or of whole numbers if asked for."""
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, u: float):
        """The value at a share ``u`` of the way from low to high."""
        low, high = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        v = low + u * (high - low)
        v = math.exp(v) if self.log else v
        return int(min(self.high, max(self.low, round(v)))) if self.whole else float(min(self.high, max(self.low, v)))

    def share(self, value) -> float:
        """The inverse of :meth:`at`."""
        scale = math.log if self.log else float
        width = scale(self.high) - scale(self.low)
        return (scale(value) - scale(self.low)) / width if width else 0.0


def _axes(est, space: Mapping[str, Sequence | Range]) -> list:
    """(parameter, values or range) of a search space (the reference's names
    or Spark's); a name the estimator lacks is an error."""
    axes = []
    for name, values in space.items():
        spark_name = SPARK_NAMES.get(name, name)
        if not est.hasParam(spark_name):
            raise ValueError(f"{type(est).__name__} has no counterpart for {name!r}")
        ranged = isinstance(values, Range)
        if spark_name == "maxDepth" and (values.high if ranged else max(values)) > MAX_TREE_DEPTH:
            raise ValueError(f"max_depth {values.high if ranged else max(values)} is beyond Spark ML's limit of {MAX_TREE_DEPTH}")
        if not ranged:
            values = [str(v) for v in values] if spark_name == "featureSubsetStrategy" else values if isinstance(values, range) else list(values)
        axes.append((est.getParam(spark_name), values))
    return axes


def _grid(est, space: Mapping[str, Sequence]):
    """All settings of a search space."""
    g = ParamGridBuilder()
    for param, values in _axes(est, space):
        g = g.addGrid(param, values)
    return g.build()


def draw_settings(est, space: Mapping[str, Sequence | Range], n: int, seed) -> list:
    """``n`` seeded settings of a space that is never listed.

    The listed values of all parameters make a number in mixed radix: a draw is
    one index, none is drawn twice unless a parameter has a range.  If there are no more than ``n``
    of them (and no range), all are returned in order."""
    axes = _axes(est, space)
    listed = [(p, v) for p, v in axes if not isinstance(v, Range)]
    ranged = [(p, v) for p, v in axes if isinstance(v, Range)]
    total = math.prod(len(v) for _, v in listed)
    rng = random.Random(seed)
    if ranged:
        picks = [rng.randrange(total) for _ in range(n)] if total else []
    elif total <= n:
        picks = range(total)
    else:
        picks = {}
        while len(picks) < n:
            picks[rng.randrange(total)] = None
    out = []
    for index in picks:
        m = {}
        for param, values in listed:
            index, at = divmod(index, len(values))
            m[param] = values[at]
        out.append({**m, **{param: r.at(rng.random()) for param, r in ranged}})
    return out


def _evaluator(metric: str, is_clf: bool = True):
    metric = METRICS.get(metric, metric)
    if metric in ("areaUnderROC", "areaUnderPR"):
        return BinaryClassificationEvaluator(metricName=metric)
    return MulticlassClassificationEvaluator(metricName=metric) if is_clf else RegressionEvaluator(metricName=metric)


def _folded(df: DataFrame, k: int, seed, key: Sequence[str]) -> DataFrame:
    """Fold numbers from a seeded hash of the key (or, without one, of the
    features and the label), so that they don't depend on partitioning."""
    by = list(key) or [F.to_json(F.struct(vector_to_array("features").alias("f"), "label"))]
    return kfold(df, k, seed, by, fold_col="_fold")


def _fit_columns(df: DataFrame, est, maps) -> list[str]:
    """The columns that a fit and its evaluation read; all, if the settings or a composite estimator may name others."""
    if not est.hasParam("featuresCol") or any(p.name.endswith("Col") for m in maps for p in m):
        return df.columns
    named = {est.getOrDefault(p) for p in est.params if p.name.endswith("Col") and est.isDefined(p)}
    return [c for c in df.columns if c in named | {"label", "_fold"}]


def _row_bytes(df: DataFrame) -> int:
    """About what a fit keeps of a row: Spark ML's tree points take some 100 bytes and a number per feature."""
    return 100 + 8 * sum((f.metadata or {}).get("ml_attr", {}).get("num_attrs", 1) for f in df.schema)


def _spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to tasks of ``FIT_BYTES``, if there are more than one task holds: a fit
    caches the rows of a task as one block, and partitions are as large as the input's splits."""
    tasks = -(-df.count() * _row_bytes(df) // FIT_BYTES)
    return df if tasks <= 1 else df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))


def _fits_at_a_time(df: DataFrame, rows: int) -> int:
    """``CV_THREADS`` fits if the caches of all take ``FIT_BYTES`` of a core; one, if one fit has tasks for all cores."""
    room = df.sparkSession.sparkContext.defaultParallelism * FIT_BYTES
    return max(1, min(CV_THREADS, room // max(1, rows * _row_bytes(df))))


def cross_validate(folded: DataFrame, est, maps, k: int, metric: str, is_clf: bool = True) -> list[float]:
    """Mean score of each setting over the folds ``_fold`` of a cached table; folds and
    settings are filters of that one table, up to ``CV_THREADS`` fits at a time."""
    rows = {r["_fold"]: r["n"] for r in folded.groupBy("_fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for fold in range(k):
        if not rows.get(fold) or rows[fold] == sum(rows.values()):
            raise ValueError(f"the {'training' if rows.get(fold) else 'validation'} data at fold {fold} is empty")
    ev = _evaluator(metric, is_clf)

    def score(job):
        fold, params = job
        model = est.fit(folded.where(F.col("_fold") != fold), params)
        return ev.evaluate(model.transform(folded.where(F.col("_fold") == fold), params))

    with ThreadPool(_fits_at_a_time(folded, sum(rows.values()))) as pool:
        scores = pool.map(inheritable_thread_target(folded.sparkSession)(score), [(fold, m) for fold in range(k) for m in maps], 1)
    return [sum(scores[i::len(maps)]) / k for i in range(len(maps))]


def _search(df: DataFrame, est, maps, k: int, metric: str, seed, key: Sequence[str]) -> tuple[DataFrame, object]:
    """(score table, model of the best setting, fitted on all rows).

    The narrow table is kept on the executors' disks: a fit caches its rows in
    memory, and a block that is kept as bytes in memory is unrolled there as a whole."""
    folded = _folded(df, k, seed, key)
    folded = _spread(folded.select(*_fit_columns(folded, est, maps))).persist(StorageLevel.DISK_ONLY)
    try:
        scores = cross_validate(folded, est, maps, k, metric)
        pick = max if _evaluator(metric).isLargerBetter() else min
        best = est.fit(folded, maps[scores.index(pick(scores))])
    finally:
        folded.unpersist()
    return _score_table(df, maps, scores), best


def grid_search(df: DataFrame, est, space: Mapping[str, Sequence], k: int = 3, metric: str = "f1",
                seed: int = 2, key: Sequence[str] = ()) -> tuple[DataFrame, object]:
    """Every grid point x k folds (weighted F1 by default).  Returns the
    score table (one row per setting) and the best model."""
    maps = _grid(est, space)
    return _search(df, est, maps, k, metric, seed, key)


def random_search(df: DataFrame, est, space: Mapping[str, Sequence | Range], n_iter: int = 100, k: int = 3,
                  metric: str = "f1", seed: int = 2, key: Sequence[str] = ()) -> tuple[DataFrame, object]:
    """``n_iter`` settings drawn (seeded, without repetition) from lists
    and ranges of values (:func:`draw_settings`)."""
    chosen = draw_settings(est, space, n_iter, seed)
    return _search(df, est, chosen, k, metric, seed, key)


def _score_table(df: DataFrame, maps, scores) -> DataFrame:
    rows = [(i, json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(s))
            for i, (m, s) in enumerate(zip(maps, scores))]
    return df.sparkSession.createDataFrame(rows, "setting int, params string, mean_score double")


def learning_curve(df: DataFrame, est, sizes: Sequence[int], k: int = 5, seed: int = 2,
                   key: Sequence[str] = (), metric: str = "f1") -> DataFrame:
    """For each training size and fold, fit on the first ``size`` rows (in
    seeded hash order) of the other folds; score train and validation.  Returns
    (size, train_mean, train_std, valid_mean, valid_std).

    A training set is a filter (a hash threshold per fold and size), so it
    stays spread over the table's partitions."""
    ev = _evaluator(metric)
    names = [f"_size{i}" for i in range(len(sizes))]
    rows = []
    folded = kfold(df, k, f"{seed}f", list(key), fold_col="_fold").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for fold in range(k):
            tr_all = with_cuts(folded.where(F.col("_fold") != fold), {None: list(map(int, sizes))}, seed, key, names=names)
            va = folded.where(F.col("_fold") == fold)
            for s, name in zip(sizes, names):
                tr = tr_all.where(name)
                m = est.fit(tr)
                rows.append((int(s), fold, float(ev.evaluate(m.transform(tr))), float(ev.evaluate(m.transform(va)))))
    finally:
        folded.unpersist()
    res = df.sparkSession.createDataFrame(rows, "size int, fold int, train double, valid double")
    return res.groupBy("size").agg(F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
                                   F.avg("valid").alias("valid_mean"), F.stddev_pop("valid").alias("valid_std"))


_DEPTH, _LEAF = Range(2, 20, whole=True), Range(1, 64, log=True, whole=True)
_LINEAR = {"regParam": Range(1e-6, 1.0, log=True), "elasticNetParam": Range(0.0, 1.0)}
_TREE = {"maxDepth": _DEPTH, "minInstancesPerNode": _LEAF}
_FOREST = {"numTrees": Range(4, 64, log=True, whole=True), "maxDepth": Range(3, 15, whole=True), "minInstancesPerNode": _LEAF}
AUTO_SPACES = {
    # candidate families of the budgeted search: a cheap first setting, the ranges (fixed values)
    "clf": [("LR", {"regParam": 0.0}, _LINEAR), ("DT", {"maxDepth": 3}, _TREE), ("RFC", {"numTrees": 5, "maxDepth": 5}, _FOREST)],
    "reg": [("DTR", {"maxDepth": 3}, _TREE), ("LinReg", {"regParam": 0.0}, _LINEAR), ("RFR", {"numTrees": 5, "maxDepth": 5}, _FOREST)],
}
AUTO_BINS = 128    # candidate thresholds per feature of the tree families (fixed value)
AUTO_ROWS = 10_000  # rows of the first sample (fixed value)
AUTO_CLASS = 500    # rows of a class that every sample has, if there are as many (fixed value)
AUTO_GROWTH = 4     # times the rows from one rung to the next; one of three settings goes on (fixed value)
AUTO_DRAWS = 2      # drawn settings per family beside the first (fixed value)


@dataclass(frozen=True)
class Trial:
    """One setting scored on one sample."""
    rung: int
    family: str
    params: str
    rows: int
    seconds: float
    score: float


def _family(name):
    return {"LR": LogisticRegression(), "DT": DecisionTreeClassifier(maxBins=AUTO_BINS),
            "RFC": RandomForestClassifier(maxBins=AUTO_BINS), "LinReg": LinearRegression(),
            "DTR": DecisionTreeRegressor(maxBins=AUTO_BINS), "RFR": RandomForestRegressor(maxBins=AUTO_BINS)}[name]


def _near(space: Mapping[str, Range], params: Mapping, rng: random.Random, step: float = 0.15) -> dict:
    """A setting a step away from ``params`` in a random direction."""
    out = dict(params)
    for name, r in space.items():
        u = r.share(max(r.low, min(r.high, params[name]))) if name in params else 0.0
        out[name] = r.at(min(1.0, max(0.0, u + rng.uniform(-step, step))))
    return out


def auto_search(df: DataFrame, feats: Sequence[str], is_clf: bool, budget_s: float = 30, seed: int = 2,
                k: int = 3, assembled: bool = False, metric: str | None = None, weight: str | None = None,
                key: Sequence[str] = ()) -> tuple[object, list[Trial]]:
    """M7 / M8: a cost-frugal search over families of Spark ML models and real
    parameter ranges until the time budget is spent; returns the best
    (unfitted) estimator and the trials.

    Successive halving: the first rung scores, by k-fold CV on a small sample,
    each family's cheap first setting and some drawn ones.  The best third
    goes on to the next rung, with ``AUTO_GROWTH`` times the rows, and so does
    a setting a step away from the leader; the last rung is the whole table.  Samples are nested
    and chosen row by row, by a hash of the key and the row (without a key, of its place and the
    row), so that copies of a row are drawn one by one; rare classes keep ``AUTO_CLASS`` rows.  No fit begins after
    the budget (but the first).  The result is the best setting of the
    largest sample that was reached; a tie goes to the one tried first.

    ``metric``: ``roc_auc`` by default for two classes, weighted F1 for more,
    RMSE for a number.  All settings of a rung see the same folds."""
    if not assembled:
        df = VectorAssembler(inputCols=list(feats), outputCol="features", handleInvalid="keep").transform(df)
    deadline = time.monotonic() + budget_s
    classes = class_counts(df, "label") if is_clf else {}
    if metric is None:
        metric = "rmse" if not is_clf else "roc_auc" if len(classes) == 2 else "f1"
    sign = 1 if _evaluator(metric, is_clf).isLargerBetter() else -1
    if not key:
        df, key = df.withColumn("_row", F.monotonically_increasing_id()), ["_row"]
    row = F.xxhash64(*key, vector_to_array("features"), "label", F.lit(seed))
    folded = df.select("features", "label", *([weight] if weight else []), F.pmod(row, F.lit(1 << 40)).alias("_u"))
    folded = kfold(folded, k, seed, ["_u"], fold_col="_fold").withColumn("_u", F.col("_u") / float(1 << 40))
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    rng, trials, best = random.Random(seed), [], None
    spaces = {fam: space for fam, _, space in AUTO_SPACES["clf" if is_clf else "reg"]}
    try:
        total = folded.count()
        todo = [(fam, first) for fam, first, _ in AUTO_SPACES["clf" if is_clf else "reg"]]
        todo += [(fam, {name: r.at(rng.random()) for name, r in space.items()}) for _ in range(AUTO_DRAWS) for fam, space in spaces.items()]
        rung, share = 0, min(1.0, AUTO_ROWS / max(total, 1))
        while todo:
            least = {c: AUTO_CLASS / n for c, n in classes.items() if n}
            keep = F.lit(share)
            for c, s in least.items():
                keep = F.when(F.col("label") == F.lit(float(c)), F.lit(max(share, min(1.0, s)))).otherwise(keep)
            sample = folded if share >= 1 else folded.where(F.col("_u") < keep).persist(StorageLevel.MEMORY_AND_DISK)
            rows, scored = (total if share >= 1 else sample.count()), []
            for fam, params in todo:
                if time.monotonic() > deadline and trials:
                    break
                est = _family(fam).setLabelCol("label").setFeaturesCol("features")
                est = est.setWeightCol(weight) if weight else est
                m = {est.getParam(name): v for name, v in params.items()}
                began = time.monotonic()
                s = float(cross_validate(sample, est, [m], k, metric, is_clf)[0])
                trials.append(Trial(rung, fam, json.dumps(params, sort_keys=True), rows, time.monotonic() - began, s))
                scored.append((sign * s, fam, params, est.copy(m)))
            if share < 1:
                sample.unpersist()
            scored.sort(key=lambda e: -e[0])
            if scored:
                best = scored[0][3]
            if share >= 1 or time.monotonic() > deadline:
                break
            todo = [(fam, params) for _, fam, params, _ in scored[:max(1, -(-len(scored) // 3))]]
            leader, params = todo[0]
            todo.append((leader, _near(spaces[leader], params, rng)))
            rung, share = rung + 1, min(1.0, share * AUTO_GROWTH)
    finally:
        folded.unpersist()
    return best, trials


def trial_table(spark, trials: Sequence[Trial]) -> DataFrame:
    """(rung, family, params, rows, seconds, score) of an automatic choice, in the order tried."""
    rows = [(i, t.rung, t.family, t.params, t.rows, t.seconds, t.score) for i, t in enumerate(trials)]
    return spark.createDataFrame(rows, "trial int, rung int, family string, params string, rows long, seconds double, score double")


LOWER_IS_BETTER = ("log_loss", "mae", "mse", "rmse")


def compare_models(score_tables: Sequence[DataFrame], metrics: Sequence[str]) -> DataFrame:
    """Appended score rows (U1) restricted to chosen metrics, with
    ``rank_<metric>`` (1 = best, ties share a rank, NULL scores last) and
    ``best`` (rank 1 on the first metric).  One row per model, so one window
    over them is small."""
    out = union_all(score_tables).select("model", *metrics)
    for m in metrics:
        order = F.col(m).asc_nulls_last() if m in LOWER_IS_BETTER else F.col(m).desc_nulls_last()
        out = out.withColumn(f"rank_{m}", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(order)))
    return out.withColumn("best", F.col(f"rank_{metrics[0]}") == 1)


def shapley_model(b: Bundle, explain: DataFrame, background: DataFrame, id_col: str, n_samples: int = 10,
                  seed: int = 0, bg_key: Sequence[str] | None = None, kernel: bool = False) -> DataFrame:
    """E2 on a trained model: (id, class, feature, shap_value, base, fx) with
    one result per class of a classifier with probabilities (a regressor's
    class is NULL).  The features are the raw ones, before encoding and scaling.
    ``kernel``: by weighted least squares over up to ``n_samples`` coalitions."""
    classes = [str(c) for c in b.classes] if b.is_classifier else [None]

    def score(df: DataFrame) -> DataFrame:
        out = predict(b, df)
        if b.is_classifier and "proba" not in out.columns:
            raise ValueError(f"{b.model_type} has no class probabilities to explain")
        return out.withColumn("score", F.col("proba") if b.is_classifier else F.array(F.col("prediction").cast("double")))

    solve = kernel_shapley_values if kernel else shapley_values
    return solve(score, explain, background, b.raw_features, id_col, n_samples, seed, bg_key, classes=classes)


def set_sizes(split_df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split."""
    return split_df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))
