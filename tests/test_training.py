"""Training input checks, kNN probabilities, searches and Shapley values of trained models."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkprep.operators import features as Fe
from sparkprep.operators.explain import kernel_shapley_values
from sparkprep.plans import model as M


def _table(spark, n=300):
    kind = F.when(F.col("id") % 5 == 0, "nan").when(F.col("id") % 5 == 1, F.lit(None)).otherwise("x")
    return spark.range(n).select("id", kind.alias("kind"), (F.col("id") % 10).cast("double").alias("a"),
                                 F.when(F.col("id") % 10 > 4, "yes").otherwise("no").alias("t"))


def test_null_and_text_nan_are_two_categories(spark):
    df = _table(spark)
    out = Fe.one_hot(df, ["kind"])
    assert [c for c in out.columns if c.startswith("kind_")] == ["kind_nan", "kind_x", "kind_nan_"]
    sums = out.agg(F.sum("kind_nan"), F.sum("kind_x"), F.sum("kind_nan_")).first()
    assert tuple(sums) == (60, 180, 60)


def test_unseen_null_and_too_many_categories(spark):
    df = _table(spark)
    fitted = Fe.fit_one_hot(df.where("kind is not null"), ["kind"])
    with pytest.raises(Exception, match="unseen category"):
        fitted.transform(df).collect()
    with pytest.raises(ValueError, match="categories"):
        Fe.fit_one_hot(df, ["id"], most=50)


def test_category_only_in_test_part_is_scored(spark):
    df = _table(spark).withColumn("kind", F.col("id").cast("string"))  # every row its own category
    b, _, test = M.train(df, "t", "DT", {"max_depth": 3}, key=["id"], onehot_cols=["kind"], split=True)
    assert M.predict(b, test).count() == test.count() == 60


def test_null_target_and_unmapped_parameters_are_errors(spark):
    df = _table(spark)
    with pytest.raises(ValueError, match="NULL in target"):
        M.train(df.withColumn("t", F.when(F.col("id") > 5, F.col("t"))), "t", "DT", key=["id"], onehot_cols=["kind"])
    with pytest.raises(ValueError, match="min_samples_split"):
        M.train(df, "t", "DT", {"min_samples_split": 4}, key=["id"], onehot_cols=["kind"])
    with pytest.raises(ValueError, match="max_dept"):
        M.estimator("RFC", {"max_dept": 4})
    with pytest.raises(ValueError, match="balanced"):
        M.estimator("DT", {"class_weight": {"yes": 2}})
    with pytest.raises(ValueError, match="no counterpart"):
        M._grid(DecisionTreeClassifier(), {"min_samples_split": [2]})


def test_knn_has_probabilities_and_curves(spark):
    df = _table(spark).drop("kind")
    b, _, test = M.train(df, "t", "KNN", {"n_neighbors": 5}, key=["id"], split=True)
    rows = M.predict(b, test).collect()
    assert len(rows) == 60 and all(abs(sum(r["proba"]) - 1) < 1e-12 and r["p"] == r["proba"][1] for r in rows)
    assert all((r["predicted_label"] == "yes") == (r["p"] > 0.5) for r in rows)
    res = M.evaluate(b, test, n_samples=10, key=["id"])
    assert res["roc_curve"].count() and res["pr_curve"].count() and res["scores"].first()["log_loss"] is not None


def test_search_does_not_depend_on_partitioning(spark):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        _table(spark).withColumn("label", (F.rand(3) > 0.5).cast("double")))
    rows = [r.asDict() for r in df.select("id", "a", "label").collect()]
    scores = []
    for parts in (1, 7):
        same = spark.createDataFrame(rows, "id long, a double, label double").repartition(parts)
        vec = VectorAssembler(inputCols=["a"], outputCol="features").transform(same)
        table, _ = M.grid_search(vec, DecisionTreeClassifier(), {"max_depth": [1, 3]}, metric="roc_auc", key=["id"])
        scores.append([round(r["mean_score"], 9) for r in table.orderBy("setting").collect()])
    assert scores[0] == scores[1]


def test_ranks(spark):
    a = spark.createDataFrame([("a", 0.9, 0.2)], "model string, accuracy double, log_loss double")
    b = spark.createDataFrame([("b", 0.9, 0.1)], a.schema)
    c = spark.createDataFrame([("c", None, None)], a.schema)
    got = {r["model"]: (r["rank_accuracy"], r["rank_log_loss"], r["best"]) for r in M.compare_models([a, b, c], ["accuracy", "log_loss"]).collect()}
    assert got == {"a": (1, 2, True), "b": (1, 1, True), "c": (3, 3, False)}


def test_shapley_of_a_regressor_and_of_three_classes(spark):
    df = _table(spark).withColumn("three", F.when(F.col("a") < 3, "l").when(F.col("a") < 6, "m").otherwise("r"))
    three = df.select("id", "a", "kind", "three")
    b, _, _ = M.train(three, "three", "DT", {"max_depth": 4}, key=["id"], onehot_cols=["kind"], split=False)
    sv = M.shapley_model(b, three.where("id < 10"), three.where("id >= 200"), "id", n_samples=4, bg_key=["id"])
    sums = sv.groupBy("id", "class").agg(F.sum("shap_value").alias("s"), F.first("base").alias("b"), F.first("fx").alias("f"))
    assert sums.count() == 30 and sums.where(F.abs(F.col("s") - F.col("f") + F.col("b")) > 1e-9).count() == 0
    num = df.select("id", "a", (F.col("a") * 2).alias("yr"))
    r, _, _ = M.train(num, "yr", "RFR", {"n_estimators": 2, "max_depth": 4}, key=["id"], split=False)
    out = M.shapley_model(r, num.where("id < 5"), num.where("id >= 200"), "id", n_samples=4, bg_key=["id"])
    assert out.count() == 5 and out.where("class is not null").count() == 0


def test_draws_of_a_space_that_is_never_listed(spark):
    est = DecisionTreeClassifier()
    space = {"max_depth": range(1, 11), "min_samples_leaf": range(1, 10**6 + 1), "random_state": range(10**6)}
    drawn = [{p.name: v for p, v in m.items()} for m in M.draw_settings(est, space, 500, 1)]
    assert len({tuple(m.values()) for m in drawn}) == 500
    assert all(1 <= m["maxDepth"] <= 10 and 1 <= m["minInstancesPerNode"] <= 10**6 and 0 <= m["seed"] < 10**6 for m in drawn)
    assert {m["maxDepth"] for m in drawn} == set(range(1, 11))
    assert M.draw_settings(est, space, 500, 1) == M.draw_settings(est, space, 500, 1) != M.draw_settings(est, space, 500, 2)
    few = M.draw_settings(est, {"max_depth": [1, 2], "min_samples_leaf": [1, 5]}, 100, 0)
    assert len({tuple(m.values()) for m in few}) == len(few) == 4
    ranged = M.draw_settings(est, {"minInfoGain": M.Range(1e-6, 1e-2, log=True), "max_depth": M.Range(2, 4, whole=True)}, 200, 0)
    gains = [v for m in ranged for p, v in m.items() if p.name == "minInfoGain"]
    assert 0.3 < np.mean([g < 1e-4 for g in gains]) < 0.7 and min(gains) >= 1e-6
    assert {v for m in ranged for p, v in m.items() if p.name == "maxDepth"} == {2, 3, 4}
    with pytest.raises(ValueError):
        M.draw_settings(est, {"max_depth": M.Range(2, 99, whole=True)}, 3, 0)


def test_automatic_choice_grows_the_sample_for_the_leaders(spark, monkeypatch):
    monkeypatch.setattr(M, "AUTO_ROWS", 150)
    monkeypatch.setattr(M, "AUTO_CLASS", 20)
    monkeypatch.setattr(M, "AUTO_SPACES", {**M.AUTO_SPACES, "clf": M.AUTO_SPACES["clf"][:2]})
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float((a > 0) != (b > 0)) if i % 40 else 2.0) for i, (a, b) in enumerate(rng.normal(size=(1200, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    est, trials = M.auto_search(df, ["a", "b"], True, budget_s=600, key=["id"])
    rungs = sorted({t.rung for t in trials})
    assert rungs == [0, 1, 2]
    sizes = [{t.rows for t in trials if t.rung == r} for r in rungs]
    assert all(len(s) == 1 for s in sizes) and 150 < min(sizes[0]) < 260 and min(sizes[1]) > 2 * min(sizes[0]) and sizes[2] == {1200}
    assert [sum(t.rung == r for t in trials) for r in rungs] == [6, 3, 2]
    last = [t for t in trials if t.rung == 2]
    assert max(t.score for t in last) > 0.9 and type(est).__name__ == "DecisionTreeClassifier"
    assert M.trial_table(spark, trials).where("seconds > 0").count() == len(trials)
    _, short = M.auto_search(df, ["a", "b"], True, budget_s=0, key=["id"])
    assert len(short) == 1


@pytest.mark.parametrize("key", [["id"], []])
@pytest.mark.parametrize("is_clf", [True, False])
def test_automatic_choice_samples_copies_one_by_one(spark, monkeypatch, key, is_clf):
    """Few distinct rows in many copies: every fold of a small sample has rows of every kind."""
    monkeypatch.setattr(M, "AUTO_ROWS", 600)
    monkeypatch.setattr(M, "AUTO_DRAWS", 0)
    df = spark.range(6000).select("id", (F.col("id") % 4).cast("double").alias("a"))
    df = df.withColumn("label", (F.col("a") > 1).cast("double"))
    _, trials = M.auto_search(df, ["a"], is_clf, budget_s=0, key=key)
    assert 400 < trials[0].rows < 1300 and trials[0].score == pytest.approx(1.0 if is_clf else 0.0)


def test_trained_automatic_choice_samples_by_the_key(spark, monkeypatch):
    monkeypatch.setattr(M, "AUTO_ROWS", 300)
    monkeypatch.setattr(M, "AUTO_CLASS", 10)
    df = spark.range(3000).select("id", (F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 4 > 1).cast("int").alias("y"))
    b, _, _ = M.train(df, "y", "Auto-Classification", {"time_budget": 0}, key=["id"], split=False)
    assert 200 < b.trials[0].rows < 420 and b.trials[0].score == 1.0


@pytest.mark.parametrize("cols", [["features", "label", "id", "note"], ["features", "label"]])
def test_search_reads_one_narrow_table(spark, cols):
    """Scores are those of CrossValidator on the same folds; the cached table has no other columns."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator
    df = spark.range(600).withColumns({"a": F.rand(1), "b": F.rand(2), "note": F.lit("x")}).withColumn("label", (F.col("a") + F.rand(3) > 1).cast("double"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).select(*cols).persist()
    est, key = DecisionTreeClassifier(), ["id"] if "id" in cols else []
    maps = M._grid(est, {"max_depth": [1, 4], "min_samples_leaf": [1, 20]})
    folded = M._folded(df, 3, 2, key)
    assert set(M._fit_columns(folded, est, maps)) == {"features", "label", "_fold"}
    scores, best = M.grid_search(df, est, {"max_depth": [1, 4], "min_samples_leaf": [1, 20]}, key=key)
    want = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=M._evaluator("f1"), numFolds=3, foldCol="_fold").fit(folded)
    assert [r["mean_score"] for r in scores.orderBy("setting").collect()] == pytest.approx(want.avgMetrics)
    assert best.toDebugString.split("\n", 1)[1] == want.bestModel.toDebugString.split("\n", 1)[1]
    with pytest.raises(ValueError, match="fold 2 is empty"):
        M.cross_validate(folded.where("_fold < 2"), est, maps, 3, "f1")


@pytest.mark.parametrize("large", [True, False])
def test_search_of_a_large_table_leaves_memory_to_one_fit(spark, monkeypatch, large):
    """Rows of more than a task are dealt anew and kept on disk; fits whose tasks fill all cores go one at a time; the
    scores are those of CrossValidator on the undealt rows (F1)."""
    from threading import Lock

    from pyspark.ml.tuning import CrossValidator
    df = spark.range(2000, numPartitions=1).withColumns({"a": F.rand(1), "b": F.rand(2)}).withColumn("label", (F.col("a") + F.rand(3) > 1).cast("double"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    space, est, cores = {"max_depth": [1, 4]}, DecisionTreeClassifier(), spark.sparkContext.defaultParallelism
    folded = M._folded(df, 3, 2, ["id"]).persist()
    want = CrossValidator(estimator=est, estimatorParamMaps=M._grid(est, space), evaluator=M._evaluator("f1"), numFolds=3, foldCol="_fold").fit(folded)
    folded.unpersist()
    if large:
        monkeypatch.setattr(M, "FIT_BYTES", 2000 * 132 // (2 * cores), raising=False)
    kept, running, most, lock = [], [], [], Lock()
    frame, fit, persist = type(df), DecisionTreeClassifier.fit, type(df).persist

    def counted(self, *a):
        with lock:
            running.append(1)
            most.append(len(running))
        try:
            return fit(self, *a)
        finally:
            with lock:
                running.pop()

    monkeypatch.setattr(frame, "persist", lambda x, *a: kept.append((a, x.rdd.getNumPartitions())) or persist(x, *a))
    monkeypatch.setattr(DecisionTreeClassifier, "fit", counted)
    scores, best = M.grid_search(df, est, space, key=["id"])
    (level, tasks), = kept
    assert not level[0].useMemory and (tasks >= 2 * cores if large else tasks == 1)
    assert len(most) == 7 and (max(most) == 1) == large
    assert [r["mean_score"] for r in scores.orderBy("setting").collect()] == pytest.approx(want.avgMetrics)
    assert best.toDebugString.split("\n", 1)[1] == want.bestModel.toDebugString.split("\n", 1)[1]


def test_fourier_features_are_not_cached_twice(spark, monkeypatch):
    """The cached rows of an rbf fit hold the plain features, in tasks of MAP_BYTES of mapped ones (F1)."""
    monkeypatch.setattr(M, "MAP_BYTES", 1 << 13)
    seen, frame = [], type(spark.range(1))
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda df, *a: seen.append((df.columns, df.rdd.getNumPartitions())) or persist(df, *a))
    df = spark.range(200).withColumns({"a": F.rand(1), "b": F.rand(2)}).withColumn("y", (F.pow(F.col("a") - 0.5, 2) + F.pow(F.col("b") - 0.5, 2) < 0.1).cast("int"))
    M.train(df, "y", "SVM", {"kernel": "rbf", "n_components": 16, "max_iter": 3}, key=["id"], split=False)
    assert seen and all("features" not in cols and n >= 200 * 16 * 8 / (1 << 13) for cols, n in seen)


@pytest.mark.parametrize("n_coalitions", [62, 30])
def test_kernel_shapley_values(spark, n_coalitions):
    rng = np.random.default_rng(1)
    x, bg = rng.normal(size=(5, 6)), rng.normal(size=(12, 6))
    names = [f"x{i}" for i in range(6)]
    frame = lambda v: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "id long, " + ", ".join(f"{n} double" for n in names))
    c = [F.col(n) for n in names]
    two = lambda df: df.withColumn("score", F.array(c[0] * c[1] + c[2] * c[2] - 3 * c[3], c[4] * 1.0))
    fn = lambda v: np.stack([v[:, 0] * v[:, 1] + v[:, 2] ** 2 - 3 * v[:, 3], v[:, 4]])

    def value(row, s):
        v = bg.copy()
        v[:, list(s)] = row[list(s)]
        return fn(v).mean(axis=1)

    got = {}
    for r in kernel_shapley_values(two, frame(x), frame(bg), names, "id", n_coalitions, bg_key=["id"], classes=["a", "b"]).collect():
        got.setdefault((r.id, r["class"]), {})[r.feature] = r
    assert len(got) == 10
    for (i, k), parts in got.items():
        want = np.zeros((2, 6))
        for size in range(6):
            for s in combinations(range(6), size):
                for j in set(range(6)) - set(s):
                    want[:, j] += math.factorial(size) * math.factorial(5 - size) / 720 * (value(x[i], [*s, j]) - value(x[i], s))
        mine = [parts[n].shap_value for n in names]
        assert abs(sum(mine) - (parts["x0"].fx - parts["x0"].base)) < 1e-9
        if n_coalitions == 62:
            assert np.allclose(mine, want["ab".index(k)], atol=1e-9)
        else:
            assert np.allclose(mine, want["ab".index(k)], atol=1.0)


def test_kernel_shapley_of_a_model(spark):
    num = _table(spark).select("id", "a", (F.col("a") * 2).alias("b"), (F.col("a") * 2).alias("yr"))
    r, _, _ = M.train(num, "yr", "RFR", {"n_estimators": 2, "max_depth": 4}, key=["id"], split=False)
    out = M.shapley_model(r, num.where("id < 5"), num.where("id >= 280"), "id", n_samples=100, bg_key=["id"], kernel=True)
    sums = out.groupBy("id").agg(F.sum("shap_value").alias("s"), F.first("base").alias("b"), F.first("fx").alias("f"))
    assert out.count() == 10 and sums.where(F.abs(F.col("s") - F.col("f") + F.col("b")) > 1e-9).count() == 0


def test_fourier_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    for gamma in ("scale", 0.3):
        out = df
        for stage in M.fourier_map(df, ["a", "b", "c"], 300, gamma, 1):
            out = stage.transform(out)
        z = np.array([r.features.toArray() for r in out.orderBy("id").select("features").collect()])
        g = 1 / (3 * x.var()) if gamma == "scale" else gamma
        want = np.exp(-g * ((x[:, None] - x[None]) ** 2).sum(axis=2))
        assert np.abs(z @ z.T - want).max() < 0.3 and np.abs(z @ z.T - want).mean() < 0.06
    with pytest.raises(ValueError):
        M.estimator("SVM", {"kernel": "rbf"})
