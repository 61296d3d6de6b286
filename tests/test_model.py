"""Training on a planted rule, persistence and Shapley invariants."""

import tempfile

from pyspark.sql import functions as F

from sparkprep.operators import explain as E
from sparkprep.plans import model as M

from conftest import SF_SMALL


def _rule(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    return li.select(F.monotonically_increasing_id().alias("rid"), F.col("l_quantity").alias("x1"),
                     F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"),
                     F.when(F.col("l_quantity") > 25, "Yes").otherwise("No").alias("t"))


def test_tree_learns_rule_and_roundtrips(spark):
    df = _rule(spark).cache()
    b, _, test = M.train(df, "t", "DT", {"max_depth": 30, "max_bins": 64}, key=["rid"], split=True)
    assert b.classes == ["No", "Yes"]
    pred = M.predict(b, test)
    assert pred.where(F.col("predicted_label") != F.col("t")).count() == 0
    path = tempfile.mkdtemp(prefix="sparkprep-bundle-") + "/m"
    M.save_bundle(b, path)
    again = M.score_batch(spark, test.drop("t"), path, key=["rid"])
    assert again.join(pred.select("rid", F.col("predicted_label").alias("p0")), "rid") \
        .where("p0 != predicted_label").count() == 0
    res = M.evaluate(b, test, n_samples=10, key=["rid"])
    assert res["scores"].first().accuracy == 1.0
    assert res["roc_curve"] is not None and res["confusion_matrix"].count() == 2


def test_unknown_model_type(spark):
    import pytest
    with pytest.raises(ValueError, match="Unsupported"):
        M.train(_rule(spark), "t", "XGB", {})


def test_shapley_efficiency_nonlinear(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"),
                                 (F.col("id") % 5).cast("double").alias("b"),
                                 (F.col("id") % 3).cast("double").alias("c"))

    def score(d):
        return d.withColumn("score", F.col("a") * F.col("b") + F.exp(F.col("c") / 3))

    explain = df.where("id < 20")
    background = df.where("id >= 100")
    sv = E.shapley_values(score, explain, background, ["a", "b", "c"], "id", n_samples=6, seed=1)
    chk = sv.groupBy("id").agg(F.sum("shap_value").alias("s"), F.first("base").alias("base"),
                               F.first("fx").alias("fx"))
    assert chk.count() == 20
    assert chk.where(F.abs(F.col("s") - (F.col("fx") - F.col("base"))) > 1e-9).count() == 0
    direct = score(explain).select("id", F.col("score").alias("f"))
    assert chk.join(direct, "id").where(F.abs(F.col("fx") - F.col("f")) > 1e-12).count() == 0
