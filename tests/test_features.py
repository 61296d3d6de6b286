"""Feature preparation and guards."""

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import features as Fe
from sparkprep.operators import sampling as X


def test_one_hot_columns_and_unseen_error(spark):
    train = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "c string, v int")
    model = Fe.fit_one_hot(train, ["c"])
    assert model.output_columns() == ["c_a", "c_b", "c_nan"]
    out = {r.v: (r.c_a, r.c_b, r.c_nan) for r in model.transform(train).collect()}
    assert out == {1: (1, 0, 0), 2: (0, 1, 0), 3: (0, 0, 1)}
    unseen = spark.createDataFrame([("z", 9)], "c string, v int")
    with pytest.raises(Exception, match="unseen category"):
        model.transform(unseen).collect()


def test_feature_mismatch_raises(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    Fe.check_features(df, ["b", "a"])
    with pytest.raises(ValueError, match="feature mismatch"):
        Fe.check_features(df, ["a", "c"])


def test_scalers_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (5.0, 5.0)], "x double, k double")
    for kind in ("minmax", "standard", "robust"):
        m = Fe.fit_scaler(df, ["x", "k"], kind)
        assert m.scale["k"] == 1.0
        back = m.inverse(m.transform(df)).collect()
        assert all(abs(r.x - w) < 1e-9 for r, w in zip(back, [1.0, 3.0, 5.0]))
    mm = Fe.fit_scaler(df, ["x"], "minmax").transform(df)
    assert [r.x for r in mm.collect()] == [0.0, 0.5, 1.0]
    rb = Fe.fit_scaler(df, ["x"], "robust")
    assert rb.center["x"] == 3.0 and rb.scale["x"] == 2.0


def test_label_encoding_alphabetical(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("Yes",)], "t string")
    out, model = Fe.encode_label(df, "t")
    assert list(model.labels) == ["No", "Yes"]
    assert [r.label for r in out.collect()] == [1.0, 0.0, 1.0]


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    w = {r.y: r.weight for r in Fe.class_weights(df, "y").collect()}
    assert w == {0: 4 / 6, 1: 2.0}


def test_stratified_split_sizes(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    s = X.split_stratified(df, "y", 0.2, 2, ["id"])
    got = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got[(0, "test")] + got[(1, "test")] == 200
    assert got[(1, "test")] == 50
    three = X.split_three(df, "y", 0.2, 0.25, 2, ["id"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in three} == {"test": 200, "valid": 200, "train": 600}


def test_proportional_sample_floor(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    s = X.sample_proportional(df, "y", 10, 1, ["id"])
    # floor(10 * 334/1000) + floor(10 * 666/1000) = 3 + 6
    assert s.count() == 9
