"""Hash cuts against a plain sort, with small, missing and single-row classes."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkprep.functions.exprs import hash_hex
from sparkprep.operators import sampling as X


def _table(spark):
    kind = F.when(F.col("id") < 400, "a").when(F.col("id") < 460, "b").when(F.col("id") == 460, "c")
    return spark.range(500).select("id", kind.alias("y"))


def test_cuts_take_the_first_rows_of_each_class(spark):
    cuts = {"a": [100, 250], "b": [0, 60], "c": [1, 5], None: [3, 4]}
    rows = X.with_cuts(_table(spark), cuts, 7, ["id"], "y", ("first", "second")).withColumn("h", hash_hex(["id"], 7)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["y"]].append(r)
    for y, (one, two) in cuts.items():
        ordered = sorted(by[y], key=lambda r: (r["h"], r["id"]))
        assert [r["first"] for r in ordered] == [k < one for k in range(len(ordered))]
        assert [r["second"] for r in ordered] == [k < two for k in range(len(ordered))]


def test_classes_without_a_cut_and_empty_tables(spark):
    df = _table(spark)
    assert X.with_cuts(df, {"a": [5]}, 1, ["id"], "y").where("_cut").groupBy("y").count().collect() == [("a", 5)]
    assert X.split_random(df.where("id < 0"), 0.2, 1, ["id"]).count() == 0
    assert X.split_stratified(df.where("id < 0"), "y", 0.2, 1, ["id"]).count() == 0


def test_too_many_classes(spark):
    with pytest.raises(ValueError, match="classes"):
        X.class_counts(_table(spark), "id", most=100)


def test_stratified_folds_are_even_and_need_no_shuffle(spark):
    df = _table(spark)
    out = X.stratified_folds(df, 7, 3, ["id"], "y")
    ordered = out.withColumn("h", hash_hex(["id"], 3)).collect()
    by = defaultdict(list)
    for r in sorted(ordered, key=lambda r: (r["h"], r["id"])):
        by[r["y"]].append(r["fold"])
    for y, folds in by.items():
        assert folds == [p * 7 // len(folds) for p in range(len(folds))]
        sizes = [folds.count(f) for f in range(7)]
        assert max(sizes) - min(sizes) <= 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    assert X.stratified_folds(df, 1, 3, ["id"], "y").groupBy("fold").count().collect() == [(0, 500)]
    assert X.stratified_folds(df.where("id < 0"), 3, 3, ["id"], "y").count() == 0
