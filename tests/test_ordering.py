"""Distributed ordering primitives against brute force."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkprep.functions.exprs import hash_hex
from sparkprep.operators import order
from sparkprep.operators.order import exact_quantiles, ordered_prefix_sums, rank_within


def _skewed(spark, n=20000):
    # one group holds ~90% of the rows
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"),
                                 ((F.col("id") * 7919) % 1009).cast("double").alias("x"))


def test_rank_within_hashed_matches_row_number(spark):
    df = _skewed(spark).withColumn("h", hash_hex(["id"], 3))
    got = rank_within(df, ["h", "id"], ["g"], name="rk", hashed=True)
    ref = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")) - 1)
    j = got.join(ref.select("id", "rk2"), "id")
    assert j.count() == 20000
    assert j.where("rk != rk2").count() == 0


def test_rank_within_numeric_and_generic(spark):
    df = _skewed(spark)
    num = rank_within(df.select("id", (F.col("x") * 100000 + F.col("id")).alias("k")), ["k"], name="rk")
    ref = num.withColumn("rk2", F.row_number().over(Window.orderBy("k")) - 1)
    assert ref.where("rk != rk2").count() == 0
    gen = rank_within(df.select("id", "g", F.format_string("%08d", "id").alias("s")), ["s"], ["g"], name="rk")
    ref = gen.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy("s")) - 1)
    assert ref.where("rk != rk2").count() == 0


def test_rank_is_stable_across_evaluations(spark):
    df = _skewed(spark).withColumn("h", hash_hex(["id"], 5))
    r = rank_within(df, ["h", "id"], ["g"], name="rk", hashed=True).where("rk < 37")
    assert r.count() == 74
    assert len(r.collect()) == 74


def test_prefix_sums(spark):
    df = _skewed(spark).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    got = ordered_prefix_sums(df, ["x"], ["n"], partition_by=["g"], pos_name="i").toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("x")
        assert (part["cum_n"].to_numpy() == np.cumsum(part["n"].to_numpy())).all()
        assert (part["i"].to_numpy() == np.arange(len(part))).all()


def test_exact_quantiles_match_numpy(spark):
    df = _skewed(spark)
    got = {r.g: r for r in exact_quantiles(df, "x", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], by=["g"]).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        want = np.percentile(part["x"].to_numpy(), [0, 10, 25, 50, 90, 100])
        row = got[g]
        assert np.allclose([row.q0, row.q10, row.q25, row.q50, row.q90, row.q100], want, rtol=0, atol=1e-9)


def test_empty_and_constant_inputs(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert exact_quantiles(empty, "x", [0.5], by=["g"]).count() == 0
    assert [r.q50 for r in exact_quantiles(empty, "x", [0.5]).collect()] == [None]  # SQL: one NULL row
    const = spark.createDataFrame([("a", 2.0)] * 5, "g string, x double")
    assert exact_quantiles(const, "x", [0.1, 0.9], by=["g"]).first().q10 == 2.0
    nulls = spark.createDataFrame([("a", None), ("a", 1.0)], "g string, x double")
    assert exact_quantiles(nulls, "x", [0.5], by=["g"]).first().q50 == 1.0


def _odd_column(n=6000, seed=4):
    """Ties, heavy values, infinities and a wide spread, with one group of most rows."""
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(size=n // 2) * 1e6, np.full(n // 4, 7.25), rng.integers(-3, 3, n // 4), [1e300, -1e300]]).astype(float)
    g = np.where(rng.random(len(v)) < 0.05, "small", "large")
    return g, v


def test_brackets_of_any_size_give_the_same_quantiles(spark, monkeypatch):
    g, v = _odd_column()
    df = spark.createDataFrame([(a, float(b)) for a, b in zip(g, v)] + [(None, 1.0), (None, 3.0), ("none", None)], "g string, x double").repartition(5)
    probs = [0.5, 0.0, 0.01, 0.25, 0.75, 0.999, 1.0]  # in any order
    for accuracy, cell, local, few in ((5000, 100_000, 10_000, 2_000_000), (50, 100_000, 10_000, 0), (50, 7, 10_000, 2_000_000), (400, 3, 1, 0)):
        monkeypatch.setattr(order, "ACCURACY", accuracy)
        monkeypatch.setattr(order, "CELL_ROWS", cell)
        monkeypatch.setattr(order, "MAX_LOCAL_GROUPS", local)
        monkeypatch.setattr(order, "SORTED_CELLS", few)
        got = {r.g: r for r in exact_quantiles(df, "x", probs, by=["g"], names=[f"p{i}" for i in range(len(probs))]).collect()}
        assert set(got) == {"small", "large", None}
        for name in ("small", "large"):
            want = np.percentile(v[g == name], [100 * p for p in probs])
            assert np.allclose([got[name][f"p{i}"] for i in range(len(probs))], want, rtol=1e-12)
        assert got[None].p0 == 2.0


def test_selected_rows_are_few(spark):
    df = spark.range(400_000).select((F.xxhash64("id") / 1e10).alias("x"))
    brackets, _ = order.quantile_brackets(df, "x", [0.25, 0.75])
    cells = order.rank_cells(df, "x", [], brackets, [(F.col("_lo0"), F.col("_hi0")), (F.col("_lo1"), F.col("_hi1"))])
    assert cells.agg(F.sum("_cnt")).first()[0] == 400_000
    assert cells.count() < 0.005 * 400_000


def test_a_rank_outside_its_bracket_is_still_found(spark, monkeypatch):
    g, v = _odd_column()
    df = spark.createDataFrame([(float(b),) for b in v], "x double")
    right = order.quantile_brackets

    def wrong(*args, **kwargs):
        brackets, rows = right(*args, **kwargs)
        return brackets.withColumns({"_lo0": F.lit(1e200), "_hi0": F.lit(1e201)}), rows

    monkeypatch.setattr(order, "quantile_brackets", wrong)
    for few in (2_000_000, 0):
        monkeypatch.setattr(order, "SORTED_CELLS", few)
        assert exact_quantiles(df, "x", [0.4]).first().q40 == np.percentile(v, 40)


def test_box_summary_against_brute_force(spark, monkeypatch):
    from sparkprep.operators.profile import box_stats
    g, v = _odd_column(seed=8)
    v = np.where(np.abs(v) > 1e200, 1e7, v)
    df = spark.createDataFrame([(a, float(b)) for a, b in zip(g, v)], "g string, x double")
    for accuracy, few in ((5000, 2_000_000), (60, 2_000_000), (60, 0)):
        monkeypatch.setattr(order, "ACCURACY", accuracy)
        monkeypatch.setattr(order, "SORTED_CELLS", few)
        for r in box_stats(df, "x", ["g"]).collect():
            x = v[g == r.g]
            q1, q2, q3 = np.percentile(x, [25, 50, 75])
            lf, uf = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            assert np.allclose([r.q1, r.median, r.q3], [q1, q2, q3], rtol=1e-12)
            assert (r["count"], r.outliers) == (len(x), ((x < lf) | (x > uf)).sum())
            assert (r.whisker_low, r.whisker_high) == (x[x >= lf].min(), x[x <= uf].max())


def test_bivariate_reads_the_table_as_often_for_many_features(spark):
    from sparkprep.operators.profile import bivariate, box_stats, percent_counts
    rng = np.random.default_rng(2)
    rows = [(float(a), None if k % 9 == 0 else float(b), "xyz"[c], "pq"[c % 2], ["no", "yes", None][k % 3]) for k, (a, b, c) in
            enumerate(zip(rng.normal(size=600), rng.integers(0, 9, 600), rng.integers(0, 3, 600)))]
    df = spark.createDataFrame(rows, "a double, b double, c string, d string, y string")
    rank = spark.createDataFrame([(f, 1.0) for f in "abcd"] + [("gone", 9.0)], "feature string, importance double")
    got = bivariate(df, rank, 9, "y").collect()
    assert {(r.feature, r.kind) for r in got} == {("a", "box"), ("b", "box"), ("c", "count"), ("d", "count"), ("gone", "missing")}
    for f in "ab":
        want = {r.y: r for r in box_stats(df, f, ["y"]).collect()}
        mine = {r.group: r for r in got if r.feature == f}
        assert set(mine) == set(want) == {"no", "yes"}
        for g in mine:
            assert all(mine[g][c] == want[g][c] for c in ("count", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers"))
    for f in "cd":
        want = {(r[f], r.y): (r["count"], r.percent) for r in percent_counts(df, f, "y").collect()}
        assert {(r.category, r.group): (r["count"], r.percent) for r in got if r.feature == f} == want
    num = df.withColumn("y", F.col("a") * 2)
    reg = bivariate(num, rank, 9, "y", task="regression").collect()
    assert sum(r.kind == "scatter" and r.feature == "a" for r in reg) == 600
    assert {r.group: r.median for r in reg if r.feature == "c"} == {r.c: r.median for r in box_stats(num, "y", ["c"]).collect()}
    assert sum(r.kind == "scatter" for r in bivariate(num, rank, 9, "y", task="regression", sample=50).collect()) == 100
    assert bivariate(df, rank.where("feature = 'gone'"), 3, "y").first().kind == "missing"
