"""NULL and ordering semantics that differ from Spark defaults."""

import datetime as dt

from pyspark.sql import functions as F

from sparkprep.functions.exprs import np_round
from sparkprep.operators import columns as C
from sparkprep.operators import keyed as K
from sparkprep.operators import profile as A
from sparkprep.operators import rows as P


def test_n1_error_rows_keep_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 20.0)], "id int, age double")
    kept = P.drop_error_rows(df, {"age": ["<", 12]})
    assert sorted(r.id for r in kept.collect()) == [2, 3]


def test_n1_date_rule(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (2, None), (3, dt.date(2021, 1, 1))],
                               "id int, d date")
    kept = P.drop_error_rows(df, {"d": ["<", "2020-12-11"]})
    assert sorted(r.id for r in kept.collect()) == [2, 3]


def test_n2_clip_keeps_null(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 20)], "id int, n int")
    out = {r.id: r.n for r in C.clip_upper(df, {"n": 10}).collect()}
    assert out == {1: None, 2: 5, 3: 10}


def test_n3_flag_null_text_is_zero(spark):
    df = spark.createDataFrame([(1, None), (2, "has diabetes"), (3, "none")], "id int, t string")
    out = {r.id: r.F for r in C.flag_matches(df, "t", ["diabet", "^htn"], "F").collect()}
    assert out == {1: 0, 2: 1, 3: 0}


def test_n4_value_counts_skip_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "c string")
    out = {r.c: r["count"] for r in A.value_counts(df, "c").collect()}
    assert out == {"a": 2, "b": 1}


def test_n5_first_per_key_follows_order(spark):
    df = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 5, "only")], "k int, pos int, v string")
    out = {r.k: r.v for r in K.first_per_key(df, "k", ["pos"]).collect()}
    assert out == {1: "early", 2: "only"}


def test_n6_collapse_in_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b")], "k int, pos int, s string")
    assert K.collapse_strings(df, "k", "s", ["pos"]).first().s == "a,b,c"


def test_n7_symptom_text_rule(spark):
    rows = [(1, 0, "a", "b", None, None, None), (2, 0, "a", None, None, None, None),
            (3, 0, "a", None, "b", None, None), (4, 0, "a", "b", "c", "d", None)]
    df = spark.createDataFrame(rows, "k int, pos int, S1 string, S2 string, S3 string, S4 string, S5 string")
    parts = {"SYMP": ["S1", "S2", "S3", "S4", "S5"]}
    compat = {r.k: (r.SYMP, r.COUNT_SYMPT) for r in K.build_symptoms(df, "k", parts, ["pos"]).collect()}
    assert compat == {1: ("a,b", 2), 2: ("a", 1), 3: ("ab", 1), 4: ("a,b,c,d,", 5)}
    plain = {r.k: (r.SYMP, r.COUNT_SYMPT)
             for r in K.build_symptoms(df, "k", parts, ["pos"], compat=False).collect()}
    assert plain == {1: ("a,b", 2), 2: ("a", 1), 3: ("a,b", 2), 4: ("a,b,c,d", 4)}


def test_n8_recode_keep_vs_null(spark):
    df = spark.createDataFrame([("M",), ("F",), ("X",)], "sex string")
    keep = [r.sex for r in C.replace_values(df, {"sex": {"M": "male"}}).collect()]
    assert keep == ["male", "F", "X"]
    mapped = [r.sex for r in C.map_labels(df, ["sex"], {"M": "male"}).collect()]
    assert mapped == ["male", None, None]


def test_n9_presence_dummy(spark):
    df = spark.createDataFrame([(1, "none"), (2, None), (3, "asthma")], "id int, h string")
    out = {r.id: (r.h, r.h_DUM) for r in C.presence_dummy(df, {"h": ["none", "no"]}).collect()}
    assert out == {1: (None, 0), 2: (None, 0), 3: ("asthma", 1)}


def test_n10_indicator_keeps_null(spark):
    df = spark.createDataFrame([(1, "SEN"), (2, "PVT"), (3, None)], "id int, v string")
    out = {r.id: r.NUR for r in C.category_indicator(df, "v", "SEN", "NUR").collect()}
    assert out == {1: 1, 2: 0, 3: None}


def test_n11_composite_null_part_is_yes(spark):
    df = spark.createDataFrame([(1, "N", 0), (2, "Y", 0), (3, None, 0), (4, "N", None)],
                               "id int, died string, flag int")
    out = {r.id: r.T for r in C.composite_target(df, ["died", "flag"], "T").collect()}
    assert out == {1: "No", 2: "Yes", 3: "Yes", 4: "Yes"}


def test_n17_impute_and_lower(spark):
    df = spark.createDataFrame([("Y",), (None,)], "died string")
    assert [r.died for r in C.impute(df, {"died": "N"}).collect()] == ["Y", "N"]
    assert C.lowercase(spark.createDataFrame([("AbC",)], "t string"), ["t"]).first().t == "abc"


def test_n18_numpy_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (5407.105,), (-1.5,)], "x double")
    got = [r.y for r in df.select(np_round("x", 2).alias("y")).collect()]
    assert got == [0.12, 2.68, 5407.1, -1.5]  # numpy.round gives the same


def test_repaired_interval(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 5), dt.date(2021, 1, 10)),
                                (dt.date(2021, 1, 10), dt.date(2021, 1, 5))], "onset date, vax date")
    out = [r.N for r in C.repaired_interval(df, {"N": ["onset", "vax"]}).collect()]
    assert out == [0, 5]


def test_audit_is_sequential(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 20.0), (4, 8.0)], "id int, age double")
    steps = [P.drop_step("age", ["<", 12]), P.null_count_step("age"), P.impute_step("age")]
    out = [(r.step_no, r.rows, r.base) for r in P.audit(df, steps).orderBy("step_no").collect()]
    assert out == [(0, 2, 4), (1, 1, 2), (2, 1, 2)]


def test_filter_samples_limit_first(spark):
    df = spark.createDataFrame([(i, i % 2, 1) for i in range(10)], "id int, true_label int, predicted_label int")
    out = P.filter_samples(df, 4, ["id"], features=["id"], true_label=1)
    assert sorted(r.id for r in out.collect()) == [1, 3]


def test_grouped_proportions(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "n"), ("a", "y"), ("b", "y"), (None, "y")], "g string, t string")
    out = {(r.g, r.t): r.proportion for r in A.grouped_proportions(df, "g", "t").collect()}
    assert out == {("a", "y"): 2 / 3, ("a", "n"): 1 / 3, ("b", "y"): 1.0}


def test_collapse_of_hot_keys_equals_single_stage(spark):
    rows = [(k, ((pos * 7919) % 3000, "f" if pos % 3 else None), f"s{pos}" if pos % 5 else None)
            for k in (1, 2, None) for pos in range({1: 3000, 2: 3, None: 2500}[k])]
    df = spark.createDataFrame(rows, "k int, pos struct<a:int,b:string>, s string")
    one = {r.k: r.s for r in K.collapse_strings(df, "k", "s", ["pos"]).collect()}
    two = K.collapse_strings(df, ["k"], "s", ["pos"], hot_rows=400)
    assert one == {r.k: r.s for r in two.collect()} and len(one) == 3
    assert one[2] == "s2,s1"
    assert K.hot_keys(df, ["k"], 400) and not K.hot_keys(df, ["k"])
    assert K.collapse_strings(df.where("k = 7"), "k", "s", ["pos"]).count() == 0


def test_runs_of_a_hot_key_are_even(spark):
    """A key with a third of all rows, and order values that repeat."""
    from statistics import median
    df = spark.range(90_000).select((F.col("id") % 3 * (F.col("id") % 1000)).alias("k"), F.xxhash64("id").alias("pos"), F.col("id").cast("string").alias("s"))
    hot = df.where("k = 0")
    runs = K.key_runs(hot, ["k"], ["pos"], 2_000).groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).orderBy("_b").collect()
    sizes = [r["n"] for r in runs]
    assert len(runs) > 20 and max(sizes) < 2 * median(sizes) and sum(sizes) == hot.count()
    assert all(a["hi"] < b["lo"] for a, b in zip(runs, runs[1:]))
    whole = {r.k: r.s for r in K.collapse_strings(df, "k", "s", ["pos"]).collect()}
    assert whole == {r.k: r.s for r in K.collapse_strings(df, "k", "s", ["pos"], hot_rows=2_000).collect()}
