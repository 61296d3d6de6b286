"""Cases that used to lose or change rows without a word."""

import pytest

from sparkprep.operators import columns as C
from sparkprep.operators import evaluate as V
from sparkprep.operators import profile as A
from sparkprep.operators import schema as S
from sparkprep.operators.neighbors import knn_predict
from sparkprep.plans.ingest import IngestConfig, ingest
from sparkprep.plans.model import estimator
from sparkprep.sources.files import read_csv


def test_depth_beyond_the_limit_is_refused():
    with pytest.raises(ValueError, match="max_depth"):
        estimator("DT", {"max_depth": 50})


def test_null_feature_is_refused_by_knn(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 1.0, "b"), (3, None, "a")], "id int, x double, y string")
    with pytest.raises(ValueError, match="NULL feature"):
        knn_predict(df.where("id < 3"), df, ["x"], "y", k=1)


def test_scatter_of_all_rows(spark):
    df = spark.range(1500).selectExpr("cast(id as double) x", "cast(id * 2 as double) y")
    rank = spark.createDataFrame([("x", 1.0)], "feature string, importance double")
    assert A.bivariate(df, rank, 1, "y", task="regression").count() == 1500
    assert A.bivariate(df, rank, 1, "y", task="regression", sample=7).count() == 7


def test_unmapped_text_in_a_numeric_recode_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("zz",)], "c string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        C.replace_values(df, {"c": {"a": 1}}).collect()


def test_composite_parts_become_numbers_and_map_labels_reads_them(spark):
    df = spark.createDataFrame([("Y", 0), ("N", 0), (None, 1)], "a string, b int")
    out = C.composite_target(df, ["a", "b"], "t")
    assert [r.a for r in out.collect()] == [1, 0, None]
    assert [r.a for r in C.map_labels(out, ["a"], {0: "No", 1: "Yes"}).collect()] == ["Yes", "No", None]


def test_confusion_matrix_with_null_and_backtick(spark):
    df = spark.createDataFrame([("a`b", None), (None, "a`b"), ("a`b", "a`b")], "y string, y_hat string")
    rows = {r[0]: tuple(r[1:]) for r in V.confusion_matrix(df).collect()}
    assert rows == {"True: a`b": (1, 1), "True: null": (1, 0)}


def test_position_follows_the_files_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,a\n")
    (tmp_path / "b.csv").write_text("k,v\n" + "1,b\n" * 5000)
    df = read_csv(spark, str(tmp_path), position_col="_pos")
    assert df.orderBy("_pos").first().v == "a" and df.select("_pos").distinct().count() == 5001


def test_bad_dates_and_types_fail_or_are_counted(spark):
    raw = spark.createDataFrame([(1, "01/31/2021", "7"), (2, "2021-02-01", "x"), (3, None, None)], "id int, RECVDATE string, n string")
    assert [r["RECVDATE"] is None for r in S.parse_dates(raw).orderBy("id").collect()] == [False, True, True]
    assert S.parse_failures(raw).first()["RECVDATE"] == 1
    assert S.cast_failures(raw, {"n": "int"}).first()["n"] == 1
    with pytest.raises(Exception, match="unparsable value in RECVDATE: 2021-02-01"):
        S.parse_dates(raw, bad="raise").collect()
    with pytest.raises(Exception, match="unparsable value in n: x"):
        S.apply_types(raw, {"n": "int"}, bad="raise").collect()


def test_ingest_refuses_a_bad_date(spark):
    main = spark.createDataFrame([(1, "01/31/2021"), (2, "2021-02-01")], "VAERS_ID int, RECVDATE string")
    symptoms = spark.createDataFrame([(1, "a", None, None, None, None, 0), (2, "b", None, None, None, None, 1)],
                                     "VAERS_ID int, SYMPTOM1 string, SYMPTOM2 string, SYMPTOM3 string, SYMPTOM4 string, SYMPTOM5 string, _pos long")
    vax = spark.createDataFrame([(1, "MODERNA", 0), (2, "MODERNA", 1)], "VAERS_ID int, VAX_MANU string, _pos long")
    with pytest.raises(Exception, match="unparsable value in RECVDATE"):
        ingest(main, symptoms, vax, IngestConfig()).collect()
    assert ingest(main, symptoms, vax, IngestConfig(bad_dates="null")).count() == 1


def test_wide_group_tables_are_not_broadcast(spark, monkeypatch):
    from sparkprep.operators import order
    monkeypatch.setattr(order, "MAX_BROADCAST_BYTES", 1000)
    big = spark.range(100).selectExpr("id % 3 as g", "id")
    for width, hinted in ((10, True), (2000, False)):
        small = spark.range(3).selectExpr("id as g", f"repeat('x', {width}) as wide")
        out = order.join_small(big, small, ["g"])
        assert out.count() == 100
        assert ("strategy=broadcast" in out._jdf.queryExecution().analyzed().toString()) == hinted
