"""The corpus pipeline on the smallest tables, and on odd rows."""

from __future__ import annotations

import corpus_pipeline
import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (docs.first().doc_id, docs.first().text, None, None, 1)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.count() <= docs.count()
        docs = out
    assert docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    from test_operators import prose

    a, b = prose(1, 200), prose(2, 200)
    rows = [(7, a), (7, b), (7, b), (8, a), (3, prose(3, 200)), (7, prose(3, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, SF).collect())) == sorted([(7, a), (7, b), rows[4]])


def test_all_fourteen_are_registered():
    names = [k for k in __spark_entry__.queries() if k == "pipeline" or k.startswith("op") and "_" in k and k[2:k.index("_")].isdigit()]
    assert len(names) == 14


def test_clashing_columns_and_empty_documents(spark):
    from test_operators import prose

    rows = [(k, t, f"k{k}", -k, 5, 6) for k, t in enumerate([prose(4, 200), prose(4, 200) + " end", None, "", prose(6, 30_000)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _id long, n_chars long, component_id long")
    for stage, kept in ((corpus_pipeline.near_duplicates, {0, 2, 4}), (corpus_pipeline.benchmark_filter, {0, 1, 2, 3, 4})):
        got = stage(spark, docs, SF).collect()
        assert {r.doc_id for r in got} == kept and all(tuple(r) == rows[r.doc_id] for r in got)
    empty = docs.limit(0).drop("component_id").selectExpr("*", "'x' as lang", "'y' as source")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
