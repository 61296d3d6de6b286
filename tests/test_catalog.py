"""Registered queries against their DuckDB oracles on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
FAST = ["flagship", "ingest_pipeline", "preprocess_pipeline", "quality_audit", "symptom_table", "first_per_key",
        "describe_numeric", "box_stats", "histogram_bins", "unique_profile", "dup_members", "value_proportions",
        "split_stratified", "split_three", "sample_proportional", "kfold_assign", "scale_robust", "one_hot",
        "classification_scores", "classification_report", "confusion_matrix", "roc_curve", "pr_curve", "auc",
        "regression_scores", "distinct_options", "csv_scan_na", "parse_dates", "shapley_linear"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    return c


def _norm(v):
    """Sortable (kind, value) pair; NULL sorts first."""
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, round(v, 9)) if not math.isnan(v) else (2, "nan")
    if type(v).__name__ == "Decimal":
        return (1, round(float(v), 9))
    if isinstance(v, (int, bool)):
        return (1, float(v))
    return (3, str(v))


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = sorted(sdf.columns)
    srows = sorted(tuple(_norm(r[c]) for c in order) for r in sdf.collect())
    idx = [rel.columns.index(c) for c in order]
    drows = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert srows == drows


def test_every_oracle_has_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["MANU", "TARGET", "proportion"]
    assert df.count() >= 0
