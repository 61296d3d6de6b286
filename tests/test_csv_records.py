"""Quoted line breaks across the byte ranges of one file, against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkprep.sources.files import read_csv, read_stage, write_stage


def _text(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["k", "note", "more"], *rows])
    return out.getvalue()


def _rows(seed, n):
    rng = random.Random(seed)
    bits = ["a", "é", ",", '"', "\n", "\n\n", " ", "line", '""', "\\", "x,y", "'"]
    return [[str(i), "".join(rng.choices(bits, k=rng.randrange(0, 12))), "".join(rng.choices(bits, k=rng.randrange(0, 5)))] for i in range(n)]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_ranges(small_splits, tmp_path, encoding, end):
    spark = small_splits
    want = {}
    for f in range(2):
        rows = [[f"{f}-{r[0]}", *r[1:]] for r in _rows(f, 200)]
        rows[100][1] = "long\n" * 700  # one record over several ranges
        (tmp_path / f"{f}.csv").write_bytes(_text(rows, end).encode(encoding))
        want |= {r[0]: (r[1] or None, r[2] or None) for r in rows}
    df = read_csv(spark, str(tmp_path), encoding=encoding, position_col="_pos")
    got = df.collect()
    assert len(got) == len(want) and {r["k"]: (r["note"], r["more"]) for r in got} == want
    assert spark.read.text(str(tmp_path / "0.csv")).rdd.getNumPartitions() > 5
    assert [r["k"] for r in sorted(got, key=lambda r: r["_pos"])] == list(want)  # file order


def test_windows_hold_a_chunk_of_a_split(spark, tmp_path, monkeypatch):
    """One split of many chunks: records inside a chunk, over a border and over several chunks."""
    from sparkprep.sources import csv_records
    monkeypatch.setattr(csv_records, "CHUNK_BITS", 3)
    rows = _rows(7, 400)
    rows[0][1], rows[200][1] = "top\nline", "long\n" * 50
    (tmp_path / "a.csv").write_text(_text(rows).replace("k,note,more", 'k,"no\nte",more', 1))
    df = read_csv(spark, str(tmp_path), position_col="_pos")
    assert [tuple(r)[:3] for r in sorted(df.collect(), key=lambda r: r["_pos"])] == [(r[0], r[1] or None, r[2] or None) for r in rows]


def test_files_without_breaks_are_plain_scans(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text(_text([[str(i), "p, q", 'say "x"'] for i in range(500)]))
    df = read_csv(small_splits, str(tmp_path))
    assert df.rdd.getNumPartitions() > 5
    assert df.where(F.col("note") == "p, q").where(F.col("more") == 'say "x"').count() == 500


def test_same_rows_as_one_task_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(_text(_rows(9, 300)) + "\n\n")
    one = read_csv(spark, str(tmp_path), splittable=False)
    assert sorted(map(str, one.collect())) == sorted(map(str, read_csv(spark, str(tmp_path)).collect()))


def test_misplaced_quotes_are_errors(spark, tmp_path):
    (tmp_path / "open.csv").write_text('k,note\n1,"never closed\n2,b\n')
    with pytest.raises(ValueError, match="inside a quoted field"):
        read_csv(spark, str(tmp_path / "open.csv"))
    (tmp_path / "stray.csv").write_text('k,note\n1,5" pipe\n2,6" pipe\n')
    with pytest.raises(PySparkException, match="unquoted field"):
        read_csv(spark, str(tmp_path / "stray.csv")).collect()
    assert read_csv(spark, str(tmp_path / "stray.csv"), splittable=False).count() == 2


def test_stage_with_breaks(spark):
    import tempfile
    df = spark.range(50).select("id", F.concat(F.lit("a\nb"), F.col("id").cast("string")).alias("t"))
    path = write_stage(df, tempfile.mkdtemp(prefix="sparkprep-csvstage-") + "/x", "csv")
    assert sorted(map(tuple, read_stage(spark, path, "csv", df.schema).collect())) == sorted(map(tuple, df.collect()))
