"""Corpus pipeline: quality filter, line dedup, near-duplicates, benchmark
decontamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works
on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import decontaminate, line_dedup, packing, quality, simhash
from sparkprep.llm.common import free_name
from sparkprep.session import shared_path


def row_id() -> Column:
    """The document's id; a null id is replaced by a negative hash of the text,
    so that documents without an id are neither mixed up nor lost."""
    stand_in = -1 - F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)
    return F.coalesce(F.col("doc_id").cast("long"), stand_in)


def row_key() -> Column:
    """A row by its id and text: rows that only share an id are told apart."""
    return F.xxhash64(row_id(), F.coalesce("text", F.lit("")))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines; n_chars follows the text."""
    kind = docs.schema["n_chars"].dataType
    out = line_dedup.drop_recurring_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash group; one row of repeated rows (same id and text)."""
    key = free_name([*docs.columns, "component_id", "first", "_id"], "_key")
    rows = docs.withColumn(key, row_key())
    groups = simhash.simhash_groups(rows.select(key, "text"), id_col=key).select(key, "component_id").distinct()
    first = F.min(F.struct(F.col("_id"), F.col(key)))
    keep = (groups.join(rows.select(key, row_id().alias("_id")), key)
            .groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{key}").alias(key)))
    return rows.join(keep, key).dropDuplicates([key]).select(*docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark text."""
    key = free_name(docs.columns, "_key")
    rows = docs.withColumn(key, row_key())
    leaks = decontaminate.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return rows.join(leaks.select(key).distinct(), key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality_filter), ("line_dedup", line_filter), ("simhash", near_duplicates),
          ("decontamination", benchmark_filter), ("packing", pack)]

#: The stages' models, hashes and token ids can't be written in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the table ``documents``; each result is
    written in the session's shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
