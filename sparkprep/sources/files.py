"""Folder scan with routing by file-name token, CSV scans with extra
NA tokens / encodings / quoted multi-line text, and stage read / write.

CSV is read with an all-string schema first so that every NA token is
handled the same way in every column, then typed with ``try_cast`` (a bad
value becomes NULL rather than failing the job).  A file is read by several
tasks whether or not its quoted fields hold line breaks
(:mod:`sparkprep.sources.csv_records`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.sources.csv_records import ENCODINGS, has_quoted_breaks, read_records

# Extra NA spellings the reference adds for its main table (fixed values).
MAIN_NA_TOKENS = ("n/a", "na", "-", "<NA>", "Na", "None", "none")


def _string_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             na_tokens: Sequence[str] = (), encoding: str = "UTF-8", multiline: bool = True,
             glob: str | None = None, position_col: str | None = None, splittable: bool = True) -> DataFrame:
    """Header CSV; ``na_tokens`` (beyond the empty field) become NULL.

    ``multiline`` allows line breaks inside quoted fields.  One scan tells if
    there are any: without them every line is a record, with them
    :func:`read_records` puts the records together, so several tasks share a file either
    way.  Other encodings than ``ENCODINGS``, and ``splittable=False`` (for quotes inside unquoted fields), are read by
    one task per file.

    ``position_col`` adds the row's position in file order, a struct of file
    path, offset of the split and id within the scan, for
    operators whose result follows input order (first row per key, string
    collapse)."""
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    cut = multiline and splittable and encoding.upper() in ENCODINGS
    breaks = cut and has_quoted_breaks(spark, path, encoding, glob)
    reader = (spark.read.option("header", True).option("encoding", encoding)
              .option("multiLine", bool(breaks if cut else multiline)).options(**options))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if schema is not None:
        reader = reader.schema(_string_schema(schema))
    df = reader.csv(path)
    if breaks:
        df = read_records(spark, path, df.columns, options, encoding, glob)
        if not position_col:
            df = df.drop("_file", "_start", "_id")
    elif position_col:  # a scan packs files into tasks by size, so ids alone don't follow the files' order
        df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                       F.monotonically_increasing_id().alias("_id"))
    tokens = list(na_tokens)
    if tokens:
        df = df.withColumns({c: F.when(~F.coalesce(F.col(c).isin(tokens), F.lit(False)), F.col(c))
                             for c in df.columns if not position_col or c not in ("_file", "_start", "_id")})
    if schema is not None:
        df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields],
                       *(["_file", "_start", "_id"] if position_col else []))
    if position_col:
        df = df.withColumn(position_col, F.struct("_file", "_start", "_id")).drop("_file", "_start", "_id")
    return df


def scan_folder(spark: SparkSession, folder: str, routes: Mapping[str, str],
                schemas: Mapping[str, T.StructType] | None = None,
                options: Mapping[str, Mapping] | None = None) -> dict[str, DataFrame]:
    """One DataFrame per logical table; a ``*.csv`` entry of the folder
    (a file, or a folder of part files) belongs to the table whose token
    occurs in its name.  Entries matching no token are ignored.  Each table
    is a single multi-file scan over a path glob."""
    out = {}
    base = folder.rstrip("/")
    for table, token in routes.items():
        opts = dict((options or {}).get(table, {}))
        out[table] = read_csv(spark, f"{base}/*{token}*.csv", schema=(schemas or {}).get(table), **opts)
    return out


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """Re-read a stage output (Parquet keeps the types)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return read_csv(spark, path, schema=schema)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", encoding: str = "UTF-8") -> str:
    """Overwrite a stage output; CSV gets a header and no index column."""
    w = df.write.mode("overwrite")
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).option("encoding", encoding).option("quote", '"') \
            .option("escape", '"').csv(path)
    return path
