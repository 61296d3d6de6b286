"""CSV whose quoted fields hold line breaks, read by as many tasks as the file
has splits.

A physical line lies inside a quoted field if the quotes before it in its file
are odd in number.  So the lines are read by Spark's line reader (which cuts
a file at any line), each chunk of a split counts its quotes, a running sum over the small
table of chunks tells the state at every chunk's start, and a window within the
chunk tells the state of each line.  Lines of one record are put together again,
also over a chunk's border, and every record is parsed by Spark's CSV parser.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.operators.order import join_small
from sparkprep.session import shared_path

# Encodings whose line feed and quote are single bytes that no other character holds (name -> name for ``decode``).
ENCODINGS = {"UTF-8": None, "UTF8": None, "US-ASCII": None, "ISO-8859-1": "ISO-8859-1", "LATIN-1": "ISO-8859-1", "LATIN1": "ISO-8859-1"}

CHUNK_BITS = 14        # 2 ** CHUNK_BITS lines of a split share a window (fixed value)
TASK_LINES = 1 << 18   # lines of a task, about (fixed value)


def lines_of(spark: SparkSession, path: str, encoding: str = "UTF-8", glob: str | None = None, line_sep: str | None = None) -> DataFrame:
    """The physical lines: ``value`` (decoded) and the columns of the files' metadata."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    lines, name = reader.text(path), ENCODINGS[encoding.upper()]
    return lines.withColumn("value", F.decode(F.col("value").cast("binary"), name)) if name else lines


def odd_quotes(line: Column) -> Column:
    return F.octet_length(line) % 2 != F.octet_length(F.replace(line, F.lit('"'), F.lit(""))) % 2


def has_quoted_breaks(spark: SparkSession, path: str, encoding: str = "UTF-8", glob: str | None = None) -> bool:
    """Does any line hold an odd number of quotes?  If none does, every line
    is a record.  One scan without a shuffle, ended by the first such line."""
    return not lines_of(spark, path, encoding, glob).where(odd_quotes(F.col("value"))).isEmpty()


def read_records(spark: SparkSession, path: str, names: Sequence[str], options: Mapping[str, object],
                 encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """The records of header CSV files as string columns ``names`` with their
    place in the files (``_file``, ``_start``, ``_id``).

    The lines are written to the shared folder once: their numbers are fixed
    then, whatever cluster later jobs run on.  A window holds a chunk of at most
    2 ** ``CHUNK_BITS`` lines of a split, a task about ``TASK_LINES`` lines, a group one record.  Records end with a
    line feed, with or without a carriage return before it; empty lines are skipped.

    A field that holds a quote must be quoted as a whole and double it.  A
    quote that is never closed, or one inside an unquoted field, would move the records'
    borders, so it is an error.
    """
    at = F.struct("_start", "_id")
    staged = shared_path(spark, "csv-lines")
    (lines_of(spark, path, encoding, glob, "\n")
     .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
             F.monotonically_increasing_id().alias("_id"), odd_quotes(F.col("value")).cast("int").alias("_odd"), "value")
     .write.parquet(staged))
    lines = spark.read.parquet(staged).withColumn("_chunk", F.shiftright("_id", CHUNK_BITS))
    chunk = ["_file", "_start", "_chunk"]
    order = Window.partitionBy("_file").orderBy("_start", "_chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # per chunk: is its start inside a quoted field, which line opened that, and which line opened the field it ends in
    chunks = (lines.groupBy(*chunk).agg(F.sum("_odd").alias("_n"), F.max(F.when(F.col("_odd") == 1, F.col("_id"))).alias("_last"))
              .withColumn("_last", F.when(F.col("_last").isNotNull(), F.struct("_start", F.col("_last").alias("_id"))))
              .select(*chunk, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_last", F.max("_last").over(before).alias("_opened"),
                      ((F.col("_start") == 0) & (F.row_number().over(order) == 1)).alias("_top"))
              .withColumn("_open", F.when((F.col("_before") + F.col("_n")) % 2 == 1, F.coalesce("_last", "_opened"))).drop("_last"))
    open_file = chunks.groupBy("_file").agg(F.sum("_n").alias("_n")).where("_n % 2 = 1").first()
    if open_file:
        raise ValueError(f"{open_file['_file']} ends inside a quoted field")
    tasks = max(-(-lines.count() // TASK_LINES), spark.sparkContext.defaultParallelism)
    here = Window.partitionBy(*chunk).orderBy("_id")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.col("_before") + F.coalesce(F.sum("_odd").over(earlier), F.lit(0))) % 2 == 1
    opened = F.max(F.when(F.col("_odd") == 1, at)).over(earlier)
    # every line with its record's first line; a record of one chunk is put together there, without another shuffle
    known = join_small(lines, chunks, chunk).repartition(tasks, *chunk).select(
        *chunk, "_id", "value", "_open", "_opened", inside.alias("_inside"), opened.alias("_own"),
        (F.col("_top") & (F.row_number().over(here) == 1)).alias("_head"))
    known = known.withColumn("_first", F.when(F.col("_inside"), F.coalesce("_own", "_opened")).otherwise(at))
    known = known.withColumn("_cross", F.coalesce(F.col("_first") == F.col("_open"), F.lit(False)) | (F.col("_inside") & F.col("_own").isNull()))

    def put_together(lines: DataFrame, by: Sequence[str]) -> DataFrame:
        return (lines.groupBy(*by, "_first").agg(F.expr("listagg(value, '\\n') WITHIN GROUP (ORDER BY _start, _id)").alias("_rec"), F.max("_head").alias("_head"))
                .where("not _head").select("_file", "_first._start", "_first._id", "_rec"))

    records = put_together(known.where("not _cross"), chunk).unionByName(put_together(known.where("_cross"), ["_file"]))
    rec = F.col("_rec")
    whole = records.withColumn("_rec", F.when(F.endswith(rec, F.lit("\r")), F.left(rec, F.length(rec) - 1)).otherwise(rec))
    plain = F.regexp_replace(rec, '"[^"]*"', "\x01")
    stray = F.contains(rec, F.lit('"')) & (F.rlike(plain, F.lit("[^,\x01]\x01")) | F.rlike(plain, F.lit("\x01[^,\x01]")))
    checked = F.when(stray, F.raise_error(F.concat(F.lit("quote inside an unquoted field (read with splittable=False): "), F.left(rec, F.lit(200))))).otherwise(rec)
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    parsed = F.from_csv(checked, schema, {k: str(v) for k, v in options.items()})
    return whole.where(rec != "").select(parsed.alias("_row"), "_file", "_start", "_id").select("_row.*", "_file", "_start", "_id")
