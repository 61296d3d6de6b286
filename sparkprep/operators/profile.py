"""Column profiling and target-by-feature summaries.

Multi-column profiles take a *list* of columns and scan the data once
(the reference ran one pass per column).  Grouped results use partial
aggregation; totals that a ratio needs come from a one-row aggregate that
is joined on a constant key (a broadcast of one row).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.exprs import hash_hex, np_round
from sparkprep.operators.order import attach_row, quantile_summary, rank_within


def _unpivot_struct(one_row: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*rows)))


def table_shape(df: DataFrame) -> DataFrame:
    """A3: (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: (column, min, max) per column in one pass."""
    one = df.agg(*[F.min(c).alias(f"mn{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"mx{i}") for i, c in enumerate(cols)])
    same = len({df.schema[c].dataType.simpleString() for c in cols}) == 1
    conv = (lambda x: x) if same else (lambda x: x.cast("string"))
    rows = [F.struct(F.lit(c).alias("column_name"), conv(F.col(f"mn{i}")).alias("min"),
                     conv(F.col(f"mx{i}")).alias("max")) for i, c in enumerate(cols)]
    return _unpivot_struct(one, rows)


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A5: (column, missing, pct) with pct = 100 * missing / rows."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                     F.col(f"m{i}").alias("missing"),
                     F.try_divide(F.col(f"m{i}") * 100.0, F.col("_n")).alias("pct"))
            for i, c in enumerate(cols)]
    return _unpivot_struct(one, rows)


def missing_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """How often each NULL mask occurs; mask = one '1'/'0' per column."""
    cols = list(cols or df.columns)
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("count"))


def _stack(df: DataFrame, cols: Sequence[str], value_type: str = "string",
           keep: Sequence[str] = ()) -> DataFrame:
    """Long form (column_name, value) of ``cols``, one output row per cell."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast(value_type).alias("value"))
             for c in cols]
    return df.select(*keep, F.inline(F.array(*pairs)))


def unique_profile(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-NULL values per column.

    Exact: cells are unpivoted and de-duplicated per (column, value) with
    map-side combine, then counted per column: a single shuffle whatever the
    number of columns.  ``approx=True`` uses HyperLogLog++ in one pass.
    """
    cols = list(cols or df.columns)
    if approx:
        one = df.agg(*[F.approx_count_distinct(c).alias(f"u{i}") for i, c in enumerate(cols)])
        rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"u{i}").alias("n_unique"))
                for i, c in enumerate(cols)]
        return _unpivot_struct(one, rows)
    cells = _stack(df, cols).where(F.col("value").isNotNull()).distinct()
    counted = cells.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(counted, "column_name", "left").select(
        "column_name", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"))


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """Counts (or proportions) per value, descending, NULL skipped."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return counts.orderBy(F.col("count").desc(), F.col(col))
    total = counts.agg(F.sum("count").alias("_total"))
    return (attach_row(counts, total)
            .select(col, (F.col("count") / F.col("_total")).alias("proportion"))
            .orderBy(F.col("proportion").desc(), F.col(col)))


def category_report(df: DataFrame, col: str) -> DataFrame:
    """Per value: count and proportion; plus the column's distinct count
    and missing count on every row.  One grouped pass."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    summary = counts.agg(
        F.sum(F.when(F.col(col).isNotNull(), F.col("count"))).alias("_present"),
        F.count(F.col(col)).alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col(col).isNull(), F.col("count"))), F.lit(0)).alias("n_missing"))
    return (attach_row(counts.where(F.col(col).isNotNull()), summary)
            .select(F.col(col).alias("value"), "count",
                    (F.col("count") / F.col("_present")).alias("proportion"),
                    "n_distinct", F.col("n_missing").cast("bigint").alias("n_missing")))


def grouped_counts(df: DataFrame, by: str, target: str) -> DataFrame:
    """Rows per (group, target); NULL keys are skipped (pandas groupby)."""
    return df.dropna(subset=[by, target]).groupBy(by, target).agg(F.count(F.lit(1)).alias("count"))


def grouped_proportions(df: DataFrame, by: str, target: str) -> DataFrame:
    """Share of each target value within its group.  The window runs
    over the aggregated (group, target) table, one small partition per group."""
    counts = grouped_counts(df, by, target)
    w = Window.partitionBy(by)
    return counts.select(by, target, (F.col("count") / F.sum("count").over(w)).alias("proportion"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std (sample), min, 25/50/75 % (linear), max per column.

    Two scans of the long form: the moments come with the quartiles' brackets,
    the second scan selects the quartiles (:func:`exact_quantiles`).
    """
    long = _stack(df, cols, "double").where(F.col("value").isNotNull())
    spread = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")]
    moments, q = quantile_summary(long, "value", [0.25, 0.5, 0.75], ["column_name"], ["p25", "p50", "p75"], spread)
    return moments.join(q, "column_name").select(
        "column_name", F.col("_n").alias("count"), "mean", "std", F.col("_min").alias("min"), "p25", "p50", "p75", F.col("_max").alias("max"))


def continuous_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Describe + missing count and percent."""
    miss = missing_profile(df, cols).select("column_name", "missing", "pct")
    return describe(df, cols).join(miss, "column_name")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max]; the max lands in the last bin.

    Empty bins are listed with count 0 (the bin list is ``bins`` rows long).
    """
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    binned = (attach_row(df.where(x.isNotNull()).select(x.alias("_x")), rng)
              .select(F.when(span == 0, F.lit(1)).otherwise(
                  F.least(F.floor((F.col("_x") - F.col("_lo")) / span * F.lit(bins)) + 1, F.lit(bins)))
                  .cast("int").alias("bin")))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    grid = attach_row(spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")), rng)
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("lower"),
                    (F.col("_lo") + F.col("bin") * width).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def density(df: DataFrame, col: str, grid_size: int = 200, bins: int = 1024, cut: float = 3.0,
            bw_adjust: float = 1.0) -> DataFrame:
    """Gaussian kernel density on a fixed grid (Scott bandwidth, grid over
    [min - cut*h, max + cut*h]).

    The data are pre-binned into ``bins`` equal-width bins (one pass, partial
    aggregation); the kernel sum runs over bins x grid points, a size fixed by
    the two parameters, not by the data.
    """
    x = F.col(col).cast("double")
    stats = df.where(x.isNotNull()).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp(x).alias("_sd"),
        F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    stats = stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)) * F.lit(bw_adjust))
    span = F.col("_hi") - F.col("_lo")
    binned = (attach_row(df.where(x.isNotNull()).select(x.alias("_x")), stats)
              .select(F.when(span == 0, F.lit(0)).otherwise(
                  F.least(F.floor((F.col("_x") - F.col("_lo")) / span * F.lit(bins)), F.lit(bins - 1)))
                  .cast("int").alias("_b"))
              .groupBy("_b").agg(F.count(F.lit(1)).alias("_c")))
    binned = attach_row(binned, stats)
    centre = F.col("_lo") + (F.col("_b") + 0.5) * span / F.lit(bins)
    g_lo = F.col("_lo") - F.lit(cut) * F.col("_h")
    g_step = (span + F.lit(2 * cut) * F.col("_h")) / F.lit(grid_size - 1)
    pts = binned.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("grid"))
    gx = g_lo + F.col("grid") * g_step
    u = F.try_divide(gx - centre, F.col("_h"))  # zero bandwidth (constant data): NULL density
    contrib = F.try_divide(F.col("_c") * F.exp(-0.5 * u * u),
                           F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    return (pts.groupBy("grid").agg(F.first(gx).alias("x"), F.sum(contrib).alias("density")))


def box_stats(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme data inside the fences),
    outlier count, per group.  Two scans: as the quartiles lie in known
    brackets, so do the fences; the second scan keeps the few values that may
    be on either side of a fence, and the least and greatest of those between."""
    by = list(by)
    base = df.select(*by, F.col(y).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    if by:
        base = base.dropna(subset=by)

    def intervals(quartiles):
        (lo1, hi1), _, (lo3, hi3) = quartiles
        low = (lo1 - 1.5 * (hi3 - lo1), hi1 - 1.5 * (lo3 - hi1))
        high = (lo3 + 1.5 * (lo3 - hi1), hi3 + 1.5 * (hi3 - lo1))
        return [low, *quartiles, high]

    iqr = F.col("q3") - F.col("q1")
    low_fence, high_fence = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    low, high = F.col("_low"), F.col("_high")
    whiskers = [F.min(F.when(low >= low_fence, low)).alias("whisker_low"), F.max(F.when(high <= high_fence, high)).alias("whisker_high"),
                F.coalesce(F.sum(F.when((high < low_fence) | (low > high_fence), F.col("_cnt"))), F.lit(0)).alias("outliers")]
    names = ["q1", "median", "q3"]
    q = quantile_summary(base, "_y", [0.25, 0.5, 0.75], by, names, edges=intervals, over_cells=[F.coalesce(F.sum("_cnt"), F.lit(0)).alias("count"), *whiskers])[1]
    return q.select(*by, "count", *names, "whisker_low", "whisker_high", "outliers")


def percent_counts(df: DataFrame, col: str, hue: str | None = None) -> DataFrame:
    """Counts by category (x hue) with percent of *all* rows."""
    keys = [col] + ([hue] if hue else [])
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return attach_row(counts, total).select(
        *keys, "count", (F.col("count") * 100.0 / F.col("_total")).alias("percent"))


def percent_counts_many(df: DataFrame, cols: Sequence[str], hue: str | None = None) -> DataFrame:
    """A22 over a list of columns via one unpivot and one group-by."""
    keep = [hue] if hue else []
    long = _stack(df, cols, "string", keep=keep)
    keys = ["column_name", "value"] + keep
    counts = long.dropna(subset=["value"] + keep).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return attach_row(counts, total).select(
        *keys, "count", (F.col("count") * 100.0 / F.col("_total")).alias("percent"))


def bar_values(df: DataFrame, x: str, y: str, hue: str | None = None, decimals: int = 2) -> DataFrame:
    """Mean of y by x (and hue), half-even rounded."""
    keys = [x] + ([hue] if hue else [])
    return df.dropna(subset=keys).groupBy(*keys).agg(np_round(F.avg(y), decimals).alias("mean"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation for every ordered pair (pairwise complete), one pass."""
    cols = list(cols)
    idx = {}
    aggs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            idx[(i, j)] = f"r{i}_{j}"
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(idx[(i, j)]))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                     F.col(idx[(min(i, j), max(i, j))]).alias("corr"))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return _unpivot_struct(one, rows)


def pair_sample(df: DataFrame, cols: Sequence[str], target: str, n: int, key: Sequence[str],
                seed: int = 0) -> DataFrame:
    """A bounded hash-ordered sample of rows (the limit is the feature),
    unpivoted into (x_name, y_name, x, y, target) for every column pair."""
    sample = (df.withColumn("_h", hash_hex(key, seed))
              .orderBy("_h", *key).limit(n))
    pairs = [F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"),
                      F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
             for a in cols for b in cols if a != b]
    return sample.select(*key, F.col(target).alias("target"), F.inline(F.array(*pairs)))


def options_list(df: DataFrame, col: str, all_label: str = "ALL") -> DataFrame:
    """Sorted distinct values with ``all_label`` first, as (position, value)."""
    vals = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("value")).distinct()
    ranked = rank_within(vals, ["value"], name="_r")
    spark = df.sparkSession
    head = spark.createDataFrame([(0, all_label)], "position bigint, value string")
    return head.unionByName(ranked.select((F.col("_r") + 1).alias("position"), "value"))


def class_share(df: DataFrame, label: str, positive=1) -> DataFrame:
    """Share of rows whose label equals ``positive``."""
    return df.agg(F.avg((F.col(label) == F.lit(positive)).cast("double")).alias("positive_share"))


def bivariate(df: DataFrame, ranking: DataFrame, n: int, target: str, task: str = "classification", sample: int | None = None,
              feature_col: str = "feature", score_col: str = "importance") -> DataFrame:
    """Target-vs-feature summaries for the top-``n`` ranked features.

    Dispatch by (task, column type): classification + numeric -> box summary
    by target; classification + categorical -> percent counts with the target
    as hue; regression -> box summary of the target by a categorical feature,
    or the (feature, target) pairs of all rows for a numeric one, or of
    ``sample`` rows picked by a hash of the whole row if asked for.
    Ranked names missing from ``df`` are reported with kind 'missing'.
    Output is one long table.  The features of a kind are summarized together
    in their long form: two scans for all box summaries, two for all counts.
    """
    top = [r[0] for r in ranking.orderBy(F.col(score_col).desc(), F.col(feature_col))
           .select(feature_col).limit(n).collect()]
    here = [f for f in top if f in df.columns]
    numeric = [f for f in here if isinstance(df.schema[f].dataType, T.NumericType)]
    other = [f for f in here if f not in numeric]
    box = ["feature", F.lit("box").alias("kind"), "group", "count", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers"]

    def long(cols, kind, name, *keep):
        pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias(name)) for f in cols]
        return df.select(*keep, F.inline(F.array(*pairs)))

    parts = []
    if task == "classification":
        if numeric:
            rows = long(numeric, "double", "_value", F.col(target).cast("string").alias("group"))
            parts.append(box_stats(rows, "_value", ["feature", "group"]).select(*box))
        if other:
            parts.append(percent_counts_many(df, other, target).select(
                F.col("column_name").alias("feature"), F.lit("count").alias("kind"), F.col(target).cast("string").alias("group"),
                F.col("value").alias("category"), "count", "percent"))
    else:
        if other:
            rows = long(other, "string", "group", F.col(target).cast("double").alias("_value"))
            parts.append(box_stats(rows, "_value", ["feature", "group"]).select(*box))
        if numeric:
            if sample is not None:
                df = df.withColumn("_h", F.xxhash64(*df.columns)).orderBy("_h", *df.columns).limit(sample)
            rows = long(numeric, "double", "x", F.col(target).cast("double").alias("y"))
            parts.append(rows.select("feature", F.lit("scatter").alias("kind"), "x", "y"))
    lost = [(f, "missing") for f in top if f not in here]
    if lost or not parts:
        parts.append(df.sparkSession.createDataFrame(lost, "feature string, kind string"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
