"""Reproducible splits and samples.

Row order comes from a seeded md5 of the key (:func:`hash_hex`), so the
chosen rows do not depend on partitioning and can be recomputed after an
executor loss.  Exact per-class sizes come from hash thresholds
(:func:`with_cuts`): the table itself is never shuffled or sorted.  Only the
per-class counts and thresholds (a few values per class) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.exprs import hash_hex, hash_int
from sparkprep.operators.order import HEX_DIGITS, rank_within

MAX_CLASSES = 10_000  # classes a label may have; more raise an error (fixed value)


def class_counts(df: DataFrame, label: str, most: int = MAX_CLASSES) -> dict:
    """Rows per class (driver-side dict).  A label with more than ``most``
    classes is an error: it is an identifier or a measure, not a class."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"column {label} has over {most} classes")
    return {r[0]: int(r[1]) for r in rows}


def approximate_mode(counts: Mapping, draws: int) -> dict:
    """Per-class allocation of ``draws`` proportional to ``counts``: floors,
    then the leftover units go to the largest fractional parts (ties to the
    first class in sorted order)."""
    classes = sorted(counts, key=lambda c: (c is None, c))
    total = sum(counts.values())
    cont = {c: counts[c] / total * draws for c in classes}
    alloc = {c: math.floor(cont[c]) for c in classes}
    left = draws - sum(alloc.values())
    for c in sorted(classes, key=lambda c: -(cont[c] - alloc[c])):
        if left <= 0:
            break
        alloc[c] += 1
        left -= 1
    return alloc


def stratified_test_counts(counts: Mapping, test_size: float) -> dict:
    """Per-class test rows of a stratified split: ``n_test = ceil(test_size * n)``,
    train allocated by :func:`approximate_mode`, test gets the rest."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    train = approximate_mode(counts, n - n_test)
    return {c: counts[c] - train[c] for c in counts}


def with_cuts(df: DataFrame, cuts: Mapping, seed, key: Sequence[str], label: str | None = None,
              names: Sequence[str] = ("_cut",)) -> DataFrame:
    """Add one boolean column per name: is the row among the first ``cut``
    rows of its class in seeded hash order?

    ``cuts`` maps a class to one cut per name (without ``label`` the only
    class is None; a class without an entry is cut at 0).  Rows are counted
    per (class, leading hash digits), which tells the one bucket that holds
    each cut; only that bucket's rows are ranked, to find the key at the cut.
    Every row is then compared with its class's threshold (a broadcast of one
    row per class), so the table is scanned, never shuffled.  Equal keys stay
    on one side of a cut, so exact sizes need unique keys.
    """
    spark = df.sparkSession
    kind = df.schema[label].dataType if label else T.StringType()
    cls = F.col(label) if label else F.lit(None).cast("string")
    place = F.struct(hash_hex(key, seed).alias("h"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)])
    rows = df.select(cls.alias("c"), place.alias("p")).withColumn("b", F.substring("p.h", 1, HEX_DIGITS))
    entry = T.StructType([T.StructField("c", kind), T.StructField("i", T.IntegerType()), T.StructField("cut", T.LongType())])
    wanted = F.broadcast(spark.createDataFrame(
        [(c, i, int(n)) for c, ns in cuts.items() for i, n in enumerate(ns)], entry)).alias("w")
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"))
    buckets = buckets.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("t")
    holds = F.col("t.c").eqNullSafe(F.col("w.c")) & (F.col("cut") >= F.col("off")) & (F.col("cut") < F.col("off") + F.col("n"))
    hit = buckets.join(wanted, holds).select("t.c", "t.b", "i", (F.col("cut") - F.col("off")).alias("at")).collect()
    there = T.StructType([T.StructField("c", kind), T.StructField("b", T.StringType()), T.StructField("at", T.ArrayType(T.LongType()))])
    by_bucket: dict[tuple, list] = {}
    for r in hit:
        by_bucket.setdefault((r["c"], r["b"]), []).append((r["i"], r["at"]))
    edge = F.broadcast(spark.createDataFrame([(c, b, [at for _, at in v]) for (c, b), v in by_bucket.items()], there)).alias("e")
    near = rows.alias("r").join(edge, F.col("r.c").eqNullSafe(F.col("e.c")) & (F.col("r.b") == F.col("e.b")))
    near = near.select("r.c", "r.b", "p", "at").withColumn(
        "rn", (F.row_number().over(Window.partitionBy("c", "b").orderBy("p")) - 1).cast("long"))
    found = {(r["c"], r["b"], r["rn"]): r["p"] for r in near.where(F.array_contains("at", F.col("rn"))).collect()} if hit else {}
    point = {(c, i): found[c, b, at] for (c, b), v in by_bucket.items() for i, at in v}
    # a class without a threshold at a cut is smaller than the cut: all its rows are before it
    bound = T.StructType([T.StructField("_c", kind), T.StructField("_known", T.BooleanType()),
                          *[T.StructField(f"_t{i}", rows.schema["p"].dataType) for i in range(len(names))]])
    limits = F.broadcast(spark.createDataFrame(
        [(c, True, *[point.get((c, i)) for i in range(len(ns))]) for c, ns in cuts.items()], bound))
    out = df.withColumns({"_c0": cls, "_p": place}).join(limits, F.col("_c0").eqNullSafe(F.col("_c")), "left")
    return out.select(*df.columns, *[
        (F.col("_known").isNotNull() & F.coalesce(F.col("_p") < F.col(f"_t{i}"), F.lit(True))).alias(n)
        for i, n in enumerate(names)])


def split_stratified(df: DataFrame, label: str, test_size: float, seed, key: Sequence[str],
                     split_col: str = "split") -> DataFrame:
    """train/test split with exact per-class test counts."""
    tests = stratified_test_counts(class_counts(df, label), test_size)
    cut = with_cuts(df, {c: [n] for c, n in tests.items()}, seed, key, label)
    return cut.withColumn(split_col, F.when(F.col("_cut"), "test").otherwise("train")).drop("_cut")


def split_random(df: DataFrame, test_size: float, seed, key: Sequence[str],
                 split_col: str = "split") -> DataFrame:
    """Plain split; exactly ``ceil(test_size * n)`` test rows."""
    n_test = math.ceil(test_size * df.count())
    cut = with_cuts(df, {None: [n_test]}, seed, key)
    return cut.withColumn(split_col, F.when(F.col("_cut"), "test").otherwise("train")).drop("_cut")


def split_three(df: DataFrame, label: str, test_size: float, valid_size: float, seed,
                key: Sequence[str], split_col: str = "split") -> DataFrame:
    """Stratified test split, then a stratified validation split of the rest
    (``valid_size`` is a share of the remaining train rows).  One pass of cuts:
    test takes the first cut of each class, validation the next one."""
    counts = class_counts(df, label)
    tests = stratified_test_counts(counts, test_size)
    rest = {c: counts[c] - tests[c] for c in counts}
    valids = stratified_test_counts(rest, valid_size)
    cut = with_cuts(df, {c: [tests[c], tests[c] + valids[c]] for c in counts}, seed, key, label, ("_test", "_valid"))
    return cut.withColumn(
        split_col, F.when(F.col("_test"), "test").when(F.col("_valid"), "valid").otherwise("train")
    ).drop("_test", "_valid")


def sample_proportional(df: DataFrame, label: str, n: int, seed, key: Sequence[str],
                        order_col: str = "sample_order") -> DataFrame:
    """``floor(n * n_c / total)`` rows per class (so fewer than ``n`` in
    total is possible, as in the reference), then shuffled: ``order_col`` is
    a second seeded hash giving the shuffled order."""
    counts = class_counts(df, label)
    total = sum(counts.values())
    cut = with_cuts(df, {c: [int(n * counts[c] / total)] for c in counts}, seed, key, label)
    return cut.where("_cut").drop("_cut").withColumn(order_col, hash_hex(key, f"{seed}s"))


def sample_n(df: DataFrame, n: int, seed, key: Sequence[str], order_col: str = "sample_order") -> DataFrame:
    """``n`` rows chosen by seeded hash order (per-task top-n, then merged)."""
    return (df.withColumn(order_col, hash_hex(key, seed))
            .orderBy(order_col, *key).limit(n))


def kfold(df: DataFrame, k: int, seed, key: Sequence[str], label: str | None = None,
          fold_col: str = "fold") -> DataFrame:
    """Fold numbers 0..k-1.  Plain: seeded hash modulo k.  Stratified:
    position within the class in hash order, modulo k (class shares equal in
    every fold up to one row)."""
    if label is None:
        return df.withColumn(fold_col, F.pmod(hash_int(key, seed), F.lit(k)).cast("int"))
    ranked = rank_within(df.withColumn("_h", hash_hex(key, seed)), ["_h", *key], [label], name="_rk", hashed=True)
    return ranked.withColumn(fold_col, F.pmod(F.col("_rk"), F.lit(k)).cast("int")).drop("_h", "_rk")


def stratified_folds(df: DataFrame, k: int, seed, key: Sequence[str], label: str,
                     fold_col: str = "fold") -> DataFrame:
    """X6 without a rank per row: fold ``floor(position * k / class size)`` of
    the position in the class's seeded hash order, so a class's folds differ by one
    row at most.  Folds are the hash ranges between k - 1 cuts per class
    (:func:`with_cuts`), so the table is scanned and never shuffled, unlike
    :func:`kfold` with a label, which deals the same order out in turn."""
    names = [f"_f{j}" for j in range(1, k)]
    cuts = {c: [-(-j * n // k) for j in range(1, k)] for c, n in class_counts(df, label).items()}
    cut = with_cuts(df, cuts, seed, key, label, names)
    before = [F.when(F.col(n), 0).otherwise(1) for n in names]
    return cut.withColumn(fold_col, sum(before, F.lit(0)).cast("int")).drop(*names)
