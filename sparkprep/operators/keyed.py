"""Key-level operators: A1 collapse, A2 symptom table, A8 - A11 duplicates,
J1 / J2 joins.

Key aggregations use partial (map-side) aggregation, so a hot key is
pre-reduced inside every task before the shuffle; nothing here uses a
window partitioned by the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.operators.columns import concat_cols, count_elements, regex_remove
from sparkprep.operators.order import join_small
from sparkprep.operators.schema import non_numeric_to_string
from sparkprep.session import cut_lineage


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


HOT_ROWS = 200_000   # rows of one key that one task orders at most, about (fixed value)
TRACKED_KEYS = 3_000  # keys that the search for large ones keeps count of, in every task (fixed value)


def hot_keys(df: DataFrame, key: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys with over ``hot_rows`` rows, about.

    Every task keeps a mergeable frequent-items sketch of ``TRACKED_KEYS``
    hashes (one scan, no shuffle of rows), so at most that many reach the driver.  Its
    counts are short by at most a fixed share of the rows (3.5 / 4,096), so a key with a
    larger share is always found.  The answer decides where work is split, never a result.
    """
    top = f"filter(approx_top_k(_h, {TRACKED_KEYS}, {TRACKED_KEYS}), t -> t.count > {int(hot_rows)}).item"
    return df.select(F.xxhash64(*key).alias("_h")).agg(F.expr(top).alias("hot")).first()["hot"] or []


def collapse_strings(df: DataFrame, key: Sequence[str] | str, col: str, order: Sequence[str],
                     sep: str = ",", new: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A1: one row per key; the key's strings joined with ``sep`` in ``order``.

    ``listagg ... WITHIN GROUP (ORDER BY ...)`` fixes the order explicitly, so
    the result does not depend on how the shuffle delivered the rows.  It
    holds and sorts all rows of a key in one task, so keys of over ``hot_rows``
    rows (:func:`hot_keys`) are cut into runs of the order first
    (:func:`key_runs`): each run is ordered and joined by its own task, then
    the runs' strings are joined in run order, which gives the same string.
    A key's result is one row as long as its input, which no plan can avoid.
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = new or col
    sep_sql = sep.replace("'", "''")

    def agg(c, order_cols):
        order_sql = ", ".join(_q(o) for o in order_cols)
        return F.expr(f"listagg({_q(c)}, '{sep_sql}') WITHIN GROUP (ORDER BY {order_sql})")

    hot = hot_keys(df, keys, hot_rows)
    if not hot:
        return df.groupBy(*keys).agg(agg(col, order).alias(out))
    rows = df.select(*dict.fromkeys([*keys, *order, col]))
    large = F.xxhash64(*keys).isin(hot)
    runs = key_runs(rows.where(large), keys, order, hot_rows)
    first = runs.groupBy(*keys, "_b").agg(agg(col, order).alias("_part"))
    joined = first.groupBy(*keys).agg(agg("_part", ["_b"]).alias(out))
    return rows.where(~large).groupBy(*keys).agg(agg(col, order).alias(out)).unionByName(joined)


def key_runs(df: DataFrame, key: Sequence[str], order: Sequence[str], run_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_b``: which run of its key's rows, in ``order``, a row is in; a run
    has about half of ``run_rows`` rows, and rows that are equal in ``order`` are
    in one run.

    The runs' bounds come from rows picked by a hash of key and order, some 50
    a run; they are cut to one array per key and joined onto the rows (measured first,
    broadcast if small).  So a key may have any number of rows, and nothing
    but its bounds passes through a task.
    """
    place = F.struct(*[F.col(o) for o in order])
    every = max(1, run_rows // 100)
    rows = df.withColumn("_h", F.xxhash64(*key))
    picked = rows.where(F.pmod(F.xxhash64("_h", *order), F.lit(every)) == 0)
    sample = picked.groupBy("_h").agg(F.array_sort(F.collect_set(place)).alias("_s"))
    ends = F.filter(F.col("_s"), lambda v, i: i % 50 == 49)
    bounds = cut_lineage(sample.select("_h", ends.alias("_ends")))
    at = F.when(F.size("_ends") > 0, _first_above(F.col("_ends"), place)).otherwise(0)
    return join_small(rows, bounds, ["_h"], "left").withColumn("_b", F.coalesce(at, F.lit(0))).drop("_h", "_ends")


def _first_above(ends: Column, x: Column) -> Column:
    """Entries of the sorted array ``ends`` that are not above ``x``, by halving: an interval of
    an array of n entries has one place left after the 21 steps if n is up to 2^20."""
    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        low = (acc["lo"] < acc["hi"]) & (F.get(ends, mid) <= x)
        return F.struct(F.when(low, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(low | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(ends).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(21)), start, step, lambda a: a["lo"])


def build_symptoms(df: DataFrame, key: str, parts: Mapping[str, Sequence[str]], order: Sequence[str],
                   count_col: str = "COUNT_SYMPT", compat: bool = True) -> DataFrame:
    """A2: T2 -> C1 -> C4 -> C5 -> A1 -> C6 in one shuffle (the A1 group-by).

    ``compat=True`` keeps the reference's text rule: blank parts become empty
    strings, runs of two or more separators are deleted (so ``a,,b,,`` turns
    into ``ab`` and ``a,b,c,d,`` keeps its trailing comma, which counts as an
    extra element).  ``compat=False`` joins only present parts.
    """
    (new, cols), = parts.items()
    df = non_numeric_to_string(df.select(key, *order, *cols)) if compat else df
    df = concat_cols(df, {new: cols}, blanks_as_empty=compat)
    if compat:
        df = regex_remove(df, new, ",,+")
    one = collapse_strings(df, key, new, order)
    return count_elements(one, new, count_col)


def first_per_key(df: DataFrame, key: Sequence[str] | str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order`` (pandas ``drop_duplicates``
    keeps the first row in file order; ``order`` makes that order explicit).

    ``min_by(struct(row), struct(order))`` is a partial aggregate: each task
    keeps one candidate per key before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    ordering = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(row, ordering).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Number of extra copies (rows minus distinct keys), one row."""
    cols = list(subset) if subset else df.columns
    per_key = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def duplicated_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """A10: every member of a key that occurs more than once (``keep=False``).

    Counted with a partial aggregate, then a null-safe semi join; no window
    holds a whole key.
    """
    keys = list(subset)
    dup = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > 1).drop("_n"))
    a, b = df.alias("_a"), dup.alias("_b")
    cond = None
    for c in keys:
        e = F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
        cond = e if cond is None else cond & e
    return a.join(b, cond, "left_semi")


def join_on_key(left: DataFrame, right: DataFrame, key: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Equi-join on the shared key; AQE picks broadcast (after a
    runtime size check) or sort-merge, and splits skewed partitions."""
    return left.join(right, on=key, how=how)
