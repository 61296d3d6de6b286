"""Order-dependent operators: sorting, head/tail, shuffling, appends, and the
distributed ordering primitives the rest of the package builds on.

``row_number() OVER (PARTITION BY label ORDER BY h)`` moves every row of a
label into one task; with two classes that is half the table in one sort.
The primitives below instead cut the order key into deterministic,
order-preserving buckets, number rows per (group, bucket) in parallel, and
stitch the buckets together with a small per-(group, bucket) offset table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.exprs import hash_hex
from sparkprep.session import cut_lineage


MAX_BROADCAST_ROWS = 1_000_000  # per-group tables broadcast up to this many rows (fixed value)
MAX_BROADCAST_BYTES = 64 << 20  # ... and this many bytes as JSON text (fixed value)


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
               null_safe: bool = False) -> DataFrame:
    """Join a per-group table onto a large one.  The small side is measured
    first and broadcast only when it has at most ``MAX_BROADCAST_ROWS`` rows
    and ``MAX_BROADCAST_BYTES`` bytes, however wide its rows; otherwise a shuffle join is planned (AQE splits skewed partitions).
    ``null_safe`` matches NULL keys to NULL keys."""
    rows, size = small.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    fits = rows <= MAX_BROADCAST_ROWS and (size or 0) <= MAX_BROADCAST_BYTES
    right = F.broadcast(small) if fits else small
    keys = list(keys)
    if not null_safe:
        return big.join(right, keys, how)
    a, b = big.alias("_big"), right.alias("_small")
    cond = reduce(lambda p, q: p & q, [F.col(f"_big.{k}").eqNullSafe(F.col(f"_small.{k}")) for k in keys])
    other = [c for c in small.columns if c not in keys]
    return a.join(b, cond, how).select("_big.*", *[F.col(f"_small.{c}") for c in other])


def local_table(df: DataFrame, most: int):
    """(table, its rows as an Arrow table) of an aggregate of up to ``most``
    rows, which passes through the driver; a larger one is written to the
    shared folder: (table, None)."""
    out = df.persist()
    try:
        rows = out.limit(most + 1).toArrow()
        if rows.num_rows > most:
            return cut_lineage(out), None
        return df.sparkSession.createDataFrame(rows, out.schema), rows
    finally:
        out.unpersist()


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate (a total, a range, a set of
    moments) to every row.  The row is computed once and its values become
    typed literals, so the plan has no join at all (an empty aggregate gives
    NULLs)."""
    row = one_row.first()
    vals = {}
    for f in one_row.schema.fields:
        v = None if row is None else row[f.name]
        vals[f.name] = F.lit(v).cast(f.dataType)
    return df.withColumns(vals)


HEX_DIGITS = 4            # 16**4 hash buckets for hash-ordered ranks (fixed value)
BUCKETS_PER_PARTITION = 4  # numeric / generic buckets per shuffle partition (fixed value)
MAX_NUMERIC_BUCKETS = 65536
MAX_GENERIC_BUCKETS = 256


def _default_buckets(df: DataFrame, cap: int) -> int:
    """Bucket count from ``spark.sql.shuffle.partitions`` (which a cluster
    sizes to its data), so each bucket stays a task-sized slice."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(cap, BUCKETS_PER_PARTITION * parts))


def _bucket_tree(key: Column, bounds: list, lo: int, hi: int) -> Column:
    """Bucket index in [lo, hi] by binary search over literal bounds."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi + 1) // 2
    return F.when(key < bounds[mid - 1], _bucket_tree(key, bounds, lo, mid - 1)).otherwise(
        _bucket_tree(key, bounds, mid, hi))


def with_bucket(df: DataFrame, order_by: Sequence[str], hashed: bool = False,
                buckets: int | None = None) -> DataFrame:
    """Add ``_b``: a deterministic, order-preserving bucket of the order key.

    * ``hashed``: the first order column is an md5 hex string (uniform), so
      its leading hex digits are the bucket; no pass over the data.
    * one numeric order column: quantile splits from ``approxQuantile``
      (computed once; literals afterwards), applied by ``Bucketizer``.
    * otherwise: bounds from a seeded sample of the key (at most
      ``MAX_GENERIC_BUCKETS``), applied as a literal binary-search expression.

    Because the bucket is an ordinary deterministic column, every branch of
    a plan (and any recomputation after an executor loss) sees the same one.
    """
    order = list(order_by)
    if hashed:
        return df.withColumn("_b", F.conv(F.substring(F.col(order[0]), 1, HEX_DIGITS), 16, 10).cast("int"))
    dtype = df.schema[order[0]].dataType
    if len(order) == 1 and isinstance(dtype, T.NumericType):
        from pyspark.ml.feature import Bucketizer
        nb = buckets or _default_buckets(df, MAX_NUMERIC_BUCKETS)
        probs = [i / nb for i in range(1, nb)]
        qs = df.approxQuantile(order[0], probs, 1.0 / (4 * nb)) if probs else []
        inner = sorted({float(q) for q in qs if q is not None}) or [0.0]  # empty input: one split
        splits = [float("-inf")] + inner + [float("inf")]
        tmp = df.withColumn("_bx", F.col(order[0]).cast("double"))
        out = Bucketizer(splits=splits, inputCol="_bx", outputCol="_bd", handleInvalid="keep").transform(tmp)
        return out.withColumn("_b", F.col("_bd").cast("int")).drop("_bx", "_bd")
    nb = buckets or _default_buckets(df, MAX_GENERIC_BUCKETS)
    n = df.count()
    frac = min(1.0, 20.0 * nb / max(n, 1))
    sample = [tuple(r) for r in df.select(*order).sample(False, frac, 17).orderBy(*order).collect()]
    step = max(1, len(sample) // nb)
    bounds = sample[step::step][: nb - 1]
    if not bounds:
        return df.withColumn("_b", F.lit(0))
    key = F.struct(*[F.col(c) for c in order])
    lits = [F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(b, order)])
            for b in bounds]
    return df.withColumn("_b", _bucket_tree(key, lits, 0, len(lits)))


def _join_offsets(rows: DataFrame, offs: DataFrame, part: Sequence[str]) -> DataFrame:
    """Join per-(group, bucket) offsets back onto the rows."""
    keys = [*part, "_b"]
    nullable = any(rows.schema[c].nullable for c in part)
    if not nullable:
        return rows.join(offs, keys, "inner")
    r, o = rows.alias("_r"), offs.alias("_o")
    cond = reduce(lambda a, b: a & b, [F.col(f"_r.{c}").eqNullSafe(F.col(f"_o.{c}")) for c in keys])
    other = [c for c in offs.columns if c not in keys]
    return r.join(o, cond, "inner").select("_r.*", *[F.col(f"_o.{c}") for c in other])


def rank_within(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                name: str = "_rank", hashed: bool = False, buckets: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row within its ``partition_by``
    group in ascending ``order_by`` order (a distributed ``row_number() - 1``).

    Rows are split into order-preserving buckets (:func:`with_bucket`); the
    window runs per (group, bucket), so even a group holding a third of the
    table is numbered by many tasks.  Offsets come from a per-(group,
    bucket) count table, its exclusive running sum, and a join.  Order keys
    should be non-NULL and unique for reproducible ranks.
    """
    part = list(partition_by)
    b = with_bucket(df, order_by, hashed, buckets)
    local = b.withColumn("_l", F.row_number().over(
        Window.partitionBy(*part, "_b").orderBy(*[F.col(c) for c in order_by])) - 1)
    counts = b.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*part, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = _join_offsets(local, offs, part)
    return out.withColumn(name, F.col("_off") + F.col("_l")).drop("_b", "_l", "_off")


def ordered_prefix_sums(df: DataFrame, order_by: Sequence[str], value_cols: Sequence[str],
                        partition_by: Sequence[str] = (), prefix: str = "cum_", pos_name: str | None = None,
                        buckets: int | None = None, materialize: bool = True) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ascending ``order_by``
    order, per group (use a negated column for descending order).

    Meant for pre-aggregated inputs (one row per distinct order key), e.g.
    per-score counts behind ROC / PR curves or per-value counts behind exact
    quantiles.  Same bucket scheme as :func:`rank_within`: a window per
    (group, bucket) plus offsets from a per-(group, bucket) totals table.
    ``pos_name`` adds the 0-based position within the group.

    The (pre-aggregated) input is read three times (bucket splits, window,
    totals), so by default it is checkpointed once to the shared checkpoint
    folder instead of being recomputed from the raw table each time.
    """
    part = list(partition_by)
    if materialize:
        df = cut_lineage(df)
    b = with_bucket(df, order_by, False, buckets)
    w = Window.partitionBy(*part, "_b").orderBy(*[F.col(c) for c in order_by])
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.select("*", *[F.sum(v).over(running).alias(f"_c_{v}") for v in value_cols],
                     (F.row_number().over(w) - 1).alias("_c__n"))
    totals = b.groupBy(*part, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols],
                                       F.count(F.lit(1)).alias("_t__n"))
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*part, "_b", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}")
                                        for v in [*value_cols, "_n"]])
    out = _join_offsets(local, offs, part)
    cols = [(F.col(f"_o_{v}") + F.col(f"_c_{v}")).alias(f"{prefix}{v}") for v in value_cols]
    if pos_name:
        cols.append((F.col("_o__n") + F.col("_c__n")).alias(pos_name))
    keep = [c for c in df.columns]
    return out.select(*keep, *cols)


ACCURACY = 5000        # of the quantile summaries; a bracket spans four in so many of a group's rows (fixed value)
CELL_ROWS = 100_000    # rows that are sorted at a time, about (fixed value)
MAX_LOCAL_GROUPS = 10_000  # groups whose brackets and results pass through the driver (fixed value)
SORTED_CELLS = 2_000_000  # selected rows of all groups that are sorted by group alone (fixed value)


def quantile_brackets(df: DataFrame, value_col: str, probs: Sequence[float], by: Sequence[str] = (),
                      also: Sequence[Column] = ()) -> tuple[DataFrame, list | None]:
    """First scan: per group ``_n``, ``_min``, ``_max``, the aggregates
    ``also`` and for the i-th of ``probs`` a bracket (``_lo<i>``, ``_hi<i>``)
    around the ranks that it asks for.

    The brackets come from mergeable quantile summaries (one per task and
    group, merged after the shuffle, of a size set by ``ACCURACY`` whatever
    the rows), read a margin below and above the rank.  A group of few rows
    is its own bracket.  Up to ``MAX_LOCAL_GROUPS`` groups become a local
    table, and their sizes are returned, too; more are written to the shared folder.
    """
    x = F.col(value_col)
    asked = [q for p in probs for q in (max(p - 2 / ACCURACY, 0.0), min(p + 2 / ACCURACY, 1.0))]
    agg = df.where(x.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min(x).alias("_min"), F.max(x).alias("_max"),
        F.percentile_approx(x, asked, ACCURACY).alias("_q"), *also)
    few = F.col("_n") <= 2 * ACCURACY
    ends = {}
    for i in range(len(probs)):
        for j, (name, end) in enumerate((("_lo", "_min"), ("_hi", "_max"))):
            whole = few | F.lit(asked[2 * i + j] in (0.0, 1.0))
            ends[f"{name}{i}"] = F.when(whole, F.col(end)).otherwise(F.col("_q")[2 * i + j])
    out, rows = local_table(agg.withColumns(ends).drop("_q"), MAX_LOCAL_GROUPS)
    return out, None if rows is None else rows["_n"].to_pylist()


def rank_cells(df: DataFrame, value_col: str, by: Sequence[str], brackets: DataFrame,
               edges: Sequence[tuple[Column, Column]], local: bool = False, cut: bool = True) -> DataFrame:
    """Second scan: count and select.  ``edges`` are intervals (low, high)
    over the columns of ``brackets``.  A value inside an interval is kept with
    its count; values between intervals are only counted.

    Returns (by, ``_slot``, ``_sub``, ``_v``, ``_cnt``, ``_low``, ``_high``):
    ordering by (_slot, _sub, _v) is ordering by value; odd slots are inside
    and hold single values, even ones have a NULL ``_v`` and their least and
    greatest value.  Of a large group an interval is cut in parts of equal
    width (``_sub``) of about ``CELL_ROWS`` rows.  What is not selected never
    leaves its task but as a count.  ``local``: the brackets are few;
    without ``cut`` no interval is cut in parts.
    """
    by, x = list(by), F.col(value_col)
    names = [(f"_e{i}", f"_f{i}") for i in range(len(edges))]
    ends = {n: e for pair, edge in zip(names, edges) for n, e in zip(pair, edge)}
    limits = brackets.select(*by, F.ceil(F.col("_n") * (4 / ACCURACY) / CELL_ROWS).alias("_parts"), *[e.alias(n) for n, e in ends.items()])
    rows = df.where(x.isNotNull()).select(*by, x.alias("_x"))
    if not by:
        rows = attach_row(rows, limits)
    elif local:
        a, b = rows.alias("_a"), F.broadcast(limits).alias("_b")
        same = reduce(lambda p, q: p & q, [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in by])
        rows = a.join(b, same).select("_a.*", "_b._parts", *[f"_b.{n}" for n in ends])
    else:
        rows = join_small(rows, limits, by, null_safe=True)
    slot, part, x = F, F, F.col("_x")
    for i, (lo, hi) in enumerate(names):
        slot = slot.when(x < F.col(lo), 2 * i).when(x <= F.col(hi), 2 * i + 1)
        width = F.col(hi).cast("double") - F.col(lo).cast("double")
        at = F.floor((x.cast("double") - F.col(lo).cast("double")) / width * F.col("_parts"))
        even = (F.col("_parts") > 1) & (width > 0) & (width < float("inf"))
        part = part.when(F.col("_slot") == 2 * i + 1, F.when(even, F.least(F.greatest(at, F.lit(0)), F.col("_parts") - 1)).otherwise(F.lit(0)))
    inside = F.col("_slot") % 2 == 1
    rows = rows.withColumn("_slot", slot.otherwise(2 * len(edges))).withColumn("_sub", part.otherwise(F.lit(0)) if cut else F.lit(0))
    return rows.withColumn("_v", F.when(inside, x)).groupBy(*by, "_slot", "_sub", "_v").agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))


def _places(probs: Sequence[float], names: Sequence[str]) -> dict:
    """Name -> (rank before, rank after, fraction) over the group size ``_total``."""
    at = {nm: (F.col("_total") - 1) * F.lit(float(p)) for p, nm in zip(probs, names)}
    return {nm: (F.floor(h), F.ceil(h), h - F.floor(h)) for nm, h in at.items()}


def _value_at(rank: Column) -> Column:
    """The value of the cell that holds a rank; ``_cl`` is the running count."""
    return F.max(F.when((F.col("_cl") - F.col("_cnt") <= rank) & (rank < F.col("_cl")), F.col("_v")))


def _between(below: Column, above: Column, share: Column) -> Column:
    return (below + (above - below) * share).cast("double")


def cell_quantiles(cells: DataFrame, probs: Sequence[float], by: Sequence[str], names: Sequence[str]) -> DataFrame | None:
    """The quantiles from the (written) cells of :func:`rank_cells`, one row
    per group; None if a wanted rank is not inside an interval.

    Only the (slot, part) cells that hold a wanted rank are sorted; which
    they are is told by the small table of cell sizes."""
    by = list(by)
    keys = [*by, "_slot", "_sub"]
    before = Window.partitionBy(*by).orderBy("_slot", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy(*keys).agg(F.sum("_cnt").alias("_bn")).select(
        *keys, "_bn", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_boff"),
        F.sum("_bn").over(Window.partitionBy(*by)).alias("_total"))
    places = _places(probs, names)
    hit = reduce(lambda a, c: a | c, [(r >= F.col("_boff")) & (r < F.col("_boff") + F.col("_bn"))
                                      for f, c, _ in places.values() for r in (f, c)])
    target = sizes.where(hit)
    if target.where("_slot % 2 = 0").limit(1).count():
        return None
    c, t = cells.alias("_c"), target.select(*keys, "_boff", "_total").alias("_t")
    same = reduce(lambda p, q: p & q, [F.col(f"_c.{k}").eqNullSafe(F.col(f"_t.{k}")) for k in keys])
    running = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = c.join(t, same).select("_c.*", "_t._boff", "_t._total").withColumn("_cl", F.col("_boff") + F.sum("_cnt").over(running))
    return ranked.groupBy(*by).agg(*[_between(_value_at(f), _value_at(c), F.max(share)).alias(nm) for nm, (f, c, share) in places.items()])


def quantile_summary(df: DataFrame, value_col: str, probs: Sequence[float], by: Sequence[str], names: Sequence[str],
                     also: Sequence[Column] = (), edges=None, over_cells: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """(brackets with the aggregates ``also``, quantiles with the aggregates
    ``over_cells``) in two scans.

    ``edges`` makes the intervals from the brackets in order of probability
    (by default they are the intervals); ``over_cells`` may name the quantiles
    and the columns of :func:`rank_cells`.  Few selected rows are sorted by
    group, many by (group, slot, part).  If a summary missed a rank, which its
    error bound rules out, everything is selected instead.
    """
    by, names = list(by), list(names)
    brackets, sizes = quantile_brackets(df, value_col, probs, by, also)
    pairs = [(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for _, i in sorted((p, i) for i, p in enumerate(probs))]
    for intervals in (edges(pairs) if edges else pairs, [(F.col("_min"), F.col("_max"))]):
        whole = len(intervals) == 1
        few = sizes is not None and SORTED_CELLS >= sum(
            n if whole or n <= 2 * ACCURACY else n * 4 * len(intervals) / ACCURACY for n in sizes)
        cells = rank_cells(df, value_col, by, brackets, intervals, sizes is not None, not few)
        if few:
            res = _sorted_quantiles(cells, probs, by, names, over_cells)
        else:
            cells = cut_lineage(cells)
            res = cell_quantiles(cells, probs, by, names)
            if res is not None and over_cells:
                joined = join_small(cells, res, by, null_safe=True) if by else attach_row(cells, res)
                res = joined.groupBy(*by).agg(*[F.first(nm).alias(nm) for nm in names], *over_cells)
        if res is not None:
            return brackets, res
    raise RuntimeError("a rank is outside the range of its column")


def _sorted_quantiles(cells: DataFrame, probs: Sequence[float], by: Sequence[str], names: Sequence[str],
                      over_cells: Sequence[Column]) -> DataFrame | None:
    """:func:`cell_quantiles` of few cells in one job, with ``over_cells``, as a local table."""
    group = Window.partitionBy(*(by or [F.lit(0)]))
    running = group.orderBy("_slot", "_sub", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.withColumns({"_cl": F.sum("_cnt").over(running), "_total": F.sum("_cnt").over(group)})
    at = {nm: _between(_value_at(f).over(group), _value_at(c).over(group), share) for nm, (f, c, share) in _places(probs, names).items()}
    out = ranked.withColumns(at).groupBy(*by).agg(*[F.first(nm).alias(nm) for nm in names], *over_cells, F.sum("_cnt").alias("_rows"))
    rows = out.toArrow()
    if any(n and v is None for nm in names for n, v in zip(rows["_rows"].to_pylist(), rows[nm].to_pylist())):
        return None
    return cells.sparkSession.createDataFrame(rows, out.schema).drop("_rows")


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / numpy default,
    DuckDB ``quantile_cont``), one row per ``by`` group; NULL values skipped.

    Bracket and select: :func:`quantile_brackets` (one scan) encloses every
    wanted rank, :func:`rank_cells` (a second scan) counts what lies below and
    keeps what lies inside, from which the ranks are read.  The column is
    never shuffled, only the few rows inside the brackets, and no group is
    gathered into one task (unlike the ``percentile`` aggregate).
    """
    return quantile_summary(df, value_col, probs, by, names or [f"q{int(round(p * 100))}" for p in probs])[1]


# ---------------------------------------------------------------- O1 - O4


def sort_rows(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """O1: total order (range-partitioned sort)."""
    return df.orderBy(*by, ascending=ascending)


def top_n(df: DataFrame, score: str, n: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """O2: the ``n`` highest-scoring rows (TakeOrderedAndProject: per-task top-n, merged)."""
    return df.orderBy(F.col(score).desc(), *[F.col(c).asc() for c in tie_break]).limit(n)


def head_rows(df: DataFrame, n: int, pos: str = "_pos") -> DataFrame:
    """O3: first ``n`` rows in input order (``pos`` carries the order)."""
    return df.orderBy(F.col(pos).asc()).limit(n)


def tail_rows(df: DataFrame, n: int, pos: str = "_pos") -> DataFrame:
    """O3: last ``n`` rows in input order."""
    return df.orderBy(F.col(pos).desc()).limit(n)


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int, order_col: str = "shuffle_order") -> DataFrame:
    """Seeded shuffle.  The order is a column (a hash of key and seed), so
    it is reproducible under any partitioning and survives later shuffles."""
    return df.withColumn(order_col, hash_hex(key, seed))


# ---------------------------------------------------------------- U1 - U3


def union_all(frames: Sequence[DataFrame | None]) -> DataFrame:
    """Append tables by column name; absent (None) tables are skipped."""
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("nothing to append")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)
