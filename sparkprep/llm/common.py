"""Helpers shared by the operators: row groups in Arrow batches, blocked
comparison of large groups, union of links inside a block, and connected
components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.session import cut_lineage


CHUNK = 256  # entries that ``carry`` appends one by one


def free_name(taken: list[str], name: str) -> str:
    """``name``, or with underscores before it until no column in ``taken`` has it (in any case of letters)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def carry(items: Column, state: Column, step, kind: str) -> Column:
    """The array of outputs (of SQL type ``kind``) of a left-to-right pass:
    ``step(state, item)`` gives the next state and the item's output.

    ``aggregate`` copies its whole state at each step, so one growing list costs
    the square of the items.  Here a list grows to ``CHUNK`` entries only, and lists
    are gathered once a chunk.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc, x):
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.array_append(acc["out"], out.cast(kind)).alias("out"))

    def chunk(acc, part):
        part_done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bind(part_done, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["done"], r["out"]).alias("done")))

    def run(it):
        last = F.greatest(F.floor((F.size(it) - 1) / CHUNK), F.lit(0)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(it, i * CHUNK + 1, CHUNK))
        return F.aggregate(parts, F.struct(state.alias("state"), nones.alias("done")), chunk, lambda a: F.flatten(a["done"]))

    return bind(items, run)


def count_below(ordered: Column, x: Column) -> Column:
    """How many entries of a sorted array are below ``x``, by halving (arrays up to 2^30)."""
    def step(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        low = (acc["lo"] < acc["hi"]) & (F.get(ordered, mid) < x)
        return F.struct(F.when(low, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(low | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), step, lambda a: a["lo"])


def iter_slices(batches, rows: int = 256):
    """Arrow batches in slices of at most ``rows`` rows, so that the Python
    objects made from long texts stay few at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def iter_groups(batches, keys: list[str]):
    """Consecutive rows with equal integer ``keys`` as one Arrow table each.

    The input is sorted by ``keys`` inside its partition.  At most one group
    plus one batch is held at a time.
    """
    carry = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if carry is not None:
            t = pa.concat_tables([carry, t]).combine_chunks()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), t.num_rows]
        for lo, hi in zip(bounds[:-2], bounds[1:-1]):
            yield t.slice(lo, hi - lo)
        carry = t.slice(bounds[-2]).combine_chunks()
    if carry is not None and carry.num_rows:
        yield carry


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def block_pairs(df: DataFrame, key: str, ident: str, block: int, visitor: str | None = None) -> DataFrame:
    """Deal the rows of each ``key`` to pairs of blocks of about ``block`` rows.

    Adds ``blk`` (the row's block), ``ga`` and ``gb`` (the pair).  Every two
    rows of a key meet in exactly one pair of blocks (two rows of one block
    meet in (blk, blk)); two visitors never meet.  A key of n rows becomes
    about (n / block)^2 / 2 independent groups of at most about 2 * block
    rows, so no key, however large, is gathered in one task.  Keys whose rows
    can't meet another row are dropped.
    """
    vis = F.col(visitor) if visitor else F.lit(False)
    size = df.groupBy(key).agg(F.count(F.when(~vis, 1)).alias("_nh"), F.count(F.when(vis, 1)).alias("_nv"))
    size = size.where("_nh > 0 and _nh + _nv > 1").select(
        key, F.ceil(F.col("_nh") / block).cast("int").alias("_bh"), F.ceil(F.col("_nv") / block).cast("int").alias("_bv"))
    h = F.xxhash64(F.col(ident), F.lit(17))
    out = df.join(size, key).withColumn(
        "blk", F.when(vis, F.col("_bh") + F.pmod(h, F.greatest("_bv", F.lit(1)))).otherwise(F.pmod(h, F.col("_bh"))).cast("int"))
    last = F.when(vis, F.col("_bh")).otherwise(F.col("_bh") + F.col("_bv")) - 1
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return (out.withColumn("ga", F.least("blk", "_o")).withColumn("gb", F.greatest("blk", "_o"))
            .drop("_o", "_bh", "_bv"))


def deal_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Shuffle by ``keys`` and sort inside partitions, for ``iter_groups``."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is the
    smallest node reachable.

    Alternating large-star and small-star rounds: only joins and grouped
    minima, nothing is gathered per node; each round is checkpointed in the
    shared folder.  Raises if it has not settled after ``max_rounds``.
    """
    e = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e = cut_lineage(e)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.min("lo").alias("_m")).select("hi", F.least("hi", "_m").alias("_m"))
        large = both.join(low, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("_m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("_m"))
        small = large.join(low, "hi").where("lo <> _m").select(F.col("lo").alias("hi"), F.col("_m").alias("lo"))
        e = cut_lineage(small.unionByName(low.select("hi", F.col("_m").alias("lo"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
            return nodes.unionByName(roots).distinct()
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, for bounded caches that
    the worker's next tasks can use again."""
    import sys
    import types

    return sys.modules.setdefault("_sparkprep_worker_state", types.ModuleType("_sparkprep_worker_state")).__dict__


def sum_blocks(blocks: DataFrame, dtype: str, shape: tuple, levels=(32, 1), bits: int = 0) -> DataFrame:
    """(block, data) with the sum of each block's arrays; their last ``bits``
    rows are bit sets and joined.

    ``blocks``: block int, src int (the task that made it), data binary (a
    zlib-compressed array of ``dtype`` and ``shape``).  Tasks add rows up one
    by one and hold one array per block, first for up to 32 groups of sources,
    then for all.
    """
    import zlib

    cut = shape[0] - bits

    def add(batches):
        total: dict = {}
        for b in iter_slices(batches, 16):
            for block, src, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                a = np.frombuffer(zlib.decompress(data), dtype=dtype).reshape(shape)
                key = (block, src)
                total[key] = a if key not in total else np.concatenate([total[key][:cut] + a[:cut], total[key][cut:] | a[cut:]]) if bits else total[key] + a
        for (block, src), a in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([src], pa.int32()),
                                              pa.array([zlib.compress(a.tobytes(), 1)], pa.binary())], ["block", "src", "data"])

    for n in levels:
        blocks = blocks.select("block", F.pmod("src", F.lit(n)).alias("src"), "data").repartition("block", "src").mapInArrow(
            add, "block int, src int, data binary")
    return blocks.select("block", "data")
