"""M6: exact k-nearest-neighbour vote without comparing every (query, train) pair.

A :class:`NeighborIndex` cuts the training rows into cells of about
``FANOUT * LEAF_ROWS`` rows, by halving the widest feature of a sample of them
over and over; a task cuts a cell into leaves of at most ``LEAF_ROWS`` rows the
same way.  So the number of cells grows with the table, up to ``MAX_CELLS``,
and a leaf does not.  The index is two tables (the cells' boxes, rows by cell
and leaf) that are written once and only read by searches.

A search answers every query exactly in two rounds; each brings queries and the
rows of a cell together by the cell, a bounded number of queries a task at a time:

1. In the query's own cell: the k nearest rows there, and so a k-th
   distance ``w``.  It can only be too large.
2. In every other cell whose box lies within ``w``.

The k nearest of both rounds are the answer.  Inside a cell a query meets the
leaves whose box lies within its k-th distance so far, and all rows of
such a leaf at once.

There is no cap on candidates.  Bounds carry a relative slack for rounding,
so ties at the k-th distance are kept.

Training rows are first reduced to at most k copies per distinct feature
vector (the smallest keys), and each distinct query vector is searched once,
so copies on either side cannot blow up a cell.

The vote is the majority label of the k nearest (distance ties broken by
training key); a tie between labels goes to the smallest label.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.operators.order import MAX_BROADCAST_ROWS, local_table
from sparkprep.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SALT = 64            # salt buckets for the per-vector top-k (fixed value)
FANOUT = 256         # leaves of a cell, about (fixed value)
LEAF_ROWS = 64       # rows of a leaf at most (fixed value)
MAX_CELLS = 16_384   # cells; beyond that many full ones the cells grow (fixed value)
CELL_SAMPLE = 32     # rows per cell, about, that place the cuts between cells (fixed value)
MAX_LOCAL_CELLS = 65_536  # cells whose sizes pass through the driver (fixed value)
TASK_QUERIES = 16_384     # queries that meet a cell's rows at once, about (fixed value)
HELD_PAIRS = 1 << 21      # candidates that a task holds before it keeps the k best of each query (fixed value)
SLACK = 1e-9         # relative slack of the bounds (fixed value)


def _k_copies(tr: DataFrame, vec: Sequence[str], k: int) -> DataFrame:
    """Keep at most ``k`` training rows (smallest keys) per distinct feature
    vector: only those can be among any query's k nearest, since copies are
    equally distant and ties go by key.  Two stages, the first salted, so a
    vector shared by a third of the table is never ranked in one task."""
    salted = tr.withColumn("_salt", F.pmod(F.xxhash64("_tk"), F.lit(SALT)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*vec, "_salt").orderBy("_tk")))
    first = first.where(F.col("_r") <= k).drop("_r", "_salt")
    second = first.withColumn("_r", F.row_number().over(Window.partitionBy(*vec).orderBy("_tk")))
    return second.where(F.col("_r") <= k).drop("_r")


def _points(t, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([t.column(n).to_numpy(zero_copy_only=False) for n in names]).reshape(-1, len(names))


def _distances(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All distances; the squares are added in the features' order, as a SQL sum would."""
    total = np.zeros((len(q), len(rows)))
    for f in range(q.shape[1]):
        x = q[:, f, None] - rows[None, :, f]
        total += x * x
    return np.sqrt(total)


def _best_cut(x: np.ndarray) -> tuple[int, float] | None:
    """(feature, value) with about half the rows of ``x`` below the value, by
    the widest feature that can do so; the most even cut if none can; None if all rows are equal."""
    best = None
    for f in np.argsort(-x.std(axis=0), kind="stable"):
        v = np.sort(x[:, f])
        above = v[np.searchsorted(v, v[len(v) // 2], side="right"):]
        for value in [v[len(v) // 2], *above[:1]]:
            share = min(np.searchsorted(v, value) / len(v), 1 - np.searchsorted(v, value) / len(v))
            if share > 0 and (best is None or share > best[0]):
                best = (share, int(f), float(value))
        if best and best[0] >= 0.35:
            break
    return best and best[1:]


def _plan_cells(sample: np.ndarray, cells: int) -> list:
    """Cuts of the space into about ``cells`` cells: (feature, value, what is below, what is not)
    by number, or a cell's number; neighbouring cells have close numbers."""
    cuts, n = [], 0

    def cut(x, cells):
        nonlocal n
        at = len(cuts)
        cuts.append(None)
        best = _best_cut(x) if cells > 1 and len(x) > 1 else None
        if best:
            low = x[:, best[0]] < best[1]
            left = min(max(round(cells * low.mean()), 1), cells - 1)
            cuts[at] = (*best, cut(x[low], left), cut(x[~low], cells - left))
        else:
            cuts[at], n = n, n + 1
        return at

    cut(sample, cells)
    return cuts


def _cells_of(x: np.ndarray, cuts: list) -> np.ndarray:
    out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
    while todo:
        i, at = todo.pop()
        if isinstance(cuts[i], int):
            out[at] = cuts[i]
        elif len(at):
            f, value, below, other = cuts[i]
            low = x[at, f] < value
            todo += [(below, at[low]), (other, at[~low])]
    return out


def _leaves_of(x: np.ndarray, leaf_rows: int) -> np.ndarray:
    """The leaf of each row: rows are halved along the widest feature, evenly by
    number, till each of the leaves asked for is left alone."""
    out = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, -(-len(x) // leaf_rows))]
    while todo:
        at, first, leaves = todo.pop()
        if leaves <= 1:
            out[at] = first
            continue
        left = leaves // 2
        cut = len(at) * left // leaves
        at = at[np.argpartition(x[at, x[at].std(axis=0).argmax()], cut)]
        todo += [(at[:cut], first, left), (at[cut:], first + left, leaves - left)]
    return out


class _Boxes:
    """A row of boxes, and those around its halves, quarters and so on."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.n, self.around = len(low), {}
        self._fill(0, self.n, low, high)

    def _fill(self, a, b, low, high):
        if b - a == 1:
            box = low[a], high[a]
        else:
            m = (a + b) // 2
            (l0, h0), (l1, h1) = self._fill(a, m, low, high), self._fill(m, b, low, high)
            box = np.minimum(l0, l1), np.maximum(h0, h1)
        self.around[a, b] = box
        return box

    def gap(self, a: int, b: int, q: np.ndarray) -> np.ndarray:
        """No point of the boxes a .. b - 1 is nearer to ``q`` than this."""
        low, high = self.around[a, b]
        out = np.maximum(np.maximum(low - q, q - high), 0.0)
        return np.sqrt(np.einsum("ij,ij->i", out, out)) * (1.0 - SLACK)

    def home(self, q: np.ndarray) -> np.ndarray:
        """For each point the box that the nearer half leads to."""
        out, todo = np.zeros(len(q), dtype=np.int64), [(0, self.n, np.arange(len(q)))]
        while todo:
            a, b, at = todo.pop()
            if b - a == 1:
                out[at] = a
            elif len(at):
                m = (a + b) // 2
                left = self.gap(a, m, q[at]) <= self.gap(m, b, q[at])
                todo += [(a, m, at[left]), (m, b, at[~left])]
        return out

    def within(self, q: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each box and the points that have it within their ``w``, which may shrink meanwhile."""
        todo = [(0, self.n, np.arange(len(q)))]
        while todo:
            a, b, at = todo.pop()
            at = at[self.gap(a, b, q[at]) <= w[at]]
            if len(at) and b - a == 1:
                yield a, at
            elif len(at):
                todo += [((a + b) // 2, b, at), (a, (a + b) // 2, at)]

    def bound(self, q: np.ndarray, counts: np.ndarray, need: int) -> np.ndarray:
        """A distance within which each point has ``need`` rows of the boxes."""
        far = np.zeros((len(q), self.n))
        for i in range(self.n):
            low, high = self.around[i, i + 1]
            far[:, i] = np.sqrt((np.maximum(abs(q - low), abs(q - high)) ** 2).sum(axis=1)) * (1.0 + SLACK)
        by = np.argsort(far, axis=1)
        enough = (np.cumsum(counts[by], axis=1) >= need).argmax(axis=1)
        return far[np.arange(len(q)), by[np.arange(len(q)), enough]]


def _k_best(found: list, order: np.ndarray, need: int) -> list:
    """The ``need`` nearest (query, row, distance) of each query; ties go by ``order``."""
    q, r, d = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((order[r], d, q))
    q, r, d = q[by], r[by], d[by]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < need
    return [(q[keep], r[keep], d[keep])]


def _search_cell(x: np.ndarray, starts: np.ndarray, order: np.ndarray, q: np.ndarray, w: np.ndarray, need: int):
    """The ``need`` nearest of a cell's rows ``x`` within ``w`` of each query, as
    (query, row, distance) by query and rank; the k-th distances; the pairs compared."""
    ends, w = np.append(starts[1:], len(x)), w.copy()
    boxes = _Boxes(np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0))
    best, pairs = np.full((len(q), need), np.inf), np.zeros(len(q), dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    found, held = [(none, none, np.zeros(0))], 0
    home = boxes.home(q)
    by = np.argsort(home, kind="stable")
    own = [(home[at[0]], at) for at in np.split(by, np.flatnonzero(np.diff(home[by])) + 1) if len(at)]
    for first in (True, False):
        for leaf, at in (own if first else boxes.within(q, w)):
            at = at if first else at[home[at] != leaf]
            if not len(at):
                continue
            d = _distances(q[at], x[starts[leaf]:ends[leaf]])
            pairs[at] += d.shape[1]
            hit = (d <= w[at][:, None]).any(axis=1)
            at, d = at[hit], d[hit]
            if not len(at):
                continue
            best[at] = np.partition(np.concatenate([best[at], d], axis=1), need - 1, axis=1)[:, :need]
            w[at] = np.minimum(w[at], best[at].max(axis=1))
            i, j = np.nonzero(d <= w[at][:, None])
            found.append((at[i], starts[leaf] + j, d[i, j]))
            held += len(i)
            if held > HELD_PAIRS:
                found = _k_best(found, order, need)
                held = 0
    return *_k_best(found, order, need)[0], w, pairs


@dataclass
class NeighborIndex:
    """Training rows by cell and leaf (``rows``: _cell, _leaf, _ord, _tk, _lab, t_x0, ...;
    ``_ord`` sorts as ``_tk`` does) and the cells' boxes (``nodes``: cell, n, low, high)."""
    dims: list
    k: int
    size: int
    nodes: DataFrame
    rows: DataFrame

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        meta = {"dims": self.dims, "k": self.k, "size": self.size}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/index")

    @staticmethod
    def load(spark: SparkSession, path: str) -> NeighborIndex:
        meta = json.loads(spark.read.text(f"{path}/index").first()[0])
        return NeighborIndex(**meta, nodes=spark.read.parquet(f"{path}/nodes"), rows=spark.read.parquet(f"{path}/rows"))


def _refuse_missing(df: DataFrame, feats: Sequence[str], side: str) -> None:
    """A missing feature has no distance: refused, so that no row is lost on the way."""
    odd = [F.col(f).isNull() | F.isnan(F.col(f).cast("double")) for f in feats]
    if df.where(reduce(lambda a, b: a | b, odd)).limit(1).count():
        raise ValueError(f"NULL feature in a {side} row: impute or drop it before k-nearest neighbours")


def build_index(train: DataFrame, features: Sequence[str], k: int, train_key: str, label: str, seed: int = 0) -> NeighborIndex:
    """The cells and leaves for searches of up to ``k`` neighbours.

    The cuts between cells come from about ``CELL_SAMPLE`` rows a cell, picked by
    a hash (they pass through the driver, at most some 500,000 rows); every row then goes to its
    cell, and each cell is cut into leaves by its own task."""
    feats = list(features)
    _refuse_missing(train, feats, "training")
    dims = [f"x{i}" for i in range(len(feats))]
    point = [f"t_{d}" for d in dims]
    tr = train.select(F.col(train_key).alias("_tk"), F.col(label).alias("_lab"),
                      *[F.col(f).cast("double").alias(t) for f, t in zip(feats, point)])
    tasks = int(tr.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tr = cut_lineage(_k_copies(tr, point, k).orderBy("_tk").withColumn("_ord", F.monotonically_increasing_id()))
    size = tr.count()
    if not size:
        raise ValueError("empty training table")
    cells, leaf_rows = min(-(-size // (FANOUT * LEAF_ROWS)), MAX_CELLS), LEAF_ROWS
    u = F.pmod(F.xxhash64("_ord", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    cuts = _plan_cells(_points(tr.where(u < CELL_SAMPLE * cells / size).select(*point).toArrow(), point), cells) if cells > 1 else [0]

    def place(batches):
        for b in batches:
            yield b.append_column("_cell", pa.array(_cells_of(_points(b, point), cuts)))

    def cut(t: pa.Table) -> pa.Table:
        leaf = _leaves_of(_points(t, point), leaf_rows)
        return t.append_column("_leaf", pa.array((t.column("_cell")[0].as_py() << 32) + leaf))

    placed = tr.mapInArrow(place, tr.withColumn("_cell", F.lit(0).cast("long")).schema).repartition(tasks, "_cell")
    rows = cut_lineage(placed.groupBy("_cell").applyInArrow(cut, placed.withColumn("_leaf", F.lit(0).cast("long")).schema))
    low, high = (F.array(*[f(p) for p in point]) for f in (F.min, F.max))
    nodes = rows.groupBy(F.col("_cell").alias("cell")).agg(F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high"))
    return NeighborIndex(dims, k, size, cut_lineage(nodes), rows)


def _in_cells(index: NeighborIndex, visits: DataFrame, need: int, cells: list | None = None) -> DataFrame:
    """``visits`` (_cell, _qid, q_x0, ..., _w) with the nearest rows of that cell within ``_w`` (``_near``),
    the number of pairs compared (``_pairs``) and, if all ``cells`` (numbers, boxes, counts) are
    given, the k-th distance and the other cells within it (``_cells``)."""
    q_cols, t_cols = [f"q_{d}" for d in index.dims], [f"t_{d}" for d in index.dims]
    # a cell with many queries is shared by several tasks
    sizes = visits.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).alias("_parts"))
    sizes, few = local_table(sizes, MAX_LOCAL_CELLS)
    sizes = F.broadcast(sizes) if few is not None and few.num_rows <= MAX_BROADCAST_ROWS else sizes
    tasks = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = visits.join(sizes, "_cell").withColumn("_part", F.pmod(F.xxhash64("_qid"), "_parts")).drop("_parts")
    right = index.rows.join(sizes, "_cell").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    kinds = index.rows.schema
    found = T.ArrayType(T.StructType([T.StructField(c, kinds[c].dataType) for c in ("_ord", "_tk", "_lab")] + [T.StructField("distance", T.DoubleType())]))

    def search(q: pa.Table, t: pa.Table) -> pa.Table:
        own = q.column("_cell")[0].as_py() if len(q) else None
        t = t.take(pa.array(np.argsort(t.column("_leaf").to_numpy(), kind="stable"))).combine_chunks()
        x, leaf, order = _points(t, t_cols), t.column("_leaf").to_numpy(), t.column("_ord").to_numpy()
        starts = np.append(0, np.flatnonzero(np.diff(leaf)) + 1)
        points = _points(q, q_cols)
        qi, ri, d, w, pairs = _search_cell(x, starts, order, points, q.column("_w").to_numpy(), need)
        offsets = pa.array(np.searchsorted(qi, np.arange(len(q) + 1)), pa.int32())
        picked = t.take(pa.array(ri))
        near = [picked.column(c).combine_chunks() for c in ("_ord", "_tk", "_lab")]
        near = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in near] + [pa.array(d)]
        out = {"_qid": q.column("_qid"), "_near": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(near, names=["_ord", "_tk", "_lab", "distance"])),
               "_pairs": pa.array(pairs)}
        if cells is not None:
            numbers, low, high, counts = cells
            boxes = _Boxes(low, high)
            short = np.flatnonzero(np.isinf(w))
            for at in np.array_split(short, -(-len(short) // 256)) if len(short) else []:
                w[at] = boxes.bound(points[at], counts, need)
            met = [(at, np.full(len(at), numbers[i])) for i, at in boxes.within(points, w) if numbers[i] != own]
            who, what = (np.concatenate(c) for c in zip((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), *met))
            by = np.argsort(who, kind="stable")
            out |= {c: q.column(c) for c in q_cols} | {"_w": pa.array(w), "_cells": pa.ListArray.from_arrays(
                pa.array(np.searchsorted(who[by], np.arange(len(q) + 1)), pa.int32()), pa.array(what[by]))}
        return pa.table(out)

    schema = T.StructType().add("_qid", T.LongType()).add("_near", found).add("_pairs", T.LongType())
    if cells is not None:
        for c in [*q_cols, "_w"]:
            schema.add(c, T.DoubleType())
        schema.add("_cells", T.ArrayType(T.LongType()))
    by = ["_cell", "_part"]
    return left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by)).applyInArrow(search, schema)


def _search(index: NeighborIndex, qv: DataFrame, need: int) -> DataFrame:
    """Per distinct query vector of ``qv`` and cell that it met: ``_near``, ``_pairs``.
    The ``need`` nearest rows of a vector are among its ``_near``."""
    q_cols = [f"q_{d}" for d in index.dims]
    at = index.nodes.orderBy("cell").toArrow()
    numbers, counts = at.column("cell").to_numpy(), at.column("n").to_numpy()
    low, high = (np.array(at.column(c).to_pylist()) for c in ("low", "high"))
    cells = [numbers, low, high, counts]

    def settle(batches):
        boxes = _Boxes(low, high)
        for b in batches:
            yield b.append_column("_cell", pa.array(numbers[boxes.home(_points(b, q_cols))]))

    start = qv.select("_qid", *q_cols).withColumn("_w", F.lit(float("inf")))
    settled = cut_lineage(start.mapInArrow(settle, start.withColumn("_cell", F.lit(0).cast("long")).schema))
    own = cut_lineage(_in_cells(index, settled, need, cells))
    if len(numbers) == 1:
        return own.select("_qid", "_near", "_pairs")
    others = own.select("_qid", *q_cols, "_w", F.explode("_cells").alias("_cell"))
    return own.select("_qid", "_near", "_pairs").unionByName(_in_cells(index, others, need))


def _vectors(index: NeighborIndex, query: DataFrame, feats: Sequence[str], query_key: str) -> tuple[DataFrame, DataFrame]:
    """Query rows (_qk, q_x0, ...) and their distinct vectors with a number."""
    _refuse_missing(query, feats, "query")
    cols = [f"q_{d}" for d in index.dims]
    qr = query.select(F.col(query_key).alias("_qk"), *[F.col(f).cast("double").alias(c) for f, c in zip(feats, cols)])
    # work per vector is the pivots on its way, not its bytes: as many tasks as the session asks for
    tasks = int(qr.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return qr, cut_lineage(qr.select(*cols).distinct().repartition(tasks, *cols).withColumn("_qid", F.monotonically_increasing_id()))


def index_neighbors(index: NeighborIndex, query: DataFrame, features: Sequence[str], query_key: str, k: int | None = None) -> DataFrame:
    """The k nearest training rows of every query row: (_qk, _tk, _lab, distance, rank)."""
    k = index.k if k is None else k
    if k > index.k:
        raise ValueError(f"the index was built for {index.k} neighbours, not {k}")
    need = min(k, index.size)
    qr, qv = _vectors(index, query, list(features), query_key)
    cand = _search(index, qv, need).select("_qid", F.inline("_near"))
    order = Window.partitionBy("_qid").orderBy("distance", "_ord")
    top = cand.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= need)
    # back to the rows of each vector; join_small's bound doesn't hold here, AQE splits hot vectors
    out = qr.join(cut_lineage(top.join(qv, "_qid")).drop("_qid"), [f"q_{d}" for d in index.dims])
    return out.select("_qk", "_tk", "_lab", "distance", "rank")


def knn_neighbors(train: DataFrame, query: DataFrame, features: Sequence[str], k: int,
                  train_key: str, query_key: str, label: str, seed: int = 0) -> DataFrame:
    """The k nearest training rows of every query row:
    (query_key, train_key [``neighbor_<key>`` when both keys share a name],
    label, distance, rank)."""
    nb = index_neighbors(build_index(train, features, k, train_key, label, seed), query, features, query_key)
    tk_name = train_key if train_key != query_key else f"neighbor_{train_key}"
    return nb.select(F.col("_qk").alias(query_key), F.col("_tk").alias(tk_name), F.col("_lab").alias(label), "distance", "rank")


def knn_candidates(index: NeighborIndex, query: DataFrame, features: Sequence[str], query_key: str) -> tuple[int, int]:
    """(query vectors, (vector, training row) pairs whose distance a search
    computes): a measure of how well the cells and leaves prune."""
    _, qv = _vectors(index, query, list(features), query_key)
    return qv.count(), _search(index, qv, min(index.k, index.size)).agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0]


def knn_predict(train: DataFrame, query: DataFrame, features: Sequence[str], label: str, k: int = 5,
                train_key: str = "id", query_key: str = "id", out: str = "predicted_label") -> DataFrame:
    """M6: majority label among the k nearest training rows (uniform weights)."""
    nb = knn_neighbors(train, query, features, k, train_key, query_key, label)
    votes = nb.groupBy(query_key, label).agg(F.count(F.lit(1)).alias("_v"))
    w = Window.partitionBy(query_key).orderBy(F.col("_v").desc(), F.col(label))
    return (votes.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select(query_key, F.col(label).alias(out)))


def knn_shares(index: NeighborIndex, query: DataFrame, features: Sequence[str], n_classes: int, query_key: str,
               out: str = "proba") -> DataFrame:
    """M11 for kNN: the share of each class 0 .. n_classes - 1 among the k
    nearest training rows of a stored index, as an array."""
    shares = [F.avg((F.col("_lab") == F.lit(c)).cast("double")) for c in range(n_classes)]
    return index_neighbors(index, query, features, query_key).groupBy(F.col("_qk").alias(query_key)).agg(F.array(*shares).alias(out))
