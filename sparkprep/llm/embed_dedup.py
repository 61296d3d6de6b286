"""Embedding near-duplicates: spherical k-means cells, blocked cosine
products inside cells, one representative per group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import block_pairs, connected_components, deal_groups, iter_groups, local_roots
from sparkprep.session import cut_lineage


def unit_rows(lists) -> np.ndarray:
    """Rows of float64 unit vectors; scaled first, so squares can't overflow."""
    m = np.asarray(lists, dtype=np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` unit centroids of the unit rows ``x``; fewer if rows coincide.
    Deterministic: starts from evenly spaced rows."""
    c = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        size = np.linalg.norm(new, axis=1)
        c = np.where(size[:, None] > 1e-12, new / np.maximum(size, 1e-12)[:, None], c)
    return np.unique(c, axis=0)


def visits(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's home cell, and a mask of the lower-numbered cells it visits.

    Row x must meet the home rows of cell j if its distance to the hyperplane
    between the centroids of home and j is at most ``reach``.
    """
    s = x @ c.T
    home = s.argmax(axis=1)
    gap = s[np.arange(len(x)), home][:, None] - s
    width = np.linalg.norm(c[home][:, None, :] - c[None, :, :], axis=2) if len(c) <= 64 else np.sqrt(
        np.maximum(2 - 2 * (c @ c.T)[home], 0))
    go = gap <= reach * width + 1e-9
    return home, go & (np.arange(len(c))[None, :] < home[:, None])


def embedding_groups(emb: DataFrame, threshold: float = 0.93, cell_rows: int = 2048, max_cells: int = 1024,
                     fit_rows: int = 20_000, block: int = 1024, probe_z: float | None = None,
                     id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine in
    double precision is at least ``threshold``.  Per label, spherical k-means
    (fitted on at most about ``fit_rows`` rows picked by a hash of the id,
    ``max_cells`` centroids in all) assigns every vector to its nearest
    centroid.  Two vectors at angle t or less in different cells both lie
    within sin(t) of the hyperplane between the two centroids, because the arc
    between them crosses it; so a vector also visits each lower-numbered cell
    whose hyperplane is that near, and no link is lost.  In a cell, blocks of
    ``block`` rows are multiplied; each pair of blocks returns link counts and
    a spanning forest, never the pairs.

    ``probe_z`` replaces the exact reach by z * tan(t) / sqrt(dimension),
    enough for near copies that differ in random directions: far fewer visits
    on data without clusters, at a loss that has to be measured.

    A null, zero or ragged vector, one with null or non-finite components, a
    null label or a null id links with nothing: n_links 0, component_id its
    own id.  Vectors of different length never link.  Identical vectors are
    one row from the first aggregation on and count each other as links.
    ``kept`` is false for a null id.  An empty table gives an empty result.
    """
    angle = math.acos(threshold)
    e = F.col("vec")
    src = emb.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                     F.col(label_col).alias("label"))
    finite = F.forall(e, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    nonzero = F.exists(e, lambda x: F.coalesce(x != 0.0, F.lit(False)))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & nonzero, F.lit(False))
    src = src.withColumn("good", good)
    rows = src.select("id", "good", F.when(F.col("good"), F.col("label")).alias("label"),
                      F.when(F.col("good"), F.xxhash64("vec")).alias("k1"),
                      F.when(F.col("good"), F.xxhash64(F.reverse("vec"), F.size("vec"))).alias("k2"))
    nodes = cut_lineage(src.where("good").select(
        "id", "label", "vec", F.size("vec").alias("dim"), F.xxhash64("vec").alias("k1"),
        F.xxhash64(F.reverse("vec"), F.size("vec")).alias("k2"))
        .groupBy("label", "dim", "k1", "k2")
        .agg(F.min("id").alias("node"), F.count("*").alias("mult"), F.first("vec").alias("vec")))

    # cells per (label, dim): only groups larger than a cell get centroids, so at most max_cells of them
    total = nodes.count()
    per_cell = max(cell_rows, -(-total // max_cells))
    large = nodes.groupBy("label", "dim").count().where(F.col("count") > per_cell).collect()
    cells: dict[tuple, np.ndarray] = {}
    if large:
        share = min(1.0, fit_rows / total)
        pick = nodes.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
        fit = pick.join(F.broadcast(emb.sparkSession.createDataFrame(
            [(r["label"], r["dim"]) for r in large], nodes.select("label", "dim").schema)), ["label", "dim"]).select(
                "label", "dim", "node", "vec").limit(2 * fit_rows).toPandas().sort_values("node")
        size = {(r["label"], r["dim"]): r["count"] for r in large}
        for k, g in fit.groupby(["label", "dim"]):
            c = spherical_kmeans(unit_rows(g["vec"].tolist()), -(-size[k] // per_cell))
            if len(c) > 1:
                cells[k] = c
    # the centroids are bounded by max_cells, whatever the table's size
    shared = emb.sparkSession.sparkContext.broadcast(cells)

    def assign(batches):
        for b in batches:
            t = b.to_pandas()
            for (label, dim), g in t.groupby(["label", "dim"]):
                x = unit_rows(g["vec"].tolist())
                c = shared.value.get((label, dim))
                row, cell, vis = np.arange(len(g)), np.zeros(len(g), dtype=np.int64), np.zeros(len(g), dtype=bool)
                if c is not None:
                    reach = math.sin(angle) if probe_z is None else min(math.sin(angle), probe_z * math.tan(angle) / math.sqrt(dim))
                    home, go = visits(x, c, reach)
                    r, j = np.nonzero(go)
                    row, cell = np.concatenate([row, r]), np.concatenate([home, j])
                    vis = np.concatenate([vis, np.ones(len(r), dtype=bool)])
                for at in range(0, len(row), 4096):
                    part = row[at:at + 4096]
                    yield pa.RecordBatch.from_pydict({
                        "label": pa.array([label] * len(part), b.schema.field("label").type), "dim": pa.array([dim] * len(part), pa.int32()),
                        "cell": pa.array(cell[at:at + 4096], pa.int32()), "vis": pa.array(vis[at:at + 4096]),
                        "node": pa.array(g["node"].to_numpy()[part], pa.int64()), "mult": pa.array(g["mult"].to_numpy()[part], pa.int64()),
                        "vec": pa.array([x[k].tobytes() for k in part.tolist()], pa.binary())})

    kind = nodes.schema["label"].dataType.simpleString()
    placed = nodes.select("label", "dim", "node", "mult", "vec").mapInArrow(
        assign, f"label {kind}, dim int, cell int, vis boolean, node long, mult long, vec binary")
    placed = placed.withColumn("key", F.xxhash64("label", "dim", "cell"))
    dealt = block_pairs(placed.select("key", "vis", "node", "mult", "vec"), "key", "node", block, "vis").select(
        "key", "ga", "gb", "blk", "node", "mult", "vec")

    def compare(batches):
        for t in iter_groups(batches, ["key", "ga", "gb"]):
            blk, ga, gb = t.column("blk").to_numpy(), t.column("ga")[0].as_py(), t.column("gb")[0].as_py()
            node, mult = t.column("node").to_numpy(), t.column("mult").to_numpy()
            vec = np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=np.float64).reshape(len(node), -1)
            left = np.flatnonzero(blk == ga)
            right = left if ga == gb else np.flatnonzero(blk == gb)
            if not len(left) or not len(right):
                continue
            i, j = np.nonzero(vec[left] @ vec[right].T >= threshold)
            i, j = left[i], right[j]
            ok = i != j
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            n = len(node)
            links = np.bincount(i, mult[j], n)
            if ga != gb:  # within one block both directions are there already
                links += np.bincount(j, mult[i], n)
            order = np.argsort(node, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(n)
            root = order[local_roots(n, rank[i], rank[j])][rank]
            far = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[far]), pa.array(links[far].astype(np.int64)), pa.array(node[root[far]])], ["node", "links", "root"])

    found = cut_lineage(deal_groups(dealt, ["key", "ga", "gb"]).mapInArrow(compare, "node long, links long, root long"))
    comp = connected_components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = (nodes.select("label", "k1", "k2", "node", "mult").join(links, "node", "left").join(comp, "node", "left")
                .select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                        F.coalesce("component", "node").alias("component_id")))
    out = rows.join(per_node, ["label", "k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id"),
                      F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))
