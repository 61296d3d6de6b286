"""SimHash near-duplicates: links at a small Hamming distance, found by
pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import (block_pairs, connected_components, deal_groups, iter_groups,
                                  iter_slices, local_roots)
from sparkprep.session import cut_lineage

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of one text (signed).

    A-Z are lower-cased, words are runs of anything but ASCII white space,
    shingles are ``width`` consecutive words joined by a space, repeats
    included; fewer words are one shingle; no words (null too) give zero.  A
    bit is set if over half the XXH64 values have it.
    """
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII only, both times
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        spans = [(0, len(joined))]
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size + 1) - 1
        spans = zip((end - size)[:len(words) - width + 1].tolist(), end[width - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        part = h[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fp) with one row per input row."""
    def run(batches):
        for b in iter_slices(batches):
            fps = [fingerprint(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long").withColumnRenamed("id", id_col)


def pigeonring_links(fps: DataFrame, max_distance: int = 2, segments: int = 8, block: int = 1024) -> DataFrame:
    """Links (a, b) that join all fingerprints ``fp`` within ``max_distance`` bits.

    The 64 bits are a ring of ``segments`` equal segments.  If two values
    differ in at most t bits, some segment starts a chain in which the first l
    segments differ in at most floor(l * t / segments) bits in all, for every
    l.  The prefix whose budget is zero must be equal, so it is the shuffle
    key (24 bits for 8 segments and t = 2; more segments make longer keys and
    more rows); the longer prefixes prune inside a group, and the whole ring
    is the Hamming check itself.

    Input: distinct fingerprints.  Large groups are compared in pairs of
    blocks, and each pair of blocks returns a spanning forest of its links,
    never all pairs, so the rows stay linear in the group's size for each
    block while the components are exact.
    """
    if not 0 <= max_distance < segments or 64 % segments:
        raise ValueError("segments must divide 64 and exceed max_distance")
    wide = 64 // segments
    free = segments if not max_distance else -(-segments // max_distance) - 1  # leading segments with budget 0
    used = wide * free
    budgets = [(wide * k, k * max_distance // segments) for k in range(free + 1, segments + 1)]

    def rotated(col, by):
        return col if not by else F.shiftleft(col, by).bitwiseOR(F.shiftrightunsigned(col, 64 - by))

    rows = F.array(*[F.struct(F.lit(i).alias("i"), rotated(F.col("fp"), wide * i).alias("rot")) for i in range(segments)])
    keyed = fps.select("fp", F.explode(rows).alias("r")).select(
        "fp", F.col("r.i").alias("i"), F.col("r.rot").alias("rot"))
    prefix = F.shiftrightunsigned("rot", 64 - used) if used < 64 else F.col("rot")
    keyed = keyed.select("fp", "rot", F.struct("i", prefix.alias("p")).alias("key"))
    dealt = block_pairs(keyed, "key", "fp", block).select(
        F.col("key.i").alias("i"), F.col("key.p").alias("p"), "ga", "gb", "blk", "fp", "rot")

    def run(batches):
        for t in iter_groups(batches, ["i", "p", "ga", "gb"]):
            if t.num_rows < 2:
                continue
            fp, rot = t.column("fp").to_numpy(), t.column("rot").to_numpy().view(np.uint64)
            blk, ga, gb = t.column("blk").to_numpy(), t.column("ga")[0].as_py(), t.column("gb")[0].as_py()
            left = np.flatnonzero(blk == ga)
            right = left if ga == gb else np.flatnonzero(blk == gb)
            if not len(left) or not len(right):
                continue
            xor = rot[left][:, None] ^ rot[right][None, :]
            i, j = np.nonzero(np.bitwise_count(xor >> np.uint64(64 - budgets[0][0])) <= budgets[0][1]) if budgets else np.nonzero(xor == 0)
            for used_bits, most in budgets[1:]:
                ok = np.bitwise_count(xor[i, j] >> np.uint64(64 - used_bits)) <= most
                i, j = i[ok], j[ok]
            i, j = left[i], right[j]
            ok = i != j
            if not ok.any():
                continue
            order = np.argsort(fp, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            root = order[local_roots(len(fp), rank[i[ok]], rank[j[ok]])][rank]
            far = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[root[far]])], ["a", "b"])

    return deal_groups(dealt, ["i", "p", "ga", "gb"]).mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3, max_distance: int = 2, segments: int = 8,
                   block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, fp (signed long) and component_id,
    the smallest id reachable over links of at most ``max_distance`` bits.

    Equal fingerprints are one node, so a group of copies of any size costs
    one row after the first aggregation.  Null and empty texts have
    fingerprint zero and link like any other.  A null id gets the component of
    its fingerprint; it is never a component's name unless all ids are null.
    An empty table gives an empty result.  Other columns are ignored.
    """
    d = cut_lineage(fingerprints(docs, width, id_col, text_col))
    nodes = d.groupBy("fp").agg(F.min(id_col).alias("_low"), F.count("*").alias("_n"))
    links = pigeonring_links(nodes.select("fp"), max_distance, segments, block)
    comp = connected_components(links, "a", "b")
    names = comp.join(nodes, comp["node"] == nodes["fp"]).select("node", "component", "_low")
    lows = names.groupBy("component").agg(F.min("_low").alias("component_id"))
    named = names.join(lows, "component").select(F.col("node").alias("fp"), "component_id")
    every = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "_low").alias("component_id"), "_n")
    # fingerprints with over a thousandth of all rows are under a thousand: broadcast, so that no task gathers their rows
    often = F.broadcast(every.where(F.col("_n") * 1000 > d.count()).select("fp", F.col("component_id").alias("_often"), F.lit(True).alias("_is")))
    d = d.join(often, "fp", "left")
    rest = d.where("_is is null").join(every, "fp", "left")
    return (d.where("_is").select(id_col, "fp", F.col("_often").alias("component_id"))
            .unionByName(rest.select(id_col, "fp", "component_id")))
