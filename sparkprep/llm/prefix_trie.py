"""Trie of conversation prefixes by fixed-length block hashing."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import iter_slices
from sparkprep.session import cut_lineage

DIGEST = ["cx", "cy"]
BEFORE = ["px", "py"]
NODE = ["d", *DIGEST]
BLOCK_NODE = ["k", *BEFORE]


def thin_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, x, y, bytes): turns by their place from 0, with the two
    halves of the md5 of role and text.  Texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), half(1).alias("x"), half(16).alias("y"),
        F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "x", "y")
    return rows.select("conv", (F.row_number().over(order) - 1).alias("pos"), "x", "y", "bytes")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, x, y, bytes) of the rebuilt conversations, and all their ids.

    Conversation c is the first h turns of conversation c - c % 5, then its
    own turns after its first h; h is crc32(c as text) % 9."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    turns = cut_lineage(turns)
    ids = turns.select("conv").distinct()
    own = turns.where(F.col("pos") >= h)
    base = turns.where((F.col("conv") % 5 == 0) & (F.col("pos") < 8)).withColumnRenamed("conv", "base")
    heirs = ids.select("conv", (F.col("conv") - F.col("conv") % 5).alias("base"), h.alias("h"))
    head = heirs.join(base, "base").where("pos < h").select(own.columns)
    return head.unionByName(own), ids


def prefix_digests(turns: DataFrame, block: int) -> DataFrame:
    """Each turn with the digest of the prefix that it ends (cx, cy), that of
    the prefix before its block (px, py), the block's number k, whether it is
    its block's last turn, and the bytes of the turns before it (pb).

    A prefix's digest is the xor of its turns' hashes, each taken with its
    place: so a block's digest is an aggregate of its turns, and a prefix's
    one of its blocks."""
    rows = turns.withColumn("d", F.row_number().over(Window.partitionBy("conv").orderBy("pos")).cast("long"))
    rows = rows.select("conv", "d", "bytes", F.expr(f"(d - 1) div {block}").alias("k"),
                       F.xxhash64("d", "x", "y").alias("x"), F.xxhash64("y", "d", "x", F.lit(1)).alias("y"))
    conv = Window.partitionBy("conv").orderBy("d")
    so_far = conv.rowsBetween(Window.unboundedPreceding, 0)
    in_block = Window.partitionBy("conv", "k").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.bit_xor("x").over(so_far).alias("cx"), F.bit_xor("y").over(so_far).alias("cy"),
                       (F.sum("bytes").over(so_far) - F.col("bytes")).alias("pb"), F.lead("d").over(conv).isNull().alias("end"))
    rows = rows.select("*", F.bit_xor("x").over(in_block).alias("_x"), F.bit_xor("y").over(in_block).alias("_y"))
    return rows.select("conv", "d", "k", "bytes", "pb", "x", "y", "cx", "cy", F.col("cx").bitwiseXOR(F.col("_x")).alias("px"),
                       F.col("cy").bitwiseXOR(F.col("_y")).alias("py"), "end", (F.col("end") | (F.col("d") % block == 0)).alias("last"))


def split_blocks(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks whose conversations all go on alike, with their number n and
    least id m; the turns of the blocks in which siblings diverge.

    Conversations are grouped by block digests first.  Those that are equal up to
    a block's start and have one digest at its end are equal in between."""
    groups = turns.where("last").groupBy(*BLOCK_NODE, *DIGEST, "d").agg(F.count("*").alias("n"), F.min("conv").alias("m"))
    starts = cut_lineage(groups.groupBy(*BLOCK_NODE).agg(F.count("*").alias("ways"), F.sum("n").alias("n"), F.min("m").alias("m")))
    alike = starts.where("k > 0 and ways = 1").select(*BLOCK_NODE, "n", "m")
    split = starts.where("k > 0 and ways > 1").select(*BLOCK_NODE)
    # all conversations meet in the first block: refined without a join
    diverge = turns.where("k = 0").unionByName(turns.where("k > 0").join(split, BLOCK_NODE).select(turns.columns))
    return alike, diverge


def ends_digests(ends: DataFrame, rows: int) -> DataFrame:
    """(d, cx, cy, ends_sha256) of (conv, d, cx, cy): the SHA-256 of a node's
    ids in order, comma-joined.

    Ids are cut into about sqrt(``rows``) ranges of like size; a node's ids of
    a range become one row, and its rows are hashed one after the other.
    So a node where a third of all conversations end meets its task as the square root of
    them in rows, each of about as many ids."""
    parts = max(1, math.isqrt(rows))
    cuts = sorted(set(ends.select(F.col("conv").cast("double").alias("v")).approxQuantile("v", [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    numbered = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="v", outputCol="part").transform(ends.withColumn("v", F.col("conv").cast("double")))
    chunks = numbered.groupBy(*NODE, "part").agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        key, sha = None, None
        for b in iter_slices(batches, 1024):
            out = []
            for *node, ids in zip(*(b.column(k).to_pylist() for k in range(4))):
                if node == key:
                    sha.update(b"," + ids.encode())
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = node, hashlib.sha256(ids.encode())
            yield batch(out)
        if key:
            yield batch([(*key, sha.hexdigest())])

    def batch(rows):
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [*NODE, "ends_sha256"])

    dealt = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "part")
    return dealt.select(*NODE, "ids").mapInArrow(run, "d long, cx long, cy long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = 4, id_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is the least id among its members and its depth.  Conversations are
    grouped by the digests of successive blocks of ``block`` turns; only inside blocks
    where siblings diverge are the digests of single turns grouped, elsewhere the
    nodes are read from the least member's turns.  What is summed over a
    subtree is summed over a node's members instead: n_leaves counts the members
    that are the least id of a childless node; saved_tokens adds up, for each member
    but the least, the bytes it shares with lesser ids beyond the node's parent.  So
    no step goes level by level, and a node of any size is a grouped sum.

    Turns are ordered by turn, null first, ties by the hash of role and text; null
    roles and texts are empty; repeated rows are turns of their own.  Rows of a
    null id belong to no conversation.  Texts of any length are hashed and measured where
    they are read.  An id's turns are numbered in one window, of
    48 bytes a turn, spilled if long.  An empty table has no node, not even
    the root; other columns are ignored.
    """
    rebuilt, ids = rebuild(thin_turns(conversations, id_col, turn_col, role_col, text_col))
    turns = cut_lineage(prefix_digests(rebuilt, block))
    total, least = ids.agg(F.count("*"), F.min("conv")).first()
    alike, diverge = split_blocks(turns)
    diverge = cut_lineage(diverge)

    node_cols = [*NODE, "x", "y", "bytes", "pb", "conv", "n"]
    same = turns.join(alike.select("k", F.col("m").alias("conv"), "n"), ["k", "conv"])
    refined = diverge.groupBy(*NODE).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("bytes").alias("bytes"),
                                         F.first("pb").alias("pb"), F.min("conv").alias("conv"), F.count("*").alias("n"))
    inner = same.where(F.col("d") > F.col("k") * block + 1).select(*node_cols, F.col("conv").alias("parent"))
    first = same.where(F.col("d") == F.col("k") * block + 1).select(node_cols).unionByName(refined.select(node_cols))
    nodes = cut_lineage(first.withColumn("parent", F.lit(None).cast("long")).unionByName(inner))
    up = nodes.select((F.col("d") + 1).alias("d"), F.col("cx").alias("ux"), F.col("cy").alias("uy"), F.col("conv").alias("parent"))
    known = nodes.where("parent is not null or d = 1").withColumn("parent", F.coalesce("parent", F.lit(least)))
    asked = nodes.where("parent is null and d > 1").drop("parent").withColumns(
        {"ux": F.col("cx").bitwiseXOR(F.col("x")), "uy": F.col("cy").bitwiseXOR(F.col("y"))})
    root = conversations.sparkSession.createDataFrame(
        [(0, 0, 0, 0, 0, 0, 0, least, total, None)] if total else [], "d long, cx long, cy long, x long, y long, bytes long, pb long, conv long, n long, parent long")
    nodes = known.unionByName(asked.join(up, ["d", "ux", "uy"]).select(known.columns)).unionByName(root)
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("conv")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["d", "conv"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut_lineage(nodes.drop("x", "y"))

    # of each conversation: bytes it shares with lesser ids; whether a childless node is called after it
    whole = turns.where("end").select("conv", *NODE, (F.col("pb") + F.col("bytes")).alias("size"))
    named = nodes.groupBy("conv").agg(F.min_by("pb", "d").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    ends = ids.join(whole, "conv", "left").select("conv", *(F.coalesce(c, F.lit(0)).alias(c) for c in (*NODE, "size")))
    ends = cut_lineage(ends.join(named, "conv", "left").select(
        "conv", *NODE, F.coalesce("shared", "size").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")))

    worth = [F.sum("leaf").alias("leaf"), F.sum("shared").alias("shared")]
    value = ends.select("conv", "shared", "leaf")
    by_turn = diverge.select("conv", *NODE).join(value, "conv").groupBy(*NODE).agg(*worth)
    by_block = turns.where("last and k > 0").join(value, "conv").groupBy(*BLOCK_NODE).agg(*worth).join(alike.where("n > 1"), BLOCK_NODE)
    by_block = by_block.select(F.col("m").alias("conv"), "k", "leaf", "shared").join(turns.select("conv", "k", *NODE), ["conv", "k"]).select(by_turn.columns)
    at_root = ends.agg(*worth).where("leaf is not null").select(*(F.lit(0).cast("long").alias(c) for c in NODE), "leaf", "shared")
    sums = by_turn.unionByName(by_block).unionByName(at_root)
    mine = value.select("conv", F.col("shared").alias("own"))
    told = nodes.where("n > 1").join(sums, NODE).join(mine, "conv").select(
        *NODE, "leaf", (F.col("shared") - F.col("own") - (F.col("n") - 1) * F.col("pb")).alias("saved"))

    hashes = ends_digests(ends.select("conv", *NODE), total)
    none = hashlib.sha256(b"").hexdigest()
    long = lambda c, name: c.cast("long").alias(name)
    return nodes.join(told, NODE, "left").join(hashes, NODE, "left").select(
        F.col("conv").alias("conv_id"), long(F.col("d"), "depth"), F.col("parent").alias("parent_conv_id"), long(F.col("n"), "n_convs"),
        long(F.col("n_children"), "n_children"), long(F.coalesce("leaf", F.lit(1)), "n_leaves"), long(F.coalesce("saved", F.lit(0)), "saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
