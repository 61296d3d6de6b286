"""Interaction of document filters: what each filter removes, in every order."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkprep.llm.common import iter_slices

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
MARKS = re.compile(rb"[#$%&*|]")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
CONTINUATION = bytes(range(0x80, 0xC0))
PIECE = 1 << 20  # bytes of a text that are cut to words at a time
THIN = "id {kind}, part string, mask int, n long"


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; a long text is cut between words."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        gap = SPACE.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        words = text[at:end].split()
        n, at = n + len(words), end
        seen.update(words)
    return n, len(seen)


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = word_counts(text)
    upper = len(text.translate(None, NOT_UPPER))
    points = len(text.translate(None, CONTINUATION))
    return (n < 100) | (100 * distinct < 80 * n) << 1 | (100 * upper > 10 * points) << 2 | (MARKS.search(text) is not None) << 3


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Bytes that ``a`` and ``b[at:]`` share from their start."""
    n = min(len(a), len(b) - at)
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n, at)
    k = int(differ.argmax()) if n else 0
    return k if n and differ[k] else n


class TextTrie:
    """Compressed trie of whole texts.  A node is [edges, terminal], an edge
    [label, node] by its first byte.  A terminal is [least id, rows of that id
    by part, mask of the text]."""

    def __init__(self):
        self.root, self.bytes = [{}, None], 0

    def node(self, text: bytes) -> list:
        """The node where ``text`` ends, made if need be."""
        node, at, n = self.root, 0, len(text)
        while at < n:
            edge = node[0].get(text[at])
            if edge is None:
                leaf = [{}, None]
                node[0][text[at]] = [text[at:], leaf]
                self.bytes += n - at + 400  # about what the objects of a node take
                return leaf
            label = edge[0]
            if not text.startswith(label, at):
                k = common_prefix(label, text, at)
                edge[0], edge[1] = label[:k], [{label[k]: [label[k:], edge[1]]}, None]
                self.bytes += 400
            at += len(edge[0])
            node = edge[1]
        return node

    def insert(self, text: bytes, ident: int, part: str, n: int, mask: int | None, found: Counter) -> None:
        """Adds ``n`` rows; those that a smaller id of the same text makes
        duplicates go to ``found`` by (id, part, mask)."""
        node = self.node(text)
        old = node[1]
        if old is None:
            node[1] = [ident, {part: n}, text_mask(text) if mask is None else mask]
        elif ident > old[0]:
            found[ident, part, old[2] | DUPLICATE] += n
        elif ident == old[0]:
            old[1][part] = old[1].get(part, 0) + n
        else:
            for p, count in old[1].items():
                found[old[0], p, old[2] | DUPLICATE] += count
            node[1] = [ident, {part: n}, old[2]]

    def terminals(self):
        """(text, terminal) of each text, by a walk over the trie."""
        stack = [((), self.root)]
        while stack:
            path, (edges, terminal) = stack.pop()
            stack += [((path, label), node) for label, node in edges.values()]
            if terminal is not None:
                labels = []
                while path:
                    path, label = path
                    labels.append(label)
                yield b"".join(reversed(labels)), terminal


def batches_of(rows, schema: pa.Schema, most: int = 8 << 20):
    """Arrow batches of about ``most`` bytes of text."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += 64 + (len(r[1]) if len(schema) == 6 and r[1] is not None else 0)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def text_bounds(src: DataFrame, ranges: int, rows: int, per_range: int = 16, longest: int = 1 << 16) -> list[bytes]:
    """Sorted prefixes that cut the texts into about ``ranges`` ranges.

    From a sample of distinct texts, picked by their hash, every
    ``per_range``-th in sorted order gives a bound: its shortest prefix that
    the text before it in order doesn't have.  So a prefix is as long as
    the texts around it need, a byte among different texts, kilobytes inside
    a group of near copies.  Bounds only decide which task meets a text; one
    over ``longest`` bytes is left out, which costs balance, nothing else.
    """
    share = min(1.0, per_range * ranges / max(rows, 1))
    pick = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(1 << 30)) < int(share * (1 << 30))
    tasks = -(-ranges // 1024)
    sample = src.where(pick).select(F.col("text").cast("binary").alias("text")).distinct()
    sample = (sample.repartitionByRange(tasks, "text") if tasks > 1 else sample.coalesce(1)).sortWithinPartitions("text")

    def run(batches):
        last, k = b"", 0
        for b in iter_slices(batches):
            out = []
            for text in b.column(0).to_pylist():
                k += 1
                if k % per_range == 0:
                    bound = text[:common_prefix(last, text, 0) + 1]
                    if len(bound) <= longest:
                        out.append(bound)
                last = text
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["bound"])

    return sorted({bytes(r.bound) for r in sample.mapInArrow(run, "bound binary").collect()})


def failure_masks(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
                  range_bytes: int = 32 << 20, flush_bytes: int = 32 << 20) -> DataFrame:
    """(id, part, mask, n): rows of ``docs`` by id, part and the filters they fail.

    Each task inserts its texts in compressed tries (a trie goes on when it
    holds ``flush_bytes``) and sends on one copy of each text with its least
    id; the other copies are duplicates already.  Texts then go to the task of
    their range between the bounds of ``text_bounds``, where a trie of all
    texts of the range finds the least id of the table.  So of a text that a
    third of all rows share, each task sends one row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                      F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    spark = docs.sparkSession
    rows, size = src.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    bounds = spark.sparkContext.broadcast(text_bounds(src, ranges, rows))
    id_type = to_arrow_type(src.schema["id"].dataType)
    sent = pa.schema([("route", pa.int32()), ("text", pa.binary()), ("id", id_type), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
    thin = pa.schema([("id", id_type), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])

    def local(batches):
        trie, found = TextTrie(), Counter()

        def rows():
            for text, (ident, parts, mask) in trie.terminals():
                route = bisect_right(bounds.value, text)
                yield from ((route, text, ident, p, mask, n) for p, n in parts.items())
            for k, ((ident, part, mask), n) in enumerate(found.items()):
                yield k % ranges, None, ident, part, mask, n

        for b in iter_slices(batches):
            for ident, text, part in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                if ident is None:
                    found[None, part, text_mask(text)] += 1
                else:
                    trie.insert(text, ident, part, 1, None, found)
            if trie.bytes + 200 * len(found) > flush_bytes:
                yield from batches_of(rows(), sent)
                trie, found = TextTrie(), Counter()
        yield from batches_of(rows(), sent)

    def table(batches):
        trie, found = TextTrie(), Counter()
        for b in iter_slices(batches):
            for text, ident, part, mask, n in zip(*(b.column(k).to_pylist() for k in range(5))):
                if text is None:
                    found[ident, part, mask] += n
                else:
                    trie.insert(text, ident, part, n, mask, found)
        kept = ((ident, p, mask, n) for _, (ident, parts, mask) in trie.terminals() for p, n in parts.items())
        yield from batches_of(kept, thin)
        yield from batches_of(((*key, n) for key, n in found.items()), thin)

    out = src.select("id", "text", "part").mapInArrow(local, f"route int, text binary, id {kind}, part string, mask int, n long")
    return out.repartitionById(ranges, "route").drop("route").mapInArrow(table, THIN.format(kind=kind))


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id",
                  text_col: str = "text", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, filter_order (all 120) and step (1 to 5): the counts
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The masks of ``failure_masks`` are reduced to counts by id, part and mask, joined
    with the labels, and summed up by part and mask: 32 rows a part at most, from which every
    order is told.  A text is never shuffled twice, a label never meets a text.

    Null texts are empty (they fail A), null parts the empty string.  Repeated rows
    count each; rows of one id and text are no duplicates of each other.  A
    null id is no smaller id: its row neither fails E nor makes others fail.
    Very long texts are cut to words piece by piece.  Several labels of an id:
    the largest; null labels are none.  An empty table gives an empty result;
    other columns are ignored.
    """
    masks = failure_masks(docs, part_col, id_col, text_col).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag(good_col).alias("good"), flag(toxic_col).alias("toxic"))
    count = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    cells = masks.join(known, "id", "left").groupBy("part", "mask").agg(count("good"), count("toxic"), F.sum("n").alias("n"))

    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    orders = [("".join(p), k + 1, sum(bit[f] for f in p[:k]), bit[p[k]]) for p in permutations(FILTERS) for k in range(len(p))]
    pairs = sorted({o[2:] for o in orders})
    steps = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, bit int")
    at = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("bit")) for b, f in pairs]))
    m, before, own = F.col("mask"), F.col("before"), F.col("bit")
    fails, gone = m.bitwiseAND(own) != 0, m.bitwiseAND(before) != 0
    total = lambda when, c="n": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    counts = cells.withColumn("at", at).select("*", "at.*").groupBy("part", "before", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(m == own).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"))
    times = {p: sum(o[2:] == p for o in orders) for p in pairs}
    weight = F.element_at(F.create_map(*[F.lit(v) for (b, f), n in times.items() for v in (b << 8 | f, n)]), F.shiftleft("before", 8).bitwiseOR(own))
    value = counts.groupBy("part", "bit").agg(F.sum(F.col("removed") * weight).cast("long").alias("shapley"))
    return (counts.join(F.broadcast(steps), ["before", "bit"]).join(value, ["part", "bit"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
