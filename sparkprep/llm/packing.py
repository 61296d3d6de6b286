"""Best-fit packing of tokenised documents into sequences of fixed length, by
hierarchical residual packing."""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import iter_slices, worker_state
from sparkprep.session import cut_lineage

END_ID = 2
MEMBERS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
BINS = f"sequence_id long, fill long, members {MEMBERS}"
FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32", "offset"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


class TokenBytes(dict):
    """Ids (little-endian uint32) of " " + word, computed on first use.

    In byte-level BPE with this split pattern a token never spans the place
    before a space that follows a non-space, so a text's ids are the ids of
    its space-led words one after the other.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word):
        ids = np.array(self.encode(" " + word), dtype="<u4").tobytes()
        if len(word) <= 64:
            if len(self) > 400_000:
                self.clear()
            self[word] = ids
        return ids


def encoder(ranks_path: str, pattern: str, vocabulary_path: str | None = None):
    """text -> ids as bytes, kept in the worker between tasks.

    A text that holds one of the added tokens of the vocabulary file is
    encoded by that file's tokenizer, which gives such a token one id wherever it stands."""
    state = worker_state()
    if state.get("ranks_path") != ranks_path or state.get("vocabulary_path") != vocabulary_path:
        import tiktoken

        state["added"], state["whole"], state["vocabulary_path"] = None, None, vocabulary_path
        if vocabulary_path:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(vocabulary_path)
            added = [t.content for t in whole.get_added_tokens_decoder().values()]
            state["added"], state["whole"] = re.compile("|".join(map(re.escape, added))) if added else None, whole

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        state["ranks_path"], state["cache"], state["bpe"] = ranks_path, TokenBytes(bpe.encode_ordinary), bpe
    words, bpe, added, whole = state["cache"], state["bpe"], state["added"], state["whole"]

    def encode(text: str) -> bytes:
        if added and added.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        if all(rest) and not any(w[0].isspace() for w in rest if w[0] < "!" or w[0] > "~"):
            return np.array(bpe.encode_ordinary(first), dtype="<u4").tobytes() + b"".join(map(words.__getitem__, rest))
        return np.array(bpe.encode_ordinary(text), dtype="<u4").tobytes()

    return encode


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: items of ``sizes`` (1..capacity) to bins.  Bins are
    filed by free space; a bit mask of the free spaces in use finds the
    tightest one at once."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = used >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            slot = by_free[free].pop()
            if not by_free[free]:
                used &= ~(1 << free)
            bins[slot].append(k)
        else:
            free, slot = capacity, len(bins)
            bins.append([k])
        free -= size
        if free:
            by_free[free].append(slot)
            used |= 1 << free
    return bins


def bins_batch(bins: list[list[int]], sizes: np.ndarray, starts: np.ndarray, members: pa.StructArray, first_id: int) -> pa.RecordBatch:
    """Bins over items; item k is members[starts[k]:starts[k + 1]], whose
    offsets are moved to the item's place in its bin."""
    order = np.array([k for b in bins for k in b], dtype=np.int64)
    per_bin = np.array([len(b) for b in bins], dtype=np.int64)
    at = np.cumsum(sizes[order]) - sizes[order]
    head = np.repeat(np.cumsum(per_bin) - per_bin, per_bin)
    shift = at - at[head]
    n = (starts[1:] - starts[:-1])[order]
    ends = np.cumsum(n)
    take = np.repeat(starts[order] - (ends - n), n) + np.arange(ends[-1])
    flat = members.take(pa.array(take)).flatten()
    flat[5] = pa.array(flat[5].to_numpy() + np.repeat(shift, n))
    fill = np.add.reduceat(sizes[order], np.cumsum(per_bin) - per_bin)
    cut = np.concatenate([[0], np.add.reduceat(n, np.cumsum(per_bin) - per_bin).cumsum()])
    return pa.RecordBatch.from_arrays([
        pa.array(first_id + np.arange(len(bins))), pa.array(fill.astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays(flat, FIELDS))], ["sequence_id", "fill", "members"])


def emit(batch: pa.RecordBatch, rows: int = 2048):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tokenize_and_fit(docs: DataFrame, capacity: int, ranks_path: str, pattern: str, flush: int,
                     id_col: str, text_col: str, vocabulary_path: str | None = None) -> DataFrame:
    """First level: ids, pieces and best fit inside each input partition."""
    def run(batches):
        encode = encoder(ranks_path, pattern, vocabulary_path)
        next_id = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def fit():
            nonlocal rows, next_id
            cols = list(zip(*rows))
            members = pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip([*cols, [0] * len(rows)], TYPES)], FIELDS)
            sizes = np.array(cols[3], dtype=np.int64)
            bins = best_fit(sizes, capacity)
            out = bins_batch(bins, sizes, np.arange(len(rows) + 1), members, next_id)
            next_id += len(bins)
            rows = []
            return out

        for b in iter_slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text or "") + END_ID.to_bytes(4, "little")
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total, capacity), total]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(ids[4 * lo:4 * hi])))
            if len(rows) >= flush:
                yield from emit(fit())
        if rows:
            yield from emit(fit())

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, BINS)


def refit(underfull: DataFrame, capacity: int, level: int) -> DataFrame:
    """A further level: the underfull bins of a partition are items themselves."""
    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.concat_tables(tables).combine_chunks()
        sizes = t.column("fill").to_numpy()
        lists = t.column("members").chunk(0)
        starts = lists.offsets.to_numpy().astype(np.int64)
        members = lists.flatten()
        bins = best_fit(sizes, capacity)
        first = (level << 56) | (TaskContext.get().partitionId() << 32)
        yield from emit(bins_batch(bins, sizes, starts - starts[0], members, first))

    return underfull.mapInArrow(run, BINS)


def pack(docs: DataFrame, capacity: int = 1024, nearly_full: float = 0.998, fan_in: int = 8,
         rows_per_task: int = 100_000, ranks_path: str | None = None, pattern: str | None = None, vocabulary_path: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A document is its token ids (a byte-level BPE given by ``ranks_path`` and
    its split ``pattern``; added tokens by the tokenizer of ``vocabulary_path``, if given) and the end id 2; null and empty texts are the end
    id alone.  A document longer than ``capacity`` is cut so that only its
    first piece may be shorter.  Each input partition packs its pieces by
    best-fit decreasing (at most 2 x ``rows_per_task`` at a time) and emits the bins
    filled to ``nearly_full``; the underfull bins are items of the next level,
    where ``fan_in`` partitions become one, until one partition is left or a
    level joins under one in twenty of them.  A task never holds more than
    about ``rows_per_task`` underfull bins.  Every level is checkpointed in
    the shared folder.  Repeated rows are separate documents; a null id stays
    null; an empty table gives an empty result; other columns are ignored.
    """
    if ranks_path is None:
        import public_tokenizers

        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    now = cut_lineage(tokenize_and_fit(docs, capacity, ranks_path, pattern, 2 * rows_per_task, id_col, text_col, vocabulary_path))
    limit = nearly_full * capacity
    parts, level, done, before = max(1, now.rdd.getNumPartitions()), 0, [], None
    while True:
        under = now.where(F.col("fill") < limit)
        count = under.count()
        if not count or (level and (parts == 1 or count > 0.95 * before)):
            done.append(now)
            break
        done.append(now.where(F.col("fill") >= limit))
        level, before = level + 1, count
        parts = max(-(-parts // fan_in), -(-count // rows_per_task))
        now = cut_lineage(refit(under.coalesce(parts), capacity, level))
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    m = F.col("m")
    return (bins.select("sequence_id", F.explode("members").alias("m"))
            .select(m["doc_id"].alias(id_col), m["piece"].alias("piece"), m["start"].alias("start"), m["length"].alias("length"),
                    m["ids_crc32"].alias("ids_crc32"), "sequence_id", m["offset"].alias("offset")))
