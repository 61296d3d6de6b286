"""Benchmark decontamination by latent semantic retrieval: randomised SVD of
TF-IDF passages, cosine candidates, then longest-common-subsequence and answer
checks."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import iter_slices, sum_blocks
from sparkprep.session import cut_lineage

WORD = re.compile(rb"[a-z0-9\x80-\xff']+")
STEP = 12  # words; windows start every STEP (short items) or 2 * STEP words
SHORT, LONG = 2, 4  # window lengths in steps
SHORT_ITEM = 30  # items under so many words are looked for in short windows
FEATURE_BLOCK = 2048


def word_ids(text: str) -> np.ndarray:
    """32-bit hashes of the lower-cased words of a whole text."""
    return np.array(list(map(zlib.crc32, WORD.findall(text.lower().encode()))), dtype=np.uint32)


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words): every text as its word hashes."""
    def run(batches):
        for b in iter_slices(batches):
            ids = [word_ids(t) for t in b.column(1).to_pylist()]
            cut = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).view(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], ["id", "words"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, words array<int>")


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat word hashes of a list column, and where each row begins (and the end)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    cut = column.offsets.to_numpy().astype(np.int64)
    return flat, cut - cut[0]


def document_counts(words: DataFrame, features: int) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each hashed feature occurs; over all documents."""
    def run(batches):
        out = np.zeros((1, features), dtype=np.int64)
        n = 0
        for b in iter_slices(batches):
            flat, cut = lists(b.column(0))
            n += b.num_rows
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                met = np.zeros(features, dtype=np.int64)
                met[flat[lo:hi] % features] = 1
                out[0] += met
        src = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([src] * 2, pa.int32()), pa.array(
            [zlib.compress(x.tobytes(), 1) for x in (out, np.full((1, features), n, dtype=np.int64))], pa.binary())], ["block", "src", "data"])

    got = {r["block"]: np.frombuffer(zlib.decompress(r["data"]), dtype=np.int64) for r in
           sum_blocks(words.select("words").mapInArrow(run, "block int, src int, data binary"), "int64", (1, features)).toLocalIterator()}
    return (int(got[1][0]), got[0]) if got else (0, np.zeros(features, dtype=np.int64))


def blocks_of(cut: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of ``step`` words of the rows that begin at
    cut[:-1], and the number of blocks of each row."""
    n = -(-np.diff(cut) // step)
    first = np.cumsum(n) - n
    return np.repeat(cut[:-1], n) + step * (np.arange(n.sum()) - np.repeat(first, n)), n


def sums_of_runs(y: np.ndarray, at: np.ndarray, heads: np.ndarray, steps: int = 8) -> np.ndarray:
    """Sums of y[at] over the runs that begin at ``heads``: the runs' first rows together,
    step by step, and the rest of each long run."""
    size = np.diff([*heads, len(at)])
    order = np.argsort(-size, kind="stable")
    first, size = heads[order], size[order]
    out = y[at[first]]
    for k in range(1, steps):
        n = int(np.searchsorted(-size, -k))  # runs of more than k rows
        out[:n] += y[at[first[:n] + k]]
    for i in range(int(np.searchsorted(-size, -steps))):
        out[i] += y[at[first[i] + steps:first[i] + size[i]]].sum(axis=0)
    back = np.empty_like(out)
    back[order] = out
    return back


def randomised_svd(words: DataFrame, idf: np.ndarray, rank: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (features x rank) and singular values of the TF-IDF
    matrix A of all 48-word passages of ``words``.  A word counts once in a
    passage and rows keep their length, so that passages of one repeated word
    weigh little.

    One distributed pass: each task projects its passages on a random matrix,
    Y = A R, and adds up Y'Y and A'Y.  With Y = Q T the small matrix B = Q'A is
    (A'Y T^-1)', and its SVD on the driver (features x rank numbers) is that
    of the projection Q Q'A.
    """
    features, width = len(idf), rank + 8
    omega = np.random.default_rng(seed).normal(size=(features, width)).astype(np.float32)
    shared = words.sparkSession.sparkContext.broadcast(np.concatenate([omega * idf.astype(np.float32)[:, None], np.zeros((1, width), dtype=np.float32)]))
    rows = features + width
    pad = -(-rows // FEATURE_BLOCK) * FEATURE_BLOCK

    def run(batches):
        r = shared.value  # row ``features`` is zero
        out = np.zeros((pad, width))
        for b in iter_slices(batches, 64):
            flat, cut = lists(b.column(0))
            if not len(flat):
                continue
            at, _ = blocks_of(cut, STEP * LONG)
            passage = np.repeat(np.arange(len(at)), np.diff([*at, len(flat)]))
            once = np.sort(passage * features + (flat % features).astype(np.int64))  # by passage, then feature
            once = once[np.r_[True, np.diff(once) > 0]]
            f, passage = once % features, once // features
            first = np.flatnonzero(np.r_[True, np.diff(passage) > 0])
            size = np.diff([*first, len(f)])
            y = np.zeros((len(first), width), dtype=np.float32)
            for k in range(STEP * LONG):
                y += r[np.where(k < size, f[np.minimum(first + k, len(f) - 1)], features)]
            out[features:rows] += y.T @ y
            order = np.argsort(f.astype(np.min_scalar_type(features)), kind="stable")
            f, passage = f[order], passage[order]
            heads = np.flatnonzero(np.r_[True, np.diff(f) > 0])
            out[f[heads]] += sums_of_runs(y, passage, heads)
        src = TaskContext.get().partitionId()
        for k in (k for k in range(0, pad, FEATURE_BLOCK) if out[k:k + FEATURE_BLOCK].any()):  # most tasks meet no fit document
            yield pa.RecordBatch.from_arrays([pa.array([k // FEATURE_BLOCK], pa.int32()), pa.array([src], pa.int32()),
                                              pa.array([zlib.compress(out[k:k + FEATURE_BLOCK].astype(np.float32).tobytes(), 1)], pa.binary())], ["block", "src", "data"])

    total = np.zeros((pad, width))
    for r in sum_blocks(words.select("words").mapInArrow(run, "block int, src int, data binary"), "float32", (FEATURE_BLOCK, width)).toLocalIterator():
        total[r["block"] * FEATURE_BLOCK:(r["block"] + 1) * FEATURE_BLOCK] = np.frombuffer(zlib.decompress(r["data"]), dtype=np.float32).reshape(FEATURE_BLOCK, width)
    gram, cross = total[features:rows], total[:features] * idf[:, None]
    size, vec = np.linalg.eigh(gram)
    ok = size > 1e-9 * max(size.max(), 1e-30)
    b = cross @ (vec[:, ok] / np.sqrt(size[ok]))
    v, s, _ = np.linalg.svd(b, full_matrices=False)
    return v[:, :rank], s[:rank]


def lcs(item: dict[int, int], size: int, region: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; ``item`` maps a
    word to the bits of its places."""
    full = (1 << size) - 1
    v = full
    for w in region:
        m = item.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def by_length(items: list[tuple[int, list[int]]]) -> dict[int, dict[tuple, list[int]]]:
    """Few-word items: number of words, then the words, to the items that consist of them."""
    out: dict[int, dict[tuple, list[int]]] = {}
    for k, words in items:
        out.setdefault(len(words), {}).setdefault(tuple(words), []).append(k)
    return out


def exact_places(flat: np.ndarray, cut: np.ndarray, items: dict):
    """(row, item, place) wherever an item's words stand consecutively inside a row, by item length, then place."""
    for size, known in items.items():
        stop = np.repeat(cut[1:], np.diff(cut))
        at = np.flatnonzero(np.isin(flat, np.array([w[0] for w in known], dtype=np.uint32)))
        at = at[at + size <= stop[at]]
        if not len(at):
            continue
        rows = np.searchsorted(cut, at, side="right") - 1
        for place, r, words in zip(at.tolist(), rows.tolist(), flat[at[:, None] + np.arange(size)].tolist()):
            for item in known.get(tuple(words), ()):
                yield r, item, place - int(cut[r])


def answer_of(text: str) -> str:
    """The last sentence: what a benchmark text without an answer column asks for."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if WORD.search(p.lower().encode())]
    return parts[-1] if parts else ""


def find_leaks(docs: DataFrame, benchmark: DataFrame, features: int = 1 << 14, rank: int = 56, skip: int = 8, fit_docs: int | None = None,
               min_cosine: float = 0.4, min_lcs: float = 0.65, sure_lcs: float = 0.8, min_answer: float = 0.6, min_words: int = 5,
               items_per_pass: int = 4096, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               answer_col: str | None = None) -> DataFrame:
    """(id, item_id, cosine, lcs, answer, word): each row's leaked benchmark
    items, with the best window's figures and its first word.

    All texts are cut into windows of 24 and 48 words that start every 12 and
    24 words.  TF-IDF weights come from the document counts of all texts over
    ``features`` hashed words; a randomised SVD of rank ``rank``, fitted on the passages of all
    texts (of about ``fit_docs`` of them, if given), gives the latent space:
    ``rank`` directions, whitened by the singular values, without the ``skip``
    leading ones, which all texts of a language share.  Every window meets every item there
    (the benchmark is the query set, ``items_per_pass`` items at a time), and
    a cosine of ``min_cosine`` makes a candidate.  A candidate leaks if the
    longest common subsequence of words of the item and the window with its
    surroundings is ``sure_lcs`` of the item, or ``min_lcs`` of it and that of
    the answer ``min_answer`` of the answer.  The answer is ``answer_col`` or, without
    one, the item's last sentence.

    Items under ``min_words`` words have no window of their own: they leak where their
    words stand consecutively (cosine null, lcs and answer 1, the first such place).

    Null and empty texts leak nothing; items without a word, null
    ones included, can't be looked for; repeated rows and items are compared each;
    a tie of windows goes to the later one.  Very long texts are searched whole.
    Empty tables give empty results; other columns are ignored.
    """
    spark = docs.sparkSession
    words = cut_lineage(word_table(docs, id_col, text_col))
    n, df = document_counts(words, features)
    kind, item_kind = words.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {item_col} {item_kind}, cosine double, lcs double, answer double, word long"
    idf = np.log((1 + n) / (1 + df)) + 0.1
    fit = words
    if fit_docs is not None:
        share = F.lit(int(min(1.0, fit_docs / max(n, 1)) * (1 << 30)))
        fit = words.where(F.pmod(F.xxhash64("words", F.lit(5)), F.lit(1 << 30)) < share)
    v, s = randomised_svd(fit, idf, rank + skip)
    v, s = (v[:, skip:], s[skip:]) if len(s) > 2 * skip else (v, s)
    latent = (idf[:, None] * v / np.maximum(s, 1e-9 * max(s.max(initial=0), 1e-30))).astype(np.float32)

    def passes():
        part = []
        answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
        for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t"), answer.alias("a")).toLocalIterator():
            ids = word_ids(r["t"] or "")
            if len(ids):
                part.append((r["i"], ids.tolist(), word_ids(r["a"] or answer_of(r["t"])).tolist()))
            if len(part) == items_per_pass:
                yield part
                part = []
        if part:
            yield part

    found = None
    for part in passes():
        at = np.cumsum([0, *(len(w) for _, w, _ in part)])[:-1]
        q = np.add.reduceat(latent[np.concatenate([w for _, w, _ in part]) % features], at)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        short = np.array([0 if len(w) < min_words else 1 if len(w) < SHORT_ITEM else 2 for _, w, _ in part])
        shared = spark.sparkContext.broadcast((np.concatenate([latent, np.zeros((1, latent.shape[1]), dtype=np.float32)]), q, short, part))
        hits = words.mapInArrow(search(shared, features, min_cosine, min_lcs, sure_lcs, min_answer), schema)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], schema)


def search(shared, features, min_cosine, min_lcs, sure_lcs, min_answer):
    def run(batches):
        table, q, short, items = shared.value
        masks = [(places(w), len(w), places(a), len(a)) for _, w, a in items]
        groups = [(length, every, k) for length, every, k in ((SHORT, 1, np.flatnonzero(short == 1)), (LONG, 2, np.flatnonzero(short == 2))) if len(k)]
        tiny = by_length([(int(k), items[k][1]) for k in np.flatnonzero(short == 0)])
        for b in iter_slices(batches, 128):
            flat, cut = lists(b.column(1))
            if not len(flat):
                continue
            at, n = blocks_of(cut, STEP)
            stop = np.repeat(cut[1:], n)
            f = (flat % features).astype(np.int64)
            sums = np.zeros((len(at), table.shape[1]), dtype=np.float32)
            for k in range(STEP):  # row ``features`` of the table is zero
                sums += table[np.where(at + k < stop, f[np.minimum(at + k, len(f) - 1)], features)]
            sums = np.concatenate([np.zeros((1, sums.shape[1]), dtype=np.float64), np.cumsum(sums, axis=0, dtype=np.float64)])
            row = np.repeat(np.arange(len(n)), n)
            first = np.repeat(np.cumsum(n) - n, n)
            index = np.arange(len(at))
            end = first + np.repeat(n, n)
            best: dict[tuple[int, int], tuple] = {}
            for r, item, place in exact_places(flat, cut, tiny):
                best.setdefault((r, item), (1.0, 1.0, None, place))
            for length, every, which in groups:
                start = index[(index - first) % every == 0]
                w = (sums[np.minimum(start + length, end[start])] - sums[start]).astype(np.float32)
                w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
                cos = w @ q[which].T
                for k, j in zip(*(x.tolist() for x in np.nonzero(cos >= min_cosine))):
                    r, item = int(row[start[k]]), int(which[j])
                    where, size, answer, answer_size = masks[item]
                    lo = max(int(at[start[k]]) - size // 2, int(cut[r]))
                    hi = min(int(at[start[k]]) + length * STEP + size // 2, int(cut[r + 1]))
                    words = flat[lo:hi].tolist()
                    region = list(filter(where.__contains__, words))
                    # the subsequence is no longer than this, nor than the item's places of the words met
                    if len(region) < min_lcs * size or sum(where[w].bit_count() for w in set(region)) < min_lcs * size:
                        continue
                    common = lcs(where, size, region) / size
                    if common < min_lcs:
                        continue
                    ans = lcs(answer, answer_size, words) / answer_size if answer_size else 1.0
                    got = (common, ans, float(cos[k, j]), int(at[start[k]] - cut[r]))
                    if (common >= sure_lcs or ans >= min_answer) and got > best.get((r, item), (0,)):
                        best[r, item] = got
            if best:
                keys = list(best)
                ids = b.column(0)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([r for r, _ in keys])), pa.array([items[i][0] for _, i in keys]), pa.array([best[k][2] for k in keys], pa.float64()),
                    pa.array([best[k][0] for k in keys], pa.float64()), pa.array([best[k][1] for k in keys], pa.float64()),
                    pa.array([best[k][3] for k in keys], pa.int64())], ["id", "item", "cosine", "lcs", "answer", "word"])

    return run
