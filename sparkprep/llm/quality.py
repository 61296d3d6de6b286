"""Quality classifier: attention-based multiple-instance learning over the
passages of a document."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import iter_slices
from sparkprep.llm.toxicity import fold

PASSAGE_WORDS = 64
BAG = 32
CLASSES = 14


def byte_classes() -> np.ndarray:
    """Kind of each UTF-8 byte: lower, upper, digit, space, newline, mark, or
    one kind for each of several symbols."""
    table = np.full(256, 13, dtype=np.int64)
    for kind, chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r",
                                  b".", b",;:", b"!?", b"|", b"#$%&*", b"'\"()-", b"<>{}[]=/\\_@+~^`"]):
        table[list(chars)] = kind
    table[128:] = 12
    return table


KIND = byte_classes()
WIDTH = CLASSES + 5 + BAG


def encode(text: str) -> np.ndarray:
    """One row of features per passage of 64 words of the whole text: shares
    of the byte kinds, mean and spread of word lengths, share of distinct
    words, of words equal to the one before, passage size, and a signed hashed
    bag of words.  An empty text is one passage of zeros."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return np.zeros((1, WIDTH), dtype=np.float32)
    n = len(words)
    count = -(-n // PASSAGE_WORDS)
    b = np.frombuffer(raw, dtype=np.uint8)
    kind = KIND[b]
    blank = (b <= 32) & ((b == 32) | ((b >= 9) & (b <= 13)))
    begins = ~blank
    begins[1:] &= blank[:-1]
    passage = np.maximum(np.cumsum(begins) - 1, 0) // PASSAGE_WORDS
    kinds = np.bincount(passage * CLASSES + kind, minlength=count * CLASSES).reshape(count, CLASSES)
    word = np.arange(n) // PASSAGE_WORDS
    per = np.bincount(word, minlength=count)
    size = np.fromiter(map(len, words), dtype=np.float64, count=n)
    mean = np.bincount(word, size, count) / per
    spread = np.sqrt(np.maximum(np.bincount(word, size * size, count) / per - mean * mean, 0))
    h = np.array(list(map(zlib.crc32, words)), dtype=np.int64)
    distinct = np.bincount(np.unique(word << 32 | h) >> 32, minlength=count) / per
    repeat = np.bincount(word[1:], h[1:] == h[:-1], count) / per
    bag = np.bincount(word * BAG + (h & (BAG - 1)), 1.0 - 2.0 * (h >> 7 & 1), count * BAG).reshape(count, BAG) / np.sqrt(per)[:, None]
    shares = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    return np.concatenate([shares, (mean / 10)[:, None], (spread / 10)[:, None], distinct[:, None], repeat[:, None],
                           (per / PASSAGE_WORDS)[:, None], bag], axis=1).astype(np.float32)


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all texts, and the first row of each text."""
    rows = [encode(t) for t in texts]
    return np.concatenate(rows), np.cumsum([0, *map(len, rows)])[:-1]


def forward(p: dict, x: np.ndarray, first: np.ndarray) -> tuple:
    """Passage encodings, gated attention over each document's passages, and
    the logit of the weighted representation."""
    n = np.diff([*first, len(x)])
    doc = np.repeat(np.arange(len(first)), n)
    h = np.tanh((x - p["mean"]) / p["std"] @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    a = (t * s) @ p["w"]
    a = np.exp(a - np.maximum.reduceat(a, first)[doc])
    a /= np.add.reduceat(a, first)[doc]
    z = np.add.reduceat(a[:, None] * h, first)
    return z @ p["c"] + p["c0"], (doc, h, t, s, a, z)


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 40,
          batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> dict:
    """Fits the network by Adam on the logistic loss of the document labels."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = {"W": rng.normal(0, d ** -0.5, (d, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden ** -0.5, (hidden, gate)),
         "U": rng.normal(0, hidden ** -0.5, (hidden, gate)), "w": rng.normal(0, gate ** -0.5, gate), "c": np.zeros(hidden), "c0": np.zeros(1)}
    fixed = {"mean": x.mean(axis=0), "std": np.maximum(x.std(axis=0), 1e-3)}
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    ends = np.append(first[1:], len(x))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(first))
        lr = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            rows = np.concatenate([np.arange(first[k], ends[k]) for k in pick])
            starts = np.cumsum([0, *(ends[pick] - first[pick])])[:-1]
            xb = x[rows]
            logit, (doc, h, t, s, a, z) = forward(p | fixed, xb, starts)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[pick]) / len(pick)
            grad = {"c": z.T @ g, "c0": np.array([g.sum()])}
            dz = (g[:, None] * p["c"])[doc]
            da = (h * dz).sum(axis=1)
            da = a * (da - np.add.reduceat(a * da, starts)[doc])
            dg = da[:, None] * p["w"]
            grad["w"] = (t * s).T @ da
            dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
            grad["V"], grad["U"] = h.T @ dt, h.T @ ds
            dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            grad["W"], grad["b"] = ((xb - fixed["mean"]) / fixed["std"]).T @ dh, dh.sum(axis=0)
            step += 1
            for k in p:
                gk = grad[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p[k] = p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return {k: q.astype(np.float32) for k, q in (p | fixed).items()}


def score_texts(p: dict, texts: list[str | None]) -> np.ndarray:
    if "share" in p:
        return np.full(len(texts), p["share"])
    logit, _ = forward(p, *bags([t or "" for t in texts]))
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_docs: int = 8_000, fit_passages: int = 150_000,
                  id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 if score >=
    ``threshold``).  Input columns other than id and text are ignored.

    Every text is cut into passages of 64 words; each is encoded by a small
    network, gated attention weighs the passages, and the weighted sum is
    scored.  All weights are learned from document labels alone, on at most about
    ``fit_docs`` labelled documents whose id's crc32 mod 5 is not 0, picked by
    a hash of the id, with at most ``fit_passages`` passages in all (documents in an order
    by hash; of one document at most a 64th, evenly spread); every document is scored over its whole text.

    Of rows with one id, the fit takes one (least text hash).  Very long texts are scored whole.

    Null and empty texts are one passage of zeros.  A null id is scored, never
    learned from, and held_out is false.  Several labels of an id: the
    largest; null labels are none.  With labels of one kind only, or none, all
    scores are the share of ones, 0.5 without labels.  An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), fold(id_col).cast("int").alias("fold"))
    # a fixed-size network
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, fit_docs, fit_passages, id_col, text_col, label_col))

    def run(batches):
        for b in iter_slices(batches, 128):
            s = score_texts(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64())], ["id", "fold", "score"])

    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fold int, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_docs: int = 8_000, fit_passages: int = 150_000,
                 id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` gives ``threshold`` or more,
    all columns as they were; one narrow pass after the fit."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, fit_docs, fit_passages, id_col, text_col, label_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in iter_slices(batches, 128):
            yield b.filter(pa.array(score_texts(shared.value, b.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_docs: int, fit_passages: int, id_col: str, text_col: str, label_col: str) -> dict:
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
             .withColumn("f", F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5))).where("f <> 0"))
    n = known.count()
    pick = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) < int(min(1.0, fit_docs / max(n, 1)) * (1 << 30))
    chosen = known.where(pick).select("id", "label").limit(2 * fit_docs)  # the limit only bounds the hash's spread
    each = max(fit_passages // 64, 1)

    def run(batches):
        for b in iter_slices(batches, 128):
            rows = [x if len(x) <= each else x[np.arange(each) * len(x) // each] for x in map(encode, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "label", "rows"])

    kind = src.schema["id"].dataType.simpleString()
    # at most 2 x fit_docs ids are broadcast; one row of each (an id may stand in many) is encoded
    first = F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")
    fit = src.select("id", "text").join(F.broadcast(chosen), "id").groupBy("id", "label").agg(first).select("text", "id", "label").mapInArrow(
        run, f"id {kind}, label int, rows binary")
    got, room = [], fit_passages
    for r in fit.orderBy(F.xxhash64("id", F.lit(29)), "id").toLocalIterator():
        x = np.frombuffer(r["rows"], dtype=np.float32).reshape(-1, WIDTH)
        room -= len(x)
        if room < 0 and got:
            break
        got.append((r["id"], r["label"], x))
    got.sort(key=lambda r: r[0])
    y = np.array([r[1] for r in got], dtype=np.float64)
    if len(set(y)) < 2:
        return {"share": float(y.mean()) if len(y) else 0.5}
    rows = [r[2] for r in got]
    return train(np.concatenate(rows), np.cumsum([0, *map(len, rows)])[:-1], y)
