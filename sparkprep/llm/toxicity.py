"""Toxicity by class-conditional Kneser-Ney models."""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import iter_slices, worker_state
from sparkprep.session import shared_path

WORD = re.compile(rb"[a-z0-9\x80-\xff']+")
DISCOUNT = 0.75
#: Letters of the spelling models: 0 before a word, a-z, 0-9, the apostrophe, 16 for the bytes beyond ASCII (by their
#: low half), and the last one after a word.  A gram is three letters and the next: at most LETTERS ** 4 of them.
LETTERS = 55
CONTEXT = 3
LETTER = np.zeros(256, dtype=np.int64)
LETTER[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789'", dtype=np.uint8)] = np.arange(1, 38)
LETTER[128:] = 38 + (np.arange(128) & 15)
LETTER[2] = LETTERS - 1
STRONG = 3.0  # log ratio of a word that counts as telling
HOT_BYTES = 64  # longer words are never broadcast
FEATURES = ["llr", "best", "strong", "size"]


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.lower().encode())


def word_key(word: bytes) -> int:
    """64-bit hash of a word, signed; joins tell words apart by it."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every letter of the words, end marks included: its word, and its gram
    (the three letters before it and itself, as a number to base LETTERS)."""
    letter = LETTER[np.frombuffer(b"\x02".join(words) + b"\x02", dtype=np.uint8)]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    place = np.arange(len(letter)) - np.repeat(np.cumsum(size) - size, size)
    key = letter.copy()
    for j in range(1, CONTEXT + 1):
        before = np.zeros(len(letter), dtype=np.int64)
        before[j:] = letter[:-j] if len(letter) > j else 0
        before[place < j] = 0
        key += before * LETTERS ** j
    return np.repeat(np.arange(len(words)), size), key


def pack_texts(docs: DataFrame) -> DataFrame:
    """(id, text): lower-cased texts, compressed for the shuffle to their labels."""
    def run(batches):
        for b in iter_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((zlib.compress(t.lower().encode(), 1) for t in b.column(1).to_pylist()), pa.binary())], ["id", "text"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, text binary")


def count_words(train: DataFrame) -> DataFrame:
    """(word, c0, c1): exact 64-bit counts of every word of (packed text, label) rows, per class."""
    def run(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows():
            keys = list(seen[0].keys() | seen[1].keys())
            for at in range(0, len(keys), 8192):
                k = keys[at:at + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), *(pa.array([c[w] for w in k], pa.int64()) for c in seen)], ["word", "c0", "c1"])

        for b in iter_slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[label].update(WORD.findall(zlib.decompress(text)))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from rows()
                seen = (Counter(), Counter())
        yield from rows()

    part = train.select("text", "label").mapInArrow(run, "word binary, c0 long, c1 long")
    return part.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def count_grams(table: DataFrame) -> DataFrame:
    """(gram, n0, n1, words) of a (word, c0, c1) table: how often each class
    writes the gram, and at how many places of different words it stands."""
    def run(batches):
        total = None

        def add(key, n):
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
            return key[at], np.add.reduceat(n, at, axis=0) if len(at) else n

        for b in iter_slices(batches, 32768):
            word, key = grams(b.column(0).to_pylist())
            count = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy(), np.ones(b.num_rows, dtype=np.int64)], axis=1)
            order = np.argsort(key, kind="stable")
            part = add(key[order], count[word[order]])
            if total is not None:
                key = np.concatenate([total[0], part[0]])
                order = np.argsort(key, kind="stable")
                part = add(key[order], np.concatenate([total[1], part[1]])[order])
            total = part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(total[0]), *(pa.array(np.ascontiguousarray(total[1][:, k])) for k in range(3))], ["gram", "n0", "n1", "words"])

    part = table.mapInArrow(run, "gram long, n0 long, n1 long, words long")
    return part.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("words").alias("words"))


def spelling_model(gram: np.ndarray, n: np.ndarray, words: np.ndarray) -> dict:
    """Log-probabilities per class of all known grams, and what the others need.

    Shared levels of 0 to 2 letters of context: a letter's count is the number
    of places in different words of both classes.  The class level has 3 letters.
    """
    order = np.argsort(gram)
    gram, n, words = gram[order], n[order], words[order]
    shared = np.full(LETTERS, 1 / (LETTERS - 1))  # by letter; later by context and letter
    for j in range(CONTEXT):
        count = np.bincount(gram % LETTERS ** (j + 1), words, LETTERS ** (j + 1)).reshape(-1, LETTERS)
        total, types = count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True)
        lower = np.tile(shared.reshape(-1, LETTERS), (LETTERS if j else 1, 1))
        shared = np.where(total > 0, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * types * lower) / np.maximum(total, 1), lower)
    shared = shared.reshape(-1)
    lower = shared[gram % LETTERS ** CONTEXT]
    at = np.flatnonzero(np.r_[True, gram[1:] // LETTERS != gram[:-1] // LETTERS]) if len(gram) else np.zeros(0, dtype=np.int64)
    run = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(gram)]))
    known, weight = [], []
    for k in range(2):
        total = np.add.reduceat(n[:, k], at) if len(at) else np.zeros(0)
        types = np.add.reduceat((n[:, k] > 0).astype(np.int64), at) if len(at) else np.zeros(0)
        w = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)  # weight of the shared level
        known.append(np.log(np.maximum(n[:, k] - DISCOUNT, 0) / np.maximum(total[run], 1) + w[run] * lower))
        weight.append(np.log(w))
    return {"gram": gram, "known": known, "context": gram[at] // LETTERS, "weight": weight, "shared": np.log(shared)}


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``x`` in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def word_ratios(words: list[bytes], m: dict, counts=None) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of distinct words; without
    ``counts`` (an array per class) neither class has them."""
    word, gram = grams(words)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    at, there = find(m["gram"], gram)
    ctx, seen = find(m["context"], gram // LETTERS)
    logs = []
    for k in range(2):
        p = m["shared"][gram % LETTERS ** CONTEXT]
        if len(m["gram"]):
            p = np.where(there, m["known"][k][at], p + np.where(seen, m["weight"][k][ctx], 0.0))
        spelled = np.exp(np.maximum(np.add.reduceat(p, first), -200))
        n = max(m["tokens"][k], 1)
        own = np.maximum(counts[k] - DISCOUNT, 0) / n if counts is not None else 0.0
        logs.append(np.log(own + DISCOUNT * max(m["types"][k], 1) / n * spelled))
    return logs[1] - logs[0]


def ratio_table(table: DataFrame, shared) -> DataFrame:
    """(word, key, ratio) of a (word, c0, c1) table."""
    def run(batches):
        for b in iter_slices(batches, 16384):
            words = b.column(0).to_pylist()
            r = word_ratios(words, shared.value, [b.column(1).to_numpy(), b.column(2).to_numpy()]) if words else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(word_key, words)), pa.int64()), pa.array(r, pa.float64())], ["word", "key", "ratio"])

    return table.mapInArrow(run, "word binary, key long, ratio double")


def hot_count(table: DataFrame, hot_words: int) -> float:
    """Least count of the words to broadcast: at most ``hot_words`` words of up
    to HOT_BYTES bytes have it.  Counts are told by eighths of their log, so
    some 500 rows reach the driver."""
    step = F.floor(8 * F.log2((F.col("c0") + F.col("c1")).cast("double"))).cast("int")
    sizes = table.where(F.length("word") <= HOT_BYTES).groupBy(step.alias("step")).count().collect()
    least, room = float("inf"), hot_words
    for r in sorted(sizes, key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return least


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights (last one the intercept) by Newton steps with a small ridge."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    keep = ridge * np.eye(a.shape[1])
    keep[-1, -1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (p - y) + keep @ w)
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, hot_words: int = 1 << 20, fit_rows: int = 50_000,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: id, held_out, the features (``FEATURES``), score, predicted.

    Folds by crc32 of the id mod 5: fold 0 is held out; folds 1 to 3 give the
    counts of the toxic and the ordinary model, over all their labelled texts;
    fold 4 gives the calibration, a logistic regression on at most about
    ``fit_rows`` of its labelled rows, picked by a hash of the id.

    Both models are interpolated Kneser-Ney: discounted counts of the word in
    the class; then its spelling, letter by letter after 3 letters of context, in
    the class; then after 2 to 0 letters by continuation counts that the two
    classes share, so that what neither class knows well says nothing.  Words
    are counted exactly, in a table that grows with the corpus and is never
    gathered: its up to ``hot_words`` most frequent words (of 64 bytes or less) are
    broadcast, the other words of a text are joined to it by key.  Which words are
    broadcast doesn't change a result.  Grams of four letters out of ``LETTERS`` are
    bounded by themselves.  A text's features are its length-normalised
    log-likelihood ratio, its most toxic word, log of 1 + the words beyond
    ``STRONG`` and log of 1 + all words.

    Null and empty texts have features 0.  Very long texts are scored whole, a text's
    rare words are one row until they are joined.  A null id is in no fold: scored,
    never learned from, held_out false.  Several labels of an id: the largest;
    null labels are none.  Rows that repeat are counted and scored each.  Without
    calibration rows of both kinds all scores
    are the share of toxic labels, 0.5 without labels.  An empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), fold(id_col).cast("int").alias("fold"))
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
             .withColumn("f", F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5))))
    train = pack_texts(src.where("fold between 1 and 3")).join(
        known.where("f between 1 and 3").select("id", "label").hint("merge"), "id")  # labels grow with the corpus: never broadcast
    table = written(count_words(train), "toxicity-words")
    t = table.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"n{k}") for k in range(2)),
                  *(F.count(F.when(F.col(f"c{k}") > 0, 1)).alias(f"t{k}") for k in range(2))).first()
    g = count_grams(table).toPandas()  # at most LETTERS ** 4 rows
    model = spelling_model(g["gram"].to_numpy(np.int64), g[["n0", "n1"]].to_numpy(np.int64), g["words"].to_numpy(np.int64))
    model |= {"tokens": [int(t["n0"]), int(t["n1"])], "types": [t["t0"], t["t1"]]}
    shared = spark.sparkContext.broadcast(model)
    step = F.floor(8 * F.log2((F.col("c0") + F.col("c1")).cast("double")))
    is_hot = (F.length("word") <= HOT_BYTES) & (step >= F.lit(hot_count(table, hot_words)))
    hot = ratio_table(table.where(is_hot), shared).select("word", "ratio").toArrow()
    # at most hot_words words of at most HOT_BYTES bytes
    hot_shared = spark.sparkContext.broadcast((uuid.uuid4().hex, hot.column("word").combine_chunks(), hot.column("ratio").to_numpy()))
    kind = src.schema["id"].dataType.simpleString()
    names = ["row", "id", "fold", "n", "total", "best", "strong", "keys", "counts", "unseen"]

    def run(batches):
        state, (name, *_) = worker_state(), hot_shared.value
        if state.get("toxicity_model") != name:
            state["toxicity_model"], state["toxicity_unseen"] = name, {}
            state["toxicity_hot"] = dict(zip(hot_shared.value[1].to_pylist(), hot_shared.value[2].tolist()))
        hot, unseen, nan = state["toxicity_hot"], state["toxicity_unseen"], float("nan")
        row = TaskContext.get().partitionId() << 40
        for b in iter_slices(batches):
            if len(unseen) > 200_000:
                unseen.clear()
            sums, rest = [], []
            for words in map(words_of, b.column(1).to_pylist()):
                r = np.fromiter(map(hot.get, words, repeat(nan)), dtype=np.float64, count=len(words))
                cold = np.isnan(r)
                rest.append(Counter([words[k] for k in np.flatnonzero(cold).tolist()]))
                r = r[~cold]
                sums.append((len(words), float(r.sum()), float(r.max()) if len(r) else None, int((r > STRONG).sum())))
            new = list({w for c in rest for w in c} - unseen.keys())
            for at in range(0, len(new), 16384):
                part = new[at:at + 16384]
                unseen.update(zip(part, zip(map(word_key, part), word_ratios(part, shared.value).tolist())))
            flat = [unseen[w] for c in rest for w in c]
            cut = pa.array(np.cumsum([0, *map(len, rest)]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + b.num_rows)), b.column(0), b.column(2),
                *(pa.array(c, k) for c, k in zip(zip(*sums), (pa.int64(), pa.float64(), pa.float64(), pa.int64()))),
                pa.ListArray.from_arrays(cut, pa.array([k for k, _ in flat], pa.int64())),
                pa.ListArray.from_arrays(cut, pa.array([n for c in rest for n in c.values()], pa.int64())),
                pa.ListArray.from_arrays(cut, pa.array([u for _, u in flat], pa.float64()))], names)
            row += b.num_rows

    # row numbers hold for this written table only
    rows = written(src.mapInArrow(run, f"row long, id {kind}, fold int, n long, total double, best double, strong long, "
                                       "keys array<long>, counts array<long>, unseen array<double>"), "toxicity-rows")
    cold = ratio_table(table.where(~is_hot), shared).select("key", "ratio")
    rest = (rows.where(F.size("keys") > 0).select("row", F.inline(F.arrays_zip("keys", "counts", "unseen"))).withColumnRenamed("keys", "key")
            .join(cold.hint("merge"), "key", "left").select("row", "counts", F.coalesce("ratio", "unseen").alias("r"))
            .groupBy("row").agg(F.sum(F.col("counts") * F.col("r")).alias("r_total"), F.max("r").alias("r_best"),
                                F.sum(F.when(F.col("r") > STRONG, F.col("counts")).otherwise(0)).alias("r_strong")))
    zero = F.lit(0)
    feats = rows.drop("keys", "counts", "unseen").join(rest, "row", "left").select(
        "id", "fold", F.coalesce((F.col("total") + F.coalesce("r_total", zero)) / F.nullif(F.col("n"), zero), F.lit(0.0)).alias("llr"),
        F.coalesce(F.greatest("best", "r_best"), F.lit(0.0)).alias("best"),
        F.log1p(F.col("strong") + F.coalesce("r_strong", zero)).alias("strong"), F.log1p("n").alias("size"))
    feats = written(feats, "toxicity-features")
    n = known.where("f = 4").count()
    pick = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, fit_rows / max(n, 1)) * (1 << 30))
    fit = feats.where("fold = 4").join(known.where("f = 4").where(pick).select("id", "label"), "id").select("id", "label", *FEATURES).limit(2 * fit_rows).toPandas()
    fit = fit.sort_values("id", kind="stable")
    if fit["label"].nunique() == 2:
        x = fit[FEATURES].to_numpy()
        mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        w = fit_logistic((x - mean) / std, fit["label"].to_numpy())
        c = float(w[-1] - (w[:-1] * mean / std).sum())
        w = w[:-1] / std
    else:
        share = known.where("f <> 0").agg(F.avg("label")).first()[0]
        share = 0.5 if share is None else min(max(share, 1e-6), 1 - 1e-6)
        w, c = np.zeros(len(FEATURES)), float(np.log(share / (1 - share)))
    z = sum((F.col(k) * float(v) for k, v in zip(FEATURES, w)), F.lit(c))
    return feats.select(F.col("id").alias(id_col), F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), *FEATURES,
                        (1 / (1 + F.exp(-z))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
