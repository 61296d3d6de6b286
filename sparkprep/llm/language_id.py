"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import iter_slices, worker_state
from sparkprep.session import cut_lineage

UNKNOWN = "und"
BATCH = 1 << 19  # code points whose letter groups are counted at a time
BLOCK = 4096  # letter groups whose vectors are made at a time
CELLS = 1 << 24  # of a table of counts by group and text
SHIFT = 21  # bits of a code point


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def letter_table() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0, kept in the worker."""
    state = worker_state()
    if "letters" not in state:
        codes = np.arange(0x110000, dtype=np.uint32)
        codes[~np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)] = 0
        state["letters"] = codes
    return state["letters"]


def pieces(texts: list[str]):
    """(owner, piece) of lower-cased texts, each piece with the character before
    and after it (a blank at a text's ends), at most ``BATCH`` long."""
    for k, text in enumerate(texts):
        text = text.lower()
        for lo in range(0, len(text), BATCH):
            hi = lo + BATCH
            yield k, f"{text[lo - 1] if lo else ' '}{text[lo:hi]}{text[hi] if hi < len(text) else ' '}"


def distinct_groups(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different groups around the places ``at``, in order, and each
    place's group.  A small alphabet's groups are told by counting, without a
    sort."""
    seen = np.zeros(0x110000, dtype=bool)
    seen[code] = True
    letters = np.flatnonzero(seen)
    n = len(letters)
    if n ** 3 > CELLS:
        return np.unique(code[at - 1] << 2 * SHIFT | code[at] << SHIFT | code[at + 1], return_inverse=True)
    rank = (np.cumsum(seen) - 1)[code]
    key = (rank[at - 1] * n + rank[at]) * n + rank[at + 1]
    used = np.bincount(key, minlength=n ** 3) > 0
    groups = np.flatnonzero(used)
    a, b, c = letters[groups // (n * n)], letters[groups // n % n], letters[groups % n]
    return a << 2 * SHIFT | b << SHIFT | c, (np.cumsum(used) - 1)[key]


def count_groups(texts: list[str], owners: np.ndarray | None = None):
    """Yields (groups, owners, counts): a letter with its two neighbours,
    where all that is no letter is a word's edge; ``counts`` is a table by
    group and owner.  An owner is a text's place, or ``owners`` of it."""
    part, size = [], 0

    def run():
        sizes = np.fromiter((len(p) for _, p in part), dtype=np.int64, count=len(part))
        who = np.fromiter((k for k, _ in part), dtype=np.int64, count=len(part))
        raw = np.frombuffer("".join(p for _, p in part).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = letter_table()[raw].astype(np.int64)
        inner = code != 0
        ends = np.cumsum(sizes)
        inner[ends - sizes] = False
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        who = np.repeat(who if owners is None else owners[who], sizes)[at]
        yield from tables(code, at, who)

    def tables(code, at, who):
        used = np.bincount(who) > 0
        names, own = np.flatnonzero(used), (np.cumsum(used) - 1)[who]
        groups, place = distinct_groups(code, at)
        if len(names) > 1 and len(names) * len(groups) > CELLS:
            half = own < len(names) // 2
            yield from tables(code, at[half], who[half])
            yield from tables(code, at[~half], who[~half])
        elif len(at):
            counts = np.bincount(place * len(names) + own, minlength=len(names) * len(groups))
            yield groups, names, counts.reshape(len(groups), len(names))

    for k, p in pieces(texts):
        if part and size + len(p) > BATCH:
            yield from run()
            part, size = [], 0
        part.append((k, p))
        size += len(p)
    if part:
        yield from run()


def group_vectors(groups: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Vectors of +1 and -1 of letter groups: the letters' random vectors,
    moved by two, one and no places, multiplied."""
    out = None
    for k in range(3):
        letters, at = np.unique(groups >> (2 - k) * SHIFT & (1 << SHIFT) - 1, return_inverse=True)
        bits = [np.random.default_rng([seed, int(c)]).integers(0, 2, dim, dtype=np.int8) for c in letters]
        v = np.roll(np.stack(bits) * 2 - 1, 2 - k, axis=1)[at]
        out = v if out is None else out * v
    return out


def bundle(groups: np.ndarray, counts: np.ndarray, dim: int, seed: int, dtype) -> np.ndarray:
    """Sums of the groups' vectors by their counts, a row per owner.  The sums
    are whole numbers, the same in any order."""
    total = np.zeros((counts.shape[1], dim), dtype=dtype)
    for lo in range(0, len(groups), BLOCK):
        total += counts[lo:lo + BLOCK].T.astype(dtype) @ group_vectors(groups[lo:lo + BLOCK], dim, seed).astype(dtype)
    return total


def count_language_groups(train: DataFrame) -> DataFrame:
    """(lang, code, n): letter groups of all (lang, text) rows."""
    def run(batches):
        for b in iter_slices(batches):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            names = sorted(set(langs))
            owners = np.array([names.index(x) for x in langs], dtype=np.int64)
            for groups, who, counts in count_groups(texts, owners):
                g, o = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in who]).take(pa.array(o)), pa.array(groups[g]), pa.array(counts[g, o])], ["lang", "code", "n"])

    part = train.select("lang", "text").mapInArrow(run, "lang string, code long, n long")
    return part.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def prototypes(groups: DataFrame, dim: int, seed: int, most_langs: int) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their bundles as unit vectors.

    Tasks bundle the counts of their groups, the driver adds up at most
    about 64 MB of such bundles.
    """
    groups = cut_lineage(groups)
    n = groups.select("lang").distinct().count()
    if n > most_langs:
        raise ValueError(f"{n} languages, over the {most_langs} whose vectors are broadcast")
    tasks = max(1, min(32, (64 << 20) // (8 * dim * max(n, 1))))

    def run(batches):
        total: dict = {}
        for b in iter_slices(batches, 8192):
            lang, at = np.unique(np.array(b.column(0).to_pylist()), return_inverse=True)
            code, place = np.unique(b.column(1).to_numpy(), return_inverse=True)
            counts = np.zeros((len(code), len(lang)))
            np.add.at(counts, (place, at), b.column(2).to_numpy())
            for name, v in zip(lang.tolist(), bundle(code, counts, dim, seed, np.float64)):
                total[name] = total.get(name, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "v"])

    total: dict = {}
    for r in groups.coalesce(tasks).mapInArrow(run, "lang string, v binary").toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.v)
    langs = sorted(total)
    v = np.stack([total[k] for k in langs]) if langs else np.zeros((0, dim))
    return langs, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def identify_language(docs: DataFrame, dim: int = 2048, seed: int = 7, most_langs: int = 2048, id_col: str = "doc_id",
                      text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Each letter has a random vector of ``dim`` +1 and -1, drawn from its code
    point.  A group of three neighbouring characters binds (multiplies) its
    letters' vectors, moved by their places; a text bundles (adds) the vectors
    of its groups, a language those of all texts of the rows that are learned from: every one with
    a language whose crc32 of the id mod 3 is not 1.  The language of largest
    cosine is predicted, the first by name of a tie; the score is that cosine, 0 if negative.

    Groups are counted by language with a grouped sum over all texts, so only
    the different groups are bundled, and only one vector per language (an
    error over ``most_langs``) reaches the driver and the tasks.

    Null, empty and letterless texts, and all texts if nothing can be learned, are ``und`` with score 0.
    Very long texts are read piece by piece.  A null id is in no
    fold: scored, never learned from, held_out false.  Repeated rows are
    learned from and scored each.  An empty table gives an empty result; other
    columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                      F.col(lang_col).cast("string").alias("lang"), fold(id_col).alias("fold"))
    langs, vectors = prototypes(count_language_groups(src.where("fold <> 1 and lang is not null")), dim, seed, most_langs)
    model = docs.sparkSession.sparkContext.broadcast((langs, vectors.T.astype(np.float32)))

    def run(batches):
        langs, vectors = model.value
        for b in iter_slices(batches):
            texts = b.column(1).to_pylist()
            total = np.zeros((len(texts), dim), dtype=np.float32)
            if langs:
                for groups, who, counts in count_groups(texts):
                    total[who] += bundle(groups, counts, dim, seed, np.float32)
            size = np.linalg.norm(total, axis=1)
            if langs:
                cos = total @ vectors / np.maximum(size, 1e-30)[:, None]
                best = cos.argmax(axis=1)
                pred = [langs[k] if any(map(str.isalpha, t)) else UNKNOWN for k, t in zip(best.tolist(), texts)]
                score = np.clip(cos[np.arange(len(texts)), best], 0, 1).astype(np.float64)
                score[[p == UNKNOWN and not s for p, s in zip(pred, size)]] = 0
            else:
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score)], [id_col, "held_out", "lang_pred", "score"])

    kind = src.schema["id"].dataType.simpleString()
    rows = src.select("id", "text", F.coalesce(F.col("fold") == 1, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
