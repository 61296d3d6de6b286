"""Filter audit, prefix trie and language ID against brute force, and odd input."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import filter_audit, language_id, prefix_trie
from sparkprep.llm.queries import ORACLES

DOCS = "doc_id long, text string, lang string, id string, part int, mask string, n long, route int, fold int"
CONVS = "conv_id long, turn long, role string, text string, conv string, d int, k int, n long"


def oracle(name: str, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(f"{t}_in", df.toArrow())
        con.sql(f"create table {t} as select * from {t}_in")
    return con.sql(ORACLES[name]).fetchall()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def extra(r, n):
    return (*r, *[None] * n)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = "alpha beta gamma delta der die und le la les".split()
    near = " ".join(rng.choice(words, 400)) + " "
    out = [None, "", " \t\n", "É漢😀 AB", "A" * 50, "x|y", " ".join(f"w{k}" for k in range(100)), " ".join(f"w{k}" for k in range(99)), "w " * 100_000]
    out += [near + f"end{k}" for k in range(40)] + [near[:k] for k in range(0, 200, 10)]
    return out + [" ".join(rng.choice(words, 130)) for _ in range(30)]


def audited(spark, texts, **options):
    rng = np.random.default_rng(5)
    pick = [*range(len(texts)), *rng.integers(0, len(texts), 150).tolist(), *[10] * 150]
    ids = rng.permutation(len(pick)).tolist()
    rows = [(ids[k], texts[t], [None, "", "en", "de"][k % 4]) for k, t in enumerate(pick)]
    rows += rows[:20] + [(None, texts[10], "en"), (None, None, None), (5, texts[11], "fr")]
    docs = spark.createDataFrame([extra(r, 6) for r in rows], DOCS).repartition(5)
    labels = spark.createDataFrame([(k, k % 3 % 2, k % 2) for k in range(0, 200)] + [(4, None, 1), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_filter_audit_against_sql(spark, texts):
    docs, labels = audited(spark, texts)
    got = filter_audit.audit_filters(docs, labels)
    assert rows_of(got) == sorted(oracle("op11_filter_audit", documents=docs, labels=labels), key=repr)
    assert got.count() == 120 * 5 * docs.select(F.coalesce("lang", F.lit(""))).distinct().count()


def test_masks_do_not_depend_on_tries_and_ranges(spark, texts):
    docs, _ = audited(spark, texts)
    sums = lambda **o: {(r.id, r.part, r["mask"]): r.n for r in filter_audit.failure_masks(docs, **o).groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).collect()}
    want = sums()
    assert sum(want.values()) == docs.count()
    assert sums(flush_bytes=1, range_bytes=4096) == want
    assert sums(range_bytes=1 << 40) == want


def test_trie_holds_whole_texts():
    trie, found = filter_audit.TextTrie(), Counter()
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(500)]
    for k, t in enumerate(texts):
        trie.insert(t, 1000 - k, "p", 1, 0, found)
    least = {t: 1000 - k for k, t in enumerate(texts)}
    assert {t: v[0] for t, v in trie.terminals()} == least
    assert sum(found.values()) == len(texts) - len(least)


def test_bounds_split_near_copies(spark):
    same = "word " * 2000
    docs = spark.createDataFrame([(same + str(k),) for k in range(2000)], "text string")
    bounds = filter_audit.text_bounds(docs, 16, 2000)
    parts = Counter(filter_audit.bisect_right(bounds, (same + str(k)).encode()) for k in range(2000))
    assert len(parts) >= 12 and max(parts.values()) < 600


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, labels).count() == 0


def conversations(spark, seed, n, most, say):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(4 * n, n, replace=False).tolist():
        rows += [(c, t, ["user", "assistant", None][t % 3], say[rng.integers(0, len(say))]) for t in range(rng.integers(0, most) + 1)]
    return rows


@pytest.mark.parametrize("block", [1, 3, 4])
def test_prefix_trie_against_sql(spark, block):
    rows = conversations(spark, block, 60, 24, ["a", "", None, "é漢" * 20]) + conversations(spark, 9, 40, 12, ["same"])
    rows += [(1000 + k, t, "user", "hot") for k in range(60) for t in range(9)]  # one group of copies
    rows += [(2000, None, "user", "null turn"), (2000, None, "user", "another"), (2000, 3, "b", "tie"), (2000, 3, "a", "tie"), (2000, 3, "a", "tie")]
    rows += [(-7, 1, "user", "below zero"), (-5, 1, "user", "base"), (None, 1, "user", "no id"), (2001, 0, None, "x" * 100_000)]
    df = spark.createDataFrame([extra(r, 4) for r in rows], CONVS).repartition(6)
    got = prefix_trie.prefix_trie(df, block)
    want = oracle("op12_prefix_trie", conversations=df)
    assert rows_of(got) == sorted(want, key=repr)


def test_prefix_trie_of_few_conversations(spark):
    one = [c for c in range(200) if zlib.crc32(str(c).encode()) % 9 > 2 and c % 5]
    for rows in ([], [(None, 1, "user", "x")], [(one[0], 0, "user", "gone")], [(0, 0, "user", "only")]):  # no ids; turnless; one
        df = spark.createDataFrame([extra(r, 4) for r in rows], CONVS)
        assert rows_of(prefix_trie.prefix_trie(df)) == sorted(oracle("op12_prefix_trie", conversations=df), key=repr)


def naive_vector(text: str, dim: int, seed: int) -> np.ndarray:
    letter = lambda c: np.random.default_rng([seed, ord(c) if c.isalpha() else 0]).integers(0, 2, dim, dtype=np.int8) * 2 - 1
    text = f" {text.lower()} "
    total = np.zeros(dim)
    for a, b, c in zip(text, text[1:], text[2:]):
        if b.isalpha():
            total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return total


def test_language_vectors_against_brute_force(spark, monkeypatch):
    lines = {"en": "the cat sat on the mat and the dog ran", "de": "die Katze saß auf der Matte und der Hund lief", "el": "Ο ΣΚΎΛΟΣ έτρεξε"}
    rows = [(k, f"{text} {k}, {text[:k % 9]}", lang) for k, (lang, text) in enumerate(list(lines.items()) * 8)]
    docs = spark.createDataFrame([extra(r, 6) for r in rows], DOCS)
    learned = {}
    for k, text, lang in rows:
        if zlib.crc32(str(k).encode()) % 3 != 1:
            learned[lang] = learned.get(lang, 0) + naive_vector(text, 512, 7)
    unit = {k: v / np.linalg.norm(v) for k, v in learned.items()}
    for batch in (1 << 19, 7):
        monkeypatch.setattr(language_id, "BATCH", batch)
        for r in language_id.identify_language(docs, dim=512).collect():
            v = naive_vector(rows[r.doc_id][1], 512, 7)
            cos = {k: v @ u / np.linalg.norm(v) for k, u in unit.items()}
            assert r.lang_pred == max(cos, key=cos.get) == rows[r.doc_id][2]
            assert abs(r.score - max(cos.values())) < 1e-5
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_counts_split_by_alphabet(monkeypatch):
    texts = ["漢字仮名 交じり文", "ab ab", "", "漢字 ab", "xyz"] * 3
    want = {}
    for g, who, n in language_id.count_groups(texts):
        want.update({(int(a), int(w)): int(n[i, j]) for i, a in enumerate(g) for j, w in enumerate(who) if n[i, j]})
    monkeypatch.setattr(language_id, "CELLS", 8)
    got = {}
    for g, who, n in language_id.count_groups(texts):
        got.update({(int(a), int(w)): int(n[i, j]) for i, a in enumerate(g) for j, w in enumerate(who) if n[i, j]})
    assert got == want and want


def test_language_odd_input(spark):
    learn = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 3 != 1)
    rows = [(learn, "hello there", "en"), (None, "bonjour", "fr"), (3, None, "xx"), (3, "", None), (4, "12 %& 34", "en"), (6, "hi " * 400_000, None), (6, "hi", None), (6, "hi", None)]
    docs = spark.createDataFrame([extra(r, 6) for r in rows], DOCS)
    got = language_id.identify_language(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert got.count() == len(rows)
    for r in got.collect():
        if r.doc_id == learn:
            assert (r.lang_pred, round(r.score, 6)) == ("en", 1.0)
        elif r.doc_id in (3, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == "en" and 0 <= r.score <= 1
        assert r.doc_id is not None or not r.held_out
    blank = language_id.identify_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in blank.collect()} == {("und", 0.0)}
    assert language_id.identify_language(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(k, "word", f"l{k}") for k in range(12)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.identify_language(many, most_langs=3)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_language(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.98
