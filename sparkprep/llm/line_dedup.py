"""Line dedup with a log-template tree: lines of one template that recur
across documents are dropped."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import free_name, iter_slices
from sparkprep.session import cut_lineage

#: (least constant tokens, least documents) of a template with variable parts, from the longest down; those with fewer constants never recur.
TIERS = ((20, 2), (8, 5), (4, 50))
EXACT_DOCS = 2  # documents that make a line recur word by word, whatever its length
#: Lines of LEAF_TOKENS tokens are generalised by what their leaf of the tree holds: a token stays if it stands at its place in
#: LEAF_DOCS documents of the leaf; the template counts with LEAF_CONSTANTS tokens left, which are LEAF_SHARE of the line.
LEAF_TOKENS, LEAF_DOCS, LEAF_CONSTANTS, LEAF_SHARE = (6, 11), 5, 5, 2 / 3
SALTS = 64
VARIABLE = re.compile(r"[0-9@]|://")
BLANK = r"(?U)[\s\x1c-\x1f]+"  # what separates tokens, for Spark's split
FIELD = "<*>"
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


def need(constants: int) -> int:
    """Documents that make a template with variable parts recur; 0 if it never does."""
    return next((n for least, n in TIERS if constants >= least), 0)


def masked(tokens: list[str]) -> list[str]:
    return [FIELD if VARIABLE.search(t) else t for t in tokens]


def templates(line: str, depth: float = 0.5, same: float = 0.75) -> list[tuple[int, str]]:
    """(documents needed, template) of a line, as the tree files it.

    The exact form is all tokens of the line, however few.  For the others,
    tokens with a digit, an @ or :// are variable fields.  The path is the
    token count and the leading tokens; the leaves generalise the rest: the
    line as masked; its leading ``same`` share with a variable tail; its
    leading ``depth`` share and its end with a variable middle.  The general
    forms need 12 tokens, so that they keep 9 or more.
    """
    tokens = line.split()
    n = len(tokens)
    if not n:
        return []
    out = [(EXACT_DOCS, "= " + " ".join(tokens))]
    forms = []
    if VARIABLE.search(line):
        tokens = masked(tokens)
        forms.append((0, tokens))
    if n >= 12:
        head, keep = -(-int(n * depth * 4) // 4), -(-int(n * same * 4) // 4)
        forms += [(1, tokens[:keep] + [FIELD]), (2, tokens[:head] + [FIELD] + tokens[n - (keep - head):])]
    for k, f in forms:
        if docs := need(sum(t is not FIELD for t in f)):
            out.append((docs, f"{n} {k} " + " ".join(f)))
    return out


def passages(lines: list[str]) -> list[tuple[int, int, str]]:
    """(place, documents needed, template) of the lines with variable fields
    that have too few constants for the first tier (but enough for the last),
    each with the lines around it that are too short as well.

    A wrapped passage is judged as one unit: the line with those after it, and
    with those before it, up to the constant tokens of the first tier.  So
    each line of a shared passage with twice as many constants is met, by one
    side or the other.  Lines without fields need no passage, their exact
    form recurs by itself.  Runs are hashed from running sums.
    """
    import xxhash

    if not any(map(VARIABLE.search, lines)):
        return []
    least, docs = TIERS[0]
    at, size, alone, sums, power, short = [], [0], [0], [0], [1], []  # of non-empty lines: places; running constants, lines judged alone, hashes
    for pos, line in enumerate(lines):
        tokens = line.split()
        if not tokens:
            continue
        tokens = masked(tokens)
        constants = sum(t is not FIELD for t in tokens)
        if TIERS[-1][0] <= constants < min(least, len(tokens)):
            short.append(len(at))
        at.append(pos)
        size.append(size[-1] + constants)
        alone.append(alone[-1] + (constants >= least))
        sums.append((sums[-1] * BASE + xxhash.xxh64_intdigest(" ".join(tokens).encode())) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    out = []
    for i in short:
        hi = bisect_left(size, size[i] + least)  # lines i to hi - 1
        lo = bisect_right(size, size[i + 1] - least) - 1  # lines lo to i
        for side, a, b in ((">", i, hi), ("<", lo, i + 1)):
            if a >= 0 and b < len(size) and alone[a] == alone[b]:
                out.append((at[i], docs, f"{side} {b - a} {(sums[b] - sums[a] * power[b - a]) % PRIME}"))
    return out


def line_templates(docs: DataFrame) -> DataFrame:
    """(doc, ident, pos, need, key) for the templates of every line; the key is a 64-bit hash."""
    def run(batches):
        import xxhash

        for b in iter_slices(batches):
            out: list[tuple] = []
            for doc, ident, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                lines = text.split("\n")
                for pos, least, t in [*((pos, *t) for pos, line in enumerate(lines) for t in templates(line)), *passages(lines)]:
                    h = xxhash.xxh64_intdigest(t.encode())
                    out.append((doc, ident, pos, least, h - (1 << 64) if h >> 63 else h))
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc", "ident", "pos", "need", "key"])

    return docs.select("doc", "ident", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc long, ident long, pos int, need int, key long")


def leaf_lines(docs: DataFrame) -> DataFrame:
    """(doc, ident, pos, leaf, tokens): the lines of LEAF_TOKENS tokens, filed
    by token count and first token; tokens as hashes, 0 for a masked field."""
    lines = docs.select("doc", "ident", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    words = lines.select("doc", "ident", "pos", F.array_remove(F.split("line", BLANK), "").alias("words")).where(F.size("words").between(*LEAF_TOKENS))
    hashed = F.transform("words", lambda w: F.when(w.rlike(VARIABLE.pattern), F.lit(0).cast("long")).otherwise(F.xxhash64(w)))
    return words.select("doc", "ident", "pos", hashed.alias("tokens")).where(F.col("tokens")[0] != 0).select(
        "doc", "ident", "pos", F.xxhash64(F.size("tokens"), F.col("tokens")[0]).alias("leaf"), "tokens")


def learned_templates(docs: DataFrame) -> DataFrame:
    """(doc, ident, pos, need, key) for the short lines that their leaf generalises.

    A leaf learns its fields from its lines: a token that stands at its place
    in fewer than LEAF_DOCS documents of the leaf is one, whatever it looks
    like.  Everything is counted by grouped sums, a leaf is never gathered:
    the counts of (leaf, place, token) are joined back to the lines' tokens.
    """
    lines = cut_lineage(leaf_lines(docs))
    # leaves of few documents learn nothing: no line of theirs can reach the counts
    wide = lines.groupBy("leaf", "ident").count().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= LEAF_DOCS).select("leaf")
    salt = F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int")  # one leaf may hold a third of all lines
    wide = wide.select("leaf", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lines = lines.withColumn("salt", salt).join(wide, ["leaf", "salt"], "left_semi")
    tokens = lines.select("doc", "ident", "pos", "leaf", F.posexplode("tokens").alias("place", "token"))
    known = (tokens.where("token <> 0").groupBy("leaf", "place", "token", "ident").count()
             .groupBy("leaf", "place", "token").agg(F.count("*").alias("docs")).where(F.col("docs") >= LEAF_DOCS).select("leaf", "place", "token"))
    kept = tokens.join(known, ["leaf", "place", "token"]).groupBy("doc", "ident", "pos", "leaf").agg(
        F.sort_array(F.collect_set(F.struct("place", "token"))).alias("kept"))  # at most 11; rows may repeat
    size = F.size("kept")
    n = lines.select("ident", "pos", F.size("tokens").alias("n")).distinct()
    return kept.where(size >= LEAF_CONSTANTS).join(n, ["ident", "pos"]).where((size < F.col("n")) & (size >= LEAF_SHARE * F.col("n"))).select(
        "doc", "ident", "pos", F.lit(LEAF_DOCS).alias("need"), F.xxhash64(F.lit("leaf"), "leaf", "kept").alias("key"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the recurring lines taken out of the text,
    and n_lines and n_dropped (an input column of such a name is replaced).

    A line recurs word by word if it occurs in ``EXACT_DOCS`` documents, however
    short it is.  A template with variable parts recurs if it occurs in as many
    documents as ``TIERS`` asks for its number of constant tokens; consecutive
    lines count as one template (``passages``).  Lines of 6 to 11 tokens also have the template that
    their leaf learns (``learned_templates``), in LEAF_DOCS documents.  Its first line (smallest id, then place)
    stays, so nothing that only copies hold is lost; every other line of it
    goes, the rest of a document stays as it was.  A document that loses all
    its lines stays with an empty text.

    Rows with the same id and text are one document: they lose the same lines
    and count once.  Very long texts are read whole.  Null texts stay null (0 lines); a null id sorts last.  An
    empty table gives an empty result.  Only hashes are shuffled to find the
    templates, with partial counts before each shuffle; a template in a third
    of all documents is joined by a skew-splittable join.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own, drop = free_name(docs.columns, "_ident"), free_name(docs.columns, "_gone")
    ident = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), ident.alias("ident"), F.col(text_col).cast("string").alias("text"))
    lines = cut_lineage(line_templates(rows)).unionByName(cut_lineage(learned_templates(rows)))
    # one pass over all keys drops those of a single document; documents are counted exactly for the rest
    shared = lines.groupBy("key").agg(
        F.min("need").alias("need"), F.min("ident").alias("low"), F.max("ident").alias("high"),
        F.min(F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), "ident", "pos")).alias("first")).where("low <> high")
    hits = cut_lineage(lines.select("key", "ident", "pos").join(shared.select(
        "key", "need", F.col("first.ident").alias("f_ident"), F.col("first.pos").alias("f_pos")), "key"))
    n_docs = hits.where("need > 2").groupBy("key", "need", "ident").count().groupBy("key", "need").agg(F.count("*").alias("n_docs"))
    later = hits.where("ident <> f_ident or pos <> f_pos")
    gone = (later.where("need > 2").join(n_docs.where("n_docs >= need").select("key"), "key", "left_semi").select("ident", "pos")
            .unionByName(later.where("need <= 2").select("ident", "pos"))  # shared by two documents already
            .groupBy("ident").agg(F.collect_set("pos").alias(drop)))
    parts = F.split(F.col(text_col).cast("string"), "\n", -1)
    kept = F.filter(parts, lambda line, at: ~F.array_contains(F.col(drop), at))
    out = docs.select(*keep, ident.alias(own)).join(gone.withColumnRenamed("ident", own), own, "left")
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in keep],
                      F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))
