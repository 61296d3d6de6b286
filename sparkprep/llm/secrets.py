"""Secret scan: pattern spans, and high-entropy tokens that pass a battery of
randomness tests.  DataFrame expressions only."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import bind, carry, count_below

# The pattern kinds, their patterns, and the least size of what must match.
KINDS = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", r"AKIA[A-Z0-9]{12,}"),
    ("hex", r"[0-9a-f]{32,}"),
]
MIN_ASSIGN = 8
SPAN = "array<struct<start:int,end:int,kind:string>>"

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"


def match_spans(text: Column, pattern: str, kind: str, group: int | None = None, least: int = 0) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping
    matches, without those whose ``group`` is under ``least`` long.

    The texts between matches (split) and the matches give the positions as
    running lengths.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.zip_with(F.zip_with(between, found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size"))),
                       tested, lambda s, t: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(t).alias("key")))

    def step(at, s):
        begin = at + s["gap"]
        end = begin + s["size"]
        return end, F.when(s["key"] >= least, F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))

    spans = carry(F.filter(steps, lambda s: s["size"].isNotNull()), F.lit(0), step, "struct<start:int,end:int,kind:string>")
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(spans, lambda s: s.isNotNull())).otherwise(F.array().cast(SPAN))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of ``others``: of those that begin before a
    span's end, the farthest end so far tells."""
    def free(order):
        ends = carry(order, F.lit(0), lambda far, s: (F.greatest(far, s["end"]), F.greatest(far, s["end"])), "int")

        def keep(far):
            starts = F.transform(order, lambda s: s["start"])
            return bind(starts, lambda st: F.filter(spans, lambda c: F.coalesce(F.get(far, count_below(st, c["end"]) - 1), F.lit(0)) <= c["start"]))

        return bind(ends, keep)

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(bind(F.array_sort(others), free))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; a published rational
    approximation with error below 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    # fixed values: the coefficients of the approximation
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


# encoding, full-match pattern, alphabet in code order; the first that matches is taken
ENCODINGS = [
    ("hex", r"[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    ("base32", r"[A-Z2-7]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"[0-9a-z]+|[0-9A-Z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"[A-Za-z0-9+/]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"[A-Za-z0-9_-]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]


def battery(token: Column) -> Column:
    """struct(encoding, n, p): the token's inferred encoding, its length and the
    p-value of the hypothesis that its symbols are independent and uniform
    over the encoding's alphabet.

    Three tests: chi-squared of the symbol counts (Wilson-Hilferty normal
    score, upper tail), number of runs above and below the alphabet's middle
    (two-sided), and lag-one serial correlation (two-sided); combined by
    Cauchy's rule, which holds for dependent tests.
    """
    body = F.regexp_replace(token, "=+$", "")
    # a token without both a letter and a digit is a word, a number or a rule, not an encoding
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    enc = F.coalesce(*[F.when(mixed & token.rlike(f"^(?:{p})$"), F.lit(e)) for e, p, _ in ENCODINGS])
    alphabet = F.coalesce(*[F.when(enc == e, F.lit(a)) for e, _, a in ENCODINGS])
    folded = F.when(enc.isin("hex", "base36"), F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(body)
    codes = F.transform(F.split(folded, ""), lambda ch: F.instr(alphabet, ch).cast("double"))
    return F.struct(enc.alias("encoding"), F.length(body).alias("n"), F.length(alphabet).cast("double").alias("k"),
                    F.filter(codes, lambda c: c > 0).alias("codes"))


def battery_p(b: Column) -> Column:
    n, k, codes = b["n"].cast("double"), b["k"], b["codes"]
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    counts = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda d: d == c)).cast("double"))
    chi = add(F.transform(counts, lambda c: c * c)) * k / n - n
    df = k - 1
    z_chi = (F.cbrt(F.greatest(chi, F.lit(1e-9)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p_chi = 1 - normal_cdf(z_chi)
    after = F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(1)))
    pairs = F.filter(F.zip_with(codes, after, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["y"].isNotNull())
    half = (k + 1) / 2
    changes = F.size(F.filter(pairs, lambda p: (p["x"] > half) != (p["y"] > half))).cast("double")
    z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    mean, var = half, (k * k - 1) / 12  # of the uniform law
    z_corr = add(F.transform(pairs, lambda p: (p["x"] - mean) * (p["y"] - mean))) / (var * F.sqrt(n - 1))
    both = lambda z: 2 * (1 - normal_cdf(F.abs(z)))
    # a count that meets its mean exactly has p = 1, which by Cauchy's rule would outweigh any small p
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(0.99))
    score = sum(F.tan((0.5 - clip(p)) * 3.141592653589793) for p in (p_chi, both(z_runs), both(z_corr))) / 3
    return 0.5 - F.atan(score) / 3.141592653589793


# What ordinary identifiers are made of.
ORDINARY = ("account action address archive article backup branch buffer button cache catalog center channel chapter client column comment config "
            "control corner country create current customer data default delete detail document download element event example export feature field "
            "figure file filter folder format front function group handler header history image import index input install item journal label language "
            "layout level library link list local login main manager market master member memory message method middle model module monitor name network "
            "north note number object office option order origin output page panel parent part path people picture place point policy press price print "
            "process product profile project public query question random record region release remote report request result return river route sample "
            "schema screen script section select server service session setting simple size source south special station status storage street string "
            "student style submit summer support switch system table target template test text theme time title tool total train update upload user "
            "value version view village volume water week width window winter word work year").split()
ORDINARY_HEX = "face bead dead beef cafe fade deaf feed decade facade added bed cab dab fed ace bad dad add ad be ab fa".split()


def ordinary_tokens(encoding: str, n: int, many: int, seed: int = 7) -> list[str]:
    """Identifiers of ``n`` characters: words, written as the encoding has
    them, with numbers in between; each has a letter and a digit."""
    rng = random.Random(f"{seed} {encoding} {n}")
    words = ORDINARY_HEX if encoding == "hex" else ORDINARY
    digits = "234567" if encoding == "base32" else "0123456789"
    glue = {"base64url": "-_"}.get(encoding, "")
    out = []
    while len(out) < many:
        t = ""
        mark = rng.choice(glue) if glue else ""
        while len(t) < n:
            w = rng.choice(words)
            w = w.upper() if encoding == "base32" else w.capitalize() if encoding == "base64" else w
            t += (mark if t else "") + w + ("".join(rng.choice(digits) for _ in range(rng.randint(1, 4))) if rng.random() < 0.4 else "")
        t = t[:n]
        if not any(c in digits for c in t):
            t = t[:-1] + rng.choice(digits)
        out.append(t)
    return out


def ordinary_tails(spark, strata: list[tuple[str, int]], bins: int, many: int = 1200, longest: int = 128) -> dict[tuple[str, int], list[float]]:
    """Of each (encoding, length class): the share of ordinary tokens with p at
    or above each bin's lower edge, at the class's shortest length (at most ``longest``)."""
    rows = [(e, s, t) for e, s in strata for t in ordinary_tokens(e, min(max(math.ceil(2 ** (s / 2) - 1e-9), 20), longest), many)]
    b = spark.createDataFrame(rows, "encoding string, size int, token string").select("encoding", "size", battery(F.col("token")).alias("b"))
    p = b.where("b.encoding = encoding").select("encoding", "size", F.least(F.floor(battery_p(F.col("b")) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    hist: dict[tuple, list[int]] = {}
    for r in p.groupBy("encoding", "size", "bin").count().collect():
        hist.setdefault((r["encoding"], r["size"]), [0] * bins)[r["bin"]] = r["count"]
    return {k: [(sum(h[t:]) + 1) / (sum(h) + 1) for t in range(bins)] for k, h in hist.items()}


def lowest_bins(strata: dict[tuple[str, int], list[int]], tails: dict[tuple[str, int], list[float]], q: float, top: float, bins: int,
                least_sure: int) -> dict[tuple[str, int], int]:
    """The lowest bin of each stratum that may be reported; strata without one are left out.

    A histogram with few candidates borrows the neighbouring lengths of its
    encoding, nearest first, for its share of random tokens and its false share.
    """
    out = {}
    edge = int(top * bins)
    for (e, s) in strata:
        near = sorted((k for k in strata if k[0] == e), key=lambda k: (abs(k[1] - s), k[1]))
        pool = [near[0]]
        for k in near[1:]:
            if sum(sum(strata[x]) for x in pool) >= least_sure:
                break
            pool.append(k)
        # expected tokens at or above t: random ones by the uniform law, ordinary ones by the tails of their lengths
        m = sum(sum(strata[k]) for k in pool)
        tail = [sum(sum(strata[k]) * tails.get(k, [1.0] * bins)[t] for k in pool) / m for t in range(bins)]
        above = [sum(sum(strata[k][t:]) for k in pool) for t in range(bins)]
        share = 1 - edge / bins - tail[edge]
        random_share = min(max((above[edge] / m - tail[edge]) / share, 0.0), 1.0) if share > 0 else 0.0
        for t in range(bins):
            if above[t] and m * (1 - random_share) * tail[t] <= q * above[t]:
                out[e, s] = max(t, int(q * bins) + 1)
                break
    return out


def find_secrets(docs: DataFrame, q: float = 0.05, top: float = 0.75, bins: int = 64, least_sure: int = 20,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base (spans of the three patterns) and
    random (spans of kind ``random``), each an array of (start, end, kind).

    Candidates are stand-alone tokens of 20 or more encoding characters with a
    letter and a digit, outside the base spans.  Each gets the p-value of
    randomness of its inferred encoding (``battery``).  Ordinary tokens have
    p near zero once they are long enough for the tests to tell; random ones
    have uniform p.  How much of the ordinary ones lies above each t is known
    from identifiers made of words and numbers (``ordinary_tails``), for each
    stratum (encoding, length rounded down to a power of sqrt 2).  The part of
    the candidates above ``top`` beyond that gives the share of random tokens,
    and a token is reported if t, its p's lower bin edge, has an expected share
    of ordinary ones of at most ``q`` in its stratum (and t > q).  Strata too short for the
    tests to tell have a large false share at every t and report nothing.
    Strata with fewer than ``least_sure`` candidates are judged together with
    the neighbouring lengths of their encoding.

    The histogram of p has (encodings x lengths x ``bins``) cells at most, so
    it is bounded whatever the input; it is broadcast.  Null and empty texts
    give empty arrays; repeated rows are scanned each; other columns are
    ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    base = F.concat(*[match_spans(F.col("text"), p, k, 1 if k == "assign" else None, MIN_ASSIGN if k == "assign" else 0)
                      for k, p in KINDS])
    rows = src.select("id", "text", base.alias("base"), match_spans(F.col("text"), CANDIDATE, "random").alias("cand"))
    outside = apart(F.col("cand"), F.col("base"))
    rows = rows.select("id", "base", F.transform(outside, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"),
        F.substring(F.col("text"), c["start"] + 1, c["end"] - c["start"]).alias("token"))).alias("cand"))
    rows = rows.withColumn("cand", F.transform("cand", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), battery(c["token"]).alias("b"))))
    rows = rows.withColumn("cand", F.transform(F.filter("cand", lambda c: c["b"]["encoding"].isNotNull()), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["b"]["encoding"].alias("encoding"),
        F.floor(2 * F.log2(c["b"]["n"].cast("double"))).cast("int").alias("size"),
        F.least(F.floor(battery_p(c["b"]) * bins), F.lit(bins - 1)).cast("int").alias("bin"))))
    from sparkprep.session import cut_lineage
    rows = cut_lineage(rows)

    # (encoding, length class, bin) counts -> the lowest bin of each stratum that may be reported
    hist = rows.select(F.explode("cand").alias("c")).groupBy("c.encoding", "c.size", "c.bin").count().collect()
    strata: dict[tuple, list[int]] = {}
    for r in hist:
        strata.setdefault((r["encoding"], r["size"]), [0] * bins)[r["bin"]] = r["count"]
    tails = ordinary_tails(docs.sparkSession, sorted(strata), bins) if strata else {}
    least_bin = lowest_bins(strata, tails, q, top, bins, least_sure)
    if least_bin:
        lookup = F.create_map(*[F.lit(x) for (e, s), t in sorted(least_bin.items()) for x in (f"{e}:{s}", t)])
        sure = F.filter("cand", lambda c: F.coalesce(c["bin"] >= lookup[F.concat(c["encoding"], F.lit(":"), c["size"].cast("string"))], F.lit(False)))
    else:
        sure = F.filter("cand", lambda c: F.lit(False))
    spans = F.transform(sure, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return rows.select(F.col("id").alias(id_col), "base", spans.alias("random"))


def span_text(spans: Column, order: list[str]) -> Column:
    """kind:start:end by start, then kind in ``order``, comma-joined."""
    rank = F.array(*[F.lit(k) for k in order])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("r"),
                                                  s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
