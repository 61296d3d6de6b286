"""License scan: ordered signature rules, gated by keywords, resolved by
priority and containment.  DataFrame expressions only."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import bind, carry, count_below

# The base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Every rule's keyword holds one of these, the first gate.
ROOTS = ["licen", "gpl", "mpl", "epl", "cddl", "gfdl", "odbl", "eupl", "cc by", "cc0", "cc zero", "commons", "bsd", "apache", "free of charge",
         "copy modify and", "source and binary", "origin of this", "unencumbered", "wtfpl", "public domain", "gnu org", "proprietary",
         "without permission", "rights reserved", "copyright", "lgpl"]
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Named licenses: label stem, how its name is written (words of the normalised
# text), its versions, and the keyword that gates its rules.
FAMILIES = [
    ("gpl", r"(?:gnu )?(?:gpl|general public licen[cs]e)", ("1", "2", "3"), ("gpl", "general public licen")),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)", ("2", "2.1", "3"), ("lgpl", "lesser general public licen", "library general public licen")),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public licen[cs]e)", ("1", "3"), ("agpl", "affero general public licen")),
    ("gfdl", r"(?:gnu )?(?:gfdl|free documentation licen[cs]e)", ("1.1", "1.2", "1.3"), ("gfdl", "free documentation licen")),
    ("apache", r"apache(?: software)?(?: licen[cs]e)?", ("1.0", "1.1", "2.0"), ("apache",)),
    ("mpl", r"(?:mpl|mozilla public licen[cs]e)", ("1.0", "1.1", "2.0"), ("mpl", "mozilla public licen")),
    ("epl", r"(?:epl|eclipse public licen[cs]e)", ("1.0", "2.0"), ("epl", "eclipse public licen")),
    ("cddl", r"(?:cddl|common development and distribution licen[cs]e)", ("1.0", "1.1"), ("cddl", "common development and distribution licen")),
    ("cpl", r"common public licen[cs]e", ("1.0",), ("common public licen",)),
    ("eupl", r"(?:eupl|european union public licen[cs]e)", ("1.0", "1.1", "1.2"), ("eupl", "european union public licen")),
    ("artistic", r"artistic licen[cs]e", ("1.0", "2.0"), ("artistic licen",)),
    ("afl", r"academic free licen[cs]e", ("1.1", "2.0", "2.1", "3.0"), ("academic free licen",)),
    ("osl", r"open software licen[cs]e", ("1.0", "2.0", "2.1", "3.0"), ("open software licen",)),
    ("ofl", r"(?:sil )?open font licen[cs]e", ("1.0", "1.1"), ("open font licen",)),
    ("boost", r"boost software licen[cs]e", ("1.0",), ("boost software licen",)),
    ("zpl", r"zope public licen[cs]e", ("1.1", "2.0", "2.1"), ("zope public licen",)),
    ("lppl", r"latex project public licen[cs]e", ("1.0", "1.2", "1.3"), ("latex project public licen",)),
    ("ms-pl", r"microsoft public licen[cs]e", ("1.0",), ("microsoft public licen",)),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", ("1.0",), ("microsoft reciprocal licen",)),
    ("ecl", r"educational community licen[cs]e", ("1.0", "2.0"), ("educational community licen",)),
    ("odbl", r"(?:odbl|open database licen[cs]e)", ("1.0",), ("odbl", "open database licen")),
    ("cc-by", r"(?:cc by|creative commons attribution)(?! (?:sa|nc|nd|share|non|no ))", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc by", "commons attribution")),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc by sa", "commons attribution share")),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc by nd", "commons attribution no")),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?! (?:sa|nd|share|no ))", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc by nc", "commons attribution non")),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc by nc sa", "commons attribution non")),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc by nc nd", "commons attribution non")),
    ("cc0", r"(?:cc0|cc zero|creative commons zero)", ("1.0",), ("cc0", "cc zero", "commons zero")),
]

# Rules of their own: label, priority, keyword, pattern.
SINGLE = [
    ("mit", 2, "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 3, "mit licen", r"(?:the )?mit licen[cs]e"),
    ("x11", 3, "x11 licen", r"x11 licen[cs]e"),
    ("isc", 2, "copy modify and", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", 3, "isc licen", r"isc licen[cs]e"),
    ("bsd", 2, "source and binary", r"redistribution and use in source and binary forms"),
    ("bsd-2-clause", 3, "bsd", r"(?:2|two) clause bsd|(?:simplified|freebsd) bsd|bsd 2 clause"),
    ("bsd-3-clause", 3, "bsd", r"(?:3|three) clause bsd|(?:new|modified|revised) bsd|bsd 3 clause"),
    ("bsd-4-clause", 3, "bsd", r"(?:4|four) clause bsd|original bsd|bsd 4 clause"),
    ("bsd", 4, "bsd", r"bsd(?: style)? licen[cs]e"),
    ("zlib", 2, "origin of this", r"the origin of this software must not be misrepresented"),
    ("zlib", 3, "licen", r"zlib(?: libpng)? licen[cs]e"),
    ("unlicense", 2, "unencumbered", r"free and unencumbered software released into the public domain"),
    ("unlicense", 3, "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", 3, "wtfpl", r"wtfpl"),
    ("public-domain", 4, "public domain", r"(?:released|placed|dedicated)(?: in)?(?: to| into)? the public domain"),
    ("apache-2.0", 2, "apache", r"licensed under the apache licen[cs]e(?: version)? 2 0"),
    ("apache-2.0", 2, "apache org", r"apache org licenses licen[cs]e 2 0"),
    ("apache", 4, "apache", r"(?:licensed under )?(?:the )?apache(?: software)? licen[cs]e"),
    ("gpl", 4, "gnu org", r"gnu org licenses (?:old licenses )?gpl"),
    ("lgpl", 4, "gnu org", r"gnu org licenses (?:old licenses )?lgpl"),
    ("cc", 4, "creativecommons", r"creativecommons org licenses [a-z ]{2,12}(?: \d \d)?"),
    ("cc", 4, "creative commons", r"(?:a |the )?creative commons licen[cs]e"),
    ("php", 3, "php licen", r"php licen[cs]e"),
    ("python", 3, "licen", r"python(?: software foundation)? licen[cs]e"),
    ("ruby", 3, "licen", r"ruby licen[cs]e"),
    ("openssl", 3, "licen", r"openssl licen[cs]e"),
    ("proprietary", 3, "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", 4, "without permission", r"(?:may not be|no part[a-z ]{0,40}) (?:reproduced|copied|distributed)[a-z ]{0,40}without permission"),
    ("reserved", 4, "rights reserved", r"(?:all|some) rights reserved"),
    ("copyright", 5, "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("licensed", 5, "licensed under", r"licensed under (?:the )?(?:terms of (?:the )?)?[a-z0-9 ]{3,40}? licen[cs]e"),
]

WEIGHT = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.5, 5: 0.25}


def rules() -> list[tuple[str, int, str, str]]:
    """The ordered rules (label, priority, keyword, pattern): an identifier
    line, a notice, a name with version and a bare name for each family and
    version, and the single rules; lower priority numbers are surer."""
    out = []
    for stem, name, versions, keys in FAMILIES:
        words = stem.replace("-", " ")
        for v in versions:
            digits = v.replace(".", " ")
            short = digits.removesuffix(" 0")
            number = f"{short}(?: 0)?" if short != digits or "." not in v else digits
            label = f"{stem}-{v}"
            number = rf"(?:v|version |v )?{number}(?! \d)"
            out.append((f"{label}-only", 1, "spdx licen", rf"spdx licen[cs]e identifier {words} {number} only"))
            out.append((f"{label}-or-later", 1, "spdx licen", rf"spdx licen[cs]e identifier {words} {number} or later"))
            out.append((label, 1, "spdx licen", rf"spdx licen[cs]e identifier {words} {number}"))
            for key in keys:
                out.append((f"{label}-or-later", 2, key, rf"{name}(?: as published by the free software foundation)?(?: either)? {number}(?: of the licen[cs]e)? or (?:at your option )?any later version"))
                out.append((label, 3, key, rf"{name}(?: licen[cs]e)?(?: international| unported| generic)? {number}"))
        for key in keys:
            out.append((stem, 4, key, name))
    return out + SINGLE


def normalised(text: Column) -> Column:
    """Lower-cased words joined by one space, with a space at either end.

    ``lower`` changes letters beyond A-Z too, but none into one that breaks a
    word or that a phrase or rule asks for, and no changed text is returned.
    """
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), BREAKS, " ")), F.lit(" "))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def spans(norm: Column, rule: Column) -> Column:
    """(start, end, prio, label) of a rule's matches, in characters of the normalised text."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    steps = F.filter(F.zip_with(F.split(norm, pattern, -1), F.regexp_extract_all(norm, pattern, F.lit(0)),
                                lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size"))), lambda s: s["size"].isNotNull())
    kind = "struct<start:int,end:int,prio:int,label:string>"

    def step(at, s):
        begin = at + s["gap"]
        return begin + s["size"], F.struct(begin.alias("start"), (begin + s["size"]).alias("end"), rule["prio"].alias("prio"), rule["label"].alias("label"))

    return F.when(F.rlike(norm, pattern), carry(steps, F.lit(0), step, kind)).otherwise(F.array().cast(f"array<{kind}>"))


def word_spans(norm: Column, found: Column) -> Column:
    """(word, n, prio, label) of the detections: their places in the array of
    all words' starts, which is built once from running lengths."""
    starts = carry(F.split(F.substring(norm, F.lit(2), F.length(norm)), " ", -1), F.lit(1), lambda at, w: (at + F.length(w) + 1, at), "int")

    def place(at):
        first = lambda d: count_below(at, d["start"])
        return F.transform(found, lambda d: F.struct(first(d).cast("long").alias("word"), (count_below(at, d["end"] + 1) - first(d)).cast("long").alias("n"),
                                                     d["prio"].alias("prio"), d["label"].alias("label")))

    none = F.array().cast("array<struct<word:bigint,n:bigint,prio:int,label:string>>")
    return F.when(F.size(found) > 0, bind(starts, place)).otherwise(none)


def resolve(found: Column) -> Column:
    """The detections that no other suppresses: one goes if it overlaps one of
    better priority, or lies inside one of equal priority that is longer or,
    for equal intervals, first in label order.

    Two linear sweeps.  In order of start, the farthest end of each priority
    so far tells what reaches into the next detection; backwards, the nearest
    start of each priority tells what begins inside it.
    """
    levels = F.sequence(F.lit(1), F.lit(len(WEIGHT)))
    fields = lambda d, end, hit: F.struct(d["start"].alias("start"), end.alias("end"), d["prio"].alias("prio"), d["label"].alias("label"), hit.alias("hit"))
    kind = "struct<start:int,end:int,prio:int,label:string,hit:boolean>"

    def sweep(order, hits, carried, init):
        def step(seen, d):
            hit = d["hit"] | F.exists(levels, lambda p: hits(p, F.element_at(seen, p), d))
            after = F.transform(seen, lambda v, i: F.when(i + 1 == d["prio"], carried(v, d)).otherwise(v))
            return after, fields(d, d["end"], hit)

        return carry(order, F.array(*[F.lit(init)] * len(WEIGHT)), step, kind)

    order = F.array_sort(F.transform(found, lambda d: fields(d, -d["end"], F.lit(False))))  # the longer of two starts first
    order = F.transform(order, lambda d: fields(d, -d["end"], d["hit"]))
    once = sweep(order, lambda p, end, d: ((p < d["prio"]) & (end > d["start"])) | ((p == d["prio"]) & (end >= d["end"])),
                 lambda v, d: F.greatest(v, d["end"]), -1)
    twice = sweep(F.reverse(once), lambda p, start, d: (p < d["prio"]) & (start < d["end"]),
                  lambda v, d: F.least(v, d["start"]), 1 << 30)
    left = F.transform(F.filter(twice, lambda d: ~d["hit"]), lambda d: F.struct(
        d["start"].alias("start"), d["end"].alias("end"), d["prio"].alias("prio"), d["label"].alias("label")))
    return F.array_sort(left)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word,
    base_labels, labels (arrays, sorted), found and score.

    Base: the places where a phrase of ``PHRASES`` stands as consecutive
    words; first_word and last_word are the smallest and largest start, null
    without any.  Method: ``rules``; a rule's pattern runs only where its
    keyword occurs, and rules at all only in texts with any keyword.  ``found``
    has the surviving detections (first word, words, priority, label);
    ``labels`` joins their labels and the base ones.  ``score`` is the weight
    of the surest label, 0 without any.

    Null and empty texts have no words and no labels; repeated rows are
    scanned each; other columns are ignored; no rows give no rows.
    """
    src = docs.select(F.col(id_col).alias("id"), normalised(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    table = rules()
    keys = {k for _, _, k, _ in table}
    roots = [r for r in ROOTS if any(r in k for k in keys)]
    needed = [r for i, r in enumerate(roots) if any(r in k and not any(o in k for o in roots[:i]) for k in keys)]
    assert all(any(r in k for r in needed) for k in keys)
    listed = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(prio).alias("prio"), F.lit(key).alias("key"), F.lit(p).alias("pattern")) for label, prio, key, p in table])
    norm = F.col("norm")
    kind = "array<struct<start:int,end:int,prio:int,label:string>>"
    open_rules = F.filter(listed, lambda r: F.contains(norm, r["key"]))
    found = F.when(functools.reduce(operator.or_, [F.contains(norm, F.lit(r)) for r in needed]), resolve(F.flatten(F.transform(open_rules, lambda r: spans(norm, r))))).otherwise(F.array().cast(kind))
    phrase = "(?<= )(?:" + "|".join(p for p, _ in PHRASES) + ")(?= )"
    hit = functools.reduce(operator.or_, [F.contains(norm, F.lit(f" {p} ")) for p, _ in PHRASES])
    between = F.when(hit, F.split(norm, phrase, -1))
    places = F.when(hit, F.regexp_extract_all(norm, F.lit(phrase), F.lit(0))).otherwise(F.array().cast("array<string>"))
    n_words = F.when(F.trim(norm) == "", 0).otherwise(spaces(norm) - 1).cast("long")
    rows = src.select("id", norm, n_words.alias("n_words"), found.alias("found"), between.alias("between"), places.alias("places"))
    tail = spaces(F.element_at("between", -1)) + spaces(F.element_at("places", -1))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: F.coalesce(*[F.when(p == w, F.lit(name)) for w, name in PHRASES]))))
    words = word_spans(F.col("norm"), F.col("found"))
    n_base = F.size("places").cast("long")
    surest = F.array_min(F.transform("found", lambda d: d["prio"]))
    weights = F.create_map(*[F.lit(x) for p, w in WEIGHT.items() for x in (p, w)])
    score = F.greatest(F.when(n_base > 0, F.lit(WEIGHT[4])).otherwise(0.0), F.coalesce(weights[surest], F.lit(0.0)))
    return rows.select(
        F.col("id").alias(id_col), "n_words", n_base.alias("n_base"),
        F.when(n_base > 0, spaces(F.element_at("between", 1)) - 1).cast("long").alias("first_word"),
        F.when(n_base > 0, F.col("n_words") - tail).cast("long").alias("last_word"),
        base.alias("base_labels"), F.array_sort(F.array_distinct(F.concat(base, F.transform("found", lambda d: d["label"])))).alias("labels"),
        words.alias("found"), score.alias("score"))
