"""Column-expression helpers shared by the operators.

The reference runs on pandas, whose NULL handling differs from SQL in a few
places (a comparison with a missing value is False, never NULL).  These
helpers make that two-valued logic explicit so every operator stays a plain
Catalyst expression.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound_literal(value) -> Column:
    """Literal for a rule bound; ISO date strings become DATE literals."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (_dt.date, _dt.datetime)):
        return F.lit(value)
    if isinstance(value, str) and len(value) == 10 and value[4] == "-" and value[7] == "-":
        return F.to_date(F.lit(value))
    return F.lit(value)


def compare(col: str | Column, op: str, bound) -> Column:
    """``col op bound``; ``bound`` may be a literal or another column."""
    if op not in _OPS:
        raise ValueError(f"unsupported comparison {op!r}; use one of {sorted(_OPS)}")
    return _OPS[op](as_col(col), bound_literal(bound))


def null_false(pred: Column) -> Column:
    """Two-valued predicate: a NULL comparison counts as False (pandas masks)."""
    return F.coalesce(pred, F.lit(False))


def pattern_union(patterns: Iterable[str]) -> str:
    """Join regex alternatives with ``|`` (the reference joins them unescaped)."""
    pats = list(patterns)
    if not pats:
        raise ValueError("pattern list is empty")
    return "|".join(pats)


def any_match(col: str | Column, patterns: Sequence[str]) -> Column:
    """True when the text contains a match for any pattern; NULL text -> False."""
    return null_false(as_col(col).rlike(pattern_union(patterns)))


def hash_hex(cols: Sequence[str | Column], seed) -> Column:
    """Seeded md5 over ``key1|key2|...|seed``; identical in DuckDB's ``md5``."""
    parts = [as_col(c).cast("string") for c in cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def hash_int(cols: Sequence[str | Column], seed) -> Column:
    """First 32 bits of :func:`hash_hex` as a non-negative BIGINT."""
    return F.conv(F.substring(hash_hex(cols, seed), 1, 8), 16, 10).cast("bigint")


def np_round(col: str | Column, decimals: int = 2) -> Column:
    """Half-even rounding the way numpy / pandas do it: ``rint(x * 10**d) / 10**d``
    on the binary double (``bround`` rounds the decimal representation, which
    differs on exact-looking ties such as 5407.105)."""
    scale = float(10 ** decimals)
    return F.rint(as_col(col) * F.lit(scale)) / F.lit(scale)
