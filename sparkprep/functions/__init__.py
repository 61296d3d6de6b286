"""Reusable column expressions (all JVM-side, codegen-friendly)."""

from sparkprep.functions.exprs import (  # noqa: F401
    any_match,
    as_col,
    compare,
    hash_hex,
    hash_int,
    np_round,
    null_false,
    pattern_union,
)
