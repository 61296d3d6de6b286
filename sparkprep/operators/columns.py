"""Column-level cleaning, recoding, flags and date arithmetic.

Each operator adds or rewrites columns with one ``withColumns`` (a single
Project, inside whole-stage codegen); none shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.exprs import any_match, np_round, null_false


def na_as_blank(df: DataFrame) -> DataFrame:
    """NULL -> '' in string columns (numeric columns keep their type)."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill("", subset=strings) if strings else df


def impute(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant imputation per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def lowercase(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lowercase text columns (cast to string first, as the reference does)."""
    return df.withColumns({c: F.lower(F.col(c).cast("string")) for c in cols if c in df.columns})


def concat_cols(df: DataFrame, spec: Mapping[str, Sequence[str]], sep: str = ",",
                blanks_as_empty: bool = True) -> DataFrame:
    """C4: row-wise join of several text columns.

    ``blanks_as_empty=True`` reproduces the reference: a missing part is an
    empty string, so separators stay (``a,b,,,``).  False skips NULL parts.
    """
    def one(cols):
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if blanks_as_empty else F.col(c)
                 for c in cols]
        return F.concat_ws(sep, *parts)
    return df.withColumns({new: one(cols) for new, cols in spec.items()})


def regex_remove(df: DataFrame, col: str, pattern: str = ",,+") -> DataFrame:
    """Delete every match of ``pattern`` (all occurrences)."""
    return df.withColumn(col, F.regexp_replace(F.col(col), pattern, ""))


def count_elements(df: DataFrame, col: str, new: str, sep: str = ",") -> DataFrame:
    """Number of ``sep``-separated elements (trailing empties count)."""
    return df.withColumn(new, F.size(F.split(F.col(col), sep, -1)).cast("int"))


def flag_matches(df: DataFrame, col: str, patterns: Sequence[str], new: str) -> DataFrame:
    """1 when the text matches any pattern, else 0 (NULL text -> 0)."""
    return df.withColumn(new, any_match(col, patterns).cast("int"))


def flag_many(df: DataFrame, col: str, spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several named pattern lists over one text column, one Project."""
    return df.withColumns({new: any_match(col, pats).cast("int") for new, pats in spec.items()})


def null_if_in(df: DataFrame, spec: Mapping[str, Sequence]) -> DataFrame:
    """Listed synonyms become NULL."""
    return df.withColumns({c: F.when(~null_false(F.col(c).isin([str(v) for v in vals])), F.col(c))
                           for c, vals in spec.items()})


def presence_dummy(df: DataFrame, spec: Mapping[str, Sequence], suffix: str = "_DUM") -> DataFrame:
    """C10 + C11: synonyms -> NULL in the source column, then ``<col>_DUM`` =
    0 for NULL, 1 for any other value."""
    df = null_if_in(df, spec)
    return df.withColumns({f"{c}{suffix}": F.when(F.col(c).isNull(), 0).otherwise(1) for c in spec})


def category_indicator(df: DataFrame, col: str, value: str, new: str) -> DataFrame:
    """1 for ``value``, 0 for any other value, NULL stays NULL."""
    c = F.col(col)
    return df.withColumn(new, F.when(c.isNull(), F.lit(None).cast("int"))
                         .when(c == F.lit(value), 1).otherwise(0))


def _lookup(col: Column, mapping: Mapping, kind: str | None = None) -> Column:
    expr = None
    for k, v in mapping.items():
        val = F.lit(v).cast(kind) if kind else F.lit(v)
        expr = (F.when(col == F.lit(k), val) if expr is None
                else expr.when(col == F.lit(k), val))
    return expr


def replace_values(df: DataFrame, spec: Mapping[str, Mapping]) -> DataFrame:
    """Dictionary recode, unmapped values kept.

    A Spark column has one type, so the result takes the replacement values'
    type and an unmapped value is cast to it; text that cannot become a number
    is an error, as it can be neither kept nor dropped unseen.
    """
    out = {}
    for c, mapping in spec.items():
        col = F.col(c)
        sample = next(iter(mapping.values()))
        if isinstance(sample, bool) or not isinstance(sample, (int, float)):
            out[c] = _lookup(col, mapping, "string").otherwise(col.cast("string"))
        else:
            kind = "double" if any(isinstance(v, float) for v in mapping.values()) else "int"
            out[c] = _lookup(col, mapping, kind).otherwise(col.cast(kind))
    return df.withColumns(out)


def map_labels(df: DataFrame, cols: Sequence[str], mapping: Mapping) -> DataFrame:
    """C14: dictionary map, unmapped -> NULL."""
    return df.withColumns({c: _lookup(F.col(c), mapping) for c in cols})


def composite_target(df: DataFrame, parts: Sequence[str], new: str,
                     sum_col: str | None = "composite", yes: str = "Yes", no: str = "No") -> DataFrame:
    """Y/N parts become 1/0 in the table (numeric parts as is), row-wise ``+`` (NULL
    propagates), then ``no`` when the sum is 0 and ``yes`` otherwise (a NULL
    sum is ``yes``, matching the reference's ``NaN == 0`` being False)."""
    def as_number(c):
        if isinstance(df.schema[c].dataType, T.NumericType):
            return F.col(c)
        return F.when(F.col(c) == "Y", 1).when(F.col(c) == "N", 0)
    total = reduce(lambda a, b: a + b, [as_number(c) for c in parts])
    out = df.withColumn(sum_col or "_composite", total)
    out = out.withColumns({c: as_number(c) for c in parts})
    out = out.withColumn(new, F.when(null_false(F.col(sum_col or "_composite") == 0), F.lit(no))
                         .otherwise(F.lit(yes)))
    return out if sum_col else out.drop("_composite")


def clip_upper(df: DataFrame, spec: Mapping[str, float]) -> DataFrame:
    """Values above the limit become the limit; NULL stays NULL."""
    return df.withColumns({c: F.when(F.col(c) > F.lit(u), F.lit(u).cast(df.schema[c].dataType))
                           .otherwise(F.col(c)) for c, u in spec.items()})


def replace_less_than(df: DataFrame, col: str, ref: str, repl: str) -> DataFrame:
    """C17: where ``col < ref`` take ``repl``; NULL comparisons keep ``col``."""
    return df.withColumn(col, F.when(null_false(F.col(col) < F.col(ref)), F.col(repl))
                         .otherwise(F.col(col)))


def date_diff(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """``new = days(a - b)`` as int."""
    return df.withColumns({new: F.datediff(F.col(a), F.col(b)).cast("int") for new, (a, b) in spec.items()})


def repaired_interval(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """C17 (end < start -> start) then C18, for each ``{new: [end, start]}``."""
    for new, (end, start) in spec.items():
        df = replace_less_than(df, end, start, start)
    return date_diff(df, spec)


def round_table(df: DataFrame, decimals: int = 2) -> DataFrame:
    """C20: numpy-style half-even rounding of every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: np_round(c, decimals) for c in floats})
