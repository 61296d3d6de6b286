"""Declared types, string casts, date parsing, column summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type-dictionary vocabulary: the reference's pandas dtype names and the
# Spark type each maps to (fixed values).
TYPE_ALIASES = {
    "string": "string",
    "category": "string",
    "object": "string",
    "float64": "double",
    "float": "double",
    "double": "double",
    "int": "int",
    "int64": "bigint",
    "long": "bigint",
    "datetime64": "date",
    "date": "date",
    "timestamp": "timestamp",
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def _checked(src: Column, parsed: Column, bad: str, name: str) -> Column:
    """``parsed``; a value of ``src`` that became NULL fails the job if ``bad`` is 'raise'."""
    if bad not in ("null", "raise"):
        raise ValueError(f"bad values are 'null' or 'raise', not {bad!r}")
    if bad == "null":
        return parsed
    error = F.raise_error(F.concat(F.lit(f"unparsable value in {name}: "), src.cast("string")))
    return F.when(src.isNotNull() & parsed.isNull(), error).otherwise(parsed)


def apply_types(df: DataFrame, types: Mapping[str, str], date_format: str | None = None,
                bad: str = "null") -> DataFrame:
    """Cast columns to declared types.

    Date targets read strings with ``date_format`` (ISO when None); other
    targets use ``try_cast``.  An unparsable value becomes NULL
    (:func:`cast_failures` counts them) or, with ``bad='raise'``, fails the job.
    """
    return df.withColumns({name: _checked(F.col(name), c, bad, name)
                           for name, c in _casts(df, types, date_format).items()})


def cast_failures(df: DataFrame, types: Mapping[str, str], date_format: str | None = None) -> DataFrame:
    """Per declared column: non-NULL values that :func:`apply_types` makes NULL (one pass)."""
    casts = _casts(df, types, date_format)
    return df.agg(*[F.count_if(F.col(name).isNotNull() & c.isNull()).alias(name) for name, c in casts.items()])


def _casts(df: DataFrame, types: Mapping[str, str], date_format: str | None) -> dict[str, Column]:
    out = {}
    for name, declared in types.items():
        if name not in df.columns:
            continue
        target = TYPE_ALIASES.get(declared, declared)
        src = df.schema[name].dataType
        c = F.col(name)
        if target == "date" and isinstance(src, T.StringType):
            out[name] = F.try_to_date(c, date_format) if date_format else c.try_cast("date")
        else:
            out[name] = c.try_cast(target)
    return out


def non_numeric_to_string(df: DataFrame) -> DataFrame:
    """Every non-numeric column becomes a string column."""
    return df.withColumns({c: F.col(c).cast("string") for c in non_numeric_columns(df)})


def parse_dates(df: DataFrame, token: str = "DATE", fmt: str = "MM/dd/yyyy", bad: str = "null") -> DataFrame:
    """Parse every string column whose *name contains* ``token`` as a date.

    Invalid text yields NULL (:func:`parse_failures` counts it for the audit)
    or, with ``bad='raise'``, fails the job.
    """
    cols = [f.name for f in df.schema.fields
            if token in f.name and isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: _checked(F.col(c), F.try_to_date(F.col(c), fmt), bad, c) for c in cols})


def parse_failures(raw: DataFrame, token: str = "DATE", fmt: str = "MM/dd/yyyy") -> DataFrame:
    """Per date column: non-NULL text values that did not parse (one pass)."""
    cols = [f.name for f in raw.schema.fields
            if token in f.name and isinstance(f.dataType, T.StringType)]
    aggs = [F.count_if(F.col(c).isNotNull() & F.try_to_date(F.col(c), fmt).isNull()).alias(c)
            for c in cols]
    return raw.agg(*aggs)


def schema_profile(df: DataFrame) -> DataFrame:
    """T4 (``info``): position, column name, Spark type and non-NULL count.

    One aggregation pass, then the one-row result is unpivoted.
    """
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                     F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.col(f"c{i}").alias("non_null"))
            for i, f in enumerate(fields)]
    return counts.select(F.inline(F.array(*rows)))
