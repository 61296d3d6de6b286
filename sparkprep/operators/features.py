"""Label encoding, one-hot encoding, scaling, class weights and the
scoring-time feature check.

Fitting collects only per-feature statistics (one number per feature or one
entry per category) to the driver; transforms are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.operators.order import attach_row, exact_quantiles, join_small


# ---------------------------------------------------------------- F1 / F2


def encode_label(df: DataFrame, col: str, out: str = "label") -> tuple[DataFrame, StringIndexerModel]:
    """classes sorted alphabetically -> 0, 1, ... (double), keeping the class list."""
    model = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc",
                          handleInvalid="error").fit(df)
    return model.transform(df), model


def decode_label(df: DataFrame, labels: Sequence[str], col: str = "prediction",
                 out: str = "predicted_label") -> DataFrame:
    """class index -> class name."""
    return IndexToString(inputCol=col, outputCol=out, labels=list(labels)).transform(df)


# ---------------------------------------------------------------- F3


MAX_CATEGORIES = 10_000  # categories of all encoded columns; more raise an error (fixed value)


@dataclass
class OneHotModel:
    """F3 fitted state: category values per column (sorted texts, then None if
    the column has NULLs)."""
    values: dict = field(default_factory=dict)

    def names(self, col: str) -> list[str]:
        """Output columns of ``col``.  NULL is named ``nan`` (``nan_``, ... if
        a text of that name is a category of its own)."""
        vals = self.values[col]
        null = "nan"
        while null in vals:
            null += "_"
        return [f"{col}_{null if v is None else v}" for v in vals]

    def output_columns(self) -> list[str]:
        return [n for c in self.values for n in self.names(c)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each encoded column by one 0/1 column per category; an
        unseen category, NULL included, fails the job (the reference's
        ``handle_unknown='error'``)."""
        out = df
        for c, vals in self.values.items():
            known = [v for v in vals if v is not None]
            col = F.col(c).cast("string")
            unseen = col.isNotNull() & ~col.isin(known) if None in vals else col.isNull() | ~col.isin(known)
            guard = F.when(unseen, F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), F.coalesce(col, F.lit("NULL")))))
            new = {}
            for v, name in zip(vals, self.names(c)):
                hit = col.isNull() if v is None else F.coalesce(col == F.lit(v), F.lit(False))
                new[name] = F.coalesce(guard.cast("int"), F.when(hit, 1).otherwise(0))
            out = out.withColumns(new).drop(c)
        return out


def fit_one_hot(df: DataFrame, cols: Sequence[str], most: int = MAX_CATEGORIES) -> OneHotModel:
    """F3 fit: distinct values per column, all columns in one scan.  More than
    ``most`` categories in all are an error."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])))
    seen = cells.distinct().limit(most + 1).collect()
    if len(seen) > most:
        raise ValueError(f"over {most} categories in {list(cols)}")
    vals = {c: sorted((r["v"] for r in seen if r["c"] == c), key=lambda v: (v is None, v or "")) for c in cols}
    return OneHotModel(vals)


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """fit and apply in one call."""
    return fit_one_hot(df, cols).transform(df)


# ---------------------------------------------------------------- F4 - F7


@dataclass
class ScalerModel:
    """Per-feature (center, scale): x' = (x - center) / scale."""
    kind: str
    center: dict
    scale: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(self.center[c])) / F.lit(self.scale[c])
                               for c in self.center})

    def inverse(self, df: DataFrame) -> DataFrame:
        """back to the original units (for display)."""
        return df.withColumns({c: F.col(c) * F.lit(self.scale[c]) + F.lit(self.center[c])
                               for c in self.center})


def fit_scaler(train: DataFrame, cols: Sequence[str], kind: str | None = "minmax") -> ScalerModel:
    """F4 minmax (default, as in the reference), F5 standard (population std),
    F6 robust (median, exact IQR).  A zero spread scales by 1."""
    kind = kind or "minmax"
    cols = list(cols)
    center, scale = {}, {}
    if kind in ("minmax", "standard"):
        aggs = []
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            if kind == "minmax":
                aggs += [F.min(x).alias(f"a{i}"), (F.max(x) - F.min(x)).alias(f"b{i}")]
            else:
                aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        row = train.agg(*aggs).first()
        for i, c in enumerate(cols):
            center[c] = float(row[f"a{i}"])
            s = row[f"b{i}"]
            scale[c] = float(s) if s else 1.0
    elif kind == "robust":
        long = train.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols])))
        qs = {r["column_name"]: r for r in
              exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column_name"],
                              names=["q1", "q2", "q3"]).collect()}
        for c in cols:
            center[c] = float(qs[c]["q2"])
            iqr = qs[c]["q3"] - qs[c]["q1"]
            scale[c] = float(iqr) if iqr else 1.0
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    return ScalerModel(kind, center, scale)


def scale(train: DataFrame, test: DataFrame, cols: Sequence[str], kind: str | None = "minmax"):
    """Fit on train, apply to both (returns train', test', model)."""
    m = fit_scaler(train, cols, kind)
    return m.transform(train), m.transform(test), m


# ---------------------------------------------------------------- F8 / F9


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """F8: balanced weights ``n / (k * n_c)`` joined onto every row (the
    per-class table has one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = attach_row(counts, totals).select(
        label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return join_small(df, w, [label], how="left", null_safe=True)


def check_features(df: DataFrame, expected: Sequence[str], target: str | None = None) -> None:
    """F9 guard: the scoring table must carry exactly the training features."""
    have = [c for c in df.columns if c != target]
    if sorted(have) != sorted(expected):
        missing = sorted(set(expected) - set(have))
        extra = sorted(set(have) - set(expected))
        raise ValueError(f"feature mismatch: missing {missing}, unexpected {extra}")
