"""Projections, filters and the quality audit.

All filters are plain Catalyst predicates, so they reach the Parquet scan
(``PushedFilters``) whenever they reference source columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.exprs import any_match, bound_literal, compare, np_round, null_false

LABEL_COLUMNS = ("true_label", "predicted_label")


def keep_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P1."""
    return df.select(*cols)


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Absent names are ignored (as ``DataFrame.drop``)."""
    return df.drop(*cols)


def feature_names(df: DataFrame, target: str | None) -> list[str]:
    """Every column except the target and the two label columns."""
    skip = {target, *LABEL_COLUMNS}
    return [c for c in df.columns if c not in skip]


def features(df: DataFrame, target: str | None) -> DataFrame:
    """Feature columns only."""
    return df.select(*feature_names(df, target))


def target(df: DataFrame, target_col: str) -> DataFrame:
    """The target column only."""
    return df.select(target_col)


def filter_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Membership filter (NULL never matches)."""
    return df.where(F.col(col).isin(list(values)))


def filter_before(df: DataFrame, col: str, bound) -> DataFrame:
    """P5: exclusive upper bound; NULL values drop out."""
    return df.where(F.col(col) < bound_literal(bound))


def error_condition(rule_col: str, rule: Sequence) -> Column:
    """Two-valued ``col op bound`` for a rule ``[op, bound]`` (NULL -> False)."""
    op, bound = rule[0], rule[1]
    return null_false(compare(rule_col, op, bound))


def drop_error_rows(df: DataFrame, rules: Mapping[str, Sequence]) -> DataFrame:
    """Drop rows matching each ``{col: [op, bound]}`` rule; NULLs are kept."""
    for c, rule in rules.items():
        df = df.where(~error_condition(c, rule))
    return df


def select_error_rows(df: DataFrame, col: str, op: str, bound) -> DataFrame:
    """Rows where ``col op bound`` holds; bound is a literal or a Column."""
    return df.where(null_false(compare(col, op, bound)))


def drop_matching(df: DataFrame, col: str, patterns: Sequence[str], lower_patterns: bool = True) -> DataFrame:
    """Drop rows whose text matches any pattern; NULL text is kept.

    Patterns are lowercased first (the texts are lowercased upstream).
    """
    pats = [p.lower() for p in patterns] if lower_patterns else list(patterns)
    return df.where(~any_match(col, pats))


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P9."""
    return df.dropna(subset=list(cols))


def select_missing(df: DataFrame, col: str) -> DataFrame:
    """P10."""
    return df.where(F.col(col).isNull())


def value_counts_having(df: DataFrame, col: str, op: str, n: int) -> DataFrame:
    """Categories whose frequency satisfies ``count op n`` (NULL skipped)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return counts.where(compare("count", op, n))


def filter_samples(df: DataFrame, n: int, order_by: Sequence[str], features: Sequence[str] | None = None,
                   true_label="ALL", predicted_label="ALL") -> DataFrame:
    """Sample view: first ``n`` rows -> chosen features + labels -> label filters.

    LIMIT comes first, as in the reference; ``'ALL'`` disables a label filter.
    """
    view = df.orderBy(*order_by).limit(n)
    if features is not None:
        view = view.select(*features, *LABEL_COLUMNS)
    if true_label != "ALL":
        view = view.where(F.col("true_label") == F.lit(true_label))
    if predicted_label != "ALL":
        view = view.where(F.col("predicted_label") == F.lit(predicted_label))
    return view


@dataclass(frozen=True)
class Step:
    """One audited cleaning step: ``kind`` in {'drop', 'count', 'impute', 'replace'};
    only 'drop' removes rows for the steps after it."""
    name: str
    kind: str
    condition: Column


def drop_step(col: str, rule: Sequence) -> Step:
    return Step(f"drop {col} {rule[0]} {rule[1]}", "drop", error_condition(col, rule))


def drop_text_step(col: str, patterns: Sequence[str]) -> Step:
    return Step(f"drop {col} matching", "drop", any_match(col, [p.lower() for p in patterns]))


def drop_null_step(col: str) -> Step:
    return Step(f"drop {col} null", "drop", F.col(col).isNull())


def null_count_step(col: str) -> Step:
    """Counts NULLs without dropping (a later ``drop_any_null_step`` drops)."""
    return Step(f"null {col}", "count", F.col(col).isNull())


def drop_any_null_step(cols: Sequence[str]) -> Step:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return Step("drop rows with null " + ",".join(cols), "drop", cond)


def impute_step(col: str) -> Step:
    return Step(f"impute {col}", "impute", F.col(col).isNull())


def replace_step(col: str, ref: str) -> Step:
    return Step(f"replace {col} < {ref}", "replace", null_false(F.col(col) < F.col(ref)))


def audit(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Rows affected by each step and percent of the rows present then.

    Steps are sequential: a step sees only rows that survived earlier drops.
    Everything is one aggregation pass (partial + final), however many steps.
    """
    aggs = []
    alive: Column = F.lit(True)
    for i, s in enumerate(steps):
        aggs += [F.count_if(alive).alias(f"b{i}"), F.count_if(alive & s.condition).alias(f"a{i}")]
        if s.kind == "drop":
            alive = alive & ~s.condition
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("step_no"), F.lit(s.name).alias("step"),
                     F.col(f"a{i}").alias("rows"), F.col(f"b{i}").alias("base"))
            for i, s in enumerate(steps)]
    out = one.select(F.inline(F.array(*rows)))
    return out.withColumn(
        "pct", F.when(F.col("base") > 0, np_round(F.col("rows") * 100.0 / F.col("base"), 2)))
