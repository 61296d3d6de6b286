"""Quality filters, imputation, features and composite target.

Every step is a narrow transformation (filters and projections), so the
whole stage is one pipelined scan with no shuffle; the optimizer collapses
the chain of projections.  Order follows the reference: lowercase -> error
rows -> error text -> drop NULL -> impute -> interval -> presence dummies ->
history flags -> symptom flags -> indicator -> composite target
[= visualization table] -> recode -> clip -> drop columns [= model table].
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sparkprep.operators import columns as C
from sparkprep.operators import rows as P


@dataclass(frozen=True)
class PreprocessConfig:
    lowercase: tuple = ()
    error_rules: dict = field(default_factory=dict)
    symptom_col: str = "SYMP"
    symptom_errors: tuple = ()
    drop_na: tuple = ()
    impute: dict = field(default_factory=dict)
    interval: dict = field(default_factory=dict)
    none_synonyms: dict = field(default_factory=dict)
    history_col: str = "HISTORY"
    history_flags: dict = field(default_factory=dict)
    symptom_flags: dict = field(default_factory=dict)
    indicator: tuple | None = None          # (source column, value, new column)
    composite: tuple = ()
    target: str = "TARGET_SERIOUS_ADVERSE"
    replace: dict = field(default_factory=dict)
    clip: dict = field(default_factory=dict)
    drop_cols: tuple = ()


def clean(df: DataFrame, cfg: PreprocessConfig) -> DataFrame:
    """The visualization table (reference ``vaers_clean``)."""
    df = C.lowercase(df, list(cfg.lowercase))
    df = P.drop_error_rows(df, cfg.error_rules)
    if cfg.symptom_errors:
        df = P.drop_matching(df, cfg.symptom_col, list(cfg.symptom_errors))
    if cfg.drop_na:
        df = P.drop_missing(df, list(cfg.drop_na))
    df = C.impute(df, cfg.impute)
    if cfg.interval:
        df = C.repaired_interval(df, cfg.interval)
    if cfg.none_synonyms:
        df = C.presence_dummy(df, cfg.none_synonyms)
    if cfg.history_flags:
        df = C.flag_many(df, cfg.history_col, cfg.history_flags)
    if cfg.symptom_flags:
        df = C.flag_many(df, cfg.symptom_col, cfg.symptom_flags)
    if cfg.indicator:
        src, value, new = cfg.indicator
        df = C.category_indicator(df, src, value, new)
    if cfg.composite:
        df = C.composite_target(df, list(cfg.composite), cfg.target)
    return df


def model_table(clean_df: DataFrame, cfg: PreprocessConfig) -> DataFrame:
    """The modelling table (reference ``vaers_model``)."""
    df = C.replace_values(clean_df, cfg.replace) if cfg.replace else clean_df
    df = C.clip_upper(df, cfg.clip) if cfg.clip else df
    return P.drop_cols(df, list(cfg.drop_cols))


def preprocess(df: DataFrame, cfg: PreprocessConfig) -> tuple[DataFrame, DataFrame]:
    """Returns (visualization table, modelling table)."""
    vis = clean(df, cfg)
    return vis, model_table(vis, cfg)


def preprocess_to_files(df: DataFrame, cfg: PreprocessConfig, clean_path: str, model_path: str,
                        fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """J4 with both stage sinks (S5): writes the visualization and modelling
    tables and returns them re-read from storage."""
    from sparkprep.sources.files import read_stage, write_stage
    vis, mod = preprocess(df, cfg)
    write_stage(vis, clean_path, fmt)
    write_stage(mod, model_path, fmt)
    spark = df.sparkSession
    schema_v = vis.schema if fmt != "parquet" else None
    schema_m = mod.schema if fmt != "parquet" else None
    return read_stage(spark, clean_path, fmt, schema_v), read_stage(spark, model_path, fmt, schema_m)


def audit_steps(cfg: PreprocessConfig) -> list:
    """P13 steps matching :func:`clean`'s drop / impute / replace order."""
    steps = [P.drop_step(c, r) for c, r in cfg.error_rules.items()]
    if cfg.symptom_errors:
        steps.append(P.drop_text_step(cfg.symptom_col, list(cfg.symptom_errors)))
    if cfg.drop_na:
        steps += [P.null_count_step(c) for c in cfg.drop_na]
        steps.append(P.drop_any_null_step(list(cfg.drop_na)))
    steps += [P.impute_step(c) for c in cfg.impute]
    steps += [P.replace_step(end, start) for end, start in cfg.interval.values()]
    return steps


def audit_preprocess(df: DataFrame, cfg: PreprocessConfig) -> DataFrame:
    """P13 for the whole cleaning stage: rows affected by each drop / impute /
    replace step of :func:`clean`, seen after the same lowercasing, in one
    aggregation pass."""
    return P.audit(C.lowercase(df, list(cfg.lowercase)), audit_steps(cfg))
