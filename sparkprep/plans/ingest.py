"""Ingest three keyed tables into one merged table.

Plan shape: the symptom rows collapse to one row per key (one shuffle on the
key), the vaccine rows are filtered and reduced to the first row per key
(partial aggregation, one shuffle on the key), the main rows are date
bounded (pushed into the scan), then two inner equi-joins on the same key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sparkprep.operators.keyed import build_symptoms, first_per_key, join_on_key
from sparkprep.operators.rows import filter_before, filter_in, keep_cols
from sparkprep.operators.schema import parse_dates
from sparkprep.sources.files import MAIN_NA_TOKENS, scan_folder, write_stage


@dataclass(frozen=True)
class IngestConfig:
    key: str = "VAERS_ID"
    symptom_parts: dict = field(default_factory=lambda: {
        "SYMP": ["SYMPTOM1", "SYMPTOM2", "SYMPTOM3", "SYMPTOM4", "SYMPTOM5"]})
    symptom_order: tuple = ("_pos",)
    vax_col: str = "VAX_MANU"
    vax_values: tuple = ("MODERNA", "PFIZER\\BIONTECH")
    vax_cols: tuple = ("VAERS_ID", "VAX_MANU")
    vax_order: tuple = ("_pos",)
    date_token: str = "DATE"
    date_format: str = "MM/dd/yyyy"
    bad_dates: str = "raise"  # 'null' keeps such rows only as far as the date bound lets NULL pass
    max_date_col: str = "RECVDATE"
    max_date: str = "2021-04-01"
    compat: bool = True
    routes: dict = field(default_factory=lambda: {"main": "DATA", "symptoms": "SYMPTOMS", "vax": "VAX"})


def ingest(main: DataFrame, symptoms: DataFrame, vax: DataFrame, cfg: IngestConfig) -> DataFrame:
    """J3 on already-loaded tables (S1 - S3 excluded)."""
    symp = build_symptoms(symptoms, cfg.key, cfg.symptom_parts, list(cfg.symptom_order), compat=cfg.compat)
    v = filter_in(vax, cfg.vax_col, list(cfg.vax_values))
    v = first_per_key(keep_cols(v, [*cfg.vax_cols, *[c for c in cfg.vax_order if c not in cfg.vax_cols]]),
                      cfg.key, list(cfg.vax_order))
    v = keep_cols(v, list(cfg.vax_cols))
    m = parse_dates(main, cfg.date_token, cfg.date_format, cfg.bad_dates)
    m = filter_before(m, cfg.max_date_col, cfg.max_date)
    return join_on_key(join_on_key(m, v, cfg.key), symp, cfg.key)


def ingest_folder(spark: SparkSession, folder: str, cfg: IngestConfig, out: str | None = None,
                  schemas: dict | None = None) -> DataFrame:
    """J3 end to end: S1 folder scan -> ingest -> S5 sink (Parquet)."""
    opts = {"main": {"na_tokens": MAIN_NA_TOKENS, "encoding": "ISO-8859-1"},
            "vax": {"encoding": "ISO-8859-1"}, "symptoms": {}}
    # the default configuration orders symptom and vaccine rows by file order
    for table, order in (("symptoms", cfg.symptom_order), ("vax", cfg.vax_order)):
        if "_pos" in order:
            opts[table]["position_col"] = "_pos"
    t = scan_folder(spark, folder, cfg.routes, schemas=schemas, options=opts)
    merged = ingest(t["main"], t["symptoms"], t["vax"], cfg)
    if out:
        write_stage(merged, out)
        return spark.read.parquet(out)
    return merged
