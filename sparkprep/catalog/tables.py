"""Driver tables and the fixture views the checks run on.

Each fixture exists twice: as DataFrame code (what the Spark query uses) and
as DuckDB SQL (prepended to an oracle as a CTE).  Both read whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ fixtures


def fx_main(spark, sf) -> DataFrame:
    """Main table with NULLs (status, priority, price)."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), "o_custkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.when(F.col("o_totalprice") > 400000, F.lit(None).cast("double"))
        .otherwise(F.col("o_totalprice")).alias("price"),
        F.col("o_orderdate").cast("date").alias("d"))


def fx_text(spark, sf) -> DataFrame:
    """Free text with a partly missing target."""
    d = table(spark, sf, "documents").alias("d")
    lab = table(spark, sf, "labels").alias("l")
    return d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        F.col("d.doc_id").alias("id"), F.lower("d.text").alias("text"), "d.lang", "d.source",
        "d.n_chars", "l.quality", "l.toxic")


def fx_eval(spark, sf) -> DataFrame:
    """Scored binary predictions (deterministic pseudo-score)."""
    o = table(spark, sf, "orders")
    a = (F.col("o_orderkey") * 37) % 101
    b = (F.col("o_orderkey") * 11) % 40
    return o.select(F.col("o_orderkey").alias("id"), (a.cast("double") / 100).alias("p"),
                    F.when(a + b > 70, 1).otherwise(0).alias("y"),
                    F.when(a >= 50, 1).otherwise(0).alias("y_hat"))


def fx_reg(spark, sf) -> DataFrame:
    """Scored regression."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"),
                    (F.col("o_totalprice") * 0.9 + (F.col("o_orderkey") % 7) * 1000).alias("y_hat"))


def fx_rule(spark, sf) -> DataFrame:
    """Planted rule for trained models: y = [x1 > 25]."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"),
                     F.col("l_tax").alias("x3"),
                     F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("y"),
                     F.when(F.col("l_quantity") > 25, 10.0).otherwise(2.0).cast("double").alias("yr"))


def symptom_rows(spark, sf) -> DataFrame:
    """Several text rows per key with blanks: stands for the symptom table."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", "l_quantity",
        F.col("l_returnflag").alias("S1"),
        F.when(F.col("l_linestatus") == "O", F.lit("open")).alias("S2"),
        F.when(F.col("l_discount") >= 0.05, F.lit("discount")).alias("S3"),
        F.when(F.col("l_tax") >= 0.04, F.lit("tax")).alias("S4"),
        F.when(F.col("l_quantity") > 45, F.lit("bulk")).alias("S5"))


SYMPTOM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
SYMPTOM_PARTS = {"SYMP": ["S1", "S2", "S3", "S4", "S5"]}


FIXTURE_SQL = {
    "fx_main": """select o_orderkey as id, o_custkey, nullif(o_orderstatus,'P') as status,
  nullif(o_orderpriority,'5-LOW') as priority,
  case when o_totalprice > 400000 then null else o_totalprice end as price,
  cast(o_orderdate as date) as d from orders""",
    "fx_text": """select d.doc_id as id, lower(d.text) as text, d.lang, d.source, d.n_chars,
  l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id""",
    "fx_eval": """select o_orderkey as id, cast((o_orderkey*37)%101 as double)/100 as p,
  case when (o_orderkey*37)%101 + (o_orderkey*11)%40 > 70 then 1 else 0 end as y,
  case when (o_orderkey*37)%101 >= 50 then 1 else 0 end as y_hat from orders""",
    "fx_reg": """select o_orderkey as id, o_totalprice as y,
  o_totalprice*0.9 + (o_orderkey%7)*1000 as y_hat from orders""",
    "fx_rule": """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity as x1,
  l_discount as x2, l_tax as x3, case when l_quantity > 25 then 1 else 0 end as y,
  cast(case when l_quantity > 25 then 10.0 else 2.0 end as double) as yr from lineitem""",
    "symptom_rows": """select l_orderkey as key, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  l_quantity, l_returnflag as S1,
  case when l_linestatus = 'O' then 'open' end as S2,
  case when l_discount >= 0.05 then 'discount' end as S3,
  case when l_tax >= 0.04 then 'tax' end as S4,
  case when l_quantity > 45 then 'bulk' end as S5 from lineitem""",
}


def with_fixtures(sql: str, names: Sequence[str]) -> str:
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} as (\n{FIXTURE_SQL[n]}\n)" for n in names)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
