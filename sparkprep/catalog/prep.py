"""Checks for S (sources / sinks), T (types), P (rows), C (columns), J (joins
and pipelines), over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from sparkprep.catalog.registry import register
from sparkprep.catalog.tables import (SYMPTOM_ORDER, SYMPTOM_PARTS, fx_eval, fx_main, fx_reg, fx_text,
                                      symptom_rows, table)
from sparkprep.operators import columns as C
from sparkprep.operators import keyed as K
from sparkprep.operators import rows as P
from sparkprep.operators import schema as S
from sparkprep.operators.evaluate import classification_report, classification_scores, confusion_matrix
from sparkprep.plans.ingest import IngestConfig, ingest
from sparkprep.plans.model import write_reports
from sparkprep.plans.preprocess import PreprocessConfig, audit_steps, clean, model_table
from sparkprep.session import shared_path
from sparkprep.sources.files import read_csv, read_stage, scan_folder, write_stage

# --------------------------------------------------------------- S1 - S6

MAIN_SCHEMA = Ty.StructType([
    Ty.StructField("id", Ty.LongType()), Ty.StructField("status", Ty.StringType()),
    Ty.StructField("priority", Ty.StringType()), Ty.StructField("note", Ty.StringType())])


@register("scan_folder", """
select 'main' as tbl, o_orderkey as k, o_orderstatus as v from orders
union all select 'lines', l_orderkey, l_returnflag from lineitem
""")
def q_scan_folder(spark, sf):
    folder = shared_path(spark, "scan")
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    write_stage(o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")),
                f"{folder}/orders_DATA.csv", "csv")
    write_stage(li.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("v")),
                f"{folder}/lines_SYMPTOMS.csv", "csv")
    write_stage(li.select(F.col("l_partkey").alias("k"), F.col("l_linestatus").alias("v")),
                f"{folder}/unrelated_notes.csv", "csv")
    sch = Ty.StructType([Ty.StructField("k", Ty.LongType()), Ty.StructField("v", Ty.StringType())])
    t = scan_folder(spark, folder, {"main": "DATA", "lines": "SYMPTOMS"}, schemas={"main": sch, "lines": sch})
    return (t["main"].select(F.lit("main").alias("tbl"), "k", "v")
            .unionByName(t["lines"].select(F.lit("lines").alias("tbl"), "k", "v")))


@register("csv_scan_na", """
select o_orderkey as id, nullif(o_orderstatus, 'P') as status, nullif(o_orderpriority, '5-LOW') as priority,
  o_orderpriority || chr(10) || 'café, "' || o_orderstatus || '"' as note from orders
""")
def q_csv_scan_na(spark, sf):
    path = shared_path(spark, "csvna")
    o = table(spark, sf, "orders")
    raw = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("-")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.concat(F.col("o_orderpriority"), F.lit("\ncafé, \""), F.col("o_orderstatus"), F.lit("\"")).alias("note"))
    write_stage(raw, path, "csv", encoding="ISO-8859-1")
    return read_csv(spark, path, schema=MAIN_SCHEMA, na_tokens=("n/a", "na", "-", "<NA>", "Na", "None", "none"),
                    encoding="ISO-8859-1", multiline=True)


@register("csv_scan", """
select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag from lineitem
""")
def q_csv_scan(spark, sf):
    path = shared_path(spark, "csv")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                             "l_returnflag")
    write_stage(li, path, "csv")
    return read_csv(spark, path, schema=li.schema)


@register("stage_roundtrip", "select * from fx_main", ["fx_main"])
def q_stage_roundtrip(spark, sf):
    path = shared_path(spark, "stage")
    write_stage(fx_main(spark, sf), path)
    return read_stage(spark, path)


@register("csv_sink", "select * from fx_main", ["fx_main"])
def q_csv_sink(spark, sf):
    path = shared_path(spark, "sink")
    df = fx_main(spark, sf)
    write_stage(df, path, "csv")
    return read_csv(spark, path, schema=df.schema)


REPORT_SQL = """
with pc as (
  select cls, sum(t) as support, sum(pr) as predicted, sum(hit) as tp from (
    select y as cls, 1 as t, 0 as pr, case when y = y_hat then 1 else 0 end as hit from fx_eval
    union all select y_hat, 0, 1, 0 from fx_eval) group by cls),
m as (select cls, support, case when predicted <> 0 then tp / predicted else 0.0 end as precision,
       case when support <> 0 then tp / support else 0.0 end as recall from pc),
f as (select *, case when precision + recall <> 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from m),
r as (
  select cast(cls as varchar) as class, precision, recall, f1 as f1_score, cast(support as bigint) as support from f
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from f
  union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
     sum(f1 * support) / sum(support), cast(sum(support) as bigint) from f)
select class, round_even(precision, 2) as precision, round_even(recall, 2) as recall,
  round_even(f1_score, 2) as f1_score, support from r
"""


@register("report_sink", REPORT_SQL, ["fx_eval"])
def q_report_sink(spark, sf):
    folder = shared_path(spark, "reports")
    ev = fx_eval(spark, sf)
    results = {"scores": classification_scores(ev, "pseudo"), "classification_report": classification_report(ev),
               "confusion_matrix": confusion_matrix(ev), "roc_curve": None}
    paths = write_reports(results, folder, "pseudo")
    rep = [p for p in paths if "classification_report" in p][0]
    sch = Ty.StructType([Ty.StructField("class", Ty.StringType()), Ty.StructField("precision", Ty.DoubleType()),
                         Ty.StructField("recall", Ty.DoubleType()), Ty.StructField("f1_score", Ty.DoubleType()),
                         Ty.StructField("support", Ty.LongType())])
    return read_csv(spark, rep, schema=sch)


# --------------------------------------------------------------- T1 - T4


@register("apply_types", """
select id, cast(o_custkey as double) as o_custkey, status, priority, price, d from fx_main
""", ["fx_main"])
def q_apply_types(spark, sf):
    m = fx_main(spark, sf)
    as_text = m.select(*[F.col(c).cast("string").alias(c) for c in m.columns])
    typed = S.apply_types(as_text, {"id": "int64", "o_custkey": "float64", "status": "category",
                                    "priority": "string", "price": "float64", "d": "datetime64"})
    return typed


@register("to_string_cols", """
select id, o_custkey, status, priority, price, cast(d as varchar) as d from fx_main
""", ["fx_main"])
def q_to_string_cols(spark, sf):
    return S.non_numeric_to_string(fx_main(spark, sf))


@register("parse_dates", """
select o_orderkey as id, try_strptime(case when o_orderpriority = '5-LOW' then 'not a date'
  else strftime(o_orderdate, '%m/%d/%Y') end, '%m/%d/%Y')::date as ORDER_DATE,
  strftime(o_orderdate, '%m/%d/%Y') as note from orders
""")
def q_parse_dates(spark, sf):
    o = table(spark, sf, "orders")
    txt = F.date_format("o_orderdate", "MM/dd/yyyy")
    raw = o.select(F.col("o_orderkey").alias("id"),
                   F.when(F.col("o_orderpriority") == "5-LOW", F.lit("not a date")).otherwise(txt).alias("ORDER_DATE"),
                   txt.alias("note"))
    return S.parse_dates(raw, "DATE", "MM/dd/yyyy")


@register("parse_failures", """
select count(*) filter (o_orderpriority = '5-LOW') as ORDER_DATE from orders
""")
def q_parse_failures(spark, sf):
    o = table(spark, sf, "orders")
    txt = F.date_format("o_orderdate", "MM/dd/yyyy")
    return S.parse_failures(o.select(F.when(F.col("o_orderpriority") == "5-LOW", F.lit("not a date")).otherwise(txt).alias("ORDER_DATE"),
                                     txt.alias("note")))


@register("cast_failures", """
select count(*) filter (o_orderstatus is not null) as o_orderstatus, 0 as o_custkey,
  count(*) filter (try_cast(substr(o_orderpriority, 1, 1) || case when o_orderkey % 7 = 0 then 'x' else '' end as integer) is null)
    as code from orders
""")
def q_cast_failures(spark, sf):
    o = table(spark, sf, "orders")
    code = F.concat(F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""))
    return S.cast_failures(o.select("o_orderstatus", "o_custkey", code.alias("code")),
                           {"o_orderstatus": "int", "o_custkey": "double", "code": "int"})


@register("schema_profile", """
select 0 as position, 'id' as column_name, 'bigint' as data_type, count(id) as non_null from fx_main
union all select 1, 'o_custkey', 'bigint', count(o_custkey) from fx_main
union all select 2, 'status', 'string', count(status) from fx_main
union all select 3, 'priority', 'string', count(priority) from fx_main
union all select 4, 'price', 'double', count(price) from fx_main
union all select 5, 'd', 'date', count(d) from fx_main
""", ["fx_main"])
def q_schema_profile(spark, sf):
    return S.schema_profile(fx_main(spark, sf))


# --------------------------------------------------------------- P1 - P13


@register("keep_cols", "select l_orderkey, l_partkey, l_quantity from lineitem")
def q_keep_cols(spark, sf):
    return P.keep_cols(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity"])


@register("drop_cols", "select id, status, priority, price from fx_main", ["fx_main"])
def q_drop_cols(spark, sf):
    return P.drop_cols(fx_main(spark, sf), ["o_custkey", "d", "not_there"])


@register("feature_target_split", """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, x1, x2, x3 from fx_rule
""", ["fx_rule"])
def q_feature_target_split(spark, sf):
    from sparkprep.catalog.tables import fx_rule
    return P.features(fx_rule(spark, sf).drop("yr"), "y")


@register("filter_isin", """
select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag in ('A', 'N')
""")
def q_filter_isin(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return P.filter_in(li, "l_returnflag", ["A", "N"])


@register("filter_before", "select * from fx_main where d < date '1997-01-01'", ["fx_main"])
def q_filter_before(spark, sf):
    return P.filter_before(fx_main(spark, sf), "d", "1997-01-01")


@register("drop_error_rows", """
select * from fx_main where not coalesce(price < 100000, false) and not coalesce(d < date '1995-03-01', false)
""", ["fx_main"])
def q_drop_error_rows(spark, sf):
    return P.drop_error_rows(fx_main(spark, sf), {"price": ["<", 100000], "d": ["<", "1995-03-01"]})


@register("select_error_rows", """
select l_orderkey, l_linenumber, l_tax, l_discount from lineitem where l_tax > l_discount
""")
def q_select_error_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return P.select_error_rows(li, "l_tax", ">", F.col("l_discount"))


TEXT_ERRORS = ["license", "@", "und die"]


@register("drop_matching_text", """
select id, lang, n_chars from fx_text where not coalesce(regexp_matches(text, 'license|@|und die'), false)
""", ["fx_text"])
def q_drop_matching_text(spark, sf):
    return P.drop_matching(fx_text(spark, sf), "text", TEXT_ERRORS).select("id", "lang", "n_chars")


@register("drop_matching_nulls", """
select id, o_custkey, status, lower(priority) as priority, price, d from fx_main
where not coalesce(regexp_matches(lower(priority), 'urgent|^4-'), false)
""", ["fx_main"])
def q_drop_matching_nulls(spark, sf):
    low = C.lowercase(fx_main(spark, sf), ["priority"])
    return P.drop_matching(low, "priority", ["URGENT", "^4-"])


@register("drop_missing", "select * from fx_main where status is not null and price is not null", ["fx_main"])
def q_drop_missing(spark, sf):
    return P.drop_missing(fx_main(spark, sf), ["status", "price"])


@register("select_missing", "select * from fx_main where priority is null", ["fx_main"])
def q_select_missing(spark, sf):
    return P.select_missing(fx_main(spark, sf), "priority")


@register("value_counts_having", """
select o_custkey, count(*) as count from orders group by o_custkey having count(*) > 14
""")
def q_value_counts_having(spark, sf):
    return P.value_counts_having(table(spark, sf, "orders"), "o_custkey", ">", 14)


@register("filter_samples", """
select p, true_label, predicted_label from (
  select id, p, y as true_label, y_hat as predicted_label from fx_eval order by id limit 500)
where true_label = 1 and predicted_label = 0
""", ["fx_eval"])
def q_filter_samples(spark, sf):
    ev = fx_eval(spark, sf).select("id", "p", F.col("y").alias("true_label"), F.col("y_hat").alias("predicted_label"))
    return P.filter_samples(ev, 500, ["id"], features=["p"], true_label=1, predicted_label=0)


AUDIT_CFG = PreprocessConfig(
    error_rules={"price": ["<", 100000], "d": ["<", "1995-03-01"]},
    drop_na=("status", "priority"),
    impute={"o_custkey": 0},
)

AUDIT_SQL = """
with a as (select
  not coalesce(price < 100000, false) as k1,
  not coalesce(d < date '1995-03-01', false) as k2, * from fx_main),
s as (select
  count(*) as b0, count(*) filter (where coalesce(price < 100000, false)) as a0,
  count(*) filter (where k1) as b1, count(*) filter (where k1 and coalesce(d < date '1995-03-01', false)) as a1,
  count(*) filter (where k1 and k2) as b2, count(*) filter (where k1 and k2 and status is null) as a2,
  count(*) filter (where k1 and k2 and priority is null) as a3,
  count(*) filter (where k1 and k2 and (status is null or priority is null)) as a4,
  count(*) filter (where k1 and k2 and status is not null and priority is not null) as b5,
  count(*) filter (where k1 and k2 and status is not null and priority is not null and o_custkey is null) as a5
  from a),
r as (
  select 0 as step_no, 'drop price < 100000' as step, a0 as rows, b0 as base from s
  union all select 1, 'drop d < 1995-03-01', a1, b1 from s
  union all select 2, 'null status', a2, b2 from s
  union all select 3, 'null priority', a3, b2 from s
  union all select 4, 'drop rows with null status,priority', a4, b2 from s
  union all select 5, 'impute o_custkey', a5, b5 from s)
select *, case when base > 0 then round_even(rows * 100.0 / base, 2) end as pct from r
"""


@register("quality_audit", AUDIT_SQL, ["fx_main"])
def q_quality_audit(spark, sf):
    return P.audit(fx_main(spark, sf), audit_steps(AUDIT_CFG))


# --------------------------------------------------------------- C1 - C20


@register("na_as_blank", """
select id, o_custkey, coalesce(status, '') as status, coalesce(priority, '') as priority, price, d from fx_main
""", ["fx_main"])
def q_na_as_blank(spark, sf):
    return C.na_as_blank(fx_main(spark, sf))


@register("impute_constant", """
select id, o_custkey, coalesce(status, 'N') as status, coalesce(priority, 'unknown') as priority, price, d
from fx_main
""", ["fx_main"])
def q_impute_constant(spark, sf):
    return C.impute(fx_main(spark, sf), {"status": "N", "priority": "unknown"})


@register("lowercase_text", "select p_partkey, lower(p_name) as p_name, lower(p_type) as p_type from part")
def q_lowercase_text(spark, sf):
    return C.lowercase(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"])


CONCAT_SQL = "concat_ws(',', coalesce(S1,''), coalesce(S2,''), coalesce(S3,''), coalesce(S4,''), coalesce(S5,''))"


@register("concat_cols", f"""
select key, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {CONCAT_SQL} as SYMP from symptom_rows
""", ["symptom_rows"])
def q_concat_cols(spark, sf):
    r = C.concat_cols(symptom_rows(spark, sf), SYMPTOM_PARTS)
    return r.select("key", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "SYMP")


@register("regex_remove", f"""
select key, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  regexp_replace({CONCAT_SQL}, ',,+', '', 'g') as SYMP from symptom_rows
""", ["symptom_rows"])
def q_regex_remove(spark, sf):
    r = C.regex_remove(C.concat_cols(symptom_rows(spark, sf), SYMPTOM_PARTS), "SYMP", ",,+")
    return r.select("key", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "SYMP")


@register("count_elements", f"""
select key, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  cast(len(string_split(regexp_replace({CONCAT_SQL}, ',,+', '', 'g'), ',')) as integer) as COUNT_SYMPT
from symptom_rows
""", ["symptom_rows"])
def q_count_elements(spark, sf):
    r = C.regex_remove(C.concat_cols(symptom_rows(spark, sf), SYMPTOM_PARTS), "SYMP", ",,+")
    r = C.count_elements(r, "SYMP", "COUNT_SYMPT")
    return r.select("key", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "COUNT_SYMPT")


@register("flag_matches", """
select id, cast(coalesce(regexp_matches(text, 'license|@'), false) as integer) as FLAG from fx_text
""", ["fx_text"])
def q_flag_matches(spark, sf):
    return C.flag_matches(fx_text(spark, sf), "text", ["license", "@"], "FLAG").select("id", "FLAG")


HISTORY_FLAGS = {
    "F_LICENSE": ["license", "licence"],
    "F_EMAIL": ["@"],
    "F_GERMAN": ["und ", " der "],
    "F_START_THE": ["^the ", "^is "],
    "F_EAU": ["eau", "^e"],
}


@register("flag_history", """
select id,
  cast(coalesce(regexp_matches(text, 'license|licence'), false) as integer) as F_LICENSE,
  cast(coalesce(regexp_matches(text, '@'), false) as integer) as F_EMAIL,
  cast(coalesce(regexp_matches(text, 'und | der '), false) as integer) as F_GERMAN,
  cast(coalesce(regexp_matches(text, '^the |^is '), false) as integer) as F_START_THE,
  cast(coalesce(regexp_matches(text, 'eau|^e'), false) as integer) as F_EAU
from fx_text
""", ["fx_text"])
def q_flag_history(spark, sf):
    return C.flag_many(fx_text(spark, sf), "text", HISTORY_FLAGS).select("id", *HISTORY_FLAGS)


SYMP_TABLE_SQL = f"""
symp as (
  select key, string_agg(s, ',' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, s) as SYMP
  from (select *, regexp_replace({CONCAT_SQL}, ',,+', '', 'g') as s from symptom_rows) group by key),
symp2 as (select key, SYMP, cast(len(string_split(SYMP, ',')) as integer) as COUNT_SYMPT from symp)"""

SYMPTOM_FLAGS = {"S_RETURN": ["^r", ",r"], "S_OPEN": ["open"], "S_BULK": ["bulk"]}


@register("flag_symptoms", f"""
with {SYMP_TABLE_SQL}
select key,
  cast(coalesce(regexp_matches(lower(SYMP), '^r|,r'), false) as integer) as S_RETURN,
  cast(coalesce(regexp_matches(lower(SYMP), 'open'), false) as integer) as S_OPEN,
  cast(coalesce(regexp_matches(lower(SYMP), 'bulk'), false) as integer) as S_BULK
from symp2
""", ["symptom_rows"])
def q_flag_symptoms(spark, sf):
    t = K.build_symptoms(symptom_rows(spark, sf), "key", SYMPTOM_PARTS, SYMPTOM_ORDER)
    t = C.lowercase(t, ["SYMP"])
    return C.flag_many(t, "SYMP", SYMPTOM_FLAGS).select("key", *SYMPTOM_FLAGS)


SYNONYMS = {"priority": ["4-NOT SPECIFIED", "3-MEDIUM"]}


@register("null_synonyms", """
select id, case when coalesce(priority in ('4-NOT SPECIFIED', '3-MEDIUM'), false) then null else priority end
  as priority from fx_main
""", ["fx_main"])
def q_null_synonyms(spark, sf):
    return C.null_if_in(fx_main(spark, sf), SYNONYMS).select("id", "priority")


@register("presence_dummy", """
select id, p as priority, case when p is null then 0 else 1 end as priority_DUM from (
  select id, case when coalesce(priority in ('4-NOT SPECIFIED', '3-MEDIUM'), false) then null else priority end
    as p from fx_main)
""", ["fx_main"])
def q_presence_dummy(spark, sf):
    return C.presence_dummy(fx_main(spark, sf), SYNONYMS).select("id", "priority", "priority_DUM")


@register("category_indicator", """
select id, case when status is null then null when status = 'F' then 1 else 0 end as STATUS_F from fx_main
""", ["fx_main"])
def q_category_indicator(spark, sf):
    return C.category_indicator(fx_main(spark, sf), "status", "F", "STATUS_F").select("id", "STATUS_F")


@register("recode_keep", """
select id, case when status = 'F' then 1 when status = 'O' then 0 else try_cast(status as integer) end as status,
  case when priority = '1-URGENT' then 'urgent' when priority = '2-HIGH' then 'high' else priority end as priority
from fx_main
""", ["fx_main"])
def q_recode_keep(spark, sf):
    r = C.replace_values(fx_main(spark, sf), {"status": {"F": 1, "O": 0},
                                             "priority": {"1-URGENT": "urgent", "2-HIGH": "high"}})
    return r.select("id", "status", "priority")


@register("recode_null", """
select id, case when quality = 0 then 'No' when quality = 1 then 'Yes' end as quality,
  case when toxic = 0 then 'No' when toxic = 1 then 'Yes' end as toxic from fx_text
""", ["fx_text"])
def q_recode_null(spark, sf):
    return C.map_labels(fx_text(spark, sf), ["quality", "toxic"], {0: "No", 1: "Yes"}).select("id", "quality", "toxic")


@register("composite_target", """
select id, a, b, c, composite, case when coalesce(composite = 0, false) then 'No' else 'Yes' end as TARGET from (
  select id, case when a = 'Y' then 1 when a = 'N' then 0 end as a, b, c,
    (case when a = 'Y' then 1 when a = 'N' then 0 end) + b + c as composite from (
    select id, case when status = 'F' then 'Y' when status = 'O' then 'N' end as a,
      cast(price > 300000 as integer) as b, case when o_custkey % 5 = 0 then 1 else 0 end as c from fx_main))
""", ["fx_main"])
def q_composite_target(spark, sf):
    m = fx_main(spark, sf).select(
        "id", F.when(F.col("status") == "F", "Y").when(F.col("status") == "O", "N").alias("a"),
        (F.col("price") > 300000).cast("int").alias("b"),
        F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0).alias("c"))
    return C.composite_target(m, ["a", "b", "c"], "TARGET").select("id", "a", "b", "c", "composite", "TARGET")


@register("clip_upper", """
select id, case when price > 300000 then 300000.0 else price end as price from fx_main
""", ["fx_main"])
def q_clip_upper(spark, sf):
    return C.clip_upper(fx_main(spark, sf), {"price": 300000}).select("id", "price")


ORDER_LINES_SQL = """
ol as (select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, cast(l.l_shipdate as date) as ship_d,
  cast(o.o_orderdate as date) as order_d from lineitem l join orders o on l.l_orderkey = o.o_orderkey)"""


def _order_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_shipdate").cast("date").alias("ship_d"), F.col("o_orderdate").cast("date").alias("order_d"))


@register("replace_less_than", f"""
with {ORDER_LINES_SQL}
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when ship_d < order_d then order_d else ship_d end as ship_d, order_d from ol
""")
def q_replace_less_than(spark, sf):
    return C.replace_less_than(_order_lines(spark, sf), "ship_d", "order_d", "order_d")


@register("date_diff_days", f"""
with {ORDER_LINES_SQL}
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(datediff('day', order_d, ship_d) as integer) as days
from ol
""")
def q_date_diff_days(spark, sf):
    r = C.date_diff(_order_lines(spark, sf), {"days": ["ship_d", "order_d"]})
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "days")


@register("repaired_interval", f"""
with {ORDER_LINES_SQL}
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  cast(datediff('day', order_d, case when ship_d < order_d then order_d else ship_d end) as integer) as days
from ol
""")
def q_repaired_interval(spark, sf):
    r = C.repaired_interval(_order_lines(spark, sf), {"days": ["ship_d", "order_d"]})
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "days")


@register("round_table", """
select id, round_even(y / 7, 2) as y, round_even(y_hat / 7, 2) as y_hat from fx_reg
""", ["fx_reg"])
def q_round_table(spark, sf):
    r = fx_reg(spark, sf)
    return C.round_table(r.select("id", (F.col("y") / 7).alias("y"), (F.col("y_hat") / 7).alias("y_hat")), 2)


# --------------------------------------------------------------- A1 / A2 / J1 - J4


@register("collapse_strings", """
select l_orderkey, string_agg(l_returnflag, ',' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  l_returnflag) as flags from lineitem group by l_orderkey
""")
def q_collapse_strings(spark, sf):
    li = table(spark, sf, "lineitem")
    return K.collapse_strings(li, "l_orderkey", "l_returnflag",
                              ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"],
                              new="flags")


@register("symptom_table", f"with {SYMP_TABLE_SQL} select * from symp2", ["symptom_rows"])
def q_symptom_table(spark, sf):
    return K.build_symptoms(symptom_rows(spark, sf), "key", SYMPTOM_PARTS, SYMPTOM_ORDER)


@register("symptom_table_plain", """
select key, SYMP, cast(len(string_split(SYMP, ',')) as integer) as COUNT_SYMPT from (
  select key, string_agg(s, ',' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, s) as SYMP
  from (select *, concat_ws(',', S1, S2, S3, S4, S5) as s from symptom_rows) group by key)
""", ["symptom_rows"])
def q_symptom_table_plain(spark, sf):
    return K.build_symptoms(symptom_rows(spark, sf), "key", SYMPTOM_PARTS, SYMPTOM_ORDER, compat=False)


def main_rows(spark, sf):
    """Main table: one row per key, text dates, Y/blank flags."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("key"), "o_custkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.when(F.col("o_totalprice") > 400000, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("price"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("ORDER_DATE"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Y")).alias("urgent"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("Y")).alias("high"))


VAX_ORDER = SYMPTOM_ORDER + ["MANU", "SHIP_DATE"]


def vax_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("MANU"),
                     F.col("l_shipdate").cast("date").alias("SHIP_DATE"), *SYMPTOM_ORDER)


INGEST_CFG = IngestConfig(key="key", symptom_parts=SYMPTOM_PARTS, symptom_order=tuple(SYMPTOM_ORDER),
                          vax_col="MANU", vax_values=("A", "N"), vax_cols=("key", "MANU", "SHIP_DATE"),
                          vax_order=tuple(VAX_ORDER), date_token="DATE", date_format="MM/dd/yyyy",
                          max_date_col="ORDER_DATE", max_date="2000-01-01")

MAIN_SQL = """
main as (select o_orderkey as key, o_custkey, nullif(o_orderstatus,'P') as status,
  nullif(o_orderpriority,'5-LOW') as priority,
  case when o_totalprice > 400000 then null else o_totalprice end as price,
  cast(o_orderdate as date) as ORDER_DATE,
  case when o_orderpriority = '1-URGENT' then 'Y' end as urgent,
  case when o_orderpriority = '2-HIGH' then 'Y' end as high
  from orders where cast(o_orderdate as date) < date '2000-01-01')"""

VAX_SQL = """
vax as (select key, MANU, SHIP_DATE from (
  select l_orderkey as key, l_returnflag as MANU, cast(l_shipdate as date) as SHIP_DATE,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      l_quantity, l_returnflag, l_shipdate) as rn
  from lineitem where l_returnflag in ('A', 'N')) where rn = 1)"""


@register("first_per_key", f"with {VAX_SQL} select * from vax")
def q_first_per_key(spark, sf):
    v = P.filter_in(vax_rows(spark, sf), "MANU", ["A", "N"])
    return K.first_per_key(v, "key", VAX_ORDER).select("key", "MANU", "SHIP_DATE")


@register("join_inner", f"with {MAIN_SQL}, {VAX_SQL} select * from main join vax using (key)")
def q_join_inner(spark, sf):
    m = P.filter_before(S.parse_dates(main_rows(spark, sf), "DATE", "MM/dd/yyyy"), "ORDER_DATE", "2000-01-01")
    v = K.first_per_key(P.filter_in(vax_rows(spark, sf), "MANU", ["A", "N"]), "key", VAX_ORDER)
    return K.join_on_key(m, v.select("key", "MANU", "SHIP_DATE"), "key")


MERGED_SQL = f"""{MAIN_SQL}, {VAX_SQL}, {SYMP_TABLE_SQL},
merged as (select * from main join vax using (key) join symp2 using (key))"""


@register("join_three_way", f"with {MERGED_SQL} select * from merged", ["symptom_rows"])
def q_join_three_way(spark, sf):
    m = P.filter_before(S.parse_dates(main_rows(spark, sf), "DATE", "MM/dd/yyyy"), "ORDER_DATE", "2000-01-01")
    v = K.first_per_key(P.filter_in(vax_rows(spark, sf), "MANU", ["A", "N"]), "key", VAX_ORDER)
    s = K.build_symptoms(symptom_rows(spark, sf), "key", SYMPTOM_PARTS, SYMPTOM_ORDER)
    return K.join_on_key(K.join_on_key(m, v.select("key", "MANU", "SHIP_DATE"), "key"), s, "key")


def merged(spark, sf):
    return ingest(main_rows(spark, sf), symptom_rows(spark, sf), vax_rows(spark, sf), INGEST_CFG)


@register("ingest_pipeline", f"with {MERGED_SQL} select * from merged", ["symptom_rows"])
def q_ingest_pipeline(spark, sf):
    return merged(spark, sf)


MAIN_CSV_SCHEMA = Ty.StructType([
    Ty.StructField("key", Ty.LongType()), Ty.StructField("o_custkey", Ty.LongType()),
    Ty.StructField("status", Ty.StringType()), Ty.StructField("priority", Ty.StringType()),
    Ty.StructField("price", Ty.DoubleType()), Ty.StructField("ORDER_DATE", Ty.StringType()),
    Ty.StructField("urgent", Ty.StringType()), Ty.StructField("high", Ty.StringType())])


@register("ingest_folder", f"with {MERGED_SQL} select * from merged", ["symptom_rows"])
def q_ingest_folder(spark, sf):
    """J3 as run from files: three CSV inputs in one folder, routed by name
    token, main table with extra NA tokens, Latin-1 main and vaccine files,
    ingest, Parquet sink, re-read."""
    from sparkprep.plans.ingest import ingest_folder
    folder = shared_path(spark, "ingest")
    main = main_rows(spark, sf).withColumn(
        "priority", F.coalesce(F.col("priority"), F.lit("-"))).withColumn(
        "status", F.coalesce(F.col("status"), F.lit("n/a")))
    write_stage(main, f"{folder}/orders_DATA.csv", "csv", encoding="ISO-8859-1")
    write_stage(symptom_rows(spark, sf), f"{folder}/lines_SYMPTOMS.csv", "csv")
    write_stage(vax_rows(spark, sf), f"{folder}/lines_VAX.csv", "csv", encoding="ISO-8859-1")
    schemas = {"main": MAIN_CSV_SCHEMA, "symptoms": symptom_rows(spark, sf).schema, "vax": vax_rows(spark, sf).schema}
    return ingest_folder(spark, folder, INGEST_CFG, out=shared_path(spark, "merged"), schemas=schemas)


PREP_CFG = PreprocessConfig(
    lowercase=("SYMP", "priority"),
    error_rules={"price": ["<", 5000], "ORDER_DATE": ["<", "1995-02-01"]},
    symptom_col="SYMP",
    symptom_errors=("discount,tax,bulk",),
    drop_na=("price",),
    impute={"urgent": "N", "high": "N", "status": "N"},
    interval={"NUMDAYS_CAL": ["SHIP_DATE", "ORDER_DATE"]},
    none_synonyms={"priority": ["4-not specified", "3-medium"]},
    history_col="priority",
    history_flags={"P_URGENT": ["urgent"], "P_HIGH": ["^2-", "high$"]},
    symptom_flags=SYMPTOM_FLAGS,
    indicator=("priority", "1-urgent", "URGENT_IND"),
    composite=("urgent", "high", "S_OPEN", "S_BULK"),
    target="TARGET",
    replace={"MANU": {"A": 1, "N": 0}, "status": {"F": 1, "O": 0, "N": 0}},
    clip={"NUMDAYS_CAL": 10, "COUNT_SYMPT": 20},
    drop_cols=("SYMP", "priority", "ORDER_DATE", "SHIP_DATE", "urgent", "high", "S_OPEN", "S_BULK",
               "composite", "o_custkey"),
)

CLEAN_SQL = f"""{MERGED_SQL},
c1 as (select * replace (lower(SYMP) as SYMP, lower(priority) as priority) from merged),
c2 as (select * from c1 where not coalesce(price < 5000, false)
  and not coalesce(ORDER_DATE < date '1995-02-01', false)
  and not coalesce(regexp_matches(SYMP, 'discount,tax,bulk'), false) and price is not null),
c3 as (select * replace (coalesce(urgent, 'N') as urgent, coalesce(high, 'N') as high,
  coalesce(status, 'N') as status,
  case when coalesce(SHIP_DATE < ORDER_DATE, false) then ORDER_DATE else SHIP_DATE end as SHIP_DATE) from c2),
c4 as (select *, cast(datediff('day', ORDER_DATE, SHIP_DATE) as integer) as NUMDAYS_CAL from c3),
c5 as (select * replace (case when coalesce(priority in ('4-not specified', '3-medium'), false) then null
  else priority end as priority) from c4),
c6 as (select *, case when priority is null then 0 else 1 end as priority_DUM,
  cast(coalesce(regexp_matches(priority, 'urgent'), false) as integer) as P_URGENT,
  cast(coalesce(regexp_matches(priority, '^2-|high$'), false) as integer) as P_HIGH,
  cast(coalesce(regexp_matches(SYMP, '^r|,r'), false) as integer) as S_RETURN,
  cast(coalesce(regexp_matches(SYMP, 'open'), false) as integer) as S_OPEN,
  cast(coalesce(regexp_matches(SYMP, 'bulk'), false) as integer) as S_BULK,
  case when priority is null then null when priority = '1-urgent' then 1 else 0 end as URGENT_IND from c5),
c7 as (select * replace (case when urgent = 'Y' then 1 when urgent = 'N' then 0 end as urgent,
  case when high = 'Y' then 1 when high = 'N' then 0 end as high), (case when urgent = 'Y' then 1 when urgent = 'N' then 0 end)
  + (case when high = 'Y' then 1 when high = 'N' then 0 end) + S_OPEN + S_BULK as composite from c6),
clean as (select *, case when coalesce(composite = 0, false) then 'No' else 'Yes' end as TARGET from c7)"""


def clean_table(spark, sf):
    return clean(merged(spark, sf), PREP_CFG)


@register("preprocess_clean", f"with {CLEAN_SQL} select * from clean", ["symptom_rows"])
def q_preprocess_clean(spark, sf):
    return clean_table(spark, sf)


@register("preprocess_pipeline", f"""with {CLEAN_SQL}
select key, case when status = 'F' then 1 when status = 'O' then 0 when status = 'N' then 0
    else try_cast(status as integer) end as status,
  price, case when MANU = 'A' then 1 when MANU = 'N' then 0 else try_cast(MANU as integer) end as MANU,
  case when COUNT_SYMPT > 20 then 20 else COUNT_SYMPT end as COUNT_SYMPT,
  case when NUMDAYS_CAL > 10 then 10 else NUMDAYS_CAL end as NUMDAYS_CAL,
  priority_DUM, P_URGENT, P_HIGH, S_RETURN, URGENT_IND, TARGET from clean
""", ["symptom_rows"])
def q_preprocess_pipeline(spark, sf):
    return model_table(clean_table(spark, sf), PREP_CFG)


@register("preprocess_written", f"""with {CLEAN_SQL}
select key, case when status = 'F' then 1 when status = 'O' then 0 when status = 'N' then 0
    else try_cast(status as integer) end as status,
  price, case when MANU = 'A' then 1 when MANU = 'N' then 0 else try_cast(MANU as integer) end as MANU,
  case when COUNT_SYMPT > 20 then 20 else COUNT_SYMPT end as COUNT_SYMPT,
  case when NUMDAYS_CAL > 10 then 10 else NUMDAYS_CAL end as NUMDAYS_CAL,
  priority_DUM, P_URGENT, P_HIGH, S_RETURN, URGENT_IND, TARGET from clean
""", ["symptom_rows"])
def q_preprocess_written(spark, sf):
    """J4 with its two CSV stage sinks; the modelling table is read back."""
    from sparkprep.plans.preprocess import preprocess_to_files
    _, mod = preprocess_to_files(merged(spark, sf), PREP_CFG, shared_path(spark, "clean"),
                                 shared_path(spark, "model"), fmt="csv")
    return mod


@register("flagship", f"""with {CLEAN_SQL},
g as (select MANU, TARGET, count(*) as count from clean group by MANU, TARGET)
select MANU, TARGET, count / sum(count) over (partition by MANU) as proportion from g
""", ["symptom_rows"])
def q_flagship(spark, sf):
    from sparkprep.operators.profile import grouped_proportions
    return grouped_proportions(clean_table(spark, sf), "MANU", "TARGET")
