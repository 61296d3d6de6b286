"""Checks for A (profiles), O (order), U3 (appends), over whole driver tables.

Floating aggregates are rounded (6 decimals, 9 for correlations, 12 for
densities) on both sides so that summation order cannot change a hash.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep.catalog.registry import register
from sparkprep.catalog.tables import fx_eval, fx_main, fx_rule, table
from sparkprep.operators import keyed as K
from sparkprep.operators import order as O
from sparkprep.operators import profile as A
from sparkprep.operators.sampling import split_random


def _r(df, cols, d=6):
    return df.withColumns({c: F.round(F.col(c), d) for c in cols})


@register("table_shape", "select count(*) as rows, 6 as columns from fx_main", ["fx_main"])
def q_table_shape(spark, sf):
    return A.table_shape(fx_main(spark, sf))


@register("date_ranges", """
with ol as (select cast(l.l_shipdate as date) as ship_d, cast(o.o_orderdate as date) as order_d
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey)
select 'ship_d' as column_name, min(ship_d) as min, max(ship_d) as max from ol
union all select 'order_d', min(order_d), max(order_d) from ol
""")
def q_date_ranges(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    ol = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_shipdate").cast("date").alias("ship_d"), F.col("o_orderdate").cast("date").alias("order_d"))
    return A.min_max(ol, ["ship_d", "order_d"])


MISSING_SQL = """
select 0 as position, 'id' as column_name, count(*) filter (where id is null) as missing,
  cast(count(*) filter (where id is null) as double) * 100 / count(*) as pct from fx_main
union all select 1, 'o_custkey', count(*) filter (where o_custkey is null),
  cast(count(*) filter (where o_custkey is null) as double) * 100 / count(*) from fx_main
union all select 2, 'status', count(*) filter (where status is null),
  cast(count(*) filter (where status is null) as double) * 100 / count(*) from fx_main
union all select 3, 'priority', count(*) filter (where priority is null),
  cast(count(*) filter (where priority is null) as double) * 100 / count(*) from fx_main
union all select 4, 'price', count(*) filter (where price is null),
  cast(count(*) filter (where price is null) as double) * 100 / count(*) from fx_main
union all select 5, 'd', count(*) filter (where d is null),
  cast(count(*) filter (where d is null) as double) * 100 / count(*) from fx_main
"""


@register("missing_profile", MISSING_SQL, ["fx_main"])
def q_missing_profile(spark, sf):
    return A.missing_profile(fx_main(spark, sf))


@register("missing_patterns", """
select (case when status is null then '1' else '0' end) || (case when priority is null then '1' else '0' end)
  || (case when price is null then '1' else '0' end) as pattern, count(*) as count
from fx_main group by 1
""", ["fx_main"])
def q_missing_patterns(spark, sf):
    return A.missing_patterns(fx_main(spark, sf), ["status", "priority", "price"])


@register("unique_profile", """
select 'o_custkey' as column_name, count(distinct o_custkey) as n_unique from fx_main
union all select 'status', count(distinct status) from fx_main
union all select 'priority', count(distinct priority) from fx_main
union all select 'price', count(distinct price) from fx_main
union all select 'd', count(distinct d) from fx_main
""", ["fx_main"])
def q_unique_profile(spark, sf):
    return A.unique_profile(fx_main(spark, sf), ["o_custkey", "status", "priority", "price", "d"])


@register("unique_profile_approx", """
select column_name, true as within_bound from (values ('o_custkey'), ('status'), ('priority'), ('price'), ('d')) t(column_name)
""")
def q_unique_profile_approx(spark, sf):
    """Sketched counts within three standard errors (5 % each) of the exact ones."""
    cols = ["o_custkey", "status", "priority", "price", "d"]
    main = fx_main(spark, sf)
    exact = A.unique_profile(main, cols).withColumnRenamed("n_unique", "_n")
    both = A.unique_profile(main, cols, approx=True).join(exact, "column_name")
    return both.select("column_name", (F.abs(F.col("n_unique") - F.col("_n")) <= 0.15 * F.col("_n")).alias("within_bound"))


@register("dup_rows", """
select cast(count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber, l_returnflag,
  l_linestatus from lineitem)) as bigint) as duplicates from lineitem
""")
def q_dup_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return K.duplicate_count(li)


@register("dup_keys", """
select cast(sum(n - 1) as bigint) as duplicates from (
  select count(*) as n from orders group by o_custkey, o_orderstatus)
""")
def q_dup_keys(spark, sf):
    return K.duplicate_count(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"])


@register("dup_members", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem
where (l_orderkey, l_linenumber) in (
  select (l_orderkey, l_linenumber) from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
""")
def q_dup_members(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return K.duplicated_rows(li, ["l_orderkey", "l_linenumber"])


@register("value_counts", """
select priority, count(*) as count from fx_main where priority is not null group by priority
""", ["fx_main"])
def q_value_counts(spark, sf):
    return A.value_counts(fx_main(spark, sf), "priority")


@register("value_proportions", """
select priority, count(*) / sum(count(*)) over () as proportion from fx_main
where priority is not null group by priority
""", ["fx_main"])
def q_value_proportions(spark, sf):
    return A.value_counts(fx_main(spark, sf), "priority", normalize=True)


@register("category_report", """
with c as (select status, count(*) as n from fx_main group by status)
select status as value, n as count, n / (select sum(n) from c where status is not null) as proportion,
  (select count(status) from c) as n_distinct,
  cast((select coalesce(sum(n), 0) from c where status is null) as bigint) as n_missing
from c where status is not null
""", ["fx_main"])
def q_category_report(spark, sf):
    return A.category_report(fx_main(spark, sf), "status")


@register("grouped_counts", """
select priority, status, count(*) as count from fx_main
where priority is not null and status is not null group by priority, status
""", ["fx_main"])
def q_grouped_counts(spark, sf):
    return A.grouped_counts(fx_main(spark, sf), "priority", "status")


@register("grouped_proportions", """
select priority, status, count(*) / sum(count(*)) over (partition by priority) as proportion from fx_main
where priority is not null and status is not null group by priority, status
""", ["fx_main"])
def q_grouped_proportions(spark, sf):
    return A.grouped_proportions(fx_main(spark, sf), "priority", "status")


DESCRIBE_COLS = ["l_quantity", "l_extendedprice"]
DESC_SQL = " union all ".join(f"""
select '{c}' as column_name, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
  round(min({c}), 6) as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
  round(quantile_cont({c}, 0.75), 6) as p75, round(max({c}), 6) as max from lineitem""" for c in DESCRIBE_COLS)


@register("describe_numeric", DESC_SQL)
def q_describe_numeric(spark, sf):
    d = A.describe(table(spark, sf, "lineitem"), DESCRIBE_COLS)
    return _r(d, ["mean", "std", "min", "p25", "p50", "p75", "max"])


@register("continuous_report", """
select 'price' as column_name, count(price) as count, round(avg(price), 6) as mean,
  round(stddev_samp(price), 6) as std, round(min(price), 6) as min, round(quantile_cont(price, 0.25), 6) as p25,
  round(quantile_cont(price, 0.5), 6) as p50, round(quantile_cont(price, 0.75), 6) as p75,
  round(max(price), 6) as max, count(*) filter (where price is null) as missing,
  round(cast(count(*) filter (where price is null) as double) * 100 / count(*), 6) as pct from fx_main
""", ["fx_main"])
def q_continuous_report(spark, sf):
    d = A.continuous_report(fx_main(spark, sf), ["price"])
    return _r(d, ["mean", "std", "min", "p25", "p50", "p75", "max", "pct"])


@register("histogram_bins", """
with r as (select min(price) as lo, max(price) as hi from fx_main),
b as (select cast(least(floor((price - lo) / (hi - lo) * 20) + 1, 20) as integer) as bin
  from fx_main, r where price is not null),
c as (select bin, count(*) as count from b group by bin),
g as (select cast(range + 1 as integer) as bin from range(20))
select g.bin, round(lo + (g.bin - 1) * ((hi - lo) / 20), 6) as lower, round(lo + g.bin * ((hi - lo) / 20), 6) as upper,
  cast(coalesce(c.count, 0) as bigint) as count from g left join c on g.bin = c.bin, r
""", ["fx_main"])
def q_histogram_bins(spark, sf):
    return _r(A.histogram(fx_main(spark, sf), "price", 20), ["lower", "upper"])


@register("density_grid", """
with s as (select count(*) as n, stddev_samp(price) as sd, min(price) as lo, max(price) as hi from fx_main
  where price is not null),
s2 as (select *, sd * pow(n, -0.2) as h from s),
b as (select cast(least(floor((price - lo) / (hi - lo) * 256), 255) as integer) as bb, count(*) as c
  from fx_main, s2 where price is not null group by 1),
g as (select range as grid from range(64)),
k as (select grid, lo - 3.0 * h + grid * ((hi - lo) + 6.0 * h) / 63 as x,
   c * exp(-0.5 * ((lo - 3.0 * h + grid * ((hi - lo) + 6.0 * h) / 63) - (lo + (bb + 0.5) * (hi - lo) / 256)) / h
     * ((lo - 3.0 * h + grid * ((hi - lo) + 6.0 * h) / 63) - (lo + (bb + 0.5) * (hi - lo) / 256)) / h)
     / (n * h * sqrt(2 * pi())) as contrib
  from b, g, s2)
select cast(grid as integer) as grid, round(min(x), 6) as x, round(sum(contrib), 12) as density from k group by grid
""", ["fx_main"])
def q_density_grid(spark, sf):
    d = A.density(fx_main(spark, sf), "price", grid_size=64, bins=256)
    return d.select(F.col("grid").cast("int"), F.round("x", 6).alias("x"), F.round("density", 12).alias("density"))


BOX_SQL = """
with q as (select status, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.5) as median,
  quantile_cont(price, 0.75) as q3 from fx_main where price is not null and status is not null group by status),
f as (select *, q1 - 1.5 * (q3 - q1) as lf, q3 + 1.5 * (q3 - q1) as uf from q)
select m.status, count(*) as count, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median,
  round(any_value(q3), 6) as q3,
  round(min(price) filter (where price >= lf), 6) as whisker_low,
  round(max(price) filter (where price <= uf), 6) as whisker_high,
  count(*) filter (where price < lf or price > uf) as outliers
from fx_main m join f on m.status = f.status where price is not null group by m.status
"""


@register("box_stats", BOX_SQL, ["fx_main"])
def q_box_stats(spark, sf):
    b = A.box_stats(fx_main(spark, sf), "price", ["status"])
    return _r(b, ["q1", "median", "q3", "whisker_low", "whisker_high"])


@register("box_stats_ungrouped", """
with f as (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as median,
  quantile_cont(o_totalprice, 0.75) as q3 from orders),
g as (select *, q1 - 1.5 * (q3 - q1) as lf, q3 + 1.5 * (q3 - q1) as uf from f)
select count(*) as count, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median,
  round(any_value(q3), 6) as q3, round(min(o_totalprice) filter (where o_totalprice >= lf), 6) as whisker_low,
  round(max(o_totalprice) filter (where o_totalprice <= uf), 6) as whisker_high,
  count(*) filter (where o_totalprice < lf or o_totalprice > uf) as outliers from orders, g
""")
def q_box_stats_ungrouped(spark, sf):
    b = A.box_stats(table(spark, sf, "orders"), "o_totalprice")
    return _r(b, ["q1", "median", "q3", "whisker_low", "whisker_high"])


@register("percent_counts", """
select priority, status, count(*) as count, round(count(*) * 100.0 / (select count(*) from fx_main), 9) as percent
from fx_main where priority is not null and status is not null group by priority, status
""", ["fx_main"])
def q_percent_counts(spark, sf):
    return _r(A.percent_counts(fx_main(spark, sf), "priority", "status"), ["percent"], 9)


@register("percent_counts_many", """
with l as (select 'status' as column_name, status as value from fx_main
  union all select 'priority', priority from fx_main)
select column_name, value, count(*) as count, round(count(*) * 100.0 / (select count(*) from fx_main), 9) as percent
from l where value is not null group by column_name, value
""", ["fx_main"])
def q_percent_counts_many(spark, sf):
    return _r(A.percent_counts_many(fx_main(spark, sf), ["status", "priority"]), ["percent"], 9)


@register("bar_values", """
select priority, status, round_even(avg(price), 2) as mean from fx_main
where priority is not null and status is not null group by priority, status
""", ["fx_main"])
def q_bar_values(spark, sf):
    return A.bar_values(fx_main(spark, sf), "priority", "price", "status")


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("correlation_matrix", " union all ".join(
    f"select '{a}' as var1, '{b}' as var2, round(corr({a}, {b}), 9) as corr from lineitem"
    for a in CORR_COLS for b in CORR_COLS))
def q_correlation_matrix(spark, sf):
    return _r(A.correlation_matrix(table(spark, sf, "lineitem"), CORR_COLS), ["corr"], 9)


@register("pair_sample", """
with s as (select o_orderkey, o_orderstatus, o_totalprice, cast(o_custkey as double) as o_custkey
  from orders order by md5(cast(o_orderkey as varchar) || '|' || '5'), o_orderkey limit 200)
select o_orderkey, o_orderstatus as target, 'o_totalprice' as x_name, 'o_custkey' as y_name,
  o_totalprice as x, o_custkey as y from s
union all select o_orderkey, o_orderstatus, 'o_custkey', 'o_totalprice', o_custkey, o_totalprice from s
""")
def q_pair_sample(spark, sf):
    return A.pair_sample(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "o_orderstatus", 200,
                         ["o_orderkey"], seed=5)


@register("distinct_options", """
select 0 as position, 'ALL' as value
union all select row_number() over (order by v), v from (select distinct p_type as v from part where p_type is not null)
""")
def q_distinct_options(spark, sf):
    return A.options_list(table(spark, sf, "part"), "p_type")


@register("positive_share", "select avg(cast(y = 1 as double)) as positive_share from fx_eval", ["fx_eval"])
def q_positive_share(spark, sf):
    return A.class_share(fx_eval(spark, sf), "y", 1)


def _box_sql(feature: str) -> str:
    return f"""
select '{feature}' as feature, 'box' as kind, cast(b.y as varchar) as "group", count(*) as count,
  round(any_value(q1), 6) as q1, round(any_value(median), 6) as median, round(any_value(q3), 6) as q3,
  round(min({feature}) filter (where {feature} >= q1 - 1.5 * (q3 - q1)), 6) as whisker_low,
  round(max({feature}) filter (where {feature} <= q3 + 1.5 * (q3 - q1)), 6) as whisker_high,
  count(*) filter (where {feature} < q1 - 1.5 * (q3 - q1) or {feature} > q3 + 1.5 * (q3 - q1)) as outliers,
  null as category, null::double as percent
from bv b join (select y, quantile_cont({feature}, 0.25) as q1, quantile_cont({feature}, 0.5) as median,
  quantile_cont({feature}, 0.75) as q3 from bv group by y) q on b.y = q.y
group by b.y"""


BIV_SQL = f"""with bv as (select x1, x2, case when x3 >= 0.04 then 'high' else 'low' end as qbin,
  cast(y as varchar) as y from fx_rule)
{_box_sql('x1')}
union all {_box_sql('x2')}
union all select 'qbin', 'count', y, count(*), null, null, null, null, null, null, qbin,
  round(count(*) * 100.0 / (select count(*) from bv), 9) from bv group by qbin, y
"""


@register("bivariate_summary", BIV_SQL, ["fx_rule"])
def q_bivariate_summary(spark, sf):
    rule = fx_rule(spark, sf)
    bv = rule.select("x1", "x2", F.when(F.col("x3") >= 0.04, "high").otherwise("low").alias("qbin"),
                     F.col("y").cast("string").alias("y"))
    ranking = bv.agg(*[F.count_distinct(c).alias(c) for c in ["x1", "x2", "qbin"]]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("importance"))
                           for c in ["x1", "x2", "qbin"]])))
    out = A.bivariate(bv, ranking, 3, "y")
    return _r(out, ["q1", "median", "q3", "whisker_low", "whisker_high"]).withColumn(
        "percent", F.round("percent", 9))


# --------------------------------------------------------------- O1 - O4, U3


@register("sort_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey")
def q_sort_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return O.sort_rows(o, ["o_totalprice", "o_orderkey"], [False, True])


@register("top_n", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 10")
def q_top_n(spark, sf):
    return O.top_n(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 10, ["p_partkey"])


@register("head_tail", """
select * from (select 'head' as part, o_orderkey, o_orderstatus from orders order by o_orderkey limit 5)
union all select * from (select 'tail', o_orderkey, o_orderstatus from orders order by o_orderkey desc limit 5)
""")
def q_head_tail(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    head = O.head_rows(o, 5, pos="o_orderkey").select(F.lit("head").alias("part"), "*")
    tail = O.tail_rows(o, 5, pos="o_orderkey").select(F.lit("tail").alias("part"), "*")
    return head.unionByName(tail)


@register("shuffle_rows", """
select o_orderkey, md5(cast(o_orderkey as varchar) || '|' || '7') as shuffle_order from orders
""")
def q_shuffle_rows(spark, sf):
    return O.shuffle_rows(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@register("union_sets", "select * from fx_main", ["fx_main"])
def q_union_sets(spark, sf):
    parts = split_random(fx_main(spark, sf), 0.2, 3, ["id"])
    train = parts.where("split = 'train'").drop("split")
    test = parts.where("split = 'test'").drop("split")
    return O.union_all([train, test])
