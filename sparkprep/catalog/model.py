"""Checks for X (splits / samples), F (features), V (evaluation), M (models),
E (explanation), U1 / U2 (appends of result tables).

Metrics run on ``fx_eval`` (a deterministic pseudo-score), so each has an
exact SQL answer.  Trained models run on ``fx_rule`` (a planted rule) where
the right predictions are known in SQL.  Random or search outputs are
rows-only checks.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkprep.catalog.prep import REPORT_SQL
from sparkprep.catalog.registry import register
from sparkprep.catalog.tables import fx_eval, fx_main, fx_reg, fx_rule, table
from sparkprep.operators import evaluate as V
from sparkprep.operators import explain as E
from sparkprep.operators import features as Fe
from sparkprep.operators import sampling as X
from sparkprep.operators.order import union_all
from sparkprep.plans import model as M
from sparkprep.session import shared_path


def _r(df, cols, d=9):
    return df.withColumns({c: F.round(F.col(c), d) for c in cols})


def _h(expr: str, seed) -> str:
    """DuckDB twin of ``hash_hex([col], seed)``."""
    return f"md5(cast({expr} as varchar) || '|' || '{seed}')"


def _hi(exprs: list[str], seed) -> str:
    """DuckDB twin of ``hash_int(cols, seed)``."""
    inner = " || '|' || ".join(f"cast({e} as varchar)" for e in exprs)
    return f"('0x' || substr(md5({inner} || '|' || '{seed}'), 1, 8))::BIGINT"


def _alloc_sql(counts: str, share: str, out: str) -> str:
    """CTEs: per-class test counts of a stratified split (floors, then the
    leftover units by largest fractional part, ties to the smaller class)."""
    return f"""
{out}_a as (select y, nc, sum(nc) over () as n from {counts}),
{out}_b as (select *, n - ceil(cast({share} as double) * n) as ntrain from {out}_a),
{out}_c as (select *, cast(nc as double) / n * ntrain as cont from {out}_b),
{out}_d as (select *, floor(cont) as fl, cont - floor(cont) as fr from {out}_c),
{out}_e as (select *, ntrain - sum(fl) over () as rem, row_number() over (order by fr desc, y) as rk from {out}_d),
{out} as (select y, nc, cast(nc - (fl + case when rk <= rem then 1 else 0 end) as bigint) as ntest from {out}_e)"""


RANKED_EVAL = f"""
rk as (select id, y, row_number() over (partition by y order by {_h('id', 2)}, id) - 1 as rn from fx_eval),
cnt as (select y, count(*) as nc from fx_eval group by y)"""


# --------------------------------------------------------------- X1 - X6


@register("split_stratified", f"""
with {RANKED_EVAL}, {_alloc_sql('cnt', '0.2', 'al')}
select id, y, case when rn < ntest then 'test' else 'train' end as split from rk join al using (y)
""", ["fx_eval"])
def q_split_stratified(spark, sf):
    return X.split_stratified(fx_eval(spark, sf).select("id", "y"), "y", 0.2, 2, ["id"])


@register("split_random", f"""
with r as (select id, row_number() over (order by {_h('id', 4)}, id) - 1 as rn from fx_main)
select id, case when rn < (select ceil(cast(0.2 as double) * count(*)) from fx_main) then 'test' else 'train' end
  as split from r
""", ["fx_main"])
def q_split_random(spark, sf):
    return X.split_random(fx_main(spark, sf).select("id"), 0.2, 4, ["id"])


@register("split_three", f"""
with {RANKED_EVAL}, {_alloc_sql('cnt', '0.2', 'al')},
rest as (select y, nc - ntest as nc from al), {_alloc_sql('rest', '0.2', 'va')}
select id, y, case when rn < al.ntest then 'test' when rn < al.ntest + va.ntest then 'valid' else 'train' end
  as split from rk join al using (y) join va using (y)
""", ["fx_eval"])
def q_split_three(spark, sf):
    return X.split_three(fx_eval(spark, sf).select("id", "y"), "y", 0.2, 0.2, 2, ["id"])


@register("set_sizes", f"""
with {RANKED_EVAL}, {_alloc_sql('cnt', '0.2', 'al')},
rest as (select y, nc - ntest as nc from al), {_alloc_sql('rest', '0.2', 'va')},
s as (select case when rn < al.ntest then 'test' when rn < al.ntest + va.ntest then 'valid' else 'train' end
  as split from rk join al using (y) join va using (y))
select split, count(*) as rows from s group by split
""", ["fx_eval"])
def q_set_sizes(spark, sf):
    return M.set_sizes(X.split_three(fx_eval(spark, sf).select("id", "y"), "y", 0.2, 0.2, 2, ["id"]))


PROP_SQL = f"""
with {RANKED_EVAL},
take as (select y, cast(floor(1000 * nc / (select count(*) from fx_eval)) as bigint) as k from cnt)
select id, y, {_h('id', '2s')} as sample_order from rk join take using (y) where rn < k"""


@register("sample_proportional", PROP_SQL, ["fx_eval"])
def q_sample_proportional(spark, sf):
    return X.sample_proportional(fx_eval(spark, sf).select("id", "y"), "y", 1000, 2, ["id"])


@register("sample_n", f"""
select id, p, {_h('id', 9)} as sample_order from fx_eval order by {_h('id', 9)}, id limit 100
""", ["fx_eval"])
def q_sample_n(spark, sf):
    return X.sample_n(fx_eval(spark, sf).select("id", "p"), 100, 9, ["id"])


@register("kfold_assign", f"""
with {RANKED_EVAL}
select id, y, cast(rn % 3 as integer) as fold from rk
""", ["fx_eval"])
def q_kfold_assign(spark, sf):
    return X.kfold(fx_eval(spark, sf).select("id", "y"), 3, 2, ["id"], label="y")


@register("kfold_ranges", f"""
with {RANKED_EVAL}
select id, y, cast((rn * 5) // nc as integer) as fold from rk join cnt using (y)
""", ["fx_eval"])
def q_kfold_ranges(spark, sf):
    return X.stratified_folds(fx_eval(spark, sf).select("id", "y"), 5, 2, ["id"], "y")


@register("kfold_plain", f"""
select id, cast({_hi(['id'], 5)} % 5 as integer) as fold from fx_eval
""", ["fx_eval"])
def q_kfold_plain(spark, sf):
    return X.kfold(fx_eval(spark, sf).select("id"), 5, 5, ["id"])


# --------------------------------------------------------------- F1 - F9


@register("label_encode", """
select p_partkey, p_type, cast(dense_rank() over (order by p_type) - 1 as double) as label from part
""")
def q_label_encode(spark, sf):
    out, _ = Fe.encode_label(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type")
    return out


@register("label_decode", """
select p_partkey, p_type, p_type as predicted_label from part
""")
def q_label_decode(spark, sf):
    out, model = Fe.encode_label(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type")
    return Fe.decode_label(out, model.labels, col="label").drop("label")


ONEHOT_SQL = """
select id, price,
  case when status = 'F' then 1 else 0 end as status_F, case when status = 'O' then 1 else 0 end as status_O,
  case when status is null then 1 else 0 end as status_nan,
  case when priority = '1-URGENT' then 1 else 0 end as "priority_1-URGENT",
  case when priority = '2-HIGH' then 1 else 0 end as "priority_2-HIGH",
  case when priority = '3-MEDIUM' then 1 else 0 end as "priority_3-MEDIUM",
  case when priority = '4-NOT SPECIFIED' then 1 else 0 end as "priority_4-NOT SPECIFIED",
  case when priority is null then 1 else 0 end as priority_nan
from fx_main"""


@register("one_hot", ONEHOT_SQL, ["fx_main"])
def q_one_hot(spark, sf):
    return Fe.one_hot(fx_main(spark, sf).select("id", "status", "priority", "price"), ["status", "priority"])


SPLIT_MAIN = f"""
sp as (select id, price, cast(o_custkey as double) as o_custkey,
  case when row_number() over (order by {_h('id', 4)}, id) - 1 < (select ceil(cast(0.2 as double) * count(*))
    from fx_main) then 'test' else 'train' end as split from fx_main)"""


def _split_main(spark, sf):
    m = fx_main(spark, sf).select("id", "price", F.col("o_custkey").cast("double").alias("o_custkey"))
    return X.split_random(m, 0.2, 4, ["id"])


def _scaled(spark, sf, kind):
    s = _split_main(spark, sf)
    model = Fe.fit_scaler(s.where("split = 'train'"), ["price", "o_custkey"], kind)
    return _r(model.transform(s), ["price", "o_custkey"]), model, s


@register("scale_minmax", f"""
with {SPLIT_MAIN},
st as (select min(price) as a1, max(price) - min(price) as b1, min(o_custkey) as a2,
  max(o_custkey) - min(o_custkey) as b2 from sp where split = 'train')
select id, split, round((price - a1) / b1, 9) as price, round((o_custkey - a2) / b2, 9) as o_custkey from sp, st
""", ["fx_main"])
def q_scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")[0]


@register("scale_standard", f"""
with {SPLIT_MAIN},
st as (select avg(price) as a1, stddev_pop(price) as b1, avg(o_custkey) as a2, stddev_pop(o_custkey) as b2
  from sp where split = 'train')
select id, split, round((price - a1) / b1, 9) as price, round((o_custkey - a2) / b2, 9) as o_custkey from sp, st
""", ["fx_main"])
def q_scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")[0]


@register("scale_robust", f"""
with {SPLIT_MAIN},
st as (select quantile_cont(price, 0.5) as a1, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) as b1,
  quantile_cont(o_custkey, 0.5) as a2, quantile_cont(o_custkey, 0.75) - quantile_cont(o_custkey, 0.25) as b2
  from sp where split = 'train')
select id, split, round((price - a1) / b1, 9) as price, round((o_custkey - a2) / b2, 9) as o_custkey from sp, st
""", ["fx_main"])
def q_scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")[0]


@register("scale_inverse", f"with {SPLIT_MAIN} select id, split, round(price, 6) as price, "
          "round(o_custkey, 6) as o_custkey from sp", ["fx_main"])
def q_scale_inverse(spark, sf):
    s = _split_main(spark, sf)
    model = Fe.fit_scaler(s.where("split = 'train'"), ["price", "o_custkey"], "standard")
    back = model.inverse(model.transform(s))
    return _r(back, ["price", "o_custkey"], 6)


@register("class_weights", """
select id, y, (select count(*) from fx_eval) / (2.0 * count(*) over (partition by y)) as weight from fx_eval
""", ["fx_eval"])
def q_class_weights(spark, sf):
    return Fe.class_weights(fx_eval(spark, sf).select("id", "y"), "y")


@register("scoring_features", ONEHOT_SQL, ["fx_main"])
def q_scoring_features(spark, sf):
    m = fx_main(spark, sf).select("id", "status", "priority", "price")
    model = Fe.fit_one_hot(m, ["status", "priority"])
    Fe.check_features(m, ["id", "status", "priority", "price"])
    return model.transform(m)


# --------------------------------------------------------------- V1 - V16, U1, U2

def _per_class_sql(ev: str, sfx: str = "") -> str:
    """CTEs pc, m, f (suffixed) for the per-class table of scored view ``ev``."""
    return f"""
pc{sfx} as (select cls, sum(t) as support, sum(pr) as predicted, sum(hit) as tp from (
    select y as cls, 1 as t, 0 as pr, case when y = y_hat then 1 else 0 end as hit from {ev}
    union all select y_hat, 0, 1, 0 from {ev}) group by cls),
m{sfx} as (select cls, support, predicted, tp, case when predicted <> 0 then tp / predicted else 0.0 end as precision,
       case when support <> 0 then tp / support else 0.0 end as recall from pc{sfx}),
f{sfx} as (select *, case when precision + recall <> 0 then 2 * precision * recall / (precision + recall)
  else 0.0 end as f1 from m{sfx})"""


PER_CLASS = _per_class_sql("ev")

SCORE_COLS = """
  case when sum(support) <> 0 then sum(tp) / sum(support) else 0.0 end as accuracy,
  case when count(*) = 2 then avg(recall) end as auc,
  case when count(*) = 2 then max(precision) filter (where cls = 1) end as precision_binary,
  case when count(*) = 2 then max(recall) filter (where cls = 1) end as recall_binary,
  sum(precision * support) / sum(support) as precision_weighted,
  sum(recall * support) / sum(support) as recall_weighted,
  avg(precision) as precision_macro, avg(recall) as recall_macro,
  sum(tp) / sum(predicted) as precision_micro, sum(tp) / sum(support) as recall_micro,
  sum(f1 * support) / sum(support) as f1_weighted"""


def _logloss(ev: str) -> str:
    return ("(select round(avg(-ln(greatest(least(case when y = 1 then p else 1 - p end, 1 - 1e-15), 1e-15))), 9)"
            f" from {ev}) as log_loss")


LOGLOSS = ("round(avg(-ln(greatest(least(case when y = 1 then p else 1 - p end, 1 - 1e-15), 1e-15))), 9)"
           " as log_loss")

SCORES_SQL = f"""with ev as (select * from fx_eval), {PER_CLASS}
select 'pseudo' as model, {SCORE_COLS}, {_logloss('ev')} from f"""

UNION_SCORES_SQL = f"""with ev as (select * from fx_eval),
ev2 as (select id, y, case when p >= 0.6 then 1 else 0 end as y_hat, 1 - p as p from fx_eval),
{PER_CLASS}, {_per_class_sql('ev2', '2')}
select 'pseudo' as model, {SCORE_COLS}, {_logloss('ev')} from f
union all select 'second', {SCORE_COLS}, {_logloss('ev2')} from f2"""


def _scores(spark, sf, name="pseudo", ev=None):
    ev = ev if ev is not None else fx_eval(spark, sf)
    return _r(V.classification_scores(ev, name), ["log_loss"])


@register("classification_scores", SCORES_SQL, ["fx_eval"])
def q_classification_scores(spark, sf):
    return _scores(spark, sf)


@register("accuracy", "select avg(cast(y = y_hat as double)) as accuracy from fx_eval", ["fx_eval"])
def q_accuracy(spark, sf):
    return V.accuracy(fx_eval(spark, sf))


AUC_SQL = """with ev as (select * from fx_eval),
s as (select p, count(*) filter (where y = 1) as pos, count(*) filter (where y <> 1) as neg from ev group by p),
c as (select *, sum(neg) over (order by p rows between unbounded preceding and current row) as cneg from s),
hard as (select (avg(cast(y_hat = 1 as double)) filter (where y = 1)
  + avg(cast(y_hat = 0 as double)) filter (where y = 0)) / 2 as auc_hard from ev)
select round((select sum(pos * (cneg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) from c), 9) as auc_score,
  round(auc_hard, 9) as auc_hard from hard"""


@register("auc", AUC_SQL, ["fx_eval"])
def q_auc(spark, sf):
    ev = fx_eval(spark, sf)
    hard = V.prf(ev).select(F.round("auc_hard", 9).alias("auc_hard"))
    score = V.auc_score(ev).select(F.round("auc_score", 9).alias("auc_score"))
    from sparkprep.operators.order import attach_row
    return attach_row(score, hard)


@register("log_loss", f"select {LOGLOSS} from fx_eval", ["fx_eval"])
def q_log_loss(spark, sf):
    return _r(V.log_loss(fx_eval(spark, sf)), ["log_loss"])


def _prf_cols(cols):
    def q(spark, sf):
        return V.prf(fx_eval(spark, sf)).select(*cols)
    return q


for _name, _cols in {
    "prf_binary": ["precision_binary", "recall_binary"],
    "prf_weighted": ["precision_weighted", "recall_weighted"],
    "prf_macro": ["precision_macro", "recall_macro"],
    "prf_micro": ["precision_micro", "recall_micro"],
    "f1_weighted": ["f1_weighted"],
}.items():
    register(_name, f"""with ev as (select * from fx_eval), {PER_CLASS},
s as (select {SCORE_COLS} from f) select {', '.join(_cols)} from s""", ["fx_eval"])(_prf_cols(_cols))


@register("classification_report", REPORT_SQL, ["fx_eval"])
def q_classification_report(spark, sf):
    return V.classification_report(fx_eval(spark, sf))


@register("confusion_matrix", """
select 'True: ' || cast(y as varchar) as label, count(*) filter (where y_hat = 0) as "Predicted: 0",
  count(*) filter (where y_hat = 1) as "Predicted: 1" from fx_eval group by y
""", ["fx_eval"])
def q_confusion_matrix(spark, sf):
    return V.confusion_matrix(fx_eval(spark, sf))


def _curve_sql(score: str, model: str) -> str:
    return f"""
s_{model} as (select {score} as threshold, count(*) filter (where y = 1) as pos,
  count(*) filter (where y <> 1) as neg from fx_eval group by 1),
c_{model} as (select threshold,
  sum(pos) over (order by threshold desc rows between unbounded preceding and current row) as tps,
  sum(neg) over (order by threshold desc rows between unbounded preceding and current row) as fps,
  row_number() over (order by threshold desc) - 1 as i from s_{model}),
t_{model} as (select max(i) as last, max(tps) as P, max(fps) as N from c_{model})"""


def _roc_select(model: str) -> str:
    return f"""
select fps / N as fpr, tps / P as tpr, '{model}' as model from (
  select *, lag(tps) over (order by i) as ptp, lead(tps) over (order by i) as ntp,
    lag(fps) over (order by i) as pfp, lead(fps) over (order by i) as nfp from c_{model}) k, t_{model}
where i = 0 or i = last or last < 2 or (pfp - 2 * fps + nfp) <> 0 or (ptp - 2 * tps + ntp) <> 0
union all select 0.0 / N, 0.0 / P, '{model}' from t_{model}"""


@register("roc_curve", f"with {_curve_sql('p', 'pseudo')} {_roc_select('pseudo')}", ["fx_eval"])
def q_roc_curve(spark, sf):
    return V.roc_curve(fx_eval(spark, sf), "pseudo")


@register("pr_curve", f"""with {_curve_sql('p', 'pseudo')},
st as (select min(i) as stop from c_pseudo, t_pseudo where tps = P)
select case when tps + fps > 0 then tps / (tps + fps) else 0.0 end as precision, tps / P as recall,
  'pseudo' as model, P / (P + N) as proportion_1 from c_pseudo, t_pseudo, st where i <= stop
union all select 1.0, 0.0, 'pseudo', P / (P + N) from t_pseudo
""", ["fx_eval"])
def q_pr_curve(spark, sf):
    return V.pr_curve(fx_eval(spark, sf), "pseudo")


@register("regression_scores", """
select 'pseudo' as model, round(1 - var_pop(y - y_hat) / var_pop(y), 9) as explained_variance,
  round(1 - avg((y - y_hat) * (y - y_hat)) / var_pop(y), 9) as r2, round(avg(abs(y - y_hat)), 6) as mae,
  round(avg((y - y_hat) * (y - y_hat)), 3) as mse, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) as rmse
from fx_reg
""", ["fx_reg"])
def q_regression_scores(spark, sf):
    r = V.regression_scores(fx_reg(spark, sf), "pseudo")
    return r.select("model", F.round("explained_variance", 9).alias("explained_variance"),
                    F.round("r2", 9).alias("r2"), F.round("mae", 6).alias("mae"), F.round("mse", 3).alias("mse"),
                    F.round("rmse", 6).alias("rmse"))


@register("prediction_samples", f"""
with {RANKED_EVAL.replace('fx_eval', 'pv')}, take as (select y, cast(floor(20 * nc / (select count(*) from pv)) as bigint)
  as k from cnt)
select id, p, y as true_label, y_hat as predicted_label, {_h('id', '2s')} as sample_order
from rk join take using (y) join pv using (id, y) where rn < k
""".replace("with ", "with pv as (select * from fx_eval), ", 1), ["fx_eval"])
def q_prediction_samples(spark, sf):
    ev = fx_eval(spark, sf).select("id", "p", F.col("y").alias("true_label"), F.col("y_hat").alias("predicted_label"))
    s = V.prediction_samples(ev, 20, 2, ["id"], classifier=True)
    return s


def _second_model(spark, sf):
    ev = fx_eval(spark, sf)
    return ev.select("id", "y", F.when(F.col("p") >= 0.6, 1).otherwise(0).alias("y_hat"),
                     (1 - F.col("p")).alias("p"))


@register("union_scores", UNION_SCORES_SQL, ["fx_eval"])
def q_union_scores(spark, sf):
    return union_all([_scores(spark, sf), _scores(spark, sf, "second", _second_model(spark, sf))])


@register("union_curves", f"""with {_curve_sql('p', 'a')}, {_curve_sql('1 - p', 'b')}
{_roc_select('a')} union all {_roc_select('b')}
""", ["fx_eval"])
def q_union_curves(spark, sf):
    ev = fx_eval(spark, sf)
    b = ev.withColumn("p", 1 - F.col("p"))
    return union_all([V.roc_curve(ev, "a"), None, V.roc_curve(b, "b")])


# --------------------------------------------------------------- M1 - M18, E1

RULE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
RULE_HASH = ("md5(l_orderkey::varchar || '|' || l_partkey::varchar || '|' || l_suppkey::varchar || '|' || "
             "l_linenumber::varchar || '|' || '{seed}')")
RULE_PRED_SQL = """select l_orderkey, l_partkey, l_suppkey, l_linenumber, y as predicted from fx_rule"""


def _rule(spark, sf, target="y"):
    r = fx_rule(spark, sf)
    return r.drop("yr") if target == "y" else r.drop("y")


def _fit(spark, sf, model_type, params, target="y", split=False):
    b, tr, te = M.train(_rule(spark, sf, target), target, model_type, params, key=RULE_KEY,
                        scaler="minmax", split=split)
    return b, tr, te


def _predicted(b, df):
    p = M.predict(b, df)
    col = F.col("predicted_label").cast("int") if b.is_classifier else F.round("predicted_label", 6)
    return p.select(*RULE_KEY, col.alias("predicted"))


TREE = {"max_depth": 5, "max_bins": 64}


@register("train_dt", RULE_PRED_SQL, ["fx_rule"])
def q_train_dt(spark, sf):
    b, _, _ = _fit(spark, sf, "DT", TREE)
    return _predicted(b, _rule(spark, sf))


@register("train_dt_sampled", """select y, count(*) as n, true as mostly_right from fx_rule group by y""", ["fx_rule"])
def q_train_dt_sampled(spark, sf):
    """Feature sampling may leave a mixed leaf where x1 wasn't drawn, so the
    rule fixes the share of right predictions per class, not each row's."""
    b, _, _ = _fit(spark, sf, "DT", {"max_depth": 30, "max_features": "sqrt", "min_samples_leaf": 2,
                                     "random_state": 2, "class_weight": "balanced"})
    right = (F.col("predicted_label").cast("int") == F.col("y")).cast("double")
    return M.predict(b, _rule(spark, sf)).groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(right) >= 0.99).alias("mostly_right"))


@register("train_dt_sampled_rows")
def q_train_dt_sampled_rows(spark, sf):
    """Every row's prediction of the same tree; which leaves are mixed depends on the draws."""
    b, _, _ = _fit(spark, sf, "DT", {"max_depth": 30, "max_features": "sqrt", "min_samples_leaf": 2,
                                     "random_state": 2, "class_weight": "balanced"})
    return _predicted(b, _rule(spark, sf))


@register("train_rfc", RULE_PRED_SQL, ["fx_rule"])
def q_train_rfc(spark, sf):
    b, _, _ = _fit(spark, sf, "RFC", {**TREE, "n_estimators": 5, "max_features": "all", "random_state": 1})
    return _predicted(b, _rule(spark, sf))


@register("train_rfr", """select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(yr, 6) as predicted
from fx_rule""", ["fx_rule"])
def q_train_rfr(spark, sf):
    b, _, _ = _fit(spark, sf, "RFR", {**TREE, "n_estimators": 5, "max_features": "all", "random_state": 1},
                   target="yr")
    return _predicted(b, _rule(spark, sf, "yr"))


@register("train_lr", RULE_PRED_SQL, ["fx_rule"])
def q_train_lr(spark, sf):
    b, _, _ = _fit(spark, sf, "LR", {})
    return _predicted(b, _rule(spark, sf))


@register("train_svm", RULE_PRED_SQL, ["fx_rule"])
def q_train_svm(spark, sf):
    b, _, _ = _fit(spark, sf, "SVM", {})
    return _predicted(b, _rule(spark, sf))


@register("train_svm_ring", """select kernel, (select count(*) from orders) as n, kernel = 'rbf' as learned
from (values ('linear'), ('rbf')) k(kernel)""")
def q_train_svm_ring(spark, sf):
    """A rule no plane can part, y = inside a circle: learned with Fourier features, saved and read again."""
    o = table(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 37 % 101 / 100).alias("x1"), (F.col("o_custkey") * 53 % 97 / 96).alias("x2"))
    inside = F.pow(F.col("x1") - 0.5, F.lit(2)) + F.pow(F.col("x2") - 0.5, F.lit(2)) < 0.1
    t = t.withColumn("y", inside.cast("int"))
    parts = []
    for kernel in ("linear", "rbf"):
        b, _, _ = M.train(t, "y", "SVM", {"kernel": kernel, "C": 10.0, "max_iter": 30, **({"n_components": 128} if kernel == "rbf" else {})}, key=["id"], split=False, seed=2)
        path = shared_path(spark, "bundle")
        M.save_bundle(b, path)
        right = F.avg((F.col("predicted_label").cast("int") == F.col("y")).cast("double"))
        parts.append(M.predict(M.load_bundle(spark, path), t).agg(
            F.lit(kernel).alias("kernel"), F.count(F.lit(1)).alias("n"), (right >= 0.95).alias("learned")))
    return parts[0].unionByName(parts[1])


@register("auto_classification", RULE_PRED_SQL, ["fx_rule"])
def q_auto_classification(spark, sf):
    b, _, _ = _fit(spark, sf, "Auto-Classification", {"time_budget": 10})
    return _predicted(b, _rule(spark, sf))


@register("auto_regression", """select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(yr, 6) as predicted
from fx_rule""", ["fx_rule"])
def q_auto_regression(spark, sf):
    b, _, _ = M.train(_rule(spark, sf, "yr"), "yr", "Auto-Regression", {"time_budget": 10}, key=RULE_KEY,
                      split=False)
    return _predicted(b, _rule(spark, sf, "yr"))


@register("train_pipeline", RULE_PRED_SQL, ["fx_rule"])
def q_train_pipeline(spark, sf):
    b, _, test = M.train(_rule(spark, sf), "y", "DT", TREE, key=RULE_KEY, split=True, test_size=0.2, seed=2)
    train_rows = _predicted(b, _rule(spark, sf))
    return train_rows


@register("predict", RULE_PRED_SQL, ["fx_rule"])
def q_predict(spark, sf):
    b, _, _ = _fit(spark, sf, "LR", {})
    return _predicted(b, _rule(spark, sf))


@register("predict_proba", """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
  cast(y as double) as p from fx_rule""", ["fx_rule"])
def q_predict_proba(spark, sf):
    b, _, _ = _fit(spark, sf, "DT", TREE)
    return M.predict_proba(b, _rule(spark, sf)).select(*RULE_KEY, F.round("p", 9).alias("p"))


@register("score_batch", RULE_PRED_SQL, ["fx_rule"])
def q_score_batch(spark, sf):
    b, _, _ = _fit(spark, sf, "DT", TREE)
    path = shared_path(spark, "bundle")
    M.save_bundle(b, path)
    scored = M.score_batch(spark, _rule(spark, sf).drop("y"), path, key=RULE_KEY)
    return scored.select(*RULE_KEY, F.col("predicted_label").cast("int").alias("predicted"))


@register("bundle_roundtrip", RULE_PRED_SQL, ["fx_rule"])
def q_bundle_roundtrip(spark, sf):
    b, _, _ = _fit(spark, sf, "RFC", {**TREE, "n_estimators": 5, "max_features": "all", "random_state": 1})
    path = shared_path(spark, "bundle")
    M.save_bundle(b, path)
    return _predicted(M.load_bundle(spark, path), _rule(spark, sf))


@register("evaluate_bundle", """
select 'DT' as model, 1.0::double as accuracy, 1.0::double as auc, 1.0::double as precision_binary,
  1.0::double as recall_binary, 1.0::double as precision_weighted, 1.0::double as recall_weighted,
  1.0::double as precision_macro, 1.0::double as recall_macro, 1.0::double as precision_micro,
  1.0::double as recall_micro, 1.0::double as f1_weighted, 0.0::double as log_loss
""")
def q_evaluate_bundle(spark, sf):
    b, _, test = M.train(_rule(spark, sf), "y", "DT", TREE, key=RULE_KEY, split=True, test_size=0.2, seed=2)
    res = M.evaluate(b, test, n_samples=20, seed=2, key=RULE_KEY, name="DT")
    s = res["scores"]
    return s.withColumns({c: F.round(F.col(c), 9) for c in s.columns if c != "model"})


@register("evaluate_samples", f"""
with s as (select *, {RULE_HASH.format(seed="2")} as h from fx_rule),
rk as (select *, row_number() over (partition by y order by h, l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 as rn from s),
cnt as (select y, count(*) as nc from s group by y), {_alloc_sql('cnt', '0.2', 'al')},
te as (select rk.* from rk join al using (y) where rn < ntest),
tk as (select y, cast(floor(20 * count(*) / (select count(*) from te)) as bigint) as k from te group by y)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(x1, 6) as x1, round(x2, 6) as x2, round(x3, 6) as x3,
  cast(y as varchar) as true_label, cast(y as varchar) as predicted_label, {RULE_HASH.format(seed="2s")} as sample_order
from te join tk using (y) where rn < k
""", ["fx_rule"])
def q_evaluate_samples(spark, sf):
    b, _, test = M.train(_rule(spark, sf), "y", "DT", TREE, key=RULE_KEY, split=True, test_size=0.2, seed=2)
    return _r(M.evaluate(b, test, n_samples=20, seed=2, key=RULE_KEY, name="DT")["predicted_samples"], ["x1", "x2", "x3"], 6)


@register("search_grid", """select cast(row_number() over (order by d, m) - 1 as integer) as setting,
  '{"maxDepth": ' || d || ', "minInstancesPerNode": ' || m || '}' as params, 1.0::double as mean_score
from (values (1), (3), (5)) a(d), (values (1), (2)) b(m)""")
def q_search_grid(spark, sf):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(
        _rule(spark, sf).withColumn("label", F.col("y").cast("double")))
    scores, _ = M.grid_search(df, DecisionTreeClassifier(maxBins=64), {"max_depth": [1, 3, 5],
                                                                      "min_samples_leaf": [1, 2]}, k=3, key=RULE_KEY)
    return _r(scores, ["mean_score"])


@register("search_random", """select cast(range as integer) as setting, 1.0::double as mean_score, true as in_space
from range(6)""")
def q_search_random(spark, sf):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(
        _rule(spark, sf).withColumn("label", F.col("y").cast("double")))
    scores, _ = M.random_search(df, DecisionTreeClassifier(maxBins=64),
                                {"maxDepth": [1, 2, 3, 4, 5], "minInstancesPerNode": [1, 2, 5, 10]},
                                n_iter=6, k=3, seed=2, key=RULE_KEY)
    drawn = F.from_json("params", "maxDepth int, minInstancesPerNode int")
    fresh = F.count("params").over(Window.partitionBy("params")) == 1
    return scores.select("setting", F.round("mean_score", 9).alias("mean_score"), (
        drawn["maxDepth"].between(1, 5) & drawn["minInstancesPerNode"].isin(1, 2, 5, 10) & fresh).alias("in_space"))


@register("search_random_wide", """select cast(range as integer) as setting, 1.0::double as mean_score, true as in_space
from range(4)""")
def q_search_random_wide(spark, sf):
    """Draws from 10^12 listed settings and a range: none of them is listed."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(
        _rule(spark, sf).withColumn("label", F.col("y").cast("double")))
    space = {"maxBins": range(64, 1064), "minInstancesPerNode": range(1, 1001), "seed": range(10**6),
             "minInfoGain": M.Range(1e-9, 1e-3, log=True)}
    scores, _ = M.random_search(df, DecisionTreeClassifier(maxDepth=3), space, n_iter=4, k=3, seed=2, key=RULE_KEY)
    drawn = F.from_json("params", "maxBins int, minInstancesPerNode int, seed int, minInfoGain double")
    return scores.select("setting", F.round("mean_score", 9).alias("mean_score"), (
        drawn["maxBins"].between(64, 1063) & drawn["minInstancesPerNode"].between(1, 1000) & drawn["seed"].between(0, 999_999)
        & drawn["minInfoGain"].between(1e-9, 1e-3)).alias("in_space"))


@register("learning_curve_forest")
def q_learning_curve_forest(spark, sf):
    """The curve of a forest, with means and deviations as they come."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(
        _rule(spark, sf).withColumn("label", F.col("y").cast("double")))
    return M.learning_curve(df, RandomForestClassifier(numTrees=5, maxBins=64), [100, 1000, 5000], k=3, key=RULE_KEY)


@register("compare_models_trained", """
select model, 1.0::double as accuracy, 1.0::double as f1_weighted, 1 as rank_accuracy, 1 as rank_f1_weighted, true as best
from (values ('DT'), ('LR')) t(model)
""")
def q_compare_models_trained(spark, sf):
    """Two models, each trained on the rule."""
    rows = []
    for kind, params in [("DT", TREE), ("LR", {})]:
        b, _, test = M.train(_rule(spark, sf), "y", kind, params, key=RULE_KEY, split=True, seed=2)
        rows.append(M.evaluate(b, test, key=RULE_KEY, name=kind)["scores"])
    return _r(M.compare_models(rows, ["accuracy", "f1_weighted"]), ["accuracy", "f1_weighted"])


@register("learning_curve", """select size, 1.0::double as train_mean, true as valid_ok
from (values (100), (1000), (5000)) t(size)""")
def q_learning_curve(spark, sf):
    """The rule is learned exactly from the rows at hand; on unseen rows the
    score is within a rounding step of 1 from 1,000 rows on."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(
        _rule(spark, sf).withColumn("label", F.col("y").cast("double")))
    curve = M.learning_curve(df, DecisionTreeClassifier(maxBins=64), [100, 1000, 5000], k=3, key=RULE_KEY)
    return curve.select("size", F.round("train_mean", 9).alias("train_mean"),
                        (F.col("valid_mean") >= F.when(F.col("size") >= 1000, 0.995).otherwise(0.9)).alias("valid_ok"))


@register("compare_models", """
select 'DT' as model, 1.0::double as accuracy, 0.0::double as log_loss, 1 as rank_accuracy, 1 as rank_log_loss, true as best
union all select 'Swapped', 0.0::double, round(-ln(1e-15), 9)::double, 2, 2, false
""")
def q_compare_models(spark, sf):
    """A tree that knows the rule, and the same tree with its labels swapped."""
    b, _, test = M.train(_rule(spark, sf), "y", "DT", TREE, key=RULE_KEY, split=True, seed=2)
    rows = [M.evaluate(b, test, key=RULE_KEY, name="DT")["scores"],
            M.evaluate(b, test.withColumn("y", 1 - F.col("y")), key=RULE_KEY, name="Swapped")["scores"]]
    return _r(M.compare_models(rows, ["accuracy", "log_loss"]), ["accuracy", "log_loss"])


@register("impurity_importance", """
select 'x1' as feature, 1.0::double as importance union all select 'x2', 0.0::double
union all select 'x3', 0.0::double
""")
def q_impurity_importance(spark, sf):
    b, _, _ = _fit(spark, sf, "DT", TREE)
    return E.impurity_importance(b.pipeline.stages[-1], b.features)


# --------------------------------------------------------------- E2 - E5

W = {"x1": 0.5, "x2": -0.01, "x3": 2.0}  # linear score weights (fixed values)
SHAP_FEATS = list(W)


def _shap_table(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("x1"),
                    F.col("o_custkey").cast("double").alias("x2"),
                    ((F.col("o_orderkey") * 37) % 101).cast("double").alias("x3"))


def _linear_score(df):
    return df.withColumn("score", F.col("x1") * W["x1"] + F.col("x2") * W["x2"] + F.col("x3") * W["x3"])


def _shap(spark, sf):
    t = _shap_table(spark, sf)
    explain = X.sample_n(t, 50, 11, ["id"]).drop("sample_order")
    background = X.sample_n(t, 100, 12, ["id"]).drop("sample_order")
    return E.shapley_values(_linear_score, explain, background, SHAP_FEATS, "id", n_samples=8, seed=0,
                            bg_key=["id"]), explain


SHAP_SQL = f"""
t as (select o_orderkey as id, o_totalprice / 1000 as x1, cast(o_custkey as double) as x2,
  cast((o_orderkey * 37) % 101 as double) as x3 from orders),
ex as (select * from t order by {_h('id', 11)}, id limit 50),
bg0 as (select * from t order by {_h('id', 12)}, id limit 100),
bg as (select *, row_number() over (order by {_h('id', 0)}, id) - 1 as bgi from bg0),
s as (select ex.id, sm.s, {_hi(['ex.id', 'sm.s'], '0b')} % 100 as bgi from ex, range(8) sm(s)),
pairs as (select s.id, bg.x1 as b1, bg.x2 as b2, bg.x3 as b3 from s join bg using (bgi)),
mb as (select id, avg(b1) as m1, avg(b2) as m2, avg(b3) as m3,
  avg(0.5 * b1 - 0.01 * b2 + 2.0 * b3) as base from pairs group by id),
sv as (select ex.id, 'x1' as feature, 0.5 * (x1 - m1) as shap_value, base, 0.5 * x1 - 0.01 * x2 + 2.0 * x3 as fx
    from ex join mb using (id)
  union all select ex.id, 'x2', -0.01 * (x2 - m2), base, 0.5 * x1 - 0.01 * x2 + 2.0 * x3 from ex join mb using (id)
  union all select ex.id, 'x3', 2.0 * (x3 - m3), base, 0.5 * x1 - 0.01 * x2 + 2.0 * x3 from ex join mb using (id))"""


@register("shapley_linear", f"""with {SHAP_SQL}
select id, feature, round(shap_value, 9) as shap_value, round(base, 9) as base, round(fx, 9) as fx from sv
""")
def q_shapley_linear(spark, sf):
    sv, _ = _shap(spark, sf)
    return _r(sv, ["shap_value", "base", "fx"], 9)


@register("shapley_kernel", f"""
with t as (select o_orderkey as id, o_totalprice / 1000 as x1, cast(o_custkey as double) as x2,
  cast((o_orderkey * 37) % 101 as double) as x3 from orders),
ex as (select * from t order by {_h('id', 11)}, id limit 50),
bg as (select x1 as b1, x2 as b2, x3 as b3 from t order by {_h('id', 12)}, id limit 100),
v as (
  select id, x1 * x2 + 2.0 * x3 as v123, avg(b1 * b2 + 2.0 * b3) as v0, avg(x1 * b2 + 2.0 * b3) as v1, avg(b1 * x2 + 2.0 * b3) as v2,
         avg(b1 * b2 + 2.0 * x3) as v3, x1 * x2 + avg(2.0 * b3) as v12, avg(x1 * b2) + 2.0 * x3 as v13, avg(b1 * x2) + 2.0 * x3 as v23
  from ex, bg group by id, x1, x2, x3),
s as (
  select id, v0 as base, v123 as fx, unnest(['x1', 'x2', 'x3']) as feature,
         unnest([(v1 - v0) / 3 + (v12 - v2) / 6 + (v13 - v3) / 6 + (v123 - v23) / 3,
                 (v2 - v0) / 3 + (v12 - v1) / 6 + (v23 - v3) / 6 + (v123 - v13) / 3,
                 (v3 - v0) / 3 + (v13 - v1) / 6 + (v23 - v2) / 6 + (v123 - v12) / 3]) as shap_value from v)
select id, feature, round(shap_value, 5) as shap_value, round(base, 5) as base, round(fx, 5) as fx from s
""")
def q_shapley_kernel(spark, sf):
    """Weighted least squares over all coalitions, against the exact values of a score with an interaction."""
    t = _shap_table(spark, sf)
    explain, background = X.sample_n(t, 50, 11, ["id"]), X.sample_n(t, 100, 12, ["id"])
    score = lambda df: df.withColumn("score", F.col("x1") * F.col("x2") + 2.0 * F.col("x3"))
    return _r(E.kernel_shapley_values(score, explain, background, SHAP_FEATS, "id", bg_key=["id"]), ["shap_value", "base", "fx"], 5)


@register("shapley_importance", f"""with {SHAP_SQL}
select feature, round(avg(abs(shap_value)), 9) as shap_feature_importance from sv group by feature
""")
def q_shapley_importance(spark, sf):
    sv, _ = _shap(spark, sf)
    return _r(E.shapley_importance(sv), ["shap_feature_importance"], 9)


@register("shapley_summary", f"""with {SHAP_SQL},
imp as (select feature, row_number() over (order by avg(abs(shap_value)) desc, feature) as rank from sv
  group by feature),
xl as (select id, 'x1' as feature, x1 as feature_value from ex union all select id, 'x2', x2 from ex
  union all select id, 'x3', x3 from ex)
select sv.feature, id, round(shap_value, 9) as shap_value, round(feature_value, 9) as feature_value, rank
from sv join xl using (id, feature) join imp using (feature)
""")
def q_shapley_summary(spark, sf):
    sv, ex = _shap(spark, sf)
    out = E.shapley_summary(sv, ex, "id", SHAP_FEATS)
    return _r(out, ["shap_value", "feature_value"], 9)


@register("shapley_row", f"""with {SHAP_SQL},
one as (select * from sv where id = (select min(id) from ex))
select 'base' as term, round(any_value(base), 9) as value from one
union all select feature, round(shap_value, 9) from one
union all select 'output', round(any_value(base) + sum(shap_value), 9) from one
""")
def q_shapley_row(spark, sf):
    sv, ex = _shap(spark, sf)
    first = ex.agg(F.min("id")).first()[0]
    return _r(E.shapley_row(sv, "id", first), ["value"], 9)


# --------------------------------------------------------------- M6


def _knn_table(spark, sf):
    o = table(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"),
                 (F.col("o_totalprice") / 1000).alias("x1"), (F.col("o_custkey") / 100.0).alias("x2"),
                 (((F.col("o_orderkey") * 37) % 101) / 10.0).alias("x3"))
    return X.split_random(t, 0.2, 4, ["id"])


@register("knn_vote", f"""
with t as (select o_orderkey as id, o_orderstatus as label, o_totalprice / 1000 as x1, o_custkey / 100.0 as x2,
  ((o_orderkey * 37) % 101) / 10.0 as x3 from orders),
sp as (select *, row_number() over (order by {_h('id', 4)}, id) - 1 < (select ceil(cast(0.2 as double) * count(*))
  from orders) as is_test from t),
te as (select * from sp where is_test), tr as (select * from sp where not is_test),
d as (select te.id as qid, tr.id as tid, tr.label,
  sqrt((te.x1 - tr.x1) * (te.x1 - tr.x1) + (te.x2 - tr.x2) * (te.x2 - tr.x2) + (te.x3 - tr.x3) * (te.x3 - tr.x3))
  as dist from te, tr),
r as (select *, row_number() over (partition by qid order by dist, tid) as rn from d),
v as (select qid, label, count(*) as n from r where rn <= 5 group by qid, label),
w as (select qid, label, row_number() over (partition by qid order by n desc, label) as rk from v)
select qid as id, label as predicted_label from w where rk = 1
""")
def q_knn_vote(spark, sf):
    from sparkprep.operators.neighbors import knn_predict
    t = _knn_table(spark, sf)
    train = t.where("split = 'train'")
    query = t.where("split = 'test'")
    return knn_predict(train, query, ["x1", "x2", "x3"], "label", k=5)


WIDE = [f"x{i}" for i in range(1, 10)]
_WIDE_DIST = " + ".join(f"(te.{f} - tr.{f}) * (te.{f} - tr.{f})" for f in WIDE)


@register("knn_wide", f"""
with t as (select o_orderkey as id, o_orderstatus as label, o_totalprice / 10000 as x1, o_custkey / 100.0 as x2,
  dayofyear(o_orderdate) / 30.0 as x3, cast(year(o_orderdate) - 1990 as double) as x4,
  cast(isodow(o_orderdate) as double) as x5, cast(substr(o_orderpriority, 1, 1) as double) as x6,
  ((o_orderkey * 37) % 101) / 10.0 as x7, ((o_orderkey * 53) % 97) / 10.0 as x8,
  ((o_custkey * 29) % 89) / 10.0 as x9 from orders),
sp as (select *, row_number() over (order by {_h('id', 4)}, id) - 1 < (select ceil(cast(0.2 as double) * count(*))
  from orders) as is_test from t),
te as (select * from sp where is_test), tr as (select * from sp where not is_test),
d as (select te.id as qid, tr.id as tid, tr.label, sqrt({_WIDE_DIST}) as dist from te, tr),
r as (select *, row_number() over (partition by qid order by dist, tid) as rn from d)
select qid as id, tid as neighbor_id, label, rn as rank from r where rn <= 5
""")
def q_knn_wide(spark, sf):
    """The neighbours themselves, by nine features."""
    from sparkprep.operators.neighbors import knn_neighbors
    o = table(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"),
                 (F.col("o_totalprice") / 10000).alias("x1"), (F.col("o_custkey") / 100.0).alias("x2"),
                 (F.dayofyear("o_orderdate") / 30.0).alias("x3"),
                 (F.year("o_orderdate") - 1990).cast("double").alias("x4"),
                 (F.weekday("o_orderdate") + 1).cast("double").alias("x5"),
                 F.substring("o_orderpriority", 1, 1).cast("double").alias("x6"),
                 (((F.col("o_orderkey") * 37) % 101) / 10.0).alias("x7"),
                 (((F.col("o_orderkey") * 53) % 97) / 10.0).alias("x8"),
                 (((F.col("o_custkey") * 29) % 89) / 10.0).alias("x9"))
    t = X.split_random(t, 0.2, 4, ["id"])
    return knn_neighbors(t.where("split = 'train'"), t.where("split = 'test'"), WIDE, 5, "id", "id",
                         "label").select("id", "neighbor_id", "label", F.col("rank").cast("long").alias("rank"))


@register("train_knn", f"""
with s as (select *, {RULE_HASH.format(seed="2")} as h from fx_rule),
rk as (select *, row_number() over (partition by y order by h, l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 as rn from s),
cnt as (select y, count(*) as nc from s group by y), {_alloc_sql('cnt', '0.2', 'al')},
tr as (select rk.* from rk join al using (y) where rn >= ntest),
m as (select min(x1) as a1, max(x1) - min(x1) as b1, min(x2) as a2, max(x2) - min(x2) as b2,
  min(x3) as a3, max(x3) - min(x3) as b3 from tr),
sc as (select tr.*, (x1 - a1) / b1 as z1, (x2 - a2) / b2 as z2, (x3 - a3) / b3 as z3,
  row_number() over (partition by x1, x2, x3 order by l_orderkey, l_partkey, l_suppkey, l_linenumber) as copy from tr, m),
qv as (select distinct x1, x2, x3, (x1 - a1) / b1 as z1, (x2 - a2) / b2 as z2, (x3 - a3) / b3 as z3 from fx_rule, m),
d as (select q.x1, q.x2, q.x3, t.y, t.l_orderkey, t.l_partkey, t.l_suppkey, t.l_linenumber,
  sqrt((q.z1 - t.z1) * (q.z1 - t.z1) + (q.z2 - t.z2) * (q.z2 - t.z2) + (q.z3 - t.z3) * (q.z3 - t.z3)) as dist
  from qv q, sc t where t.copy <= 5),
r as (select *, row_number() over (partition by x1, x2, x3
  order by dist, l_orderkey, l_partkey, l_suppkey, l_linenumber) as rn from d),
v as (select x1, x2, x3, avg(cast(y as double)) as p from r where rn <= 5 group by 1, 2, 3)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when p > 0.5 then 1 else 0 end as predicted, round(p, 6) as p
from fx_rule join v using (x1, x2, x3)
""", ["fx_rule"])
def q_train_knn(spark, sf):
    """KNN through the estimator registry (M9 -> M10, M11), all rows."""
    rule = _rule(spark, sf)
    b, _, _ = M.train(rule, "y", "KNN", {"n_neighbors": 5}, key=RULE_KEY, split=True, seed=2)
    return M.predict(b, rule).select(*RULE_KEY, F.col("predicted_label").cast("int").alias("predicted"),
                                     F.round("p", 6).alias("p"))


# --------------------------------------------------------------- E2 on a trained model


@register("shapley_tree", f"""
with t as (select o_orderkey as id, cast((o_orderkey * 37) % 101 as double) as x1 from orders),
ex as (select * from t order by {_h('id', 11)}, id limit 50),
bg0 as (select * from t order by {_h('id', 12)}, id limit 100),
bg as (select *, row_number() over (order by {_h('id', 0)}, id) - 1 as bgi from bg0),
s as (select ex.id, sm.s, {_hi(['ex.id', 'sm.s'], '0b')} % 100 as bgi from ex, range(8) sm(s)),
mb as (select s.id, avg(cast(bg.x1 > 50 as double)) as m from s join bg using (bgi) group by 1),
one as (select id, c.class, case when (x1 > 50) = (c.class = '1') then 1.0 else 0.0 end::double as fx,
  case when c.class = '1' then m else 1 - m end as base from ex join mb using (id), (values ('0'), ('1')) c(class))
select id, class, f.feature, round(case when f.feature = 'x1' then fx - base else 0.0 end, 9)::double as shap_value,
  round(base, 9) as base, fx from one, (values ('x1'), ('x2'), ('x3')) f(feature)
""")
def q_shapley_tree(spark, sf):
    """Class probabilities of a trained tree: y = [x1 > 50], x2 and x3 play no part."""
    o = table(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 37) % 101).cast("double").alias("x1"),
                 (F.col("o_totalprice") / 1000).alias("x2"), F.col("o_custkey").cast("double").alias("x3"))
    t = t.withColumn("y", (F.col("x1") > 50).cast("int"))
    b, _, _ = M.train(t, "y", "DT", {"max_depth": 5, "max_bins": 128}, key=["id"], split=False)
    explain = X.sample_n(t, 50, 11, ["id"])
    background = X.sample_n(t, 100, 12, ["id"])
    sv = M.shapley_model(b, explain, background, "id", n_samples=8, seed=0, bg_key=["id"])
    return _r(sv, ["shap_value", "base", "fx"])
