"""Evaluation tables over a scored table ``(y, y_hat[, p])``.

Count-based metrics reduce to one grouped pass into a per-class table (one
row per class).  Score-based results (ROC / PR points, rank AUC) first
collapse rows to one row per distinct score (map-side combine), then run
the distributed ordered prefix sum, so the curve never sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.exprs import np_round
from sparkprep.operators.order import attach_row, ordered_prefix_sums
from sparkprep.session import cut_lineage

EPS = 1e-15  # log-loss clipping (fixed value)


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def per_class_table(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """(class, support, predicted, tp, precision, recall, f1) for every class seen
    on either side; one pass with partial aggregation."""
    cls_type = df.schema[y].dataType
    sides = F.array(
        F.struct(F.col(y).cast(cls_type).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 (F.col(y) == F.col(y_hat)).cast("int").alias("hit")),
        F.struct(F.col(y_hat).cast(cls_type).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"),
                 F.lit(0).alias("hit")))
    long = df.select(F.inline(sides))
    tab = long.groupBy("cls").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"),
                                  F.sum("hit").alias("tp"))
    prec = _safe_div(F.col("tp").cast("double"), F.col("predicted"))
    rec = _safe_div(F.col("tp").cast("double"), F.col("support"))
    tab = tab.withColumns({"precision": prec, "recall": rec})
    return tab.withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                          F.col("precision") + F.col("recall")))


def _score_aggs(pos_label) -> list[Column]:
    is_pos = F.col("cls") == F.lit(pos_label)
    n = F.sum("support")
    return [
        _safe_div(F.sum("tp").cast("double"), n).alias("accuracy"),
        F.max(F.when(is_pos, F.col("precision"))).alias("precision_binary"),
        F.max(F.when(is_pos, F.col("recall"))).alias("recall_binary"),
        _safe_div(F.sum(F.col("precision") * F.col("support")), n).alias("precision_weighted"),
        _safe_div(F.sum(F.col("recall") * F.col("support")), n).alias("recall_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        _safe_div(F.sum("tp").cast("double"), F.sum("predicted")).alias("precision_micro"),
        _safe_div(F.sum("tp").cast("double"), n).alias("recall_micro"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), n).alias("f1_weighted"),
        # hard-label AUC (compat): (TPR + TNR) / 2 for two classes
        F.avg("recall").alias("auc_hard"),
    ]


def accuracy(df: DataFrame, y="y", y_hat="y_hat") -> DataFrame:
    """V2."""
    return df.agg(F.avg((F.col(y) == F.col(y_hat)).cast("double")).alias("accuracy"))


def log_loss(df: DataFrame, y="y", p="p", pos_label=1) -> DataFrame:
    """V4: binary log loss with probabilities clipped to [1e-15, 1 - 1e-15]."""
    pt = F.when(F.col(y) == F.lit(pos_label), F.col(p)).otherwise(1 - F.col(p))
    clipped = F.greatest(F.least(pt, F.lit(1 - EPS)), F.lit(EPS))
    return df.agg(F.avg(-F.ln(clipped)).alias("log_loss"))


def auc_score(df: DataFrame, y="y", p="p", pos_label=1) -> DataFrame:
    """V3 (score form): area under the ROC curve from scores, ties counted
    half (Mann-Whitney).  Per-score counts -> ascending prefix sums."""
    by_score = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("score")).agg(
        F.count_if(F.col(y) == F.lit(pos_label)).alias("pos"),
        F.count_if(F.col(y) != F.lit(pos_label)).alias("neg"))
    cum = ordered_prefix_sums(by_score, ["score"], ["neg"])
    part = F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))
    return cum.agg(F.try_divide(F.sum(part), F.sum("pos") * F.sum("neg")).alias("auc_score"))


def prf(df: DataFrame, y="y", y_hat="y_hat", pos_label=1) -> DataFrame:
    """V5 - V9 in one row."""
    return per_class_table(df, y, y_hat).agg(*_score_aggs(pos_label))


def classification_scores(df: DataFrame, name: str, y="y", y_hat="y_hat", p: str | None = "p",
                          pos_label=1) -> DataFrame:
    """One score row labelled by model: accuracy, AUC (hard labels, as the
    reference computes it), log loss, precision / recall binary, weighted,
    macro, micro, weighted F1.  Binary-only scores are NULL for more classes."""
    tab = per_class_table(df, y, y_hat)
    scores = tab.agg(*_score_aggs(pos_label), F.count(F.lit(1)).alias("_k"))
    binary = F.col("_k") == 2
    scores = scores.select(
        F.lit(name).alias("model"), "accuracy",
        F.when(binary, F.col("auc_hard")).alias("auc"),
        *[F.when(binary, F.col(c)).alias(c) for c in ("precision_binary", "recall_binary")],
        "precision_weighted", "recall_weighted", "precision_macro", "recall_macro",
        "precision_micro", "recall_micro", "f1_weighted")
    if p:
        scores = attach_row(scores, log_loss(df, y, p, pos_label))
    return scores


def classification_report(df: DataFrame, y="y", y_hat="y_hat", decimals: int = 2) -> DataFrame:
    """Per class, 'macro avg' and 'weighted avg' rows of precision,
    recall, f1-score and support; half-even rounded (accuracy row omitted)."""
    tab = per_class_table(df, y, y_hat)
    per = tab.select(F.col("cls").cast("string").alias("class"), "precision", "recall",
                     F.col("f1").alias("f1_score"), F.col("support").cast("bigint").alias("support"))
    n = F.sum("support")
    macro = tab.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1_score"),
                    n.cast("bigint").alias("support"))
    weighted = tab.agg(F.lit("weighted avg").alias("class"),
                       (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_score"),
                       n.cast("bigint").alias("support"))
    out = per.unionByName(macro).unionByName(weighted)
    return out.select("class", *[np_round(c, decimals).alias(c) for c in ("precision", "recall", "f1_score")],
                      "support")


def confusion_matrix(df: DataFrame, y="y", y_hat="y_hat") -> DataFrame:
    """V1: wide matrix: rows ``True: c``, columns ``Predicted: c``, over the
    sorted union of classes on both sides (class list collected: its size is
    the number of classes)."""
    counts = df.groupBy(F.col(y).alias("_t"), F.col(y_hat).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    classes = sorted({r[0] for r in counts.select("_t").union(counts.select("_p")).distinct().collect()},
                     key=lambda v: (v is None, 0 if v is None else v))
    spark = df.sparkSession
    typ = df.schema[y].dataType
    rows = spark.createDataFrame([(c,) for c in classes], T.StructType([T.StructField("_t", typ)]))
    name = {c: "Predicted: " + ("null" if c is None else str(c)) for c in classes}
    wide = counts.groupBy(F.col("_t").alias("_w")).agg(
        *[F.coalesce(F.sum(F.when(F.col("_p").eqNullSafe(F.lit(c)), F.col("_n"))), F.lit(0)).alias(f"_c{i}") for i, c in enumerate(classes)])
    full = rows.join(wide, F.col("_t").eqNullSafe(F.col("_w")), "left")
    return full.select(F.concat(F.lit("True: "), F.coalesce(F.col("_t").cast("string"), F.lit("null"))).alias("label"),
                       *[F.coalesce(F.col(f"_c{i}"), F.lit(0)).cast("bigint").alias(name[c]) for i, c in enumerate(classes)])


def _curve_base(df: DataFrame, y: str, p: str, pos_label) -> DataFrame:
    """Per distinct score (descending): cumulative tps / fps and position,
    kept in the shared folder, as a curve reads it several times.  Rows
    without a score are left out."""
    by_score = df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("threshold")).agg(
        F.count_if(F.col(y) == F.lit(pos_label)).alias("pos"),
        F.count_if(F.col(y) != F.lit(pos_label)).alias("neg"))
    by_score = by_score.withColumn("_neg_t", -F.col("threshold"))
    sums = ordered_prefix_sums(by_score, ["_neg_t"], ["pos", "neg"], pos_name="i")
    return cut_lineage(sums.select("i", "cum_pos", "cum_neg"))


def roc_curve(df: DataFrame, model: str, y="y", p="p", pos_label=1, drop_intermediate: bool = True) -> DataFrame:
    """(fpr, tpr, model) at every distinct threshold, descending, with
    collinear interior points dropped and (0, 0) first.

    A point is kept when the second difference of fps or tps is non-zero
    (first and last always); neighbours come from an equi-join on position.
    """
    base = _curve_base(df, y, p, pos_label)
    tot = base.agg(F.max("i").alias("_last"), F.max("cum_pos").alias("_P"), F.max("cum_neg").alias("_N"))
    pts = attach_row(base, tot)
    if drop_intermediate:
        prev = base.select((F.col("i") + 1).alias("i"), F.col("cum_pos").alias("_pp"), F.col("cum_neg").alias("_pn"))
        nxt = base.select((F.col("i") - 1).alias("i"), F.col("cum_pos").alias("_np"), F.col("cum_neg").alias("_nn"))
        pts = pts.join(prev, "i", "left").join(nxt, "i", "left")
        d2p = F.col("_pp") - 2 * F.col("cum_pos") + F.col("_np")
        d2n = F.col("_pn") - 2 * F.col("cum_neg") + F.col("_nn")
        keep = (F.col("i") == 0) | (F.col("i") == F.col("_last")) | (F.col("_last") < 2) | (d2p != 0) | (d2n != 0)
        pts = pts.where(keep)
    # one class only: the rates are undefined -> NULL (ANSI would raise on x / 0)
    curve = pts.select(F.try_divide(F.col("cum_neg"), F.col("_N")).alias("fpr"),
                       F.try_divide(F.col("cum_pos"), F.col("_P")).alias("tpr"))
    origin = tot.select(F.try_divide(F.lit(0.0), F.col("_N")).alias("fpr"),
                        F.try_divide(F.lit(0.0), F.col("_P")).alias("tpr"))
    return origin.unionByName(curve).withColumn("model", F.lit(model))


def pr_curve(df: DataFrame, model: str, y="y", p="p", pos_label=1) -> DataFrame:
    """(precision, recall, model, proportion_1) per threshold up to the
    first one reaching full recall, plus the closing (1, 0) point."""
    base = _curve_base(df, y, p, pos_label)
    tot = base.agg(F.max("cum_pos").alias("_P"), F.max("cum_neg").alias("_N"))
    full = attach_row(base, tot)
    last = full.where(F.col("cum_pos") == F.col("_P")).agg(F.min("i").alias("_stop"))
    pts = attach_row(full, last).where(F.col("i") <= F.col("_stop"))
    prec = F.when((F.col("cum_pos") + F.col("cum_neg")) > 0,
                  F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).otherwise(F.lit(0.0))
    curve = pts.select(prec.alias("precision"), F.try_divide(F.col("cum_pos"), F.col("_P")).alias("recall"))
    end = tot.select(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    share = tot.select(F.try_divide(F.col("_P"), F.col("_P") + F.col("_N")).alias("proportion_1"))
    return attach_row(curve.unionByName(end).withColumn("model", F.lit(model)), share)


def regression_scores(df: DataFrame, name: str, y="y", y_hat="y_hat") -> DataFrame:
    """Explained variance, R2, MAE, MSE, RMSE in one aggregation."""
    err = F.col(y) - F.col(y_hat)
    one = df.agg(F.var_pop(err).alias("_ve"), F.var_pop(F.col(y)).alias("_vy"),
                 F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"))
    return one.select(F.lit(name).alias("model"),
                      (1 - F.try_divide(F.col("_ve"), F.col("_vy"))).alias("explained_variance"),
                      (1 - F.try_divide(F.col("mse"), F.col("_vy"))).alias("r2"),
                      "mae", "mse", F.sqrt("mse").alias("rmse"))


def positive_share(df: DataFrame, y="y", pos_label=1) -> DataFrame:
    """A29 on a scored table."""
    return df.agg(F.avg((F.col(y) == F.lit(pos_label)).cast("double")).alias("positive_share"))


def prediction_samples(df: DataFrame, n: int, seed, key: Sequence[str], classifier: bool = True,
                       y="true_label") -> DataFrame:
    """Stratified (X4) sample for classifiers, plain (X5) otherwise."""
    from sparkprep.operators.sampling import sample_n, sample_proportional
    if classifier:
        return sample_proportional(df, y, n, seed, key)
    return sample_n(df, n, seed, key)
