"""Impurity importance and sampled Shapley values as a Spark job.

Shapley values use the permutation-sampling estimator: for every explained
row and sample ``s`` a seeded permutation of the features and one seeded
background row are drawn; walking the permutation, feature after feature
switches from the background value to the row's own value, and each switch's
change in model output is that feature's contribution.  The average over
samples estimates the Shapley value, and per row the contributions sum
exactly to ``f(x) - base`` (``base`` = mean output of the drawn background
rows).

Job shape: rows x samples (explode) -> equi-join on the drawn background
index (the background is a bounded sample with a row index) -> explode the
``F + 1`` path steps -> **one** scoring pass -> ``lag`` within each
(row, sample) -> average per (row, feature).  No cross join; the work is
rows x samples x (features + 1).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.exprs import hash_hex, hash_int
from sparkprep.operators.order import rank_within

MAX_BROADCAST_BACKGROUND = 200_000  # rows; larger backgrounds use a shuffle join (fixed value)


def impurity_importance(model, names: Sequence[str]) -> DataFrame:
    """(feature, importance) sorted descending; empty when the model has
    no impurity importance (linear models)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    schema = "feature string, importance double"
    imp = getattr(model, "featureImportances", None)
    if imp is None:
        return spark.createDataFrame([], schema)
    vals = imp.toArray().tolist()
    return spark.createDataFrame(list(zip(names, [float(v) for v in vals])), schema) \
        .orderBy(F.col("importance").desc(), F.col("feature"))


def index_background(background: DataFrame, key: Sequence[str], seed) -> DataFrame:
    """Number background rows 0..B-1 in seeded hash order (``_bg``)."""
    return rank_within(background.withColumn("_bh", hash_hex(key, seed)), ["_bh", *key], name="_bg", hashed=True).drop("_bh")


def shapley_values(score: Callable[[DataFrame], DataFrame], explain: DataFrame, background: DataFrame,
                   features: Sequence[str], id_col: str, n_samples: int = 10, seed: int = 0,
                   bg_key: Sequence[str] | None = None, score_col: str = "score",
                   classes: Sequence[str | None] | None = None) -> DataFrame:
    """(id, feature, shap_value, base, fx) for every explained row and feature.

    With ``classes``, ``score_col`` is an array with one output per class,
    all from the same scoring pass, and the result has a column ``class``.

    ``score`` maps a DataFrame holding the feature columns to the same rows
    plus ``score_col`` (e.g. a model's positive-class probability).
    ``background`` must be a bounded sample (its size B is counted).
    """
    feats = list(features)
    nf = len(feats)
    bg = index_background(background.select(*(bg_key or []), *feats), bg_key or feats, seed)
    b_count = bg.count()
    if b_count == 0:
        raise ValueError("empty background sample")
    bg = bg.select("_bg", *[F.col(f).alias(f"_b_{f}") for f in feats])
    if b_count <= MAX_BROADCAST_BACKGROUND:
        bg = F.broadcast(bg)

    rows = explain.select(id_col, *feats).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    rows = rows.withColumn("_bg", F.pmod(hash_int([id_col, "_s"], f"{seed}b"), F.lit(b_count)))
    # seeded permutation of feature indexes, per (row, sample)
    keyed = F.array(*[F.struct(hash_hex([id_col, "_s", F.lit(f)], f"{seed}p").alias("h"), F.lit(j).alias("j"))
                      for j, f in enumerate(feats)])
    rows = rows.withColumn("_perm", F.transform(F.array_sort(keyed), lambda e: e["j"]))
    paired = rows.join(bg, "_bg")
    steps = paired.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(nf))))
    pos = {f: F.array_position(F.col("_perm"), F.lit(j)) for j, f in enumerate(feats)}
    hybrid = steps.select(
        id_col, "_s", "_t", "_perm",
        *[F.when(pos[f] <= F.col("_t"), F.col(f)).otherwise(F.col(f"_b_{f}")).alias(f) for f in feats])
    by = [id_col]
    scored = score(hybrid)
    if classes is None:
        scored = scored.select(id_col, "_s", "_t", "_perm", F.col(score_col).cast("double").alias("_f"))
    else:
        by = [id_col, "class"]
        names = F.array(*[F.lit(c).cast("string") for c in classes])
        scored = scored.select(id_col, "_s", "_t", "_perm", F.posexplode(score_col).alias("_o", "_f")).select(
            id_col, F.element_at(names, F.col("_o") + 1).alias("class"), "_s", "_t", "_perm", F.col("_f").cast("double").alias("_f"))
    w = Window.partitionBy(*by, "_s").orderBy("_t")
    deltas = scored.select(
        *by, "_s", "_t", "_f",
        (F.col("_f") - F.lag("_f").over(w)).alias("_d"),
        F.element_at(F.col("_perm"), F.greatest(F.col("_t"), F.lit(1))).alias("_j"))
    names = F.array(*[F.lit(f) for f in feats])
    contrib = (deltas.where(F.col("_t") > 0)
               .groupBy(*by, "_j").agg(F.avg("_d").alias("shap_value"))
               .withColumn("feature", F.element_at(names, F.col("_j") + 1)).drop("_j"))
    ends = deltas.groupBy(*by).agg(
        F.avg(F.when(F.col("_t") == 0, F.col("_f"))).alias("base"),
        F.max(F.when(F.col("_t") == nf, F.col("_f"))).alias("fx"))
    same = reduce(lambda a, b: a & b, [F.col(f"_a.{c}").eqNullSafe(F.col(f"_e.{c}")) for c in by])
    return contrib.alias("_a").join(ends.alias("_e"), same).select(
        *[f"_a.{c}" for c in by], "feature", "shap_value", "base", "fx")


def kernel_coalitions(n_features: int, n_coalitions: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(coalitions as rows of 0 and 1, their kernel weights), never empty or full.

    All of them if there are no more than ``n_coalitions``.  Otherwise sizes
    are taken whole from the outside in, as they weigh most, while they fit;
    the rest is drawn by size, each with its complement, and shares the
    weight of the sizes that are left."""
    m, rng = n_features, np.random.default_rng(seed)
    if m > 62:
        raise ValueError(f"{m} features, over the 62 that coalitions are made of")
    weight = {s: (m - 1) / (s * (m - s)) for s in range(1, m)}  # of all coalitions of a size together
    rows, weights, left = [], [], dict(weight)
    for s in range(1, m // 2 + 1):
        sizes = sorted({s, m - s})
        n = sum(math.comb(m, t) for t in sizes)
        if len(rows) + n > n_coalitions:
            break
        for t in sizes:
            rows += [sum(1 << j for j in c) for c in combinations(range(m), t)]
            weights += [weight[t] / math.comb(m, t)] * math.comb(m, t)
            left.pop(t)
    if left:
        sizes = sorted(left)
        p = np.array([left[t] for t in sizes])
        drawn = Counter()
        while len(drawn) < max(2, n_coalitions - len(rows)) and sum(drawn.values()) < 20 * n_coalitions:
            c = sum(1 << int(j) for j in rng.permutation(m)[:rng.choice(sizes, p=p / p.sum())])
            drawn.update([c, (1 << m) - 1 - c])
        each = sum(left.values()) / sum(drawn.values())
        rows += list(drawn)
        weights += [each * n for n in drawn.values()]
    z = np.array([[c >> j & 1 for j in range(m)] for c in rows], dtype=float).reshape(len(rows), m)
    return z, np.array(weights)


def kernel_solution(z: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(g, h): Shapley value j = sum over coalitions of g[., j] * (value - base) + h[j] * (fx - base).

    The weighted least squares with the last value fixed by the sum of all.
    The coalitions are the same for every row, so one solution of the normal equations serves all rows."""
    m = z.shape[1]
    if m == 1:
        return np.zeros((len(z), 1)), np.ones(1)
    x = z[:, :-1] - z[:, -1:]
    solve = np.linalg.pinv((x * weights[:, None]).T @ x) @ (x * weights[:, None]).T  # (m - 1) x coalitions
    h = -solve @ z[:, -1]
    return np.concatenate([solve, -solve.sum(axis=0, keepdims=True)]).T, np.append(h, 1 - h.sum())


def kernel_shapley_values(score: Callable[[DataFrame], DataFrame], explain: DataFrame, background: DataFrame,
                          features: Sequence[str], id_col: str, n_coalitions: int = 2048, seed: int = 0,
                          bg_key: Sequence[str] | None = None, score_col: str = "score",
                          classes: Sequence[str | None] | None = None) -> DataFrame:
    """E2 by weighted least squares: the same columns as :func:`shapley_values`.

    A coalition's value is the mean output over the whole background with the
    coalition's features set to the row's.  With ``n_coalitions`` of at least
    2 ** features - 2 the result is exact, otherwise coalitions are sampled by
    their kernel weight (:func:`kernel_coalitions`).

    rows x coalitions x background rows are made by ``explode`` and an
    equi-join on the background's row number, scored in one pass and averaged
    by a grouped sum; a second grouped sum applies the solved equations,
    whose coefficients are a table of coalitions x features.  Nothing is gathered per row.  The background must be a bounded
    sample, as every row meets all of it.
    """
    feats = list(features)
    z, weights = kernel_coalitions(len(feats), n_coalitions, seed)
    g, h = kernel_solution(z, weights)
    bg = index_background(background.select(*(bg_key or []), *feats), bg_key or feats, seed)
    b_count = bg.count()
    if b_count == 0:
        raise ValueError("empty background sample")
    bg = bg.select("_bg", *[F.col(f).alias(f"_b_{f}") for f in feats])
    spark = explain.sparkSession
    masks = [int(sum(1 << j for j in range(len(feats)) if r[j])) for r in z] + [0, (1 << len(feats)) - 1]
    coalitions = F.broadcast(spark.createDataFrame(list(enumerate(masks)), "_z int, _mask long"))
    rows = explain.select(id_col, *feats).withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1)))).join(coalitions, "_z")
    full = F.col("_mask") == masks[-1]  # needs no background
    rows = rows.withColumn("_bg", F.explode(F.when(full, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(b_count - 1)))))
    paired = rows.join(F.broadcast(bg) if b_count <= MAX_BROADCAST_BACKGROUND else bg, "_bg")
    own = {f: F.col("_mask").bitwiseAND(F.lit(1 << j)) != 0 for j, f in enumerate(feats)}
    scored = score(paired.select(id_col, "_z", *[F.when(own[f], F.col(f)).otherwise(F.col(f"_b_{f}")).alias(f) for f in feats]))
    by = [id_col]
    if classes is None:
        scored = scored.select(id_col, "_z", F.col(score_col).cast("double").alias("_f"))
    else:
        by = [id_col, "class"]
        names = F.array(*[F.lit(c).cast("string") for c in classes])
        scored = scored.select(id_col, "_z", F.posexplode(score_col).alias("_o", "_f")).select(
            id_col, F.element_at(names, F.col("_o") + 1).alias("class"), "_z", F.col("_f").cast("double").alias("_f"))
    value = scored.groupBy(*by, "_z").agg(F.avg("_f").alias("_v"))
    factors = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(g)], "_z int, _g array<double>")
    value = value.join(F.broadcast(factors), "_z", "left")
    none, all_ = F.col("_z") == len(z), F.col("_z") == len(z) + 1
    sums = value.groupBy(*by).agg(
        F.max(F.when(none, F.col("_v"))).alias("base"), F.max(F.when(all_, F.col("_v"))).alias("fx"),
        *[F.coalesce(F.sum(F.col("_v") * F.col("_g")[j]), F.lit(0.0)).alias(f"_s{j}") for j in range(len(feats))])
    spare = [float(v) for v in g.sum(axis=0)]
    parts = [F.struct(F.lit(f).alias("feature"), (F.col(f"_s{j}") - F.lit(spare[j]) * F.col("base")
                                                  + F.lit(float(h[j])) * (F.col("fx") - F.col("base"))).alias("shap_value")) for j, f in enumerate(feats)]
    return sums.select(*by, "base", "fx", F.inline(F.array(*parts))).select(*by, "feature", "shap_value", "base", "fx")


def shapley_importance(sv: DataFrame) -> DataFrame:
    """Mean absolute Shapley value per feature, descending."""
    return (sv.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("shap_feature_importance"))
            .orderBy(F.col("shap_feature_importance").desc(), F.col("feature")))


def shapley_summary(sv: DataFrame, x: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """Summary-plot data (feature, rank, id, shap_value, feature_value);
    rank 1 = most important feature by E3."""
    long = x.select(id_col, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("feature_value")) for f in features])))
    imp = shapley_importance(sv)
    imp = imp.withColumn("_neg", -F.col("shap_feature_importance"))
    ranked = rank_within(imp, ["_neg", "feature"], name="_r")
    ranked = ranked.select("feature", (F.col("_r") + 1).alias("rank"))
    return (sv.select(id_col, "feature", "shap_value").join(long, [id_col, "feature"])
            .join(F.broadcast(ranked), "feature"))


def shapley_row(sv: DataFrame, id_col: str, row_id) -> DataFrame:
    """E5: one prediction decomposed: a 'base' row, one row per feature, and
    an 'output' row (base + contributions = model output)."""
    one = sv.where(F.col(id_col) == F.lit(row_id))
    parts = one.select(F.col("feature").alias("term"), F.col("shap_value").alias("value"))
    base = one.agg(F.first("base").alias("value")).select(F.lit("base").alias("term"), "value")
    out = one.agg((F.first("base") + F.sum("shap_value")).alias("value")).select(
        F.lit("output").alias("term"), "value")
    return base.unionByName(parts).unionByName(out)


