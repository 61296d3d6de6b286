"""Exact kNN against numpy brute force."""

import numpy as np
import pytest

from sparkprep.operators import neighbors
from sparkprep.operators.neighbors import build_index, knn_candidates, knn_neighbors, knn_predict


def _brute(tr, q, k):
    out = {}
    for qi, qx in q.items():
        d = sorted((float(np.sqrt(((np.array(qx) - np.array(tx)) ** 2).sum())), ti) for ti, (tx, _) in tr.items())
        out[qi] = [ti for _, ti in d[:k]]
    return out


def _data(spark, n_train, n_query, seed, clustered=False):
    rng = np.random.default_rng(seed)
    if clustered:
        xt = rng.integers(0, 3, (n_train, 3)).astype(float)
        xq = rng.integers(0, 3, (n_query, 3)).astype(float)
    else:
        xt = rng.normal(size=(n_train, 3)) * [1, 5, 0.1]
        xq = rng.normal(size=(n_query, 3)) * [1, 5, 0.1]
    lab = rng.integers(0, 3, n_train)
    tr = {i: (tuple(map(float, xt[i])), f"c{lab[i]}") for i in range(n_train)}
    q = {1000 + i: tuple(map(float, xq[i])) for i in range(n_query)}
    tdf = spark.createDataFrame([(i, *x, lb) for i, (x, lb) in tr.items()], "id long, a double, b double, c double, y string")
    qdf = spark.createDataFrame([(i, *x) for i, x in q.items()], "id long, a double, b double, c double")
    return tr, q, tdf, qdf


def test_knn_neighbors_exact(spark):
    tr, q, tdf, qdf = _data(spark, 400, 60, 1)
    got = {}
    for r in knn_neighbors(tdf, qdf, ["a", "b", "c"], 5, "id", "id", "y").collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor_id))
    want = _brute(tr, q, 5)
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == want


def test_knn_ties_and_vote(spark):
    tr, q, tdf, qdf = _data(spark, 300, 40, 2, clustered=True)
    want = _brute(tr, q, 4)
    pred = {r.id: r.predicted_label for r in knn_predict(tdf, qdf, ["a", "b", "c"], "y", k=4).collect()}
    for qi, nbrs in want.items():
        labels = [tr[t][1] for t in nbrs]
        counts = {lb: labels.count(lb) for lb in set(labels)}
        best = sorted(counts, key=lambda lb: (-counts[lb], lb))[0]
        assert pred[qi] == best


def test_knn_far_away_queries(spark):
    """Queries much farther from the pivot than any training row still get
    their k nearest rows (the last band must cover train and query radii)."""
    tr, _, tdf, _ = _data(spark, 200, 1, 3)
    q = {5000: (100.0, -80.0, 3.0), 5001: (-60.0, 40.0, 0.0), 5002: (0.1, 0.2, 0.0)}
    qdf = spark.createDataFrame([(i, *x) for i, x in q.items()], "id long, a double, b double, c double")
    got = {}
    for r in knn_neighbors(tdf, qdf, ["a", "b", "c"], 3, "id", "id", "y").collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor_id))
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == _brute(tr, q, 3)


def _wide(spark, n_train, n_query, n_dim, seed):
    """Rows around a few hundred centres in ``n_dim`` dimensions."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(200, n_dim)) * 5
    x = centres[rng.integers(0, 200, n_train + n_query)] + rng.normal(size=(n_train + n_query, n_dim)) * 0.5
    names = [f"f{i}" for i in range(n_dim)]
    rows = [(i, *map(float, v), "a") for i, v in enumerate(x)]
    schema = ", ".join(["id long", *[f"{n} double" for n in names], "y string"])
    df = spark.createDataFrame(rows, schema)
    return x, names, df.where(f"id < {n_train}"), df.where(f"id >= {n_train}").drop("y")


def test_knn_ten_features_prunes_and_is_exact(spark):
    n_train, n_query = 4000, 200
    x, names, tdf, qdf = _wide(spark, n_train, n_query, 10, 5)
    got = {}
    for r in knn_neighbors(tdf, qdf, names, 5, "id", "id", "y").collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor_id))
    d = np.sqrt(((x[n_train:, None, :] - x[None, :n_train, :]) ** 2).sum(-1))
    want = {n_train + i: [int(j) for j in np.argsort(d[i], kind="stable")[:5]] for i in range(n_query)}
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == want
    _, pairs = knn_candidates(build_index(tdf, names, 5, "id", "y"), qdf, names, "id")
    assert pairs < 0.1 * n_train * n_query


@pytest.mark.parametrize("few", [True, False])
def test_knn_deep_tree(spark, monkeypatch, few):
    """Many levels, copies on both sides, and more neighbours asked for than rows near by; with joins instead of broadcasts, too."""
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 6)
    monkeypatch.setattr(neighbors, "FANOUT", 4)
    if not few:
        monkeypatch.setattr(neighbors, "MAX_BROADCAST_ROWS", 0)
    tr, q, tdf, qdf = _data(spark, 300, 30, 7)
    twice = qdf.unionByName(qdf.withColumn("id", qdf.id + 5000))
    got = {}
    for r in knn_neighbors(tdf, twice, ["a", "b", "c"], 40, "id", "id", "y").collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor_id))
    want = _brute(tr, q, 40)
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == {**want, **{k + 5000: v for k, v in want.items()}}
    assert knn_neighbors(tdf.limit(3), qdf, ["a", "b", "c"], 40, "id", "id", "y").count() == 3 * 30
    assert knn_neighbors(tdf, qdf.limit(0), ["a", "b", "c"], 4, "id", "id", "y").count() == 0


def test_knn_levels_grow_and_candidates_do_not(spark):
    """The tree grows with the table: candidates per query stay about the same."""
    rng = np.random.default_rng(11)
    per_query = []
    for n in (2_000, 20_000):
        tdf = spark.createDataFrame([(i, *map(float, v), "a") for i, v in enumerate(rng.random((n, 2)))], "id long, a double, b double, y string")
        qdf = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.random((100, 2)))], "id long, a double, b double")
        index = build_index(tdf, ["a", "b"], 5, "id", "y")
        assert index.rows.count() == n and index.rows.groupBy("_leaf").count().where(f"count > {neighbors.LEAF_ROWS}").count() == 0
        vectors, pairs = knn_candidates(index, qdf, ["a", "b"], "id")
        per_query.append(pairs / vectors)
    assert max(per_query) <= 2 * min(per_query)


def test_knn_bundle_builds_its_index_once(spark, monkeypatch, tmp_path):
    from sparkprep.plans import model
    builds = []
    monkeypatch.setattr(model, "build_index", lambda *a, **k: builds.append(1) or build_index(*a, **k))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 2))
    df = spark.createDataFrame([(i, float(a), float(b), "in" if a * a + b * b < 1 else "out") for i, (a, b) in enumerate(x)], "id long, a double, b double, t string")
    b, _, test = model.train(df, "t", "KNN", {"n_neighbors": 7}, key=["id"])
    model.save_bundle(b, str(tmp_path / "knn"))
    c = model.load_bundle(spark, str(tmp_path / "knn"))
    first = {r.id: (r.predicted_label, r.p) for r in model.predict(b, test).collect()}
    assert first == {r.id: (r.predicted_label, r.p) for r in model.predict(c, test).collect()}
    assert first == {r.id: (r.predicted_label, r.p) for r in model.predict(c, test).collect()}
    assert len(builds) == 1 and np.mean([first[r.id][0] == r.t for r in test.collect()]) > 0.9


@pytest.mark.parametrize("features", [3, 9])
def test_knn_hot_cells_are_shared_and_grown_cells_stay_exact(spark, monkeypatch, features):
    """Many queries of one cell are shared by tasks, candidates held are cut to the best, cells grow
    once there are as many as allowed; ties at the k-th distance go to the smallest key."""
    for name, value in (("LEAF_ROWS", 8), ("FANOUT", 4), ("MAX_CELLS", 5), ("TASK_QUERIES", 7), ("HELD_PAIRS", 10), ("MAX_LOCAL_CELLS", 2)):
        monkeypatch.setattr(neighbors, name, value)
    rng = np.random.default_rng(17)
    xt, xq = rng.integers(0, 4, (400, features)).astype(float), rng.integers(0, 4, (50, features)).astype(float)
    xq[:30] = xt[0] + rng.random((30, features)) / 8
    names = [f"f{i}" for i in range(features)]
    schema = "id long, " + ", ".join(f"{n} double" for n in names)
    tdf = spark.createDataFrame([(400 - i, *map(float, v), f"c{i % 3}") for i, v in enumerate(xt)], schema + ", y string")
    qdf = spark.createDataFrame([(1000 + i, *map(float, v)) for i, v in enumerate(xq)], schema)
    index = build_index(tdf, names, 6, "id", "y")
    assert 1 < index.nodes.count() <= 5 and index.rows.groupBy("_leaf").count().where("count > 8").count() == 0
    got = {}
    for r in neighbors.index_neighbors(index, qdf, names, "id").collect():
        got.setdefault(r._qk, []).append((r["rank"], r._tk, r._lab, r.distance))
    d = np.sqrt(((xq[:, None, :] - xt[None, :, :]) ** 2).sum(-1))
    for i in range(50):
        want = sorted((d[i, j], 400 - j, f"c{j % 3}") for j in range(400))[:6]
        assert [(t, lab) for _, t, lab, _ in sorted(got[1000 + i])] == [(t, lab) for _, t, lab in want]


def test_knn_vote_from_several_cells(spark, monkeypatch):
    """Votes gathered from rows of several cells, by queries on the borders between them."""
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 5)
    monkeypatch.setattr(neighbors, "FANOUT", 2)
    tr, _, tdf, _ = _data(spark, 200, 1, 21)
    index = build_index(tdf, ["a", "b", "c"], 7, "id", "y")
    q = {1000 + i: tuple((r.low if i % 2 else r.high)) for i, r in enumerate(index.nodes.orderBy("cell").collect())}
    assert len(q) >= 10
    qdf = spark.createDataFrame([(i, *x) for i, x in q.items()], "id long, a double, b double, c double")
    pred = {r.id: r.predicted_label for r in knn_predict(tdf, qdf, ["a", "b", "c"], "y", k=7).collect()}
    for i, near in _brute(tr, q, 7).items():
        labels = [tr[t][1] for t in near]
        assert pred[i] == min(set(labels), key=lambda lb: (-labels.count(lb), lb))
