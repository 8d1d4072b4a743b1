"""Models against brute force or a baseline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.operators import clustering, evaluation, models
from reviewmill.operators.components import connected_components
from reviewmill.operators.dbscan import dbscan

SF = "/root/testdata/sf0.001"


def brute_dbscan(points, keys, eps, min_points):
    """Plain O(n^2) twin with the same numbering and border rules."""
    gaps = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    near = gaps <= eps * eps
    core = near.sum(axis=1) >= min_points
    label = np.full(len(points), -1)
    order = sorted(range(len(points)), key=lambda i: keys[i])
    current = 0
    for i in order:
        if not core[i] or label[i] != -1:
            continue
        stack = [i]
        label[i] = current
        while stack:
            here = stack.pop()
            for j in np.flatnonzero(near[here] & core & (label == -1)):
                label[j] = current
                stack.append(j)
        current += 1
    result = label.copy()
    for i in np.flatnonzero(~core):
        owners = label[near[i] & core]
        result[i] = owners.min() if len(owners) else -1
    return dict(zip(keys, map(int, result)))


def cloud(seed, dims):
    rng = np.random.default_rng(seed)
    blobs = [rng.normal(c, 0.35, (40, dims)) for c in (0.0, 2.2, 4.0)]
    bridge = np.linspace(0, 2.2, 6)[:, None] * np.ones((1, dims))
    copies = np.tile(rng.normal(8.0, 0.1, (1, dims)), (12, 1))
    return np.vstack([*blobs, bridge, copies, np.full((1, dims), 50.0), rng.uniform(-2, 6, (25, dims))])


@pytest.mark.parametrize("seed,dims", [(1, 2), (2, 4), (3, 5)])
def test_dbscan_equals_brute_force(make, seed, dims):
    points = cloud(seed, dims)
    keys = [f"k{i:04d}" for i in np.random.default_rng(seed).permutation(len(points))]
    names = [f"x{d}" for d in range(dims)]
    schema = "key string, " + ", ".join(f"{n} double" for n in names)
    df = make([(k, *map(float, p)) for k, p in zip(keys, points)], schema)
    got = {r["key"]: r["cluster"] for r in dbscan(df, names, "key", 0.8, 10).collect()}
    assert got == brute_dbscan(points, keys, 0.8, 10)
    assert len(set(got.values())) > 2


def test_dbscan_clusters_every_row_with_many_id_less_keys(make):
    df = make([(f"k{i}", float(i % 3), 0.0) for i in range(90)], "key string, x double, y double")
    rows = dbscan(df, ["x", "y"], "key", 0.5, 5).collect()
    assert len(rows) == 90 and {r["cluster"] for r in rows} == {0, 1, 2}


def test_dbscan_edges_of_a_crowded_cell_do_not_grow_with_its_points(make):
    from reviewmill.operators import dbscan as module

    def edges(n):
        rng = np.random.default_rng(n)
        points = [(f"k{i:05d}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 2.0, (n, 2)))]
        df = make(points, "pid string, x double, y double").withColumn("w", F.lit(1))
        core = module.core_points(df, ["x", "y"], 0.8, 10).filter("core")
        cells = module._boxes(core, ["x", "y"])
        return module._edges(core, cells, ["x", "y"], 0.8).count()

    assert edges(4000) <= 2 * edges(400)


def two_arcs(n, gap):
    """Two crowded sets whose boxes reach each other: arcs of one centre, ``gap`` apart."""
    rng = np.random.default_rng(n)
    angle = rng.uniform(0.3, 1.2, (2, n))
    radius = np.array([[0.25], [0.25 + gap]]) + rng.uniform(0, 0.02, (2, n)) * np.array([[-1], [1]])
    return radius * np.cos(angle), radius * np.sin(angle)


@pytest.mark.parametrize("gap,meets", [(0.3001, 0), (0.2999, 1)])
def test_crowded_cells_are_compared_in_linear_work(make, spark, gap, meets):
    """Box pairs looked at between two sets of n points that just miss, or just meet, each other grow no faster than n."""
    from reviewmill.operators.meeting import meeting_pairs

    looked = {}
    for n in (2_000, 16_000):
        x, y = two_arcs(n, gap)
        rows = [([int(i), 0], float(a), float(b)) for i in (0, 1) for a, b in zip(x[i], y[i])]
        points = make(rows, "cell array<bigint>, x double, y double")
        pairs = make([(1, 2, [0, 0], [1, 0])], "a int, b int, cell_a array<bigint>, cell_b array<bigint>")
        watch = []
        met = meeting_pairs(pairs, points, ["x", "y"], 0.3, 0.4, watch).count()
        if meets == 0:
            assert met == 0
        looked[n] = sum(watch)
    assert looked[16_000] < 8 * looked[2_000] + 100 and looked[16_000] < 16_000


def test_meeting_equals_brute_force(make):
    from reviewmill.operators.meeting import meeting_pairs

    rng = np.random.default_rng(5)
    sets = {i: rng.normal(rng.uniform(-1, 1, 3), 0.12, (rng.integers(1, 120), 3)) for i in range(14)}
    rows = [([i], *map(float, p)) for i, ps in sets.items() for p in ps]
    pairs = [(i, j, [i], [j]) for i in sets for j in sets if i < j]
    want = {
        (i, j) for i, j, _, _ in pairs if (((sets[i][:, None] - sets[j][None]) ** 2).sum(axis=2) <= 0.4**2).any()
    }
    met = meeting_pairs(
        make(pairs, "a int, b int, cell_a array<bigint>, cell_b array<bigint>"), make(rows, "cell array<bigint>, x double, y double, z double"), ["x", "y", "z"], 0.4, 0.23
    )
    assert {(r["a"], r["b"]) for r in met.collect()} == want and 3 < len(want) < len(pairs)
    none = make([], "a int, b int, cell_a array<bigint>, cell_b array<bigint>")
    assert meeting_pairs(none, make(rows, "cell array<bigint>, x double, y double, z double"), ["x", "y", "z"], 0.4, 0.23).count() == 0


def test_components_of_a_long_chain(make):
    vertices = make([(i,) for i in range(40)], "v int")
    edges = make([(i, i + 1) for i in range(0, 29)] + [(35, 33)], "a int, b int")
    got = {r["v"]: r["label"] for r in connected_components(vertices, edges).collect()}
    assert {got[i] for i in range(30)} == {0} and got[35] == 33 and got[31] == 31


def brute_silhouette(points, labels):
    gaps = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    scores = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            scores.append(0.0)
            continue
        a = gaps[i][mine].sum() / (mine.sum() - 1)
        b = min(gaps[i][labels == c].mean() for c in set(labels) if c != own)
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette_equals_brute_force(make):
    points = cloud(4, 3)
    labels = np.arange(len(points)) % 4
    labels[0] = 9  # a cluster of one
    df = make([(i, int(c), *map(float, p)) for i, (c, p) in enumerate(zip(labels, points))], "i int, c int, x double, y double, z double")
    row = clustering.silhouette(df, ["x", "y", "z"], "c").first()
    assert row["silhouette"] == pytest.approx(brute_silhouette(points, labels))
    assert (row["clusters"], row["n_rows"]) == (5, len(points))
    one = clustering.silhouette(df.withColumn("c", F.lit(1)), ["x"], "c").first()
    assert one["silhouette"] is None


def brute_euclidean(points, labels):
    gaps = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    names, at = np.unique(labels, return_inverse=True)
    sizes = np.bincount(at)
    sums = gaps @ np.eye(len(names))[at]
    own = np.arange(len(points)), at
    inner = sums[own] / np.maximum(1, sizes[at] - 1)
    means = sums / sizes
    means[own] = np.inf
    outer = means.min(axis=1)
    return float(np.where(sizes[at] == 1, 0.0, (outer - inner) / np.maximum(inner, outer)).mean())


@pytest.mark.parametrize("nodes,bound", [(20_000, 1e-12), (2_000, 0.004), (200, 0.05)])
def test_euclidean_silhouette_is_within_its_bound(make, nodes, bound):
    """5,000 rows against brute force: exact with a node for every point, else off by no more than the stated error."""
    from reviewmill.operators.euclid import euclidean_silhouette

    rng = np.random.default_rng(11)
    points = np.vstack([rng.normal(c, 0.5, (1245, 3)) for c in (0.0, 1.5, 3.0, 9.0)] + [np.full((19, 3), 2.0), rng.uniform(-9, 9, (1, 3))])
    labels = np.r_[np.repeat([0, 1, 2, 2], 1245), np.repeat(3, 19), 7]
    df = make([(int(c), *map(float, p)) for c, p in zip(labels, points)], "c int, x double, y double, z double")
    row = euclidean_silhouette(df, ["x", "y", "z"], "c", nodes).first()
    off = abs(row["silhouette"] - brute_euclidean(points, labels))
    assert off <= row["error"] + 1e-9 and row["error"] < bound
    assert (row["n_rows"], row["clusters"]) == (5000, 5)


def test_euclidean_silhouette_of_odd_tables(make):
    from reviewmill.operators.euclid import euclidean_silhouette

    schema = "c string, x double"
    assert euclidean_silhouette(make([], schema), ["x"], "c").first()["silhouette"] is None
    assert euclidean_silhouette(make([("a", 1.0)] * 3, schema), ["x"], "c").first()["silhouette"] is None
    assert euclidean_silhouette(make([("a", 1.0), ("b", 2.0)], schema), ["x"], "c").first()["silhouette"] is None
    row = euclidean_silhouette(make([("a", 1.0), ("a", 1.0), (None, 1.0), (None, 1.0)], schema), ["x"], "c").first()
    assert (row["silhouette"], row["error"], row["clusters"]) == (0.0, 0.0, 2)


def test_choice_of_cluster_count():
    assert clustering.choose_clusters([(2, 9.0, 0.5), (3, 5.0, 0.7), (4, 4.0, 0.7)]) == 3
    nan = float("nan")
    assert clustering.choose_clusters([(2, 100.0, nan), (3, 50.0, nan), (4, 45.0, nan), (5, 20.0, nan)]) == 3
    assert clustering.choose_clusters([(2, 9.0, None), (3, 5.0, None)]) == 2


def embeddings(spark):
    raw = spark.read.parquet(f"{SF}/embeddings.parquet")
    names = [f"e{i}" for i in range(16)]
    columns = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    rows = raw.select("vec_id", F.col("label").cast("bigint").alias("label"), *columns)
    return models.assemble(rows, names).select("vec_id", "label", "features", *names), names


def test_classifiers_beat_the_majority_class(spark):
    df, _ = embeddings(spark)
    # a target the features carry: which half of the space the first coordinates lie in
    target = F.when(F.col("e0") + F.col("e1") > 0.05, 2).when(F.col("e2") > 0, 1).otherwise(0).cast("bigint")
    df = df.withColumn("label", target)
    train, test = df.filter("vec_id % 4 != 0"), df.filter("vec_id % 4 = 0")
    majority = test.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    for fit in (
        models.fit_linear_svc,
        lambda d: models.fit_random_forest(d, trees=30, depth=6),
    ):
        predicted = fit(train.select("label", "features")).transform(test)
        predicted = predicted.withColumn("prediction", F.col("prediction").cast("bigint"))
        accuracy = evaluation.classification_metrics(predicted, "label", "prediction").first()["accuracy"]
        assert accuracy > majority + 0.1


def test_regressors_beat_the_mean(spark):
    df, names = embeddings(spark)
    df = df.withColumn("y", 3 * F.col("e0") - 2 * F.col("e1") + F.abs(F.col("e2")))
    linear = models.fit_linear_regression(df, "y").transform(df)
    boosted_model = models.fit_boosted_regression(df, "y", rounds=8, depth=3)
    boosted = boosted_model.transform(df)
    assert evaluation.regression_metrics(linear, "y", "prediction").first()["r2"] > 0.5
    assert evaluation.regression_metrics(boosted, "y", "prediction").first()["r2"] > 0.3
    top = models.feature_importance(df, boosted_model, names, top=2).collect()
    assert {r["feature"] for r in top} == {"e0", "e1"}


def numpy_svm(x, sign, weight, cost=1.0):
    """Newton with backtracking on the whole matrix."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    value = lambda v: 0.5 * v @ v + cost * (weight * np.maximum(0, 1 - sign * (x @ v)) ** 2).sum()
    for _ in range(100):
        short = np.maximum(0, 1 - sign * (x @ w))
        on = short > 0
        grad = w - 2 * cost * x.T @ (weight * sign * short)
        if np.linalg.norm(grad) < 1e-10:
            break
        step = np.linalg.solve(np.eye(len(w)) + 2 * cost * (x[on] * weight[on, None]).T @ x[on], -grad)
        t = 1.0
        while value(w + t * step) > value(w) and t > 1e-12:
            t /= 2
        w = w + t * step
    return value(w)


@pytest.mark.parametrize("dense", [True, False])
def test_squared_hinge_reaches_the_numpy_optimum(make, monkeypatch, tmp_path, dense):
    from pyspark.ml.linalg import Vectors

    from reviewmill.operators import svm

    if not dense:
        monkeypatch.setattr(svm, "MAX_DENSE", 1)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 4)) * [1, 5, 0.2, 1] + [0, 3, 0, 0]
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=240) > 0.5, 2, np.where(x[:, 1] > 3, 1, 0))
    w = rng.uniform(0.5, 2, 240)
    df = make([(float(a), float(b), Vectors.dense(r)) for a, b, r in zip(y, w, x)], None).toDF("label", "weight", "features").repartition(3)
    model = svm.fit_squared_hinge(df, weight="weight")
    for c, got in zip(model.classes, model.objective):
        want = numpy_svm(x, np.where(y == c, 1.0, -1.0), w)
        assert want - 1e-9 <= got <= want * (1 + 1e-4)
    right = model.transform(df).filter("prediction = label").count()
    assert right > 0.85 * 240
    again = svm.LinearClassifier.load(model.save(str(tmp_path / "svm")))
    assert (again.weights == model.weights).all() and again.classes == model.classes
    one = svm.fit_squared_hinge(df.filter("label = 1"))
    assert {r["prediction"] for r in one.transform(df).collect()} == {1.0}


def test_minibatch_kmeans_is_as_good_as_full(make):
    from reviewmill.operators.minibatch import fit_minibatch

    rng = np.random.default_rng(12)
    points = np.vstack([rng.normal(c, s, (700, 3)) for c, s in ((0, 1.0), (2.5, 0.7), (5, 0.3), (-4, 1.5))])
    names = ["x", "y", "z"]
    df = make([tuple(map(float, p)) for p in rng.permutation(points)], "x double, y double, z double").repartition(4)
    fitted = fit_minibatch(df, names, [2, 4, 5], starts=6)
    vectors = models.assemble(df, names)
    for k, model in fitted.items():
        full = clustering.fit_full_kmeans(vectors, k).summary.trainingCost
        assert model.inertia <= 1.02 * full
        labelled = model.transform(df)
        gaps = ((points[:, None] - np.array(model.clusterCenters())[None]) ** 2).sum(axis=2).min(axis=1).sum()
        assert model.inertia == pytest.approx(gaps) and labelled.select("cluster").distinct().count() == k
    assert fit_minibatch(df, names, [4], starts=6)[4].inertia == pytest.approx(fitted[4].inertia, rel=0.02)
    same = fit_minibatch(make([(1.0, 1.0, 1.0)] * 5, "x double, y double, z double"), names, [3], starts=2)[3]
    assert same.inertia == 0 and len(same.clusterCenters()) == 3
    with pytest.raises(ValueError):
        fit_minibatch(df.limit(0), names, [2])


def plain_boosting(x, y, rounds, rate, depth):
    """All columns and rows, every value a bin: one node after the other."""
    guess = np.full(len(y), y.mean())
    for _ in range(rounds):
        gradient = guess - y
        groups = [np.arange(len(y))]
        for _ in range(depth):
            after = []
            for rows in groups:
                g, best = gradient[rows], (1e-12, None)
                base = g.sum() ** 2 / (len(rows) + 1)
                for c in range(x.shape[1]):
                    for cut in np.unique(x[rows, c])[:-1]:
                        left = x[rows, c] <= cut
                        n = left.sum()
                        gain = g[left].sum() ** 2 / (n + 1) + g[~left].sum() ** 2 / (len(rows) - n + 1) - base
                        if gain > best[0] + 1e-9:
                            best = (gain, left)
                after += [rows] if best[1] is None else [rows[best[1]], rows[~best[1]]]
            groups = after
        for rows in groups:
            guess[rows] -= rate * gradient[rows].sum() / (len(rows) + 1)
    return guess


def test_boosting_equals_plain_trees(make, monkeypatch, tmp_path):
    from pyspark.ml.linalg import Vectors

    from reviewmill.operators import boosting

    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (150, 3)).astype(float)
    y = np.sin(x[:, 0]) * 3 + np.abs(x[:, 1] - 6) + 0.01 * rng.normal(size=150)
    df = make([(float(b), Vectors.dense(a), i) for i, (a, b) in enumerate(zip(x, y))], None).toDF("label", "features", "i").repartition(3)
    model = boosting.fit_boosted(df, rounds=4, rate=0.3, depth=3, rows=1.0, columns=1.0)
    got = {r["i"]: r["prediction"] for r in model.transform(df).collect()}
    want = plain_boosting(x, y, 4, 0.3, 3)
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-9
    again = boosting.BoostedTrees.load(model.save(str(tmp_path / "trees")))
    assert (again.predict(x) == model.predict(x)).all() and model.featureImportances.toArray()[2] < 0.1
    drawn = boosting.fit_boosted(df, rounds=20, depth=3)
    assert ((drawn.predict(x) - y) ** 2).mean() < 0.5 * y.var()
    same = boosting.fit_boosted(df.filter("i = 0"), rounds=2)
    assert same.predict(x[:1])[0] == pytest.approx(y[0])
    with pytest.raises(ValueError):
        boosting.fit_boosted(df.limit(0))


def test_lost_predictions_are_worked_out_again():
    from reviewmill.operators import boosting

    tree = boosting.Tree(np.array([0, -1, -1]), np.array([1, 0, 0]), np.array([0.0, 1.0, 10.0]))
    x = np.array([[0], [2]], np.uint8)

    class Sent:
        value = [tree] * 5

    for done in (0, 1, 2, 5, 3, 4):
        boosting._REMEMBERED.pop(("f", "other"), None)
        assert boosting._predictions("f", "b", x, 0.5, done, tree, type("S", (), {"value": [tree] * done})).tolist() == [0.5 + done, 0.5 + 10 * done]
    assert boosting._predictions("g", "b", x, 0.0, 1, tree, Sent).tolist() == [1.0, 10.0]


def test_class_weights(make):
    df = make([("a",)] * 6 + [("b",)] * 2, "y string")
    assert {r["y"]: r["weight"] for r in models.with_class_weights(df, "y").collect()} == {
        "a": pytest.approx(8 / 12), "b": pytest.approx(2.0),
    }


def test_kmeans_and_pca_recover_separated_blobs(make):
    points = np.vstack([np.random.default_rng(0).normal(c, 0.2, (30, 3)) for c in (-3.0, 0.0, 3.0)])
    names = ["x", "y", "z"]
    df = make([(i, *map(float, p)) for i, p in enumerate(points)], "i int, x double, y double, z double")
    sweep = clustering.kmeans_sweep(df, names, (2, 4))
    assert clustering.choose_clusters(sweep) == 3
    assert [row[0] for row in sweep] == [2, 3, 4]
    axes = clustering.pca_2d(df, names).agg(F.var_pop("pca1"), F.var_pop("pca2")).first()
    assert axes[0] > 10 * axes[1]


def test_model_data_with_both_encoders(spark):
    from reviewmill.plans import fixtures
    from reviewmill.plans.modeling import prepare_model_data

    data = prepare_model_data(fixtures.features(spark, SF), categorical=["source", "app_version"])
    assert {"source_kaggle", "app_version_freq"} <= set(data.features)
    meta = data.metadata.first()
    assert (meta["one_hot_columns"], meta["frequency_columns"]) == ("source", "app_version")
    assert meta["train_rows"] + meta["val_rows"] + meta["test_rows"] == meta["total_rows"]
    assert data.table.filter(" OR ".join(f"`{c}` IS NULL" for c in data.features)).count() == 0


def test_boosting_moves_drawn_rows_one_step_a_level():
    from reviewmill.operators import boosting

    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, (500, 3)).astype(np.uint8)
    column = np.array([0, 2, 1, -1, 0, 2, -1, *[-1] * 8])
    tree = boosting.Tree(column, np.array([3, 4, 2, 0, 1, 5, 0, *[0] * 8]), np.zeros(15))
    drawn, gradient, calls = np.array([0, 1, 2]), rng.random(500), []

    def start():
        calls.append(1)
        return np.ascontiguousarray(x.T), gradient, np.zeros(500, np.int64)

    for level in range(4):
        whole = tree.leaves(x, level)
        there = whole >= 2**level - 1  # not left behind in a leaf above
        for key in (("fit", "kept"), ("fit", f"lost at {level}")):  # a worker with and one without the level before
            got_x, got_gradient, node = boosting._open_rows(key, 0, level, tree, drawn, start)
            assert (node == whole[there]).all() and (got_gradient == gradient[there]).all() and (got_x.T == x[there]).all()
    assert len(calls) == 5  # the worker that keeps them reads the rows once


def test_cleaner_skips_no_step_that_matters(make):
    from reviewmill.functions.text import clean_text

    texts = ["é&amp;http://x.io/a b", "é\x07bell\ttab", "ﬁne  é", "é \U0001f600 ok", "www.x.io é", "é\n\ny", "\x85é", "中é"]
    got = [r[0] for r in make([(t,) for t in texts], "t string").select(clean_text(F.col("t"))).collect()]
    assert got == ["é& b", "ébell tab", "fine é", "é  ok", "é", "é y", "é", "é"]
