import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quarry.operators import features, models


def known_linear(spark, n=50):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    return spark.createDataFrame([(i, float(a), float(b), float(3 + 2 * a - b)) for i, (a, b) in enumerate(zip(x1, x2))],
                                 "id long, x1 double, x2 double, y double"), x1, x2


def test_ols_recovers_exact_line(spark):
    df, _, _ = known_linear(spark)
    coefs, st = models.ols(df, "y", ["x1", "x2"])
    est = {r.term: r.estimate for r in coefs.collect()}
    assert abs(est["x1"] - 2) < 1e-8 and abs(est["x2"] + 1) < 1e-8 and abs(est["(Intercept)"] - 3) < 1e-8
    assert st["r2"] > 0.999999


def test_vif_both_definitions(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    b = a * 0.8 + rng.normal(size=200) * 0.5 + 1.0
    c = rng.normal(size=200) + 2.0
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)], "a double, b double, c double")
    X = np.column_stack([a, b, c])
    cen = {r.feature: r.vif for r in models.vif(df, ["a", "b", "c"]).collect()}
    unc = {r.feature: r.vif for r in models.vif(df, ["a", "b", "c"], centred=False).collect()}
    for i, name in enumerate("abc"):
        others = np.delete(X, i, axis=1)
        # centred: regression with a constant; uncentred: without, R^2 against sum of squares
        A = np.column_stack([np.ones(len(a)), others])
        r = X[:, i] - A @ np.linalg.lstsq(A, X[:, i], rcond=None)[0]
        r2 = 1 - r @ r / np.sum((X[:, i] - X[:, i].mean()) ** 2)
        assert abs(cen[name] - 1 / (1 - r2)) < 1e-8
        r = X[:, i] - others @ np.linalg.lstsq(others, X[:, i], rcond=None)[0]
        r2u = 1 - r @ r / np.sum(X[:, i] ** 2)
        assert abs(unc[name] - 1 / (1 - r2u)) < 1e-8


def test_rfe_drops_irrelevant(spark):
    df, _, _ = known_linear(spark)
    df = df.withColumn("noise", F.sin(F.col("id").cast("double")) * 0.001)
    r = {x.feature: (x.selected, x.rank) for x in models.rfe(df, "y", ["x1", "x2", "noise"], 2).collect()}
    assert r == {"x1": (True, 1), "x2": (True, 1), "noise": (False, 2)}


def known_logit(spark, n=2000):
    rng = np.random.default_rng(7)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    p = 1 / (1 + np.exp(-(-0.5 + 1.5 * x1 - 1.0 * x2)))
    y = (rng.uniform(size=n) < p).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))],
                                 "id long, x1 double, x2 double, y int")


def test_logit_recovery_and_score_equations(spark):
    df = known_logit(spark)
    coefs, st = models.logit(df, "y", ["x1", "x2"])
    est = {r.term: r.estimate for r in coefs.collect()}
    assert abs(est["x1"] - 1.5) < 0.25 and abs(est["x2"] + 1.0) < 0.25 and abs(est["(Intercept)"] + 0.5) < 0.25
    sc = models.score(st["model"], df, ["x1", "x2"], ["id", "y"])
    g = sc.agg(F.sum(F.col("y") - F.col("score")).alias("g0")).first().g0
    assert abs(g) < 1e-6  # score equation of the intercept at the optimum
    assert st["aic"] > 0 and st["deviance"] < st["null_deviance"]


def test_step_aic_keeps_signal(spark):
    df = known_logit(spark, 800).withColumn("junk", F.cos(F.col("id").cast("double")))
    path = models.step_aic(df, "y", ["x1", "x2", "junk"]).collect()
    assert path[0].action == "start"
    assert all(r.feature in ("junk",) for r in path[1:])


def test_stratified_split_exact(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    tr, te = features.split_stratified(df, "label", ["id"], 0.7, seed=9)
    counts = {r.label: r["count"] for r in tr.groupBy("label").count().collect()}
    assert counts == {1: 175, 0: 525} and tr.count() + te.count() == 1000
    assert tr.join(te, "id").count() == 0
    tr2, _ = features.split_stratified(df.repartition(5), "label", ["id"], 0.7, seed=9)
    assert sorted(r.id for r in tr.collect()) == sorted(r.id for r in tr2.collect())


def test_minmax_uses_train_bounds(spark):
    tr = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    te = spark.createDataFrame([(5.0,), (20.0,)], "x double")
    got = [r.x for r in features.minmax_apply(te, features.minmax_fit(tr, ["x"]), ["x"]).collect()]
    assert got == [0.5, 2.0]


def test_svms_on_blobs(spark):
    rng = np.random.default_rng(3)
    centers = np.array([[0, 0], [6, 6], [0, 6]])
    rows = [(i, float(c), [float(v) for v in centers[c] + rng.normal(size=2)]) for i, c in
            enumerate(rng.integers(0, 3, size=300))]
    df = spark.createDataFrame(rows, "id long, label double, f array<double>").withColumn("features", array_to_vector("f"))
    m = models.svm_linear(df, "label", "features", c=1.0, max_iter=10)
    acc = m.transform(df).where(F.col("label") == F.col("prediction")).count() / 300
    assert acc > 0.95
    m2, z = models.svm_rbf(df, "label", "features", sigma=0.1, c=10.0, n_features=64, seed=1, max_iter=10)
    acc2 = m2.transform(z).where(F.col("label") == F.col("prediction")).count() / 300
    assert acc2 > 0.9
    g = models.grid_search(df, "label", "features", {"c": [0.1, 1.0]}, folds=2, max_iter=3).collect()
    assert len(g) == 2 and all(0 <= r.accuracy <= 1 for r in g)


def test_residual_histogram(spark):
    from quarry.operators import aggs
    df, _, _ = known_linear(spark)
    df = df.withColumn("y", F.col("y") + F.sin(F.col("id").cast("double")))
    _, st = models.ols(df, "y", ["x1", "x2"])
    r = models.residuals(st["model"], df, "y", ["x1", "x2"], ["id"])
    h = aggs.histogram(r, "residual", 5).collect()
    assert sum(x.n for x in h) == 50 and max(x.bin for x in h) == 5


def test_least_squares_of_a_label_without_spread(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 0.0, 4.0) for i in range(20)], "a double, b double, zero double, four double")
    for y, want in (("zero", 0.0), ("four", 4.0)):
        coefs, stats = models.ols(df, y, ["a", "b"])
        got = {r["term"]: r for r in coefs.collect()}
        assert abs(got[models.INTERCEPT]["estimate"] - want) < 1e-9 and abs(got["a"]["estimate"]) < 1e-9
        assert got["a"]["p_value"] is None and stats["n"] == 20 and stats["rss"] < 1e-12 and stats["aic"] == -math.inf
