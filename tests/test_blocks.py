"""Block sums of products against numpy; batched fits against single ones."""

import numpy as np
import pandas as pd

from quarry.operators import aggs, blocks, models


def frame(spark, x, names):
    return spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(5)


def test_gram_of_many_columns_in_one_pass(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 500)) + r.normal(size=500) * 10
    names = [f"c.{i}" for i in range(500)]
    g, s, n = models.gram(frame(spark, x, names), names)
    assert n == 300 and np.allclose(g, x.T @ x) and np.allclose(s, x.sum(0))


def test_correlations_over_pairs_that_are_present(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 5)) * [1, 5, 1e-3, 1, 1] + [1e9, 0, 1, 2, 3]
    x[:, 3] = 7.0
    x[r.random(x.shape) < 0.2] = np.nan
    x[1:, 4] = np.nan
    names = list("abcde")
    got = {(t["a"], t["b"]): t["r"] for t in aggs.corr_matrix(frame(spark, x, names), names).collect()}
    want = pd.DataFrame(x, columns=names)
    for a in "abc":
        for b in "abc":
            assert abs(got[a, b] - want[a].corr(want[b])) < 1e-6
    assert all(got[k] is None for k in got if {"d", "e"} & set(k))


def logistic(n=2000, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    x[:, 3] = x[:, 0] + 0.3 * r.normal(size=n)
    y = (r.random(n) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 2 * x[:, 1])))).astype(int)
    return x, y


def test_batched_fits_equal_single_ones(spark):
    x, y = logistic()
    names = ["a", "b", "c", "d"]
    df = frame(spark, np.column_stack([x, y]), [*names, "y"])
    sets = [names, ["a", "b"], ["c"], ["d", "b"]]
    for fit, cols in zip(blocks.logit_fits(df, "y", sets), sets, strict=True):
        coefs, stats = models.logit(df, "y", cols)
        want = {t["term"]: t for t in coefs.collect()}
        assert fit.converged and fit.n == 2000 and fit.cols == tuple(cols)
        assert abs(fit.aic - stats["aic"]) < 1e-4 and abs(fit.deviance - stats["deviance"]) < 1e-4
        for c, b, v, in zip([*cols, models.INTERCEPT], fit.beta, np.diag(fit.covariance), strict=True):
            assert abs(b - want[c]["estimate"]) < 1e-4 and abs(np.sqrt(v) - want[c]["std_error"]) < 1e-4
        assert all(abs(p - want[c]["p_value"]) < 1e-4 for c, p in fit.p_values().items())
        m = np.column_stack([df.toPandas()[cols].to_numpy(), np.ones(2000)])
        score = m.T @ (df.toPandas()["y"].to_numpy() - 1 / (1 + np.exp(-(m @ fit.beta))))
        assert np.abs(score).max() < 1e-2


def test_a_batch_takes_the_passes_of_its_slowest_fit(spark, monkeypatch):
    x, y = logistic(400)
    names = ["a", "b", "c", "d"]
    df = frame(spark, np.column_stack([x, y]), [*names, "y"])
    passes, plain = [], blocks.summed_rows
    monkeypatch.setattr(blocks, "summed_rows", lambda *a: passes.append(1) or plain(*a))
    fits = blocks.logit_fits(df, "y", [["a"], ["a", "b"], ["c", "d"]])
    assert len(passes) == 1 + max(f.iterations for f in fits)


def test_fits_that_cannot_converge_say_so(spark):
    df = frame(spark, np.array([[-1.0, 0], [-2, 0], [1, 1], [2, 1]]), ["x", "y"])
    fit = blocks.logit_fits(df, "y", [["x"]], max_iter=4)[0]
    assert not fit.converged and fit.iterations == 4
    assert blocks.logit_fits(df.limit(0), "y", [["x"]])[0].n == 0


def test_step_path_is_that_of_single_fits(spark):
    x, y = logistic(600, 5)
    names = ["a", "b", "c", "d"]
    df = frame(spark, np.column_stack([x, y]), [*names, "y"])
    path = models.step_aic(df, "y", names).collect()
    current = list(names)
    for s in path[1:]:
        current = [c for c in current if c != s["feature"]] if s["action"] == "drop" else [*current, s["feature"]]
        assert abs(models.logit(df, "y", current)[1]["aic"] - s["aic"]) < 1e-4
    assert {"a", "b"} <= set(current) or {"d", "b"} <= set(current)


def test_machines_of_all_labels_share_their_passes(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    r = np.random.default_rng(8)
    rows = [(float(i % 6) if i % 17 else None, r.normal(size=4).tolist() + [3.0]) for i in range(240)]  # the last column has no spread
    df = spark.createDataFrame(rows, "label double, f array<double>").repartition(3).withColumn("features", array_to_vector("f"))
    passes, real = [], blocks.summed_blocks
    monkeypatch.setattr(blocks, "summed_blocks", lambda *a: passes.append(1) or real(*a))
    m = models.svm_linear(df, "label", "features", c=2.0, max_iter=6)
    assert m.labels == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and max(m.iterations) <= 7
    assert len(passes) <= 2 + 1 + 6 * 10  # the longest fit's, not six fits' one after another
    both = df.withColumn("label", F.coalesce((F.col("label") == 2).cast("double"), F.lit(0.0))).coalesce(1).cache()
    one = LinearSVC(regParam=1 / (2.0 * 240), maxIter=6, standardization=False).fit(both)
    assert np.allclose(one.coefficients.toArray(), m.weights[2], atol=1e-8) and abs(one.intercept - m.bias[2]) < 1e-8
    assert one.summary().totalIterations == m.iterations[2] and m.weights[2][4] == 0


def test_sums_of_many_tasks_reach_the_driver_as_one(spark):
    from pyspark.sql import functions as F
    df = spark.range(500).select((F.col("id") % 3).cast("double").alias("y"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    rows = blocks.packed(df.repartition(70), "y", "x")

    def step(total, block):
        total[:, 0] += block[0].sum(0)

    assert blocks.summed_blocks(rows.repartition(70), 70, 1, 2, step)[:, 0].tolist() == [500 * 499 / 2, 500.0]
