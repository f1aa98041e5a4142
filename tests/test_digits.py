"""The digit queries fit with the operators' own iterations and the whole grid."""

import inspect

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quarry.operators import models
from quarry.plans import digits


OPERATORS = {"svm_linear": "svm_linear", "svm_rbf": "svm_rbf", "svm_poly": "svm_poly", "grid_search": "grid_search"}


def test_no_query_cuts_its_fits(monkeypatch):
    calls = {}
    monkeypatch.setattr(digits, "_split", lambda spark, sf: (None, None))
    monkeypatch.setattr(digits, "digits", lambda spark, sf: None)
    for query, name in OPERATORS.items():
        kept = inspect.signature(getattr(models, name))

        def fit(*args, name=name, kept=kept, **kwargs):
            bound = kept.bind(*args, **kwargs)
            bound.apply_defaults()
            calls[name] = [(bound.arguments.get(k), kept.parameters[k].default if k in kept.parameters else None)
                           for k in ("max_iter", "n_features")] + [bound.arguments.get("grid")]
            raise StopIteration

        monkeypatch.setattr(models, name, fit)
        try:
            digits.QUERIES[query](None, None)
        except StopIteration:
            pass
    assert len(calls) == 4 and all(used == own for got in calls.values() for used, own in got[:2])
    assert calls["grid_search"][2] == {"sigma": [0.005, 0.01], "c": [0.1, 1.0]}


def blobs(spark, centers, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, float(c), [float(v) for v in centers[c] + rng.normal(size=len(centers[c]))])
            for i, c in enumerate(rng.integers(0, len(centers), size=n))]
    return spark.createDataFrame(rows, "id long, label double, f array<double>").withColumn("features", array_to_vector("f"))


def test_votes_of_pairs(spark):
    centers = np.array([[0, 0], [5, 5], [0, 5], [5, 0]])
    df = blobs(spark, centers, 160)
    m = models.svm_one_vs_one(df, "label", "features", c=1.0, max_iter=20)
    assert len(m.pairs) == 6 and m.labels == [0.0, 1.0, 2.0, 3.0]
    got = m.transform(df).collect()
    for r in got:
        votes = dict.fromkeys(m.labels, 0)
        for (a, b), w, b0 in zip(m.pairs, m.weights, m.bias, strict=True):
            votes[a if w @ np.array(r["f"]) + b0 > 0 else b] += 1
        assert r["prediction"] == min(votes, key=lambda x: (-votes[x], x))
    assert sum(r["prediction"] == r["label"] for r in got) > 150
    fits = m.fits(spark).collect()
    assert [(r["first"], r["second"]) for r in fits] == m.pairs and all(r["converged"] == (r["iterations"] < 20) for r in fits)
    assert {r["converged"] for r in models.svm_one_vs_one(df, "label", "features", max_iter=1).fits(spark).collect()} == {False}


def test_votes_that_tie_and_rows_without_features(spark):
    m = models.OneVsOne([1.0, 2.0, 5.0], [(1.0, 2.0), (1.0, 5.0), (2.0, 5.0)], np.zeros((3, 1)), np.array([1.0, -1.0, 1.0]), [1, 1, 1], 5)
    df = spark.createDataFrame([(1, [0.0]), (2, None)], "id long, features array<double>")
    assert {r["id"]: r["prediction"] for r in m.transform(df).collect()} == {1: 1.0, 2: None}  # one vote each
    one = models.svm_one_vs_one(spark.createDataFrame([(3.0, [1.0])], "label double, f array<double>")
                                .withColumn("features", array_to_vector("f")), "label", "features")
    assert one.labels == [3.0] and one.pairs == []


def test_tensor_sketch_estimates_the_polynomial_kernel(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 64)) / 8
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "f array<double>").withColumn("features", array_to_vector("f"))
    for degree in (2, 3):
        got = models.tensor_sketch(df, "features", degree, n_features=4096, seed=1).select("f", vector_to_array("sketch").alias("z")).collect()
        f, z = np.array([r["f"] for r in got]), np.array([r["z"] for r in got])
        want, size = (f @ f.T + 1) ** degree - 1, (f * f).sum(1) + 1
        bound = 2 ** (degree / 2) * np.outer(size, size) ** (degree / 2) / np.sqrt(4096)
        error = np.abs(z @ z.T - want)
        assert np.mean(error / bound) < 1 and (error < 5 * bound).all()


def test_polynomial_machine_separates_what_lines_cannot(spark):
    rng = np.random.default_rng(6)
    rows = [(float(x * y > 0), [float(x), float(y)]) for x, y in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "label double, f array<double>").withColumn("features", array_to_vector("f"))
    m, z = models.svm_poly(df, "label", "features", degree=2, c=10.0, n_features=128)
    hit = m.transform(z).where(F.col("label") == F.col("prediction")).count() / 300
    turns, ended = models.fits_ended(m, 50)
    assert hit > 0.9 and turns > 0 and isinstance(ended, bool)
