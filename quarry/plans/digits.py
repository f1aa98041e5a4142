"""Digit classification (R kernlab/caret in the reference): linear, RBF and polynomial
SVMs, a cross-validated grid, multi-class report.  Bound to `embeddings` (64 floats,
10 labels, no learnable signal: these queries check that fits run and reproduce)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quarry.operators import evaluate, features, models
from quarry.plans.tables import read


def digits(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label"),
                    array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _split(spark, sf):
    return features.split_stratified(digits(spark, sf), "label", ["vec_id"], 0.7, seed=1)


def _report(predicted, iterations: int, converged: bool):
    """L7 of the held-out rows, with the most iterations of a fit and whether all fits converged."""
    report = evaluate.multiclass_report(predicted, "label", "prediction")
    return report.withColumns({"iterations": F.lit(iterations).cast("long"), "converged": F.lit(converged)})


def q_svm_linear(spark, sf):
    """K10 + L7: linear one-vs-rest SVM (C = 1), report on the held-out 30 %."""
    tr, te = _split(spark, sf)
    m = models.svm_linear(tr, "label", "features", c=1.0)
    return _report(m.transform(te), *models.fits_ended(m, 50))


def q_svm_rbf(spark, sf):
    """RBF kernel by random Fourier features (sigma 0.01) + linear SVM."""
    tr, te = _split(spark, sf)
    m, _ = models.svm_rbf(tr, "label", "features", sigma=0.01, c=1.0, seed=7)
    z = models.fourier_features(te, "features", sigma=0.01, seed=7)
    return _report(m.transform(z), *models.fits_ended(m, 50))


def q_svm_poly(spark, sf):
    """Polynomial kernel (degree 2) of all dimensions by a tensor sketch + linear SVM."""
    tr, te = _split(spark, sf)
    m, _ = models.svm_poly(tr, "label", "features", degree=2, c=1.0, seed=7)
    return _report(m.transform(models.tensor_sketch(te, "features", degree=2, seed=7)), *models.fits_ended(m, 50))


def q_grid_search(spark, sf):
    """5-fold cross-validated accuracy and kappa over sigma x C of the RBF kernel."""
    return models.grid_search(digits(spark, sf), "label", "features", {"sigma": [0.005, 0.01], "c": [0.1, 1.0]})


QUERIES = {"svm_linear": q_svm_linear, "svm_rbf": q_svm_rbf, "svm_poly": q_svm_poly, "grid_search": q_grid_search}
ORACLE: dict = {}
