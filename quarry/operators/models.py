"""Models fitted on Spark, results as tables.

Fits are Spark ML jobs (executors compute Gram matrices or gradients, the
driver holds p-sized state).  Selection loops (step-wise AIC, RFE, VIF
pruning) drive many small fits over one assembled, cached table; for least
squares one Gram aggregate serves every round.  Coefficient tables keep the
feature names; the intercept row is named ``(Intercept)``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import UnsupportedOperationException
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.blocks import Hinge, gram_blocks, hinge_fits, logit_fits, packed, packed_block
from quarry.operators.order import q
from quarry.session import cut_lineage

INTERCEPT = "(Intercept)"


def _vec(df: DataFrame, xs: Sequence[str], y: str | None = None, keep: Sequence[str] = (), nulls: str = "skip") -> DataFrame:
    va = VectorAssembler(inputCols=list(xs), outputCol="features", handleInvalid=nulls)
    cols = [q(k) for k in keep] + ["features"] + ([q(y).cast("double").alias("label")] if y else [])
    whole = F.lit(True)
    for x in xs:
        whole = whole & q(x).isNotNull()
    return va.transform(df.withColumn("__whole", whole)).select(*cols, "__whole")


def _table(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


COEF_SCHEMA = "term string, estimate double, std_error double, statistic double, p_value double"


# --------------------------------------------------------------------------- K1 / K2 / K3


def ols(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True):
    """K1: least squares with the full summary.

    Returns (coefficients DataFrame, stats dict: n, r2, adj_r2, aic, rss, sigma2, model).
    AIC as statsmodels: -2 log L + 2 k, k = number of coefficients; -inf for an exact fit.  A label
    without spread has an exact fit: its estimates have no standard errors, statistics or p-values (NULL).
    """
    v = cut_lineage(_vec(df, xs, y), "ols")
    m = LinearRegression(solver="normal", fitIntercept=intercept, regParam=0.0).fit(v)
    s = m.summary
    names = list(xs) + ([INTERCEPT] if intercept else [])
    est = list(m.coefficients) + ([m.intercept] if intercept else [])
    try:
        tests = [[float(v) for v in part] for part in (s.coefficientStandardErrors, s.tValues, s.pValues)]
    except UnsupportedOperationException:
        tests = [[None] * len(names)] * 3
    rows = [(n, float(e), *t) for n, e, *t in zip(names, est, *tests, strict=True)]
    n = s.numInstances
    rss = float(s.meanSquaredError) * n
    k = len(names)
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(rss / n) + 1) if rss > 0 else math.inf
    stats = dict(n=n, r2=float(s.r2), adj_r2=float(s.r2adj), rss=rss, sigma2=rss / max(n - k, 1),
                 aic=-2 * llf + 2 * k, model=m)
    return _table(df.sparkSession, rows, COEF_SCHEMA), stats


def logit(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True, cached: DataFrame | None = None):
    """K2: binomial GLM (logit link) with summary: coefficients (z, p), AIC, null and residual deviance."""
    v = cached if cached is not None else _vec(df, xs, y)
    m = GeneralizedLinearRegression(family="binomial", link="logit", fitIntercept=intercept, maxIter=50).fit(v)
    s = m.summary
    names = list(xs) + ([INTERCEPT] if intercept else [])
    est = list(m.coefficients) + ([m.intercept] if intercept else [])
    rows = [(n, float(e), float(se), float(t), float(p))
            for n, e, se, t, p in zip(names, est, s.coefficientStandardErrors, s.tValues, s.pValues)]
    stats = dict(aic=float(s.aic), deviance=float(s.deviance), null_deviance=float(s.nullDeviance),
                 df_residual=int(s.residualDegreeOfFreedom), model=m, iterations=int(s.numIterations),
                 converged=int(s.numIterations) < m.getMaxIter())
    return _table(df.sparkSession, rows, COEF_SCHEMA), stats


def logit_l2(df: DataFrame, y: str, xs: Sequence[str], c: float = 1.0, keep: Sequence[str] = ()):
    """K3: L2-penalised logistic regression with sklearn's C: regParam = 1 / (C n), no standardisation."""
    v = _vec(df, xs, y, keep).cache()
    n = v.count()
    m = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200,
                           tol=1e-10).fit(v)
    coefs = [(x, float(b)) for x, b in zip(xs, m.coefficients)] + [(INTERCEPT, float(m.intercept))]
    v.unpersist()
    return _table(df.sparkSession, coefs, "term string, estimate double"), m


# --------------------------------------------------------------------------- K8 / K9


def score(model, df: DataFrame, xs: Sequence[str], key: Sequence[str], out: str = "score") -> DataFrame:
    """Predictions for new rows with their key kept (Q18): probability of class 1 for
    classifiers, predicted value for regressions.  A row without all its features keeps its key and
    gets NULL."""
    p = model.transform(_vec(df, xs, None, key, "keep"))
    if "probability" in p.columns:
        val = vector_to_array("probability")[1]
    else:
        val = F.col("prediction")
    return p.select(*[q(k) for k in key], F.when(F.col("__whole"), val).alias(out))


def residuals(model, df: DataFrame, y: str, xs: Sequence[str], key: Sequence[str]) -> DataFrame:
    """K9: actual, predicted and residual per row (histogram them with aggs.histogram)."""
    p = model.transform(_vec(df, xs, y, key, "keep"))
    fit = F.when(F.col("__whole"), F.col("prediction"))  # NULL without all features
    return p.select(*[q(k) for k in key], F.col("label").alias("actual"), fit.alias("predicted"),
                    (F.col("label") - fit).alias("residual"))


# --------------------------------------------------------------------------- Gram based: K5 (OLS) / K6


def gram(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """One pass: sums of products of all columns (uncentred X'X), column sums, n, over rows without NULLs.

    Blocks of rows are multiplied in the tasks; p-sized state reaches the driver.
    """
    return gram_blocks(df, cols)


def vif(df: DataFrame, xs: Sequence[str], centred: bool = True) -> DataFrame:
    """K6: variance inflation factors from one aggregate.

    centred=True : diag(inv(R)), R the correlation matrix (regressions with a constant).
    centred=False: G_ii * inv(G)_ii with G = X'X uncentred, as statsmodels computes it for a
                   design without a constant column (uncentred R^2).
    """
    if centred:  # around the means first: sums of raw products would cancel when means are large
        whole = df.dropna(subset=list(xs))
        mean = whole.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(xs)]).first()
        df = whole.select(*[(q(c).cast("double") - F.lit(mean[f"m{i}"] or 0.0)).alias(c) for i, c in enumerate(xs)])
    G, s, n = gram(df, xs)
    if centred:
        C = G - np.outer(s, s) / n
        d = np.sqrt(np.diag(C))
        R = C / np.outer(d, d)
        v = np.diag(np.linalg.pinv(R))
    else:
        v = np.diag(G) * np.diag(np.linalg.pinv(G))
    return _table(df.sparkSession, [(x, float(val)) for x, val in zip(xs, v)], "feature string, vif double")


def vif_glm(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """K6: variance inflation factors of a fitted binomial GLM -> (feature, vif).

    diag(inv(R)), R the correlation matrix of the coefficients' covariance without the intercept.
    """
    fit = logit_fits(df, y, [list(xs)])[0]
    return _table(df.sparkSession, [(x, float(f)) for x, f in fit.inflation().items()], "feature string, vif double")


def _ols_from_gram(G, s, n, idx, yi, intercept):
    """Least squares of column yi on columns idx from the full Gram (no data pass)."""
    if intercept:
        A = np.zeros((len(idx) + 1, len(idx) + 1))
        A[0, 0] = n
        A[0, 1:] = A[1:, 0] = s[idx]
        A[1:, 1:] = G[np.ix_(idx, idx)]
        b = np.concatenate([[s[yi]], G[idx, yi]])
    else:
        A = G[np.ix_(idx, idx)]
        b = G[idx, yi]
    beta = np.linalg.pinv(A) @ b
    return beta[1:] if intercept else beta


def rfe(df: DataFrame, y: str, xs: Sequence[str], n_keep: int, kind: str = "ols", intercept: bool = True,
        c: float = 1.0) -> DataFrame:
    """K5: recursive feature elimination to ``n_keep`` features -> (feature, selected, rank).

    Each round drops the feature with the smallest |coefficient| (rank = elimination order
    from the end, selected features rank 1).  For OLS the Gram of [xs, y] is aggregated once
    and every round is solved on the driver; for "logit" (binomial GLM) and "logit_l2" (L2-penalised
    with inverse strength ``c``) each round is a Spark fit.
    """
    xs = list(xs)
    remaining = list(range(len(xs)))
    ranks = {}
    if kind == "ols":
        G, s, n = gram(df, xs + [y])
        yi = len(xs)
        while len(remaining) > n_keep:
            beta = _ols_from_gram(G, s, n, np.array(remaining), yi, intercept)
            worst = remaining[int(np.argmin(np.abs(beta)))]
            ranks[xs[worst]] = len(remaining) - n_keep + 1
            remaining.remove(worst)
    else:
        v_all = cut_lineage(df.select(*[q(c) for c in xs], q(y)))  # many fits over one checkpointed table
        while len(remaining) > n_keep:
            cur = [xs[i] for i in remaining]
            coefs, _ = logit_l2(v_all, y, cur, c) if kind == "logit_l2" else logit(v_all, y, cur, intercept)
            est = {r["term"]: r["estimate"] for r in coefs.collect()}
            worst = min(remaining, key=lambda i: abs(est[xs[i]]))
            ranks[xs[worst]] = len(remaining) - n_keep + 1
            remaining.remove(worst)
    rows = [(x, i in remaining, 1 if i in remaining else ranks[x]) for i, x in enumerate(xs)]
    return _table(df.sparkSession, rows, "feature string, selected boolean, rank long")


# --------------------------------------------------------------------------- K4 / K7


def step_aic(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """K4: bidirectional step-wise selection by AIC over binomial GLMs, from the full model.

    All candidates of a step (drop one / add one back) are fitted together: each pass over one written
    table serves every fit that still moves.  Returns the path: (step, action, feature, aic).
    """
    xs = list(xs)
    base = cut_lineage(df.select(*[q(c) for c in xs], q(y)).dropna())
    known = {frozenset(): _null_aic(base, y)}

    def fit(sets):
        new = [s for s in dict.fromkeys(map(frozenset, sets)) if s not in known]
        for f in logit_fits(base, y, [[x for x in xs if x in s] for s in new]):
            known[frozenset(f.cols)] = f.aic

    current = list(xs)
    fit([current])
    cur_aic = known[frozenset(current)]
    path = [(0, "start", None, cur_aic)]
    step = 0
    while True:  # ends: the AIC falls with every step, and there are finitely many feature sets
        step += 1
        cands = [("drop", c, [x for x in current if x != c]) for c in current]
        cands += [("add", c, current + [c]) for c in xs if c not in current]
        if not cands:
            break
        fit([m[2] for m in cands])
        act, feat, a = min(((act, c, known[frozenset(cols)]) for act, c, cols in cands), key=lambda m: (m[2], m[1]))
        if a >= cur_aic - 1e-9:
            break
        current = [x for x in current if x != feat] if act == "drop" else current + [feat]
        cur_aic = a
        path.append((step, act, feat, a))
    return _table(df.sparkSession, path, "step long, action string, feature string, aic double")


def _null_aic(df: DataFrame, y: str) -> float:
    row = df.agg(F.avg(q(y).cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = row["p"], row["n"]
    if p in (0.0, 1.0):
        return 2.0
    ll = n * (p * math.log(p) + (1 - p) * math.log(1 - p))
    return -2 * ll + 2


def prune_features(df: DataFrame, y: str, xs: Sequence[str], max_vif: float = 2.0, max_p: float = 0.05,
                   kind: str = "logit", centred: bool = True) -> DataFrame:
    """K7: backward elimination by VIF and p-value.

    Each round fits the model and the VIFs; among features with p > max_p the one
    with the largest VIF above max_vif is dropped, else the one with the largest p.  For logit the
    VIFs are those of the fitted GLM, for ols the plain ones.
    Stops when every p <= max_p.  Returns the path (step, dropped, vif, p_value).
    """
    cur = list(xs)
    base = cut_lineage(df.select(*[q(c) for c in xs], q(y)).dropna())  # one table for every round
    path = []
    step = 0
    while cur:
        if kind == "logit":
            fit = logit_fits(base, y, [cur])[0]
            pv, vf = fit.p_values(), fit.inflation()
        else:
            pv = {r["term"]: r["p_value"] for r in ols(base, y, cur)[0].collect() if r["term"] != INTERCEPT}
            vf = {r["feature"]: r["vif"] for r in vif(base, cur, centred).collect()} if len(cur) > 1 else {cur[0]: 1.0}
        cand = [c for c in cur if pv[c] > max_p]
        if not cand:
            break
        high = [c for c in cand if vf[c] > max_vif]
        drop = max(high, key=lambda c: (vf[c], c)) if high else max(cand, key=lambda c: (pv[c], c))
        step += 1
        path.append((step, drop, float(vf[drop]), float(pv[drop])))
        cur.remove(drop)
    return _table(df.sparkSession, path, "step long, dropped string, vif double, p_value double")


# --------------------------------------------------------------------------- K10 - K13


@dataclass
class OneVsAll:
    """A linear machine for every label against all others; the label of the highest margin wins, of equal ones the least."""

    labels: list[float]
    weights: np.ndarray  # labels x dimensions
    bias: np.ndarray
    iterations: list[int]
    features: str

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with ``out``; NULL for rows without features."""
        labels, weights, bias = np.array(self.labels), self.weights, self.bias

        @F.pandas_udf(T.DoubleType())
        def highest(col: pd.Series) -> pd.Series:
            found = pd.Series([None] * len(col), dtype="float64")
            there = col.notna().to_numpy()
            if there.any() and len(labels):
                found[there] = labels[(np.vstack(col[there].to_numpy()) @ weights.T + bias).argmax(1)]
            return found

        return df.withColumn(out, highest(_array(df, self.features)))


def _one_vs_all(rows: DataFrame, c: Sequence[float], max_iter: int, folds: Sequence[int | None] = (None,)) -> dict:
    """(c, fold left out) -> machines of the labels, all fitted together on ``packed`` rows."""
    counts = rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()  # labels x folds
    fits = {}
    for k in folds:
        kept = [r for r in counts if r["fold"] != k]
        n = sum(r["n"] for r in kept)
        labels = sorted({r["y"] for r in kept if r["y"] is not None})
        for v in c:
            fits[v, k] = [Hinge(y, k, 1.0 / (v * n)) for y in labels]
    hinge_fits(rows, [f for group in fits.values() for f in group], max_iter)
    return fits


def svm_linear(df: DataFrame, label: str, features: str, c: float = 1.0, max_iter: int = 50) -> OneVsAll:
    """Linear multi-class SVM, one-vs-rest, penalty C -> regParam 1 / (C n).

    The labels' machines share every pass over one written table (``blocks.hinge_fits``).
    """
    rows = packed(df.select(q(label).alias("y"), _array(df, features).alias("x")), "y", "x")
    fits, = _one_vs_all(rows, [c], max_iter).values()
    return OneVsAll([f.positive for f in fits], np.array([f.weights for f in fits]), np.array([f.bias for f in fits]),
                    [f.iterations for f in fits], features)


def fits_ended(model, max_iter: int) -> tuple[int, bool]:
    """Most iterations of a one-vs-rest model's fits, and whether every fit ended before ``max_iter``."""
    return max(model.iterations, default=0), all(t < max_iter for t in model.iterations)


@dataclass
class OneVsOne:
    """Pairwise linear classifiers: for pair i, a score above 0 votes for ``pairs[i][0]``, else for ``pairs[i][1]``."""

    labels: list[float]
    pairs: list[tuple[float, float]]
    weights: np.ndarray  # pairs x dimensions
    bias: np.ndarray
    iterations: list[int]
    max_iter: int

    def fits(self, spark) -> DataFrame:
        """One row a pair: first, second, iterations, converged."""
        rows = [(float(a), float(b), int(t), t < self.max_iter) for (a, b), t in zip(self.pairs, self.iterations, strict=True)]
        return _table(spark, rows, "first double, second double, iterations long, converged boolean")

    def transform(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        """``df`` with ``out``: the label with most votes; of labels with equal votes the least.  NULL features: NULL."""
        labels, weights, bias = np.array(self.labels), self.weights, self.bias
        first, second = (np.searchsorted(labels, [p[k] for p in self.pairs]) for k in (0, 1))

        @F.pandas_udf(T.DoubleType())
        def vote(col: pd.Series) -> pd.Series:
            found = pd.Series([None] * len(col), dtype="float64")
            there = col.notna().to_numpy()
            if there.any():
                won = np.where(np.vstack(col[there].to_numpy()) @ weights.T + bias > 0, first, second)
                votes = np.zeros((len(won), len(labels)), np.int64)
                np.add.at(votes, (np.arange(len(won))[:, None], won), 1)
                found[there] = labels[votes.argmax(1)]
            return found

        return df.withColumn(out, vote(_array(df, features)))


def _array(df: DataFrame, features: str):
    return vector_to_array(features) if isinstance(df.schema[features].dataType, T.UserDefinedType) else F.col(features)


def svm_one_vs_one(df: DataFrame, label: str, features: str, c: float = 1.0, max_iter: int = 50, parallelism: int = 4) -> OneVsOne:
    """Linear multi-class SVM by a LinearSVC for every two labels and votes, penalty C -> regParam 1 / (C n_pair).

    The pairs' fits are independent jobs over one written table, ``parallelism`` at a time.  Rows without
    a label or features are left out; one label alone gives a model that always votes for it.
    """
    base = cut_lineage(df.where(q(label).isNotNull() & q(features).isNotNull())
                       .select(q(label).cast("double").alias("y"), q(features).alias("features")), "pairs")
    counts = {r["y"]: r["n"] for r in base.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a label
    labels = sorted(counts)
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1:]]

    def fit(pair):
        a, b = pair
        rows = base.where(F.col("y").isin(a, b)).withColumn("label", (F.col("y") == a).cast("double"))
        return LinearSVC(regParam=1.0 / (c * (counts[a] + counts[b])), maxIter=max_iter, standardization=False).fit(rows)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        models = list(pool.map(fit, pairs))
    d = len(models[0].coefficients) if models else 0
    weights = np.array([m.coefficients.toArray() for m in models]).reshape(len(models), d)
    return OneVsOne(labels, pairs, weights, np.array([m.intercept for m in models]), [m.summary().totalIterations for m in models], max_iter)


def fourier_features(df: DataFrame, features: str, sigma: float, n_features: int = 256, seed: int = 42,
                     out: str = "rff") -> DataFrame:
    """K11 (re-aimed): random Fourier features z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 sigma),
    so z(x).z(y) ~ exp(-sigma |x-y|^2) (kernlab rbfdot).  W is parameter-sized (D x d), made on the
    driver from the seed; the projection runs per Arrow batch."""
    d = len(df.select(features).first()[0])
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * sigma), size=(d, n_features))
    b = rng.uniform(0, 2 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(col: pd.Series) -> pd.Series:
        X = np.vstack(col.to_numpy())
        Z = scale * np.cos(X @ W + b)
        return pd.Series(list(Z))

    return df.withColumn(out, array_to_vector(project(_array(df, features))))


def svm_rbf(df: DataFrame, label: str, features: str, sigma: float, c: float = 1.0, n_features: int = 256,
            seed: int = 42, max_iter: int = 50):
    """RBF-kernel SVM approximated by random Fourier features + K10.  Returns (model, projected df)."""
    z = fourier_features(df, features, sigma, n_features, seed)
    return svm_linear(z, label, "rff", c, max_iter=max_iter), z


def tensor_sketch(df: DataFrame, features: str, degree: int = 2, offset: float = 1.0, n_features: int = 512, seed: int = 42,
                  out: str = "sketch", scale: float = 1.0) -> DataFrame:
    """Features whose products estimate the polynomial kernel (scale x.y + offset) ^ degree of all dimensions,
    less the constant offset ^ degree (which a fit with an intercept does not see).

    A count sketch of x for each factor; the product of their Fourier transforms is the transform of the
    sketch of the tensor power (Pham and Pagh).  Unbiased; the standard error of one product is at most
    about 2 ^ (degree / 2) |x'|^degree |y'|^degree / sqrt(n_features), with |x'|^2 = scale |x|^2 + offset.
    The hashes are parameter-sized and drawn from the seed.
    """
    d = len(df.select(features).first()[0]) + 1
    rng = np.random.default_rng(seed)
    place = rng.integers(0, n_features, (degree, d))
    sign = rng.choice([-1.0, 1.0], (degree, d))
    to = np.zeros((degree, d, n_features))
    for j in range(degree):
        to[j, np.arange(d), place[j]] = sign[j]

    def sketched(x: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.prod([np.fft.rfft(x @ t, axis=1) for t in to], axis=0), n_features, axis=1)

    constant = np.zeros((1, d))
    constant[0, -1] = math.sqrt(offset)
    base = sketched(constant)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sketch(col: pd.Series) -> pd.Series:
        x = np.vstack(col.to_numpy()) * math.sqrt(scale)
        x = np.column_stack([x, np.full(len(x), math.sqrt(offset))])
        z = sketched(x) - base
        # rounding noise in cells that no term hits would be scaled up by fits that standardise
        z[np.abs(z) < 1e-12 * (np.abs(z).max(1, keepdims=True) + offset ** degree)] = 0.0
        return pd.Series(list(z))

    return df.withColumn(out, array_to_vector(sketch(_array(df, features))))


def svm_poly(df: DataFrame, label: str, features: str, degree: int = 2, c: float = 1.0, offset: float = 1.0,
             n_features: int = 512, seed: int = 42, max_iter: int = 50, scale: float = 1.0):
    """Polynomial-kernel SVM approximated by a tensor sketch + K10.  Returns (model, sketched df)."""
    z = tensor_sketch(df, features, degree, offset, n_features, seed, scale=scale)
    return svm_linear(z, label, "sketch", c, max_iter=max_iter), z


def grid_search(df: DataFrame, label: str, features: str, grid: Mapping[str, Sequence[float]], folds: int = 5,
                seed: int = 42, max_iter: int = 100, n_features: int = 256) -> DataFrame:
    """K-fold cross-validated accuracy and kappa of every grid point.

    ``grid`` has "c" and, for the RBF kernel, "sigma": ([sigma,] c, accuracy, kappa, iterations, converged),
    the last two over all fits of the grid point.  Folds come from a seeded hash of the feature vector, so equal rows share a fold and the
    split does not depend on partitioning.
    """
    arr = _array(df, features)
    base = df.select(q(label).cast("double").alias("label"), arr.alias("x"), F.pmod(F.xxhash64(F.lit(seed), arr), F.lit(folds)).alias("fold"))

    def searched(sigma) -> list:
        z = base if sigma is None else fourier_features(base, "x", sigma, n_features, seed, "z").select("label", vector_to_array("z").alias("x"), "fold")
        rows = packed(z, "label", "x", "fold")
        fits = _one_vs_all(rows, grid["c"], max_iter, range(folds))
        cells = _held_out(rows, {(i, k): fits[c, k] for i, c in enumerate(grid["c"]) for k in range(folds)})
        return [([float(sigma)] if sigma is not None else []) + _grid_row(
            float(c), cells[i], [f.iterations for k in range(folds) for f in fits[c, k]], max_iter) for i, c in enumerate(grid["c"])]

    sigmas = list(grid.get("sigma", [None]))
    with ThreadPoolExecutor(max_workers=min(4, max(1, len(sigmas)))) as pool:  # the searches are independent jobs
        rows = [r for found in pool.map(searched, sigmas) for r in found]
    lead = "sigma double, " if "sigma" in grid else ""
    return _table(df.sparkSession, rows, f"{lead}c double, accuracy double, kappa double, iterations long, converged boolean")


def _held_out(rows: DataFrame, machines: Mapping) -> dict:
    """Grid point -> (label, prediction) -> rows of all folds, each predicted by the machines that did not see it.

    ``machines`` maps (grid point, fold) to fits.
    """
    tables = {key: (np.array([f.positive for f in fits]), np.array([f.weights for f in fits]).T, np.array([f.bias for f in fits]))
              for key, fits in machines.items() if fits}

    def body(batches):
        for b in batches:
            x, y, fold = packed_block(b)
            for (point, k), (labels, weights, bias) in tables.items():
                mine = fold == k
                won = labels[(x[mine] @ weights + bias).argmax(1)]
                pairs = pd.DataFrame({"label": y[mine], "prediction": won}).groupby(["label", "prediction"], dropna=False).size().reset_index(name="n")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([point] * len(pairs), pa.int32()), pa.array(pairs["label"], pa.float64(), from_pandas=True),
                     pa.array(pairs["prediction"], pa.float64()), pa.array(pairs["n"], pa.int64())], ["point", "label", "prediction", "n"])

    votes = rows.mapInArrow(body, "point int, label double, prediction double, n long")
    cells: dict = {point: {} for point, _ in machines}
    for r in votes.groupBy("point", "label", "prediction").agg(F.sum("n").alias("n")).collect():  # grid points x classes x classes
        cells[r["point"]][r["label"], r["prediction"]] = float(r["n"])
    return cells


def _grid_row(c: float, cells: Mapping, turns: Sequence[int], max_iter: int) -> list:
    """c, accuracy, kappa, most iterations, whether all fits ended."""
    total = sum(cells.values())
    hit = sum(v for (a, b), v in cells.items() if a == b) / total
    margin = lambda side, x: sum(v for key, v in cells.items() if key[side] == x)
    chance = sum(margin(0, x) * margin(1, x) for x in {a for a, _ in cells}) / total ** 2
    return [c, hit, (hit - chance) / (1 - chance) if chance < 1 else 0.0, max(turns), all(t < max_iter for t in turns)]
