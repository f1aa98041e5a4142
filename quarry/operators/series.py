"""Many time series at once.

A series is a group of rows keyed by ``by`` with an integer index ``t``
(1..n, no gaps: :func:`to_series` completes the calendar first).  Window
operators partition by the series keys, so thousands of series run in
parallel; each window partition is one series (one row per period), never
raw events.  Model fits reduce each series to sufficient statistics with a
SQL aggregate (Gram sums) or, for the recursive methods, hand one series
(n rows, n = number of periods) to a pandas function via ``applyInPandas``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.order import q, row_index


def _w(by: Sequence[str], t: str | None = None) -> Window:
    w = Window.partitionBy(*[q(b) for b in by])
    return w.orderBy(q(t)) if t else w


# --------------------------------------------------------------------------- M1 / M2


def to_series(df: DataFrame, ts: str, by: Sequence[str], measures: Mapping[str, Column],
              start: str | None = None, end: str | None = None, period: str = "period", t: str = "t") -> DataFrame:
    """M1: monthly series per key with a complete calendar (missing month = 0) and index t.

    ``measures`` maps output names to aggregate Columns (e.g. F.sum('sales')).
    The calendar (months between start and end, or the data's first and last
    month) is crossed with the distinct keys -- both small -- and left-joined
    to the aggregate, so every series has every month before any lag is taken.
    """
    by = list(by)
    month = F.trunc(q(ts).cast("date"), "month")
    agg = df.groupBy(*[q(b) for b in by], month.alias(period)).agg(*[e.alias(n) for n, e in measures.items()])
    if start and end:
        s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    else:  # the data's span, as scalar subqueries (one small aggregate, evaluated once)
        s, e = agg.agg(F.min(period)).scalar(), agg.agg(F.max(period)).scalar()
    keys = agg.select(*[q(b) for b in by]).distinct()
    # every series gets every month of the span: a generator per key (months of the span), no join
    grid = keys.select(*[q(b).alias(f"__b{k}") for k, b in enumerate(by)],
                       F.explode(F.sequence(s, e, F.expr("interval 1 month"))).alias("__p"))
    on = F.col("__p") == F.col(period)  # a NULL key is a series like any other
    for k, b in enumerate(by):
        on = on & F.col(f"__b{k}").eqNullSafe(q(b))
    full = grid.join(agg, on, "left").select(*[F.col(f"__b{k}").alias(b) for k, b in enumerate(by)], F.col("__p").alias(period),
                                             *[F.coalesce(q(m), F.lit(0)).alias(m) for m in measures])
    return full.withColumn(t, (F.months_between(period, s).cast("int") + 1).cast("long"))


def rank_series(series: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """M2: per series total, mean, sample sd and CV of ``c``; rank by total (desc)."""
    g = series.groupBy(*[q(b) for b in by]).agg(F.sum(q(c)).alias("total"), F.avg(q(c)).alias("mean"),
                                                F.stddev_samp(q(c)).alias("sd"))
    g = g.withColumn("cv", F.try_divide(F.col("sd"), F.col("mean")))
    # series may number in the millions: distributed rank, not an unpartitioned window
    return row_index(g, [F.col("total").desc(), *[q(b).asc() for b in by]], out="rank")


# --------------------------------------------------------------------------- M3 / M4


def smooth(df: DataFrame, by: Sequence[str], t: str, c: str, w: int = 1, out: str = "smoothed") -> DataFrame:
    """M3: centred moving average over 2w+1 points, ends extended linearly.

    Inner points: mean of the 2w+1 window.  Left end: s_i = s_{w+1} - (w+1-i) * (s_{w+2} - s_{w+1});
    right end: s_i = s_{n-w} + (i-(n-w)) * (s_{n-w} - s_{n-w-1}).
    """
    frame = _w(by, t).rowsBetween(-w, w)
    whole = _w(by)
    x = df.withColumn("__ma", F.when(F.count(q(c)).over(frame) == 2 * w + 1, F.avg(q(c)).over(frame)))
    x = x.withColumn("__n", F.count(F.lit(1)).over(whole))
    pick = lambda k: F.max(F.when(q(t) == k, F.col("__ma"))).over(whole)
    x = x.withColumn("__l1", pick(F.lit(w + 1))).withColumn("__l2", pick(F.lit(w + 2))) \
        .withColumn("__r1", pick(F.col("__n") - w)).withColumn("__r2", pick(F.col("__n") - w - 1))
    tt = q(t)
    s = (F.when(tt <= w, F.col("__l1") - (F.lit(w + 1) - tt) * (F.col("__l2") - F.col("__l1")))
         .when(tt > F.col("__n") - w, F.col("__r1") + (tt - (F.col("__n") - w)) * (F.col("__r1") - F.col("__r2")))
         .otherwise(F.col("__ma")))
    return x.withColumn(out, s).drop("__ma", "__n", "__l1", "__l2", "__r1", "__r2")


def decompose(df: DataFrame, by: Sequence[str], t: str, c: str, period: int = 12) -> DataFrame:
    """M4: classical additive decomposition (as R ``decompose``).

    trend: centred moving average (2 x p for even p, weights 1/2 at both ends);
    seasonal: mean of the detrended values per phase ((t-1) mod p), centred to
    sum zero; remainder = value - trend - seasonal.
    """
    by = list(by)
    h = period // 2
    frame = _w(by, t).rowsBetween(-h, h)
    full = F.count(q(c)).over(frame) == 2 * h + 1
    if period % 2 == 0:
        ends = F.lag(q(c), h).over(_w(by, t)) + F.lead(q(c), h).over(_w(by, t))
        tr = (F.sum(q(c)).over(frame) - F.lit(0.5) * ends) / F.lit(float(period))
    else:
        tr = F.avg(q(c)).over(frame)
    x = df.withColumn("trend", F.when(full, tr)).withColumn("__phase", F.pmod(q(t) - 1, F.lit(period)))
    fig = x.groupBy(*[q(b) for b in by], "__phase").agg(F.avg(q(c) - F.col("trend")).alias("__fig"))
    fig = fig.withColumn("__fig", F.col("__fig") - F.avg("__fig").over(_w(by)))  # p rows per series
    fig = fig.select(*[q(b).alias(f"__s{i}") for i, b in enumerate(by)], F.col("__phase").alias("__p2"), "__fig")
    cond = F.col("__phase") == F.col("__p2")
    for i, b in enumerate(by):
        cond = cond & q(b).eqNullSafe(F.col(f"__s{i}"))
    j = x.join(fig, cond, "left")
    return j.select(*[q(col) for col in df.columns], "trend", F.col("__fig").alias("seasonal"),
                    (q(c) - F.col("trend") - F.col("__fig")).alias("remainder"))


# --------------------------------------------------------------------------- M8 / M9 / M11 / M12


def acf(df: DataFrame, by: Sequence[str], t: str, c: str, max_lag: int) -> DataFrame:
    """M8: autocorrelations r_1..r_K per series -> (by..., lag, acf, n).

    r_k = sum_{t>k} (x_t - mean)(x_{t-k} - mean) / sum_t (x_t - mean)^2, one aggregate over lag columns.
    """
    by = list(by)
    x = df.withColumn("__xc", q(c) - F.avg(q(c)).over(_w(by)))
    x = x.withColumns({f"__l{k}": F.lag("__xc", k).over(_w(by, t)) for k in range(1, max_lag + 1)})
    g = x.groupBy(*[q(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__xc") * F.col("__xc")).alias("__s0"),
        *[F.sum(F.col("__xc") * F.col(f"__l{k}")).alias(f"__s{k}") for k in range(1, max_lag + 1)])
    arr = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"),
                             F.try_divide(F.col(f"__s{k}"), F.col("__s0")).alias("acf")) for k in range(1, max_lag + 1)])
    return g.select(*[q(b) for b in by], "n", F.inline(arr))


def pacf(acf_df: DataFrame, by: Sequence[str]) -> DataFrame:
    """M9: partial autocorrelations from the M8 vector per series (Durbin-Levinson), one small group each."""
    by = list(by)
    schema = T.StructType([acf_df.schema[b] for b in by] + [T.StructField("lag", T.LongType()),
                                                            T.StructField("pacf", T.DoubleType())])

    def dl(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy(dtype=float)
        K = len(r)
        out = np.full(K, np.nan)
        phi = np.zeros(0)
        for k in range(1, K + 1):
            if k == 1:
                a = r[0]
                phi = np.array([a])
            else:
                num = r[k - 1] - np.dot(phi, r[k - 2::-1][:k - 1])
                den = 1.0 - np.dot(phi, r[:k - 1])
                a = num / den if den != 0 else np.nan
                phi = np.append(phi - a * phi[::-1], a)
            out[k - 1] = a
        res = pd.DataFrame({"lag": pdf["lag"].to_numpy(dtype="int64"), "pacf": out})
        for b in by:
            res.insert(0, b, pdf[b].iloc[0])
        return res[[*by, "lag", "pacf"]]

    return acf_df.groupBy(*[q(b) for b in by]).applyInPandas(dl, schema)


def ljung_box(acf_df: DataFrame, by: Sequence[str], max_lag: int, fitted_params: int = 0) -> DataFrame:
    """Ljung-Box Q = n(n+2) sum_{k<=K} r_k^2 / (n-k) per series -> (by..., q_stat, df, p_value).

    For the residuals of a fit, give the number of its fitted lags as ``fitted_params``.
    """
    free = max_lag - fitted_params

    @F.pandas_udf(T.DoubleType())
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: _chi2_tail(v, free)).astype(float)

    a = acf_df.where(F.col("lag") <= max_lag)
    g = a.groupBy(*[q(b) for b in by]).agg(
        (F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))))
        .alias("q_stat"))
    return g.withColumn("df", F.lit(free).cast("long")).withColumn("p_value", tail("q_stat"))


# fixed values: KPSS level-stationarity critical values (Kwiatkowski et al. 1992, Table 1)
KPSS_LEVEL_CRIT = [0.347, 0.463, 0.574, 0.739]
KPSS_LEVEL_P = [0.10, 0.05, 0.025, 0.01]


def kpss_lags(n: Column, lags: str | int = "short") -> Column:
    """Bartlett truncation lag: 'short' trunc(3 sqrt(n) / 13), 'long' trunc(10 sqrt(n) / 14), or a number."""
    if isinstance(lags, int):
        return F.lit(lags)
    k = 3.0 / 13 if lags == "short" else 10.0 / 14
    return F.floor(F.lit(k) * F.sqrt(n.cast("double"))).cast("int")


def kpss_test(df: DataFrame, by: Sequence[str], t: str, c: str, lags: str | int = "short") -> DataFrame:
    """KPSS level test per series -> (by..., n, lags, statistic, p_value).

    e = x - mean, S = running sum of e; statistic = sum S^2 / (n^2 * s2), with the
    Bartlett long-run variance s2 = (sum e^2 + 2 sum_{s<=l} (1 - s/(l+1)) sum e_t e_{t-s}) / n.
    l comes from each series' own length, or from the caller, uncapped: every row meets its l
    predecessors through a join on (series, place).  p interpolated in the published table,
    clipped to [0.01, 0.10].
    """
    by = list(by)
    e = q(c) - F.avg(q(c)).over(_w(by))
    x = df.select(*[q(b) for b in by], e.alias("__e"), F.row_number().over(_w(by, t)).alias("__i"),
                  F.count(F.lit(1)).over(_w(by)).alias("__n"), q(t).alias("__t"))
    x = x.withColumn("__S", F.sum("__e").over(_w(by, "__i").rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy(*[q(b) for b in by]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__S") * F.col("__S")).alias("__ss"),
                                           F.sum(F.col("__e") * F.col("__e")).alias("__e2"))
    lag = F.least(kpss_lags(F.col("__n"), lags), F.col("__i") - 1)
    back = x.where(lag > 0).select(*[q(b).alias(f"__b{k}") for k, b in enumerate(by)], F.col("__e").alias("__f"), "__n",
                                   F.posexplode(F.sequence(F.col("__i") - 1, F.col("__i") - lag, F.lit(-1))).alias("__s", "__j"))
    on = F.col("__j") == F.col("__i")
    for k, b in enumerate(by):
        on = on & q(b).eqNullSafe(F.col(f"__b{k}"))
    weight = 1 - (F.col("__s") + 1) / (kpss_lags(F.col("__m"), lags) + 1)
    cross = (back.withColumnRenamed("__n", "__m").join(x.select(*[q(b) for b in by], "__i", "__e"), on)
             .groupBy(*[F.col(f"__b{k}") for k in range(len(by))]).agg(F.sum(weight * F.col("__e") * F.col("__f")).alias("__x")))
    on = F.lit(True)
    for k, b in enumerate(by):
        on = on & q(b).eqNullSafe(F.col(f"__b{k}"))
    g = g.join(cross, on, "left") if by else g.withColumn("__x", cross.scalar())
    n = F.col("n").cast("double")
    stat = F.col("__ss") / (n * n) / ((F.col("__e2") + 2 * F.coalesce("__x", F.lit(0.0))) / n)
    g = g.withColumn("statistic", stat).withColumn("lags", kpss_lags(F.col("n"), lags))
    return g.select(*[q(b) for b in by], "n", F.col("lags").cast("long").alias("lags"), "statistic",
                    _interp_p(F.col("statistic"), KPSS_LEVEL_CRIT, KPSS_LEVEL_P).alias("p_value"))


def _interp_p(stat: Column, crit: Sequence[float], probs: Sequence[float]) -> Column:
    """Linear interpolation of p over increasing critical values, clipped to the table's range."""
    e = F.when(stat <= F.lit(crit[0]), F.lit(probs[0]))
    for (c0, p0), (c1, p1) in zip(zip(crit, probs), zip(crit[1:], probs[1:])):
        e = e.when(stat <= F.lit(c1), F.lit(p0) + (stat - F.lit(c0)) * F.lit((p1 - p0) / (c1 - c0)))
    return e.otherwise(F.lit(probs[-1]))


# --------------------------------------------------------------------------- M5 / M6 / M7


def basis(t: Column, spec: Sequence[tuple]) -> list[Column]:
    """Design columns of the time index.  spec items: ('poly', d) -> t^1..t^d;
    ('sin', a) / ('cos', a) -> sin(a t) / cos(a t); ('sinpoly', a, d) / ('cospoly', a, d) -> the
    sin/cos term times t^1..t^d (interactions).  An intercept is always first."""
    tt = t.cast("double")
    cols = [F.lit(1.0)]
    for s in spec:
        kind = s[0]
        if kind == "poly":
            cols += [F.pow(tt, k) for k in range(1, s[1] + 1)]
        elif kind in ("sin", "cos"):
            f = F.sin if kind == "sin" else F.cos
            cols.append(f(F.lit(float(s[1])) * tt))
        elif kind in ("sinpoly", "cospoly"):
            f = F.sin if kind == "sinpoly" else F.cos
            cols += [f(F.lit(float(s[1])) * tt) * F.pow(tt, k) for k in range(1, s[2] + 1)]
        else:
            raise ValueError(kind)
    return cols


def trend_fit(df: DataFrame, by: Sequence[str], t: str, c: str, spec: Sequence[tuple]) -> DataFrame:
    """M5: least-squares trend-season regression per series -> (by..., coef array).

    Each series reduces to its Gram sums (X'X, X'y) in one SQL aggregate; the
    p x p system of each series is solved by pseudo-inverse (rank-safe: collinear
    terms, Q28, get the minimum-norm solution) in a pandas function on one row.
    """
    by = list(by)
    X = basis(q(t), spec)
    p = len(X)
    x = df.where(q(c).isNotNull()).select(*[q(b) for b in by], F.array(*X).alias("__x"), q(c).cast("double").alias("__y"))
    gram = [F.sum(F.col("__x")[i] * F.col("__x")[j]).alias(f"__g{i}_{j}") for i in range(p) for j in range(i, p)]
    xy = [F.sum(F.col("__x")[i] * F.col("__y")).alias(f"__h{i}") for i in range(p)]
    g = x.groupBy(*[q(b) for b in by]).agg(*gram, *xy)
    schema = T.StructType([df.schema[b] for b in by] + [T.StructField("coef", T.ArrayType(T.DoubleType()))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        coefs = []
        for _, row in pdf.iterrows():  # one row per series in this group
            G = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    G[i, j] = G[j, i] = row[f"__g{i}_{j}"]
            h = np.array([row[f"__h{i}"] for i in range(p)])
            scale = np.sqrt(np.clip(np.diag(G), 1e-300, None))
            Gs = G / np.outer(scale, scale)
            coefs.append(list(np.linalg.pinv(Gs, rcond=1e-10) @ (h / scale) / scale))
        out = pdf[by].copy()
        out["coef"] = coefs
        return out

    return g.groupBy(*[q(b) for b in by]).applyInPandas(solve, schema)


def trend_predict(df: DataFrame, coefs: DataFrame, by: Sequence[str], t: str, spec: Sequence[tuple],
                  out: str = "fitted") -> DataFrame:
    """M6: fitted / forecast trend = basis(t) . coef, for any t (past rows or future indexes)."""
    by = list(by)
    # one row per series: joined by key; AQE broadcasts it from its measured size
    c = coefs.select(*[q(b).alias(f"__c{i}") for i, b in enumerate(by)], "coef")
    cond = None
    for i, b in enumerate(by):
        e = q(b).eqNullSafe(F.col(f"__c{i}"))
        cond = e if cond is None else cond & e
    j = df.join(c, cond, "inner")
    X = basis(q(t), spec)
    pred = sum((F.col("coef")[i] * X[i] for i in range(1, len(X))), F.col("coef")[0] * X[0])
    return j.withColumn(out, pred).drop("coef", *[f"__c{i}" for i in range(len(by))])


def future_index(series: DataFrame, by: Sequence[str], t: str, horizon: int) -> DataFrame:
    """Indexes n+1 .. n+h of every series."""
    last = series.groupBy(*[q(b) for b in by]).agg(F.max(q(t)).alias("__n"))
    return last.select(*[q(b) for b in by], F.explode(F.sequence(F.col("__n") + 1, F.col("__n") + horizon)).alias(t))


# --------------------------------------------------------------------------- M10


# fixed values: Dickey-Fuller critical values of the tau statistic with constant and trend
# (Fuller 1976, Table 8.5.2), rows = sample sizes, columns = probabilities
ADF_SIZES = [25, 50, 100, 250, 500, 100000]
ADF_PROBS = [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
ADF_TABLE = [
    [-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15],
    [-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24],
    [-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28],
    [-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31],
    [-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32],
    [-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33],
]


def adf_p_value(stat: float, n: int) -> float:
    table = np.array(ADF_TABLE)
    row = np.array([np.interp(n, ADF_SIZES, table[:, j]) for j in range(len(ADF_PROBS))])
    return float(np.clip(np.interp(stat, row, ADF_PROBS), 0.01, 0.99))


def _ols(X: np.ndarray, y: np.ndarray):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    dof = max(len(y) - X.shape[1], 1)
    s2 = float(resid @ resid) / dof
    cov = s2 * np.linalg.pinv(X.T @ X)
    return beta, np.sqrt(np.clip(np.diag(cov), 0, None)), resid, s2


def adf_test(df: DataFrame, by: Sequence[str], t: str, c: str, k: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test (constant + trend) per series.

    Regress diff(y)_t on 1, t, y_{t-1}, diff(y)_{t-1..t-k}; k = trunc((n-1)^(1/3)) by default;
    statistic = t value of y_{t-1}; p from the table at the length of diff(y), clipped to [0.01, 0.99].
    One series (n rows) per group.
    """
    by = list(by)
    schema = T.StructType([df.schema[b] for b in by] + [
        T.StructField("n", T.LongType()), T.StructField("lags", T.LongType()),
        T.StructField("statistic", T.DoubleType()), T.StructField("p_value", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(t)[c].to_numpy(dtype=float)
        n = len(y)
        kk = k if k is not None else int(math.trunc((n - 1) ** (1 / 3)))
        dy = np.diff(y)
        rows = []
        for i in range(kk, len(dy)):
            rows.append([1.0, i + 1.0, y[i]] + [dy[i - j] for j in range(1, kk + 1)])
        X = np.array(rows)
        target = dy[kk:]
        stat, pv = float("nan"), float("nan")
        if len(target) > X.shape[1]:
            beta, se, _, _ = _ols(X, target)
            stat = float(beta[2] / se[2]) if se[2] > 0 else float("nan")
            pv = adf_p_value(stat, len(dy)) if np.isfinite(stat) else float("nan")
        res = {b: [pdf[b].iloc[0]] for b in by}
        res.update(n=[n], lags=[kk], statistic=[stat], p_value=[pv])
        return pd.DataFrame(res)

    return df.groupBy(*[q(b) for b in by]).applyInPandas(run, schema)


# --------------------------------------------------------------------------- M13 / M14 / M15


def _expand(lag_coefs: dict, d: int, D: int, s: int) -> np.ndarray:
    """a_1..a_K of y_t = c + sum a_i y_{t-i} + e_t for A(B) (1-B)^d (1-B^s)^D y_t = c + e_t,
    A(B) = 1 - sum_lag coef B^lag."""
    poly = np.zeros(max(lag_coefs, default=0) + 1)
    poly[0] = 1.0
    for lag, v in lag_coefs.items():
        poly[lag] -= v
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(D):
        sd = np.zeros(s + 1)
        sd[0], sd[s] = 1.0, -1.0
        poly = np.convolve(poly, sd)
    return -poly[1:]


def _differenced(y: np.ndarray, d: int, D: int, s: int) -> np.ndarray:
    w = y.copy()
    for _ in range(D):
        w = w[s:] - w[:-s]
    for _ in range(d):
        w = np.diff(w)
    return w


def _sar_lags(p: int, P: int, s: int) -> list[int]:
    return list(range(1, p + 1)) + [s * (i + 1) for i in range(P)]


def _kpss_level(w: np.ndarray) -> float:
    """KPSS level statistic with the short Bartlett lag (0 for a constant series)."""
    e, n = w - w.mean(), len(w)
    lag = int(3 * math.sqrt(n) / 13)
    s2 = (e @ e + 2 * sum((1 - k / (lag + 1)) * (e[k:] @ e[:-k]) for k in range(1, lag + 1))) / n
    return float((np.cumsum(e) ** 2).sum() / n ** 2 / s2) if s2 > 1e-12 * max(1.0, float(w @ w) / n) else 0.0


def _choose_sar(y: np.ndarray, grid, D: int, s: int):
    """Best order by AICc: d is the least of the grid whose differenced series passes KPSS at 5 %, and
    the orders of that d are all fitted to the same rows, so their AICc compare."""
    for d in sorted({g[2] for g in grid}):
        w = _differenced(y, d, D, s) if len(y) > D * s + d else np.zeros(0)
        last = d == max(g[2] for g in grid)
        if len(w) < 4 or not last and _kpss_level(w) > KPSS_LEVEL_CRIT[list(KPSS_LEVEL_P).index(0.05)]:
            continue
        orders = [(p, P) for p, P, k in grid if k == d]
        orders = [o for o in orders if len(w) - max(_sar_lags(*o, s), default=0) >= len(_sar_lags(*o, s)) + 3]
        skip = max((max(_sar_lags(*o, s), default=0) for o in orders), default=0)
        fits = [f for f in (_fit_sar(y, p, P, d, D, s, skip) for p, P in orders) if f is not None]
        if fits:
            return min(fits, key=lambda f: f["aicc"])
    return None


def _fit_sar(y: np.ndarray, p: int, P: int, d: int, D: int, s: int, skip: int = 0):
    """Conditional least squares of the differenced series on its lags 1..p and s, 2s, .. Ps (+ constant).

    The first ``skip`` rows (at least the longest lag) only serve as lags.
    """
    w = _differenced(y, d, D, s)
    lags = _sar_lags(p, P, s)
    m = max(lags, default=0)
    m = max(m, skip)
    if len(w) - m < len(lags) + 3:
        return None
    X = np.column_stack([np.ones(len(w) - m)] + [w[m - L:len(w) - L] for L in lags])
    target = w[m:]
    beta, *_ = np.linalg.lstsq(X, target, rcond=None)
    resid = target - X @ beta
    n_eff = len(target)
    sigma2 = float(resid @ resid) / n_eff
    k = len(lags) + 2  # lag coefficients + constant + variance
    aic = n_eff * math.log(max(sigma2, 1e-300)) + 2 * k
    aicc = aic + (2 * k * (k + 1)) / max(n_eff - k - 1, 1)
    return dict(p=p, P=P, d=d, D=D, const=float(beta[0]), lags=dict(zip(lags, beta[1:])), sigma2=sigma2, aicc=aicc,
                residuals=resid)


def _forecast_sar(y: np.ndarray, fit: dict, s: int, h: int):
    """Recursive h-step forecast on the original scale and its standard errors (psi weights)."""
    a = _expand(fit["lags"], fit["d"], fit["D"], s)
    hist = list(y)
    out = []
    for _ in range(h):
        v = fit["const"] + sum(a[i - 1] * hist[-i] for i in range(1, len(a) + 1) if i <= len(hist))
        hist.append(v)
        out.append(v)
    psi = [1.0]
    for j in range(1, h):
        psi.append(sum(a[i - 1] * psi[j - i] for i in range(1, min(j, len(a)) + 1)))
    se = [math.sqrt(fit["sigma2"] * sum(x * x for x in psi[:j + 1])) for j in range(h)]
    return out, se


SAR_GRID = [(p, P, d) for d in (0, 1) for p in (0, 1, 2) for P in (0, 1)]


def seasonal_ar(df: DataFrame, by: Sequence[str], t: str, c: str, period: int = 12, horizon: int = 6,
                grid: Sequence[tuple] = SAR_GRID, D: int = 1) -> DataFrame:
    """M13 + M14: seasonal autoregression chosen by AICc, and its h-step forecast with 95 % bands.

    Each series (one group of n rows) fits every (p, P, d) of the grid by
    conditional least squares on the (seasonally) differenced series, keeps the
    smallest AICc, and forecasts recursively with differencing undone (the
    expanded AR polynomial).  MA terms and exact likelihood are not built.
    Output: by..., t (future index), forecast, lo95, hi95, order (text), aicc.
    """
    by = list(by)
    schema = T.StructType([df.schema[b] for b in by] + [
        T.StructField(t, T.LongType()), T.StructField("forecast", T.DoubleType()),
        T.StructField("lo95", T.DoubleType()), T.StructField("hi95", T.DoubleType()),
        T.StructField("order", T.StringType()), T.StructField("aicc", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        y = pdf[c].to_numpy(dtype=float)
        best = _choose_sar(y, grid, D, period)
        n0 = int(pdf[t].max())
        res = {b: [pdf[b].iloc[0]] * horizon for b in by}
        res[t] = list(range(n0 + 1, n0 + horizon + 1))
        if best is None:
            res.update(forecast=[np.nan] * horizon, lo95=[np.nan] * horizon, hi95=[np.nan] * horizon,
                       order=[None] * horizon, aicc=[np.nan] * horizon)
            return pd.DataFrame(res)
        fc, se = _forecast_sar(y, best, period, horizon)
        res.update(forecast=fc, lo95=[f - 1.96 * e for f, e in zip(fc, se)],
                   hi95=[f + 1.96 * e for f, e in zip(fc, se)],
                   order=[f"({best['p']},{best['d']},0)({best['P']},{best['D']},0)[{period}]"] * horizon,
                   aicc=[best["aicc"]] * horizon)
        return pd.DataFrame(res)

    return df.groupBy(*[q(b) for b in by]).applyInPandas(run, schema)


def seasonal_ar_residuals(df: DataFrame, by: Sequence[str], t: str, c: str, period: int = 12,
                          grid: Sequence[tuple] = SAR_GRID, D: int = 1) -> DataFrame:
    """Fitted values and residuals of the order that M13 chooses -> (by..., t, actual, fitted, residual).

    The rows that only serve as lags have none.  Diagnose with ``acf`` and ``ljung_box`` of the
    residuals; a smoothed series goes in as its column.  One series (n rows) per group.
    """
    by = list(by)
    schema = T.StructType([df.schema[b] for b in by] + [T.StructField(t, T.LongType())] + [
        T.StructField(k, T.DoubleType()) for k in ("actual", "fitted", "residual")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        y = pdf[c].to_numpy(dtype=float)
        best = _choose_sar(y, grid, D, period)
        e = best["residuals"] if best is not None else np.zeros(0)
        k = len(y) - len(e)
        res = {b: [pdf[b].iloc[0]] * len(e) for b in by}
        res.update({t: pdf[t].to_numpy()[k:], "actual": y[k:], "fitted": y[k:] - e, "residual": e})
        return pd.DataFrame(res)

    return df.groupBy(*[q(b) for b in by]).applyInPandas(run, schema)


def _chi2_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > x), by the finite sum for even k and its odd twin."""
    if k <= 0 or x is None or x != x:
        return float("nan")
    h = x / 2.0
    if k % 2 == 0:
        term, total = math.exp(-h), math.exp(-h)
        for i in range(1, k // 2):
            term *= h / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5) if h > 0 else 0.0
    for i in range(1, k // 2 + 1):
        total += term
        term *= h / (i + 0.5)
    return min(1.0, total)


def backtest(df: DataFrame, by: Sequence[str], t: str, c: str, spec: Sequence[tuple], horizon: int = 6,
             period: int = 12, smooth_w: int | None = 1) -> DataFrame:
    """Hold out the last ``horizon`` points, forecast them by the trend regression (M5/M6,
    fitted on the smoothed training part) and by the seasonal AR (M13/M14), and compare by MAPE
    per series -> (by..., method, mape, best)."""
    by = list(by)
    last = F.max(q(t)).over(_w(by))
    tagged = df.withColumn("__last", last)
    train = tagged.where(q(t) <= F.col("__last") - horizon).drop("__last")
    test = tagged.where(q(t) > F.col("__last") - horizon).drop("__last")
    fit_on = smooth(train, by, t, c, smooth_w, "__sm") if smooth_w else train.withColumn("__sm", q(c))
    coefs = trend_fit(fit_on, by, t, "__sm", spec)
    tr = trend_predict(test, coefs, by, t, spec, "forecast").select(*[q(b) for b in by], q(t), q(c), "forecast") \
        .withColumn("method", F.lit("trend"))
    ar = seasonal_ar(train, by, t, c, period, horizon).select(*[q(b) for b in by], q(t), "forecast")
    ar = ar.join(test.select(*[q(b) for b in by], q(t), q(c)), [*by, t]).withColumn("method", F.lit("seasonal_ar"))
    both = tr.unionByName(ar.select(tr.columns))
    e = F.abs(F.try_divide(q(c) - F.col("forecast"), q(c))) * 100
    m = both.groupBy(*[q(b) for b in by], "method").agg(F.avg(e).alias("mape"))
    return m.withColumn("best", F.col("mape") == F.min("mape").over(_w(by)))
