import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import series

PATTERN = [5, -3, 2, 8, -6, 0, 1, -2, 4, -4, 3, -8]


def series12(spark, n=48, keys=("a", "b")):
    rows = [(k, t, 10.0 + 0.5 * t + PATTERN[(t - 1) % 12] + (3.0 if k == "b" else 0.0)) for k in keys
            for t in range(1, n + 1)]
    return spark.createDataFrame(rows, "k string, t long, y double"), rows


def test_to_series_fills_missing_months(spark):
    df = spark.createDataFrame([("x", "2020-01-15", 1.0), ("x", "2020-03-02", 2.0), ("y", "2020-02-01", 5.0)],
                               "k string, d string, v double").withColumn("d", F.to_date("d"))
    s = series.to_series(df, "d", ["k"], {"v": F.sum("v")}).orderBy("k", "t").collect()
    assert [(r.k, r.t, r.v) for r in s] == [("x", 1, 1.0), ("x", 2, 0.0), ("x", 3, 2.0),
                                            ("y", 1, 0.0), ("y", 2, 5.0), ("y", 3, 0.0)]


def test_decompose_recovers_pattern(spark):
    df, _ = series12(spark)
    d = series.decompose(df, ["k"], "t", "y", 12).orderBy("k", "t").collect()
    inner = [r for r in d if r.trend is not None]
    assert len(inner) == 2 * (48 - 12)
    assert max(abs(r.remainder) for r in inner) < 1e-9
    centred = np.array(PATTERN) - np.mean(PATTERN)
    assert all(abs(r.seasonal - centred[(r.t - 1) % 12]) < 1e-9 for r in d)


def brute_smooth(y, w=1):
    n = len(y)
    s = [None] * n
    for i in range(w, n - w):
        s[i] = sum(y[i - w:i + w + 1]) / (2 * w + 1)
    diff = s[w + 1] - s[w]
    for i in range(w - 1, -1, -1):
        s[i] = s[i + 1] - diff
    diff = s[n - w - 1] - s[n - w - 2]
    for i in range(n - w, n):
        s[i] = s[i - 1] + diff
    return s


def test_smooth_matches_loop(spark):
    df, rows = series12(spark, n=20, keys=("a",))
    got = [r.smoothed for r in series.smooth(df, ["k"], "t", "y", 1).orderBy("t").collect()]
    assert np.allclose(got, brute_smooth([r[2] for r in rows], 1))
    got2 = [r.smoothed for r in series.smooth(df, ["k"], "t", "y", 2).orderBy("t").collect()]
    assert np.allclose(got2, brute_smooth([r[2] for r in rows], 2))


def test_acf_pacf_ljung_box(spark):
    rng = np.random.default_rng(1)
    y = [0.0]
    for _ in range(199):
        y.append(0.6 * y[-1] + rng.normal())
    df = spark.createDataFrame([("s", t + 1, v) for t, v in enumerate(y)], "k string, t long, y double")
    a = series.acf(df, ["k"], "t", "y", 5)
    got = [r.acf for r in a.orderBy("lag").collect()]
    x = np.array(y) - np.mean(y)
    want = [float(np.sum(x[k:] * x[:-k]) / np.sum(x * x)) for k in range(1, 6)]
    assert np.allclose(got, want)
    p = [r.pacf for r in series.pacf(a, ["k"]).orderBy("lag").collect()]
    # partial autocorrelation k = last coefficient of the Yule-Walker system of order k
    r = np.array([1.0] + want)
    for k in range(1, 6):
        R = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(p[k - 1] - np.linalg.solve(R, r[1:k + 1])[-1]) < 1e-10
    q = series.ljung_box(a, ["k"], 5).first().q_stat
    n = len(y)
    assert abs(q - n * (n + 2) * sum(r * r / (n - k) for k, r in enumerate(want, start=1))) < 1e-8


def test_kpss_statistic(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=60)
    df = spark.createDataFrame([("s", t + 1, float(v)) for t, v in enumerate(y)], "k string, t long, y double")
    r = series.kpss_test(df, ["k"], "t", "y").first()
    e = y - y.mean()
    S = np.cumsum(e)
    n = len(y)
    lag = int(math.trunc(3 * math.sqrt(n) / 13))
    s2 = (e @ e + 2 * sum((1 - s / (lag + 1)) * (e[s:] @ e[:-s]) for s in range(1, lag + 1))) / n
    assert r.lags == lag and abs(r.statistic - (S @ S) / n ** 2 / s2) < 1e-9
    assert 0.01 <= r.p_value <= 0.10


def test_adf_separates_stationary_from_random_walk(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=300)
    ar = [0.0]
    for v in e[1:]:
        ar.append(0.3 * ar[-1] + v)
    rw = np.cumsum(e)
    df = spark.createDataFrame([("ar", t + 1, float(v)) for t, v in enumerate(ar)]
                               + [("rw", t + 1, float(v)) for t, v in enumerate(rw)], "k string, t long, y double")
    r = {x.k: x for x in series.adf_test(df, ["k"], "t", "y").collect()}
    assert r["ar"].p_value <= 0.01 + 1e-12 and r["rw"].p_value > 0.05


def test_trend_fit_recovers_coefficients(spark):
    rows = [("s", t, 2.0 + 0.3 * t + 4.0 * math.sin(0.5 * t)) for t in range(1, 61)]
    df = spark.createDataFrame(rows, "k string, t long, y double")
    spec = [("poly", 1), ("sin", 0.5)]
    c = series.trend_fit(df, ["k"], "t", "y", spec).first().coef
    assert np.allclose(c, [2.0, 0.3, 4.0], atol=1e-6)
    fut = series.future_index(df, ["k"], "t", 3)
    f = [r.fitted for r in series.trend_predict(fut, series.trend_fit(df, ["k"], "t", "y", spec), ["k"], "t",
                                                spec).orderBy("t").collect()]
    assert np.allclose(f, [2.0 + 0.3 * t + 4.0 * math.sin(0.5 * t) for t in (61, 62, 63)], atol=1e-5)


def test_seasonal_ar_forecasts_pure_seasonal_series(spark):
    df, rows = series12(spark, n=60, keys=("a",))
    f = series.seasonal_ar(df, ["k"], "t", "y", 12, 6).orderBy("t").collect()
    want = [10.0 + 0.5 * t + PATTERN[(t - 1) % 12] for t in range(61, 67)]
    assert [r.t for r in f] == list(range(61, 67))
    assert np.allclose([r.forecast for r in f], want, atol=1e-6)
    assert all(r.lo95 <= r.forecast <= r.hi95 for r in f)


def test_backtest_runs(spark):
    df, _ = series12(spark, n=60)
    b = series.backtest(df, ["k"], "t", "y", [("poly", 1), ("sin", 0.5)], 6, 12).collect()
    assert {r.method for r in b} == {"trend", "seasonal_ar"} and len(b) == 4
    assert pd.Series([r.best for r in b]).sum() >= 2
