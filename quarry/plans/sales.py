"""Retail sales forecasting (R forecast/tseries in the reference): monthly market x segment
series, stability ranking, smoothing, decomposition, stationarity tests, trend regression,
seasonal AR and a 6-month back-test.  Bound to `orders` x `customer` x `nation` x `region`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggs, clean, evaluate, rank, series
from quarry.plans.tables import sales_lines, with_ctes

BY = ["market", "segment"]
# fixed values: the global trend-season formula of the study,
# sin(0.5 t) * poly(t, 2) + sin(0.15 t) + cos(0.5 t) * poly(t, 2)
TREND_SPEC = [("poly", 2), ("sin", 0.5), ("sinpoly", 0.5, 2), ("sin", 0.15), ("cos", 0.5), ("cospoly", 0.5, 2)]


def monthly(spark, sf):
    """M1: complete monthly series of sales (sum) and quantity (count)."""
    return series.to_series(sales_lines(spark, sf), "order_date", BY,
                            {"sales": F.sum("sales"), "quantity": F.count(F.lit(1))})


SERIES_SQL = """
, agg AS (SELECT market, segment, CAST(date_trunc('month', order_date) AS DATE) AS period, sum(sales) AS sales,
          count(*) AS quantity FROM sales_lines GROUP BY ALL)
, cal AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM agg), (SELECT max(period) FROM agg), INTERVAL 1 MONTH)) AS DATE) AS period)
, keys AS (SELECT DISTINCT market, segment FROM agg)
, series AS (SELECT k.market, k.segment, c.period, coalesce(a.sales, 0) AS sales, coalesce(a.quantity, 0) AS quantity,
             CAST(datediff('month', (SELECT min(period) FROM agg), c.period) + 1 AS BIGINT) AS t
             FROM keys k CROSS JOIN cal c LEFT JOIN agg a
             ON a.market = k.market AND a.segment = k.segment AND a.period = c.period)"""


def _sql(body):
    return with_ctes(SERIES_SQL + "\n" + body, "sales_lines")


def q_to_series(spark, sf):
    """M1: calendar-complete monthly sums per market x segment (missing month = 0)."""
    s = monthly(spark, sf)
    return s.select(*BY, "t", F.round("sales", 2).alias("sales"), "quantity")


SQL_TO_SERIES = _sql("SELECT market, segment, t, round(sales, 2) AS sales, quantity FROM series")


def q_rank_series(spark, sf):
    """M2: series by total sales with their coefficient of variation."""
    r = series.rank_series(monthly(spark, sf), BY, "sales")
    return r.select(*BY, F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"),
                    F.round("sd", 4).alias("sd"), F.round("cv", 8).alias("cv"), "rank")


SQL_RANK_SERIES = _sql("""SELECT market, segment, round(sum(sales), 2) AS total, round(avg(sales), 6) AS mean,
 round(stddev_samp(sales), 4) AS sd, round(stddev_samp(sales) / avg(sales), 8) AS cv,
 row_number() OVER (ORDER BY sum(sales) DESC, market, segment) AS rank FROM series GROUP BY market, segment""")


def q_rollup_to(spark, sf):
    """F8: order lines summed to month x market x segment, then to market x segment."""
    s = sales_lines(spark, sf).withColumn("month", F.date_format("order_date", "yy-MM"))
    r = aggs.rollup_to(s, ["month", *BY], BY, {"sales": "sales"})
    return r.withColumn("sales", F.round("sales", 2))


SQL_ROLLUP_TO = with_ctes("""SELECT market, segment, round(sum(s), 2) AS sales FROM (
 SELECT strftime(order_date, '%y-%m') AS month, market, segment, sum(sales) AS s FROM sales_lines GROUP BY ALL)
GROUP BY market, segment""", "sales_lines")


def q_coef_variation(spark, sf):
    """sd / mean of monthly sales per market (all segments pooled), one groupBy."""
    c = aggs.coef_variation(monthly(spark, sf), ["market"], "sales")
    return c.select("market", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"),
                    F.round("cv", 8).alias("cv"))


SQL_COEF_VARIATION = _sql("""SELECT market, round(avg(sales), 6) AS mean, round(stddev_samp(sales), 4) AS sd,
 round(stddev_samp(sales) / avg(sales), 8) AS cv FROM series GROUP BY market""")


def q_add_index(spark, sf):
    """1..n within each series by month."""
    s = clean.add_index(monthly(spark, sf), BY, ["period"], out="idx")
    return s.select(*BY, F.date_format("period", "yyyy-MM").alias("month"), "idx")


SQL_ADD_INDEX = _sql("""SELECT market, segment, strftime(period, '%Y-%m') AS month,
 row_number() OVER (PARTITION BY market, segment ORDER BY period) AS idx FROM series""")


def q_split_by_index(spark, sf):
    """Last 6 months held out per series -> training and test sizes and sums."""
    train, test = clean.split_by_index(monthly(spark, sf), BY, "t", n_test=6)
    a = train.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_train"), F.round(F.sum("sales"), 2).alias("train_sales"))
    b = test.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_test"), F.round(F.sum("sales"), 2).alias("test_sales"))
    return a.join(b, BY)


SQL_SPLIT_BY_INDEX = _sql("""SELECT market, segment, count(*) FILTER (WHERE t <= mx - 6) AS n_train,
 round(sum(sales) FILTER (WHERE t <= mx - 6), 2) AS train_sales, count(*) FILTER (WHERE t > mx - 6) AS n_test,
 round(sum(sales) FILTER (WHERE t > mx - 6), 2) AS test_sales
FROM (SELECT *, max(t) OVER (PARTITION BY market, segment) AS mx FROM series) GROUP BY market, segment""")


def q_moving_average(spark, sf):
    """Centred 3-month moving average, NULL where the window is not full."""
    m = rank.moving_average(monthly(spark, sf), BY, "t", "sales", 1)
    return m.select(*BY, "t", F.round("ma", 4).alias("ma"))


SQL_MOVING_AVERAGE = _sql("""SELECT market, segment, t, CASE WHEN count(sales) OVER w = 3 THEN round(avg(sales) OVER w, 4)
 END AS ma FROM series WINDOW w AS (PARTITION BY market, segment ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")


def q_lags(spark, sf):
    """Quantity one month and twelve months back."""
    l = rank.lags(monthly(spark, sf), BY, "t", "quantity", [1, 12])
    return l.select(*BY, "t", "quantity", "quantity_lag1", "quantity_lag12")


SQL_LAGS = _sql("""SELECT market, segment, t, quantity,
 lag(quantity, 1) OVER (PARTITION BY market, segment ORDER BY t) AS quantity_lag1,
 lag(quantity, 12) OVER (PARTITION BY market, segment ORDER BY t) AS quantity_lag12 FROM series""")


def q_smooth(spark, sf):
    """M3: 3-point moving average with linear extension at both ends."""
    s = series.smooth(monthly(spark, sf), BY, "t", "sales", 1)
    return s.select(*BY, "t", F.round("smoothed", 4).alias("smoothed"))


SQL_SMOOTH = _sql("""
, m AS (SELECT market, segment, t, CASE WHEN count(sales) OVER w = 3 THEN avg(sales) OVER w END AS ma,
        count(*) OVER (PARTITION BY market, segment) AS n FROM series
        WINDOW w AS (PARTITION BY market, segment ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
, e AS (SELECT *, max(ma) FILTER (WHERE t = 2) OVER p AS l1, max(ma) FILTER (WHERE t = 3) OVER p AS l2,
        max(ma) FILTER (WHERE t = n - 1) OVER p AS r1, max(ma) FILTER (WHERE t = n - 2) OVER p AS r2
        FROM m WINDOW p AS (PARTITION BY market, segment))
SELECT market, segment, t, round(CASE WHEN t <= 1 THEN l1 - (2 - t) * (l2 - l1)
 WHEN t > n - 1 THEN r1 + (t - (n - 1)) * (r1 - r2) ELSE ma END, 4) AS smoothed FROM e""".lstrip("\n"))


def q_decompose(spark, sf):
    """M4: additive decomposition, period 12."""
    d = series.decompose(monthly(spark, sf), BY, "t", "sales", 12)
    # cents, floored: round() differs between engines on values whose shortest decimal form
    # ends in 5 (decimal vs binary half-up), floor(x * 100) is the same IEEE operation in both
    return d.select(*BY, "t", *[(F.floor(F.col(c) * 100) / 100).alias(c) for c in ("trend", "seasonal", "remainder")])


SQL_DECOMPOSE = _sql("""
, tr AS (SELECT *, CASE WHEN count(sales) OVER w = 13 THEN (sum(sales) OVER w - 0.5 * (lag(sales, 6) OVER o
         + lead(sales, 6) OVER o)) / 12.0 END AS trend, (t - 1) % 12 AS phase FROM series
         WINDOW w AS (PARTITION BY market, segment ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING),
                o AS (PARTITION BY market, segment ORDER BY t))
, fg AS (SELECT market, segment, phase, avg(sales - trend) AS fig FROM tr GROUP BY ALL)
, fc AS (SELECT market, segment, phase, fig - avg(fig) OVER (PARTITION BY market, segment) AS fig FROM fg)
SELECT tr.market, tr.segment, t, floor(trend * 100) / 100 AS trend, floor(fc.fig * 100) / 100 AS seasonal,
 floor((sales - trend - fc.fig) * 100) / 100 AS remainder FROM tr JOIN fc USING (market, segment, phase)""".lstrip("\n"))


def q_acf(spark, sf):
    """M8: autocorrelations to lag 12 per series."""
    a = series.acf(monthly(spark, sf), BY, "t", "sales", 12)
    return a.select(*BY, "lag", F.round("acf", 10).alias("acf"))


ACF_SQL = """
, xc AS (SELECT market, segment, t, sales - avg(sales) OVER (PARTITION BY market, segment) AS x FROM series)
, s0 AS (SELECT market, segment, count(*) AS n, sum(x * x) AS s0 FROM xc GROUP BY ALL)
, sk AS (SELECT a.market, a.segment, l.lag, sum(a.x * b.x) AS sk FROM xc a
         CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS lag) l
         JOIN xc b ON a.market = b.market AND a.segment = b.segment AND b.t = a.t - l.lag GROUP BY ALL)
, acf AS (SELECT sk.market, sk.segment, CAST(sk.lag AS BIGINT) AS lag, sk / s0 AS acf, n FROM sk
          JOIN s0 USING (market, segment))"""

SQL_ACF = _sql(ACF_SQL.lstrip("\n") + "\nSELECT market, segment, lag, round(acf, 10) AS acf FROM acf")


def q_ljung_box(spark, sf):
    """Ljung-Box Q over 12 lags per series."""
    lb = series.ljung_box(series.acf(monthly(spark, sf), BY, "t", "sales", 12), BY, 12)
    return lb.select(*BY, F.round("q_stat", 8).alias("q_stat"), "df")


SQL_LJUNG_BOX = _sql(ACF_SQL.lstrip("\n") + """
SELECT market, segment, round(any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)), 8) AS q_stat,
 CAST(12 AS BIGINT) AS df FROM acf GROUP BY market, segment""")


def q_kpss_test(spark, sf):
    """KPSS level statistic and p-value per series (short Bartlett lag)."""
    k = series.kpss_test(monthly(spark, sf), BY, "t", "sales")
    return k.select(*BY, "n", "lags", F.round("statistic", 8).alias("statistic"), F.round("p_value", 8).alias("p_value"))


SQL_KPSS_TEST = _sql("""
, e AS (SELECT market, segment, t, sales - avg(sales) OVER (PARTITION BY market, segment) AS e FROM series)
, s AS (SELECT *, sum(e) OVER (PARTITION BY market, segment ORDER BY t ROWS UNBOUNDED PRECEDING) AS S FROM e)
, base AS (SELECT market, segment, count(*) AS n, sum(S * S) AS ss, sum(e * e) AS e2,
           CAST(floor(3.0 / 13 * sqrt(count(*))) AS INTEGER) AS l FROM s GROUP BY ALL)
, g AS (SELECT a.market, a.segment, k.s AS lag, sum(a.e * b.e) AS gk FROM e a
        CROSS JOIN (SELECT unnest(generate_series(1, 20)) AS s) k
        JOIN e b ON a.market = b.market AND a.segment = b.segment AND b.t = a.t - k.s GROUP BY ALL)
, lr AS (SELECT base.market, base.segment, any_value(n) AS n, any_value(l) AS l, any_value(ss) AS ss,
         any_value(e2) + coalesce(sum(2 * (1 - g.lag / (base.l + 1.0)) * g.gk) FILTER (WHERE g.lag <= base.l), 0) AS lr
         FROM base LEFT JOIN g ON base.market = g.market AND base.segment = g.segment GROUP BY ALL)
, st AS (SELECT market, segment, n, l, ss / (n * n) / (lr / n) AS stat FROM lr)
SELECT market, segment, n, CAST(l AS BIGINT) AS lags, round(stat, 8) AS statistic, round(CASE
 WHEN stat <= 0.347 THEN 0.10 WHEN stat <= 0.463 THEN 0.10 + (stat - 0.347) * ((0.05 - 0.10) / (0.463 - 0.347))
 WHEN stat <= 0.574 THEN 0.05 + (stat - 0.463) * ((0.025 - 0.05) / (0.574 - 0.463))
 WHEN stat <= 0.739 THEN 0.025 + (stat - 0.574) * ((0.01 - 0.025) / (0.739 - 0.574)) ELSE 0.01 END, 8) AS p_value
FROM st""".lstrip("\n"))


def q_forecast_accuracy(spark, sf):
    """Seasonal-naive forecast (same month last year) of the last 6 months, ME/RMSE/MAE/MPE/MAPE."""
    s = rank.lags(monthly(spark, sf), BY, "t", "sales", [12], prefix="naive")
    last = F.max("t").over(series._w(BY))
    test = s.withColumn("__last", last).where(F.col("t") > F.col("__last") - 6)
    a = evaluate.forecast_accuracy(test, BY, "sales", "naive12")
    return a.select(*BY, *[F.round(c, 6).alias(c) for c in ("me", "rmse", "mae", "mpe", "mape")])


SQL_FORECAST_ACCURACY = _sql("""
, f AS (SELECT market, segment, t, sales, lag(sales, 12) OVER (PARTITION BY market, segment ORDER BY t) AS naive,
        max(t) OVER (PARTITION BY market, segment) AS mx FROM series)
SELECT market, segment, round(avg(sales - naive), 6) AS me, round(sqrt(avg((sales - naive) * (sales - naive))), 6) AS rmse,
 round(avg(abs(sales - naive)), 6) AS mae, round(avg((sales - naive) / nullif(sales, 0) * 100), 6) AS mpe,
 round(avg(abs((sales - naive) / nullif(sales, 0)) * 100), 6) AS mape FROM f WHERE t > mx - 6 GROUP BY ALL""".lstrip("\n"))


def q_arg_max(spark, sf):
    """The best month (largest sales, earliest on ties) of each series -- an aggregate, no window."""
    a = rank.arg_max(monthly(spark, sf), BY, "sales", ["t"], cols=["t", "quantity", "sales"])
    return a.select(*BY, "t", "quantity", F.round("sales", 2).alias("sales"))


SQL_ARG_MAX = _sql("""SELECT market, segment, t, quantity, round(sales, 2) AS sales FROM (
 SELECT *, row_number() OVER (PARTITION BY market, segment ORDER BY sales DESC, t) AS r FROM series) WHERE r = 1""")


def q_time_basis(spark, sf):
    """Trig and polynomial bases of the time index (the regressors of the trend fit)."""
    s = monthly(spark, sf).select(*BY, "t")
    X = series.basis(F.col("t"), [("poly", 2), ("sin", 0.5), ("cos", 0.5), ("sinpoly", 0.5, 1)])
    names = ["one", "t1", "t2", "sin05", "cos05", "sin05_t1"]
    return s.select(*BY, "t", *[F.round(x, 10).alias(n) for x, n in zip(X, names)])


SQL_TIME_BASIS = _sql("""SELECT market, segment, t, 1.0 AS one, round(CAST(t AS DOUBLE), 10) AS t1,
 round(CAST(t AS DOUBLE) ^ 2, 10) AS t2, round(sin(0.5 * t), 10) AS sin05, round(cos(0.5 * t), 10) AS cos05,
 round(sin(0.5 * t) * t, 10) AS sin05_t1 FROM series""")


# ---- the model-based steps: no SQL twin (rows-only check; numeric unit tests in tests/)


def q_pacf(spark, sf):
    """M9: partial autocorrelations to lag 12 per series (Durbin-Levinson per series)."""
    return series.pacf(series.acf(monthly(spark, sf), BY, "t", "sales", 12), BY)


def q_pacf_low(spark, sf):
    """M9: partial autocorrelations of lags 1 to 3, which have a closed form in the autocorrelations."""
    p = series.pacf(series.acf(monthly(spark, sf), BY, "t", "sales", 3), BY)
    return p.select(*BY, "lag", F.round("pacf", 8).alias("pacf"))


SQL_PACF_LOW = _sql(ACF_SQL.lstrip("\n") + """
, r AS (SELECT market, segment, max(acf) FILTER (WHERE lag = 1) AS r1, max(acf) FILTER (WHERE lag = 2) AS r2,
        max(acf) FILTER (WHERE lag = 3) AS r3 FROM acf GROUP BY ALL)
, p AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM r)
, w AS (SELECT *, r1 - p2 * r1 AS p21 FROM p)
SELECT market, segment, CAST(1 AS BIGINT) AS lag, round(r1, 8) AS pacf FROM w UNION ALL
SELECT market, segment, 2, round(p2, 8) FROM w UNION ALL
SELECT market, segment, 3, round((r3 - p21 * r2 - p2 * r1) / (1 - p21 * r1 - p2 * r2), 8) FROM w""")


def q_adf_test(spark, sf):
    """Augmented Dickey-Fuller test per series."""
    return series.adf_test(monthly(spark, sf), BY, "t", "sales")


def _train(spark, sf):
    train, _ = clean.split_by_index(monthly(spark, sf), BY, "t", n_test=6)
    return train


def q_trend_fit(spark, sf):
    """M5: trend-season regression on the smoothed training months, per series (Gram sums + solve)."""
    sm = series.smooth(_train(spark, sf), BY, "t", "sales", 1)
    return series.trend_fit(sm, BY, "t", "smoothed", TREND_SPEC)


def q_trend_predict(spark, sf):
    """M6: the fitted trend carried 6 months ahead."""
    tr = _train(spark, sf)
    coefs = series.trend_fit(series.smooth(tr, BY, "t", "sales", 1), BY, "t", "smoothed", TREND_SPEC)
    return series.trend_predict(series.future_index(tr, BY, "t", 6), coefs, BY, "t", TREND_SPEC, "forecast")


def q_local_part(spark, sf):
    """M7: local part = raw value - global (trend-season) fit, per training month."""
    tr = _train(spark, sf)
    coefs = series.trend_fit(series.smooth(tr, BY, "t", "sales", 1), BY, "t", "smoothed", TREND_SPEC)
    fitted = series.trend_predict(tr, coefs, BY, "t", TREND_SPEC, "global")
    return fitted.select(*BY, "t", "sales", "global", (F.col("sales") - F.col("global")).alias("local"))


def q_seasonal_ar(spark, sf):
    """M13 + M14: seasonal AR order by AICc and its 6-month forecast with 95 % bands."""
    return series.seasonal_ar(_train(spark, sf), BY, "t", "sales", 12, 6)


def q_backtest(spark, sf):
    """Trend regression vs seasonal AR on the last 6 months, MAPE per series and the better one."""
    return series.backtest(monthly(spark, sf), BY, "t", "sales", TREND_SPEC, 6, 12)


def study(spark, sf, top: int = 2, horizon: int = 6) -> dict:
    """The whole sales study, end to end: monthly series of every market x segment,
    the ``top`` series by total sales (with their CV), then for each of them in one
    grouped plan: smoothing, trend-season regression on the training months, local
    part, stationarity tests and correlograms of the local part, seasonal AR order
    choice and forecast, and the hold-out comparison.  Returns the report DataFrames."""
    s = monthly(spark, sf)
    ranked = series.rank_series(s, BY, "sales")
    chosen = s.join(ranked.where(F.col("rank") <= top).select(*BY), BY, "left_semi")
    train, test = clean.split_by_index(chosen, BY, "t", n_test=horizon)
    sm = series.smooth(train, BY, "t", "sales", 1)
    coefs = series.trend_fit(sm, BY, "t", "smoothed", TREND_SPEC)
    fitted = series.trend_predict(train, coefs, BY, "t", TREND_SPEC, "global")
    local = fitted.withColumn("local", F.col("sales") - F.col("global"))
    acf_local = series.acf(local, BY, "t", "local", 12)
    return {
        "ranking": ranked,
        "local_adf": series.adf_test(local, BY, "t", "local"),
        "local_kpss": series.kpss_test(local, BY, "t", "local"),
        "local_acf": acf_local,
        "local_pacf": series.pacf(acf_local, BY),
        "trend_forecast": series.trend_predict(test, coefs, BY, "t", TREND_SPEC, "forecast"),
        "ar_forecast": series.seasonal_ar(train, BY, "t", "sales", 12, horizon),
        "backtest": series.backtest(chosen, BY, "t", "sales", TREND_SPEC, horizon, 12),
    }


QUERIES = {
    "to_series": q_to_series, "rank_series": q_rank_series, "rollup_to": q_rollup_to,
    "coef_variation": q_coef_variation, "add_index": q_add_index, "split_by_index": q_split_by_index,
    "moving_average": q_moving_average, "lags": q_lags, "smooth": q_smooth, "decompose": q_decompose,
    "acf": q_acf, "ljung_box": q_ljung_box, "kpss_test": q_kpss_test, "forecast_accuracy": q_forecast_accuracy,
    "arg_max": q_arg_max, "time_basis": q_time_basis, "pacf": q_pacf, "pacf_low": q_pacf_low, "adf_test": q_adf_test, "trend_fit": q_trend_fit, "trend_predict": q_trend_predict,
    "local_part": q_local_part, "seasonal_ar": q_seasonal_ar, "backtest": q_backtest,
}
ORACLE = {
    "to_series": SQL_TO_SERIES, "rank_series": SQL_RANK_SERIES, "rollup_to": SQL_ROLLUP_TO,
    "coef_variation": SQL_COEF_VARIATION, "add_index": SQL_ADD_INDEX, "split_by_index": SQL_SPLIT_BY_INDEX,
    "moving_average": SQL_MOVING_AVERAGE, "lags": SQL_LAGS, "smooth": SQL_SMOOTH, "decompose": SQL_DECOMPOSE,
    "acf": SQL_ACF, "ljung_box": SQL_LJUNG_BOX, "kpss_test": SQL_KPSS_TEST, "forecast_accuracy": SQL_FORECAST_ACCURACY,
    "arg_max": SQL_ARG_MAX, "time_basis": SQL_TIME_BASIS, "pacf_low": SQL_PACF_LOW,
}
