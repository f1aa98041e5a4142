"""Attrition and car-price modelling (R glm/caret and Python statsmodels/sklearn in the
reference): join the inputs, timesheet hours, dummies, scaling, splits, GLM / OLS with
step-wise, RFE and VIF pruning, scoring.  Bound to `customer` + `orders` + `events`, and `part` as cars."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import aggs, features, joins, models, reshape
from quarry.plans.tables import cars, read, with_ctes

X_COLS = ["acctbal", "n_orders", "mean_price", "max_price"]


def customer_stats(spark, sf):
    o = read(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"),
        F.max("o_totalprice").alias("max_price"))


def employees(spark, sf):
    """Customer x order stats x nation x region on the common keys."""
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"),
                                           F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    n = read(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    r = read(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
    j = joins.join_all([c, customer_stats(spark, sf)], "c_custkey")
    j = joins.join_all([j, n], "n_nationkey")
    j = joins.join_all([j, r], "r_regionkey")
    return j.withColumn("attrition", (F.col("c_mktsegment") == "BUILDING").cast("int"))


CTE_EMP = """
, emp AS (SELECT c_custkey, c_acctbal AS acctbal, c_mktsegment, n_orders, mean_price, max_price, r_name AS region,
          CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS attrition
          FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price,
                                     max(o_totalprice) AS max_price FROM orders GROUP BY o_custkey) s
               ON c_custkey = o_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def q_join_all(spark, sf):
    """The joined modelling table, per region and label."""
    e = employees(spark, sf)
    return e.groupBy("region", "attrition").agg(F.count(F.lit(1)).alias("n"), F.sum("n_orders").alias("orders"),
                                                F.round(F.avg("acctbal"), 6).alias("avg_acctbal"))


SQL_JOIN_ALL = "WITH x AS (SELECT 1)" + CTE_EMP + """
SELECT region, attrition, count(*) AS n, sum(n_orders) AS orders, round(avg(acctbal), 6) AS avg_acctbal FROM emp
GROUP BY region, attrition"""


def timesheets(spark, sf):
    """Two wide tables (one column per date, NULL on days off): first and last event time per user and
    date.  The dates are those of the events; they become the sheets' columns."""
    e = read(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    days = [r["day"] for r in e.where("day is not null").select("day").distinct().orderBy("day").collect()]
    g = e.groupBy("user_id").pivot("day", days)
    return g.agg(F.min("ts")), g.agg(F.max("ts"))


def q_timesheet_hours(spark, sf):
    """Mean hours between first and last event per user over the days with events."""
    t_in, t_out = timesheets(spark, sf)
    h = reshape.timesheet_hours(t_in, t_out, "user_id")
    return h.select("user_id", F.round("mean_hours", 8).alias("mean_hours"), "days_worked")


SQL_TIMESHEET_HOURS = """SELECT user_id, round(avg((epoch(t_out) - epoch(t_in)) / 3600.0), 8) AS mean_hours,
 count(*) AS days_worked FROM (SELECT user_id, CAST(ts AS DATE) AS d, min(ts) AS t_in, max(ts) AS t_out FROM events
 GROUP BY user_id, CAST(ts AS DATE)) GROUP BY user_id"""


def q_dummies(spark, sf):
    """One-hot of region with the alphabetically first level dropped -> ones per column."""
    d = reshape.dummies(employees(spark, sf).select("c_custkey", "region"), ["region"])
    cols = [c for c in d.columns if c.startswith("region_")]
    return d.agg(*[F.sum(c).cast("long").alias(c) for c in cols])


SQL_DUMMIES = "WITH x AS (SELECT 1)" + CTE_EMP + """
SELECT count(*) FILTER (WHERE region = 'AMERICA') AS region_AMERICA, count(*) FILTER (WHERE region = 'ASIA') AS region_ASIA,
 count(*) FILTER (WHERE region = 'EUROPE') AS region_EUROPE,
 count(*) FILTER (WHERE region = 'MIDDLE EAST') AS "region_MIDDLE EAST" FROM emp"""


def q_minmax_scale(spark, sf):
    """Min-max bounds fitted on the training customers (key % 10 < 7), applied to the others."""
    e = employees(spark, sf)
    train, test = e.where(F.col("c_custkey") % 10 < 7), e.where(F.col("c_custkey") % 10 >= 7)
    fit = features.minmax_fit(train, X_COLS)
    s = features.minmax_apply(test, fit, X_COLS)
    return s.agg(*[F.round(F.min(c), 10).alias(f"{c}_min") for c in X_COLS],
                 *[F.round(F.max(c), 10).alias(f"{c}_max") for c in X_COLS],
                 *[F.round(F.avg(c), 10).alias(f"{c}_avg") for c in X_COLS])


SQL_MINMAX_SCALE = "WITH x AS (SELECT 1)" + CTE_EMP + """
, f AS (SELECT """ + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in X_COLS) + """
        FROM emp WHERE c_custkey % 10 < 7)
, s AS (SELECT """ + ", ".join(f"coalesce(({c} - {c}_lo) / nullif({c}_hi - {c}_lo, 0), 0.0) AS {c}" for c in X_COLS) + """
        FROM emp, f WHERE c_custkey % 10 >= 7)
SELECT """ + ", ".join(f"round(min({c}), 10) AS {c}_min" for c in X_COLS) + ", " + \
    ", ".join(f"round(max({c}), 10) AS {c}_max" for c in X_COLS) + ", " + \
    ", ".join(f"round(avg({c}), 10) AS {c}_avg" for c in X_COLS) + " FROM s"


def q_split_stratified(spark, sf):
    """Stratified 70/30 split: exact training share within each label."""
    tr, te = features.split_stratified(employees(spark, sf), "attrition", ["c_custkey"], 0.7, seed=100)
    return tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test"))) \
        .groupBy("attrition", "part").agg(F.count(F.lit(1)).alias("n"))


SQL_SPLIT_STRATIFIED = "WITH x AS (SELECT 1)" + CTE_EMP + """
, c AS (SELECT attrition, count(*) AS n FROM emp GROUP BY attrition)
SELECT attrition, 'train' AS part, CAST(round(n * 0.7) AS BIGINT) AS n FROM c
UNION ALL SELECT attrition, 'test', n - CAST(round(n * 0.7) AS BIGINT) FROM c"""


def q_split_random(spark, sf):
    """Reproducible 70/30 random split by key hash (rows-only: the hash is Spark's)."""
    tr, te = features.split_random(employees(spark, sf), ["c_custkey"], 0.7, seed=100)
    return tr.select("c_custkey", F.lit("train").alias("part")).unionByName(
        te.select("c_custkey", F.lit("test").alias("part")))


def q_assemble(spark, sf):
    """Feature vectors and label, key kept."""
    return features.assemble(employees(spark, sf), X_COLS, "attrition", keep=["c_custkey"])


def q_logit(spark, sf):
    """K2: binomial GLM of attrition with coefficient table (z and p values)."""
    coefs, st = models.logit(employees(spark, sf), "attrition", X_COLS)
    return coefs.withColumn("aic", F.lit(st["aic"])).withColumn("deviance", F.lit(st["deviance"]))


def q_logit_l2(spark, sf):
    """K3: L2-penalised logistic regression (C = 1) on min-max scaled features."""
    e = employees(spark, sf)
    s = features.minmax_apply(e, features.minmax_fit(e, X_COLS), X_COLS)
    return models.logit_l2(s, "attrition", X_COLS, c=1.0)[0]


def q_step_aic(spark, sf):
    """K4: bidirectional step-wise AIC path over the GLM."""
    return models.step_aic(employees(spark, sf), "attrition", X_COLS)


def q_prune_features(spark, sf):
    """K7: backward elimination by VIF (> 2) and p-value (> 0.05) over the GLM."""
    return models.prune_features(employees(spark, sf), "attrition", X_COLS, max_vif=2.0, max_p=0.05)


def q_score(spark, sf):
    """K8 + L9: probabilities for the test customers from a GLM fitted on the training ones, key kept."""
    tr, te = features.split_stratified(employees(spark, sf), "attrition", ["c_custkey"], 0.7, seed=100)
    _, st = models.logit(tr, "attrition", X_COLS)
    s = models.score(st["model"], te, X_COLS, ["c_custkey", "attrition"])
    return s


def study(spark, sf) -> dict:
    """The whole attrition study, end to end: joined inputs with timesheet hours, NULL and
    constant checks, caps, dummies, stratified split, scaling fitted on training rows, binomial
    GLM, step-wise AIC, VIF/p-value pruning, scores for the test rows, cutoff sweep, best
    cutoffs, KS and lift.  Returns the report DataFrames."""
    from quarry.operators import clean, evaluate, profile
    from quarry.session import cut_lineage
    e = employees(spark, sf)
    t_in, t_out = timesheets(spark, sf)
    hours = reshape.timesheet_hours(t_in, t_out, "user_id").select(
        F.col("user_id").alias("c_custkey"), F.col("mean_hours"))
    e = e.join(hours, "c_custkey", "left").fillna({"mean_hours": 0.0})
    e = clean.cap(e, {"acctbal": (-500.0, 9000.0)})
    # the modelling table, the two parts and the scores are written once (checkpoints in the
    # shared folder): every later step reads them instead of re-deriving a deep plan
    e = cut_lineage(reshape.dummies(e, ["region"], keep_original=False))
    xs = X_COLS + ["mean_hours"] + [c for c in e.columns if c.startswith("region_")]
    tr, te = features.split_stratified(e, "attrition", ["c_custkey"], 0.7, seed=100)
    fit = cut_lineage(features.minmax_fit(tr, xs))
    tr_s = cut_lineage(features.minmax_apply(tr, fit, xs))
    te_s = cut_lineage(features.minmax_apply(te, fit, xs))
    coefs, st = models.logit(tr_s, "attrition", xs)
    scored = cut_lineage(models.score(st["model"], te_s, xs, ["c_custkey", "attrition"]))
    cutoffs = [round(0.01 + i * (0.80 - 0.01) / 99, 10) for i in range(100)]
    sweep = evaluate.cutoff_sweep(scored, "attrition", "score", cutoffs)
    return {
        "nulls": profile.null_counts(e), "constants": profile.constant_columns(e),
        "coefficients": coefs, "step_aic": models.step_aic(tr_s, "attrition", xs),
        "pruning": models.prune_features(tr_s, "attrition", xs), "scores": scored, "sweep": sweep,
        "best_cutoffs": evaluate.best_cutoffs(sweep), "ks": evaluate.max_ks(sweep),
        "lift": evaluate.lift_table(scored, "attrition", "score", ["c_custkey"], 10),
    }


# ---- cars (part): least squares


CAR_X = ["enginesize", "car_id"]


def car_table(spark, sf):
    return cars(spark, sf)


def q_ols(spark, sf):
    """K1 (one predictor + intercept): price on engine size -> estimate, std error, t."""
    coefs, _ = models.ols(car_table(spark, sf), "price", ["enginesize"])
    return coefs.select("term", F.round("estimate", 8).alias("estimate"), F.round("std_error", 8).alias("std_error"),
                        F.round("statistic", 6).alias("statistic"))


SQL_OLS = with_ctes("""
, r AS (SELECT regr_slope(price, enginesize) AS b, regr_intercept(price, enginesize) AS a, count(*) AS n,
        regr_sxx(price, enginesize) AS sxx, avg(enginesize) AS mx FROM cars)
, e AS (SELECT sum((price - a - b * enginesize) * (price - a - b * enginesize)) / (any_value(n) - 2) AS s2
        FROM cars, r)
SELECT 'enginesize' AS term, round(b, 8) AS estimate, round(sqrt(s2 / sxx), 8) AS std_error,
 round(b / sqrt(s2 / sxx), 6) AS statistic FROM r, e
UNION ALL SELECT '(Intercept)', round(a, 8), round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 8),
 round(a / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 6) FROM r, e""", "cars")


def q_ols_no_intercept(spark, sf):
    """J5 + K1: the intercept is an explicit option (Q17): price on engine size through the origin."""
    coefs, _ = models.ols(car_table(spark, sf), "price", ["enginesize"], intercept=False)
    return coefs.select("term", F.round("estimate", 8).alias("estimate"), F.round("std_error", 8).alias("std_error"))


SQL_OLS_NO_INTERCEPT = with_ctes("""
, b AS (SELECT sum(enginesize * price) / sum(enginesize * enginesize) AS b, sum(enginesize * enginesize) AS sxx,
        count(*) AS n FROM cars)
SELECT 'enginesize' AS term, round(b, 8) AS estimate,
 round(sqrt(sum((price - b * enginesize) * (price - b * enginesize)) / (any_value(n) - 1) / any_value(sxx)), 8)
 AS std_error FROM cars, b GROUP BY b""", "cars")


def q_vif(spark, sf):
    """K6 (centred, two predictors): VIF = 1 / (1 - r^2)."""
    v = models.vif(car_table(spark, sf), CAR_X, centred=True)
    return v.select("feature", F.round("vif", 8).alias("vif"))


SQL_VIF = with_ctes("""SELECT 'enginesize' AS feature, round(1 / (1 - corr(enginesize, car_id) ^ 2), 8) AS vif FROM cars
UNION ALL SELECT 'car_id', round(1 / (1 - corr(enginesize, car_id) ^ 2), 8) FROM cars""", "cars")


def q_vif_uncentred(spark, sf):
    """K6 (uncentred, statsmodels without a constant): G_ii inv(G)_ii from one Gram aggregate."""
    return models.vif(car_table(spark, sf), ["enginesize", "car_id", "price"], centred=False)


def q_rfe(spark, sf):
    """K5: recursive elimination to 2 of 3 car features (one Gram pass for all rounds)."""
    c = car_table(spark, sf).withColumn("body_len", F.length("carbody"))
    return models.rfe(c, "price", ["enginesize", "car_id", "body_len"], 2, kind="ols")


def q_residuals(spark, sf):
    """K9 + F16: residuals of price on engine size and car id, and their 20-bin histogram."""
    c = car_table(spark, sf)
    _, st = models.ols(c, "price", CAR_X)
    r = models.residuals(st["model"], c, "price", CAR_X, ["car_id"])
    return aggs.histogram(r, "residual", 20)


def q_row_mean(spark, sf):
    """Mean of engine size, price and a half-NULL column per car, NULLs skipped."""
    c = car_table(spark, sf).withColumn("half", F.when(F.col("car_id") % 2 == 0, F.col("price") / 2))
    m = reshape.row_mean(c, ["car_id"], ["enginesize", "price", "half"])
    return m.withColumn("row_mean", F.round("row_mean", 8))


SQL_ROW_MEAN = with_ctes("""SELECT car_id, round((enginesize + price + coalesce(half, 0))
 / (2 + CAST(half IS NOT NULL AS INTEGER)), 8) AS row_mean
FROM (SELECT *, CASE WHEN car_id % 2 = 0 THEN price / 2 END AS half FROM cars)""", "cars")


def q_vif_uncentred_pair(spark, sf):
    """K6 (uncentred, two predictors): VIF = G11 G22 / (G11 G22 - G12^2)."""
    v = models.vif(car_table(spark, sf), ["enginesize", "price"], centred=False)
    return v.select("feature", F.round("vif", 8).alias("vif"))


SQL_VIF_UNCENTRED_PAIR = with_ctes("""
, g AS (SELECT sum(enginesize * enginesize) AS a, sum(price * price) AS b, sum(enginesize * price) AS c FROM cars)
SELECT f.feature, round(a * b / (a * b - c * c), 8) AS vif FROM g, (SELECT unnest(['enginesize', 'price']) AS feature) f""", "cars")


def q_score_line(spark, sf):
    """Predicted price of every car from the line on engine size, with the actual one."""
    c = car_table(spark, sf)
    _, st = models.ols(c, "price", ["enginesize"])
    s = models.score(st["model"], c, ["enginesize"], ["car_id", "price"], "predicted")
    return s.select("car_id", "price", F.round("predicted", 6).alias("predicted"))


SQL_SCORE_LINE = with_ctes("""
, r AS (SELECT regr_slope(price, enginesize) AS b, regr_intercept(price, enginesize) AS a FROM cars)
SELECT car_id, price, round(a + b * enginesize, 6) AS predicted FROM cars, r""", "cars")


def q_residual_line(spark, sf):
    """K9: residual of every car around the line on engine size."""
    c = car_table(spark, sf)
    _, st = models.ols(c, "price", ["enginesize"])
    r = models.residuals(st["model"], c, "price", ["enginesize"], ["car_id"])
    return r.select("car_id", F.round("residual", 6).alias("residual"))


SQL_RESIDUAL_LINE = with_ctes("""
, r AS (SELECT regr_slope(price, enginesize) AS b, regr_intercept(price, enginesize) AS a FROM cars)
SELECT car_id, round(price - a - b * enginesize, 6) AS residual FROM cars, r""", "cars")


def q_assemble_sum(spark, sf):
    """The assembled feature vector of every car, by its length and the sum of its parts."""
    v = features.assemble(car_table(spark, sf), ["enginesize", "price", "car_id"], keep=["car_id"])
    parts = vector_to_array("features")
    return v.select("car_id", F.size(parts).cast("long").alias("parts"),
                    F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


SQL_ASSEMBLE_SUM = with_ctes("""SELECT car_id, CAST(3 AS BIGINT) AS parts,
 round(CAST(enginesize AS DOUBLE) + price + car_id, 6) AS total FROM cars""", "cars")


QUERIES = {
    "vif_uncentred_pair": q_vif_uncentred_pair, "score_line": q_score_line, "residual_line": q_residual_line,
    "assemble_sum": q_assemble_sum, "join_all": q_join_all, "timesheet_hours": q_timesheet_hours, "dummies": q_dummies,
    "minmax_scale": q_minmax_scale, "split_stratified": q_split_stratified, "split_random": q_split_random,
    "assemble": q_assemble, "logit": q_logit, "logit_l2": q_logit_l2, "step_aic": q_step_aic,
    "prune_features": q_prune_features, "score": q_score, "ols": q_ols, "vif": q_vif,
    "vif_uncentred": q_vif_uncentred, "rfe": q_rfe, "residuals": q_residuals, "row_mean": q_row_mean,
    "ols_no_intercept": q_ols_no_intercept,
}
ORACLE = {
    "vif_uncentred_pair": SQL_VIF_UNCENTRED_PAIR, "score_line": SQL_SCORE_LINE, "residual_line": SQL_RESIDUAL_LINE,
    "assemble_sum": SQL_ASSEMBLE_SUM,
    "join_all": SQL_JOIN_ALL, "timesheet_hours": SQL_TIMESHEET_HOURS, "dummies": SQL_DUMMIES,
    "minmax_scale": SQL_MINMAX_SCALE, "split_stratified": SQL_SPLIT_STRATIFIED, "ols": SQL_OLS, "vif": SQL_VIF,
    "row_mean": SQL_ROW_MEAN, "ols_no_intercept": SQL_OLS_NO_INTERCEPT,
}
