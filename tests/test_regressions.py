"""One test per defect of earlier versions: each fails on the code it was written against."""

import decimal
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import aggs, clean, evaluate, joins, models, profile, rank, reshape, series
from quarry.operators.order import running_total


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_running_total_keeps_types_and_uses_no_python(spark):
    big = 2 ** 53 + 1
    rows = [(1, big, float("nan"), decimal.Decimal("0.10")), (2, None, 1.0, decimal.Decimal("0.20")), (3, big + 2, None, None)]
    d = spark.createDataFrame(rows, "id long, b long, x double, w decimal(10,2)")
    out = running_total(d, ["id"], F.col("w"), out="c")
    got = out.orderBy("id").collect()
    assert [r["b"] for r in got] == [big, None, big + 2]
    assert math.isnan(got[0]["x"]) and got[2]["x"] is None
    assert [r["c"] for r in got] == [decimal.Decimal("0.10"), decimal.Decimal("0.30"), decimal.Decimal("0.30")]
    assert not any(w in plan(out) for w in ("Python", "Pandas", "Arrow", "InMemoryTableScan"))


def test_range_numbers_survive_union_and_coalesce(spark):
    d = spark.range(2000).withColumn("v", F.col("id") % 7)
    a = running_total(d, [F.col("v").desc(), "id"], out="rn")
    both = spark.range(3).select(F.col("id"), F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("rn")).unionByName(a).coalesce(2)
    want = {r: i + 1 for i, r in enumerate(sorted(range(2000), key=lambda i: (-(i % 7), i)))}
    assert {r["id"]: r["rn"] for r in both.where("rn > 0").collect()} == want


@pytest.mark.parametrize("n", [0, 1, 37, 150, 1000])
def test_exact_sample(spark, n):
    d = spark.range(1000).withColumn("t", F.lit("x"))
    a = {r["id"] for r in clean.sample_rows(d, ["id"], n=n, seed=3).collect()}
    assert len(a) == n and a == {r["id"] for r in clean.sample_rows(d.repartition(3), ["id"], n=n, seed=3).collect()}
    if n == 37:
        assert a <= {r["id"] for r in clean.sample_rows(d, ["id"], n=150, seed=3).collect()}


def kpss(x, lag):
    e = x - x.mean()
    s2 = (e @ e + 2 * sum((1 - s / (lag + 1)) * (e[s:] @ e[:-s]) for s in range(1, lag + 1))) / len(x)
    return (np.cumsum(e) ** 2).sum() / len(x) ** 2 / s2


def test_kpss_lags_are_not_cut(spark):
    r = np.random.default_rng(1)
    x = np.cumsum(r.normal(size=1200)) * 0.05 + r.normal(size=1200)
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [(None, i, float(v)) for i, v in enumerate(x[:50])], "k string, t long, x double")
    for lags, la, lb in ((40, 40, 40), ("long", 24, 5), ("short", 7, 1)):
        got = {r["k"]: r for r in series.kpss_test(d, ["k"], "t", "x", lags).collect()}
        assert (got["a"]["lags"], got[None]["lags"]) == (la, lb)
        assert abs(got["a"]["statistic"] - kpss(x, la)) < 1e-9 and abs(got[None]["statistic"] - kpss(x[:50], lb)) < 1e-9


def test_null_series_key_keeps_its_values(spark):
    d = spark.createDataFrame([(None, "2024-01-05", 3.0), ("a", "2024-03-01", 2.0)], "k string, d string, v double")
    got = series.to_series(d, "d", ["k"], {"s": F.sum("v")}).collect()
    assert {(r["k"], str(r["period"])): r["s"] for r in got if r["s"]} == {(None, "2024-01-01"): 3.0, ("a", "2024-03-01"): 2.0}
    assert len(got) == 6


def test_wide_crosstab_and_histogram_have_zero_cells(spark):
    d = spark.createDataFrame([("a", "x", 0.0), ("b", "y", 10.0), ("b", "y", 1.0)], "g string, s string, v double")
    assert {tuple(r) for r in aggs.crosstab(d, "g", "s", wide=True, levels=["x", "y", "z"]).collect()} == {("a", 1, 0, 0), ("b", 0, 2, 0)}
    assert [(r["bin"], r["n"]) for r in aggs.histogram(d, "v", 5).orderBy("bin").collect()] == [(1, 2), (2, 0), (3, 0), (4, 0), (5, 1)]
    per = aggs.histogram(d, "v", 2, "g").collect()
    assert {(r["g"], r["bin"]): r["n"] for r in per} == {("a", 1): 1, ("a", 2): 0, ("b", 1): 1, ("b", 2): 1}


def test_kappa_of_large_counts(spark):
    d = spark.createDataFrame([(0, 0), (1, 1), (0, 1)], "y int, p int")
    r = evaluate.multiclass_report(d, "y", "p")
    assert "cast(n_actual" in plan(r).replace("#", " ").lower() or "as double) * " in plan(r)
    assert abs(r.first()["kappa"] - 0.4) < 1e-9


def test_row_mean_is_row_local(spark):
    d = spark.createDataFrame([(1, 1.0, None), (1, 20.0, 22.0), (2, None, None)], "k long, a double, b double")
    out = reshape.row_mean(d, ["k"], ["a", "b"])
    assert sorted((r["k"], r["row_mean"]) for r in out.where("row_mean is not null").collect()) == [(1, 1.0), (1, 21.0)] and out.count() == 3
    assert "Exchange" not in plan(out)


def test_models_keep_rows_without_features(spark):
    d = spark.createDataFrame([(i, float(i), float(2 * i + 1)) for i in range(19)] + [(19, None, 5.0)], "k long, x double, y double")
    _, st = models.ols(d, "y", ["x"])
    s = {r["k"]: r["score"] for r in models.score(st["model"], d, ["x"], ["k"]).collect()}
    assert len(s) == 20 and s[19] is None and abs(s[4] - 9) < 1e-6
    r = {x["k"]: x["residual"] for x in models.residuals(st["model"], d, "y", ["x"], ["k"]).collect()}
    assert len(r) == 20 and r[19] is None


def test_plans_without_needless_shuffles(spark):
    d = spark.range(50).selectExpr("id", "id % 3 as g", "cast(null as string) as e", "'c' as c", "if(id = 1, null, 'c') as h")
    out = profile.constant_columns(d)
    assert "Expand" not in plan(out)
    assert {r["column"]: (r["n_null"], r["is_constant"]) for r in out.collect()} == {
        "id": (0, False), "g": (0, False), "e": (50, True), "c": (0, True), "h": (1, False)}
    sweep = evaluate.cutoff_sweep(d.selectExpr("g = 1 as y", "id / 50 as s"), "y", "s", [0.1, 0.5])
    assert "__s" not in plan(sweep)
    a, b = (spark.createDataFrame([("u", s1, s2)], "k string, d1 string, d2 string").selectExpr("k", "timestamp(d1) d1", "timestamp(d2) d2")
            for s1, s2 in (("2024-01-01 08:00:00", None), ("2024-01-01 16:30:00", "2024-01-02 10:00:00")))
    h = reshape.timesheet_hours(a, b, "k")
    assert tuple(h.first()) == ("u", 8.5, 1) and "Expand" not in plan(h)


def test_lookup_computes_its_side_once(spark):
    seen = spark.sparkContext.accumulator(0)
    dim = spark.range(100).withColumn("a", F.udf(lambda i: (seen.add(1), str(i))[1])("id"))
    out = joins.lookup(spark.range(10), dim, "id", ["a"])
    assert seen.value == 0  # planning runs nothing
    assert out.count() == 10


def test_grid_search_uses_sigma_and_finds_the_ring(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(240, 2))
    y = (np.hypot(*x.T) > 1.1).astype(float)
    from pyspark.ml.functions import array_to_vector
    d = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, x array<double>").withColumn("f", array_to_vector("x"))
    got = {(g["sigma"], g["c"]): g for g in models.grid_search(d, "label", "f", {"sigma": [1e-6, 0.5], "c": [10.0]}, folds=3, max_iter=30, n_features=64).collect()}
    assert got[0.5, 10.0]["accuracy"] > 0.85 > got[1e-6, 10.0]["accuracy"] and got[0.5, 10.0]["kappa"] > 0.7
    line = {g["c"]: g for g in models.grid_search(d.withColumn("label", (F.col("x")[0] > 0).cast("double")), "label", "f", {"c": [10.0]}, folds=3).collect()}
    assert line[10.0]["accuracy"] > 0.95 and line[10.0]["kappa"] > 0.9


def test_ntile_of_wide_rows(spark):
    d = spark.range(103).selectExpr("id", "id % 10 as s", "array(id) as extra")
    got = rank.ntile_bucket(d, "s", 4, ["id"])
    assert sorted(r["count"] for r in got.groupBy("bucket").count().collect()) == [25, 26, 26, 26]


def glm_data(spark, seed=4, n=400):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=n), r.normal(size=n)
    x = np.stack([a, 0.9 * a + 0.3 * b, r.normal(size=n), r.normal(size=n)], axis=1)
    y = (r.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 2])))).astype(int)
    return x, y, spark.createDataFrame([(*map(float, row), int(t)) for row, t in zip(x, y)], "a double, b double, c double, d double, y int")


def irls(x, y, ridge=0.0):
    X, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    pen = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        H = X.T @ (X * (p * (1 - p))[:, None]) + pen
        beta = beta + np.linalg.solve(H, X.T @ (y - p) - pen @ beta)
    return beta, H


def test_vif_of_a_fitted_glm(spark):
    x, y, d = glm_data(spark)
    V = np.linalg.inv(irls(x, y)[1])[1:, 1:]
    s = np.sqrt(np.diag(V))
    want = np.diag(np.linalg.inv(V / np.outer(s, s)))
    got = {r["feature"]: r["vif"] for r in models.vif_glm(d, "y", ["a", "b", "c", "d"]).collect()}
    assert np.allclose([got[k] for k in "abcd"], want, rtol=1e-4)


def test_centred_vif_with_large_means(spark):
    x, _, d = glm_data(spark)
    far = d.select((F.col("a") + 1e9).alias("a"), (F.col("b") + 1e9).alias("b"), "c")
    want = np.diag(np.linalg.inv(np.corrcoef(x[:, :3].T)))
    got = [r["vif"] for r in models.vif(far, ["a", "b", "c"]).collect()]
    assert np.allclose(got, want, rtol=1e-3)


def test_penalised_logit_and_its_rfe(spark):
    x, y, d = glm_data(spark)
    beta = irls(x, y, ridge=1 / 0.5)[0]
    coefs = {r["term"]: r["estimate"] for r in models.logit_l2(d, "y", ["a", "b", "c", "d"], c=0.5)[0].collect()}
    assert np.allclose([coefs[k] for k in "abcd"], beta[1:], atol=1e-3)
    got = {r["feature"]: (r["selected"], r["rank"]) for r in models.rfe(d, "y", ["a", "b", "c", "d"], 2, "logit_l2", c=0.5).collect()}
    left, rank_ = list(range(4)), {}
    while len(left) > 2:
        w = np.abs(irls(x[:, left], y, ridge=2.0)[0][1:])
        rank_["abcd"[left.pop(int(w.argmin()))]] = len(left) - 1
    assert got == {k: (k not in rank_, rank_.get(k, 1)) for k in "abcd"}


def test_pruning_and_stepwise_find_the_signal(spark):
    _, _, d = glm_data(spark)
    path = models.prune_features(d, "y", ["a", "b", "c", "d"]).collect()
    assert {r["dropped"] for r in path} >= {"d"} and "c" not in {r["dropped"] for r in path}
    steps = models.step_aic(d, "y", ["a", "b", "c", "d"]).collect()
    aic = [r["aic"] for r in steps]
    assert aic == sorted(aic, reverse=True) and steps[0]["action"] == "start"


def test_polynomial_svm_split_and_assemble(spark):
    from pyspark.ml.functions import array_to_vector

    from quarry.operators import features
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 3))
    d = spark.createDataFrame([(i, float(a @ a > 2.4), a.tolist()) for i, a in enumerate(x)], "id long, y double, x array<double>").withColumn("f", array_to_vector("x"))
    m, z = models.svm_poly(d, "y", "f", degree=2, c=100.0)
    out = m.transform(z).collect()
    assert np.mean([r["y"] == r["prediction"] for r in out]) > 0.9
    tr, te = features.split_random(spark.range(1000), ["id"], 0.7, seed=3)
    a, b = ({r["id"] for r in p.collect()} for p in (tr, te))
    assert not a & b and len(a | b) == 1000 and 600 < len(a) < 800
    v = features.assemble(spark.createDataFrame([(1, 2.0, 3.0)], "id long, p double, q double"), ["p", "q"]).first()
    assert [list(c) for c in v if hasattr(c, "toArray")] == [[2.0, 3.0]]


def test_ljung_box_p_values():
    for x, k, p in ((18.307, 10, 0.05), (3.841, 1, 0.05), (11.070, 5, 0.05), (0.0, 4, 1.0), (23.209, 10, 0.01)):
        assert abs(series._chi2_tail(x, k) - p) < 2e-4


def test_seasonal_fit_residuals_are_diagnosed(spark):
    r = np.random.default_rng(7)
    t = np.arange(150)
    season = 10 * np.sin(2 * np.pi * t / 12) + 100
    ar = np.zeros(150)
    for i in range(1, 150):
        ar[i] = 0.6 * ar[i - 1] + r.normal()
    rows = [("a", int(i), float(v)) for i, v in zip(t + 1, season + ar)] + [("b", int(i), float(v)) for i, v in zip(t + 1, season)]
    d = spark.createDataFrame(rows, "k string, t long, y double")
    res = series.seasonal_ar_residuals(d, ["k"], "t", "y")
    got = res.where("k = 'a'").toPandas()
    assert np.allclose(got["fitted"] + got["residual"], got["actual"]) and len(got) < 150 - 12
    assert res.where("k = 'b'").agg(F.max(F.abs("residual"))).first()[0] < 1e-6
    lb = series.ljung_box(series.acf(res.where("k = 'a'"), ["k"], "t", "residual", 10), ["k"], 10, 2).first()
    raw = series.ljung_box(series.acf(d.where("k = 'a'"), ["k"], "t", "y", 10), ["k"], 10).first()
    assert lb["p_value"] > raw["p_value"] and raw["p_value"] < 1e-6 and lb["df"] == 8
    orders = {x["k"]: x["order"] for x in series.seasonal_ar(d, ["k"], "t", "y").collect()}
    assert orders["a"].startswith(("(1,0,0)", "(2,0,0)"))


def test_partitioned_write_splits_and_reads_back(spark, tmp_path):
    from quarry import sources
    d = spark.range(1000).selectExpr("id", "id % 3 as part", "'2024' as yr")
    sources.write_partitioned(d, str(tmp_path / "t"), ["yr", "part"])
    back = sources.read_partitioned(spark, str(tmp_path / "t"), "part = 1")
    assert back.count() == 333 and back.agg(F.sum("id")).first()[0] == sum(range(1, 1000, 3))
