"""FIXTURES `empty`: operators on inputs with a schema and no rows return empty or NULL results, never fail."""

from pyspark.sql import functions as F

from quarry.operators import aggs, clean, evaluate, features, order, profile, rank, reshape, series


def empty(spark):
    return spark.createDataFrame([], "id long, g string, x double, y int, d timestamp")


def test_order_primitives_on_empty(spark):
    e = empty(spark)
    assert order.row_index(e, ["id"]).count() == 0
    assert order.running_total(e, ["id"], F.col("x"), by=["g"]).count() == 0
    # a global aggregate over no rows is one row of NULLs (as SQL percentile / quantile_cont)
    assert [(r.prob, r.value) for r in order.quantiles(e, "x", [0.5]).collect()] == [(0.5, None)]
    assert order.hinges(e, "x", ["g"]).count() == 0


def test_profiles_on_empty(spark):
    e = empty(spark)
    assert profile.shape(e).first().n_rows == 0
    assert {r.column: r.nulls for r in profile.null_counts(e).collect()}["x"] == 0
    assert profile.duplicate_count(e).first().duplicates == 0
    b = profile.box_stats(e, "x").collect()
    assert len(b) == 1 and b[0].n == 0 and b[0].q1 is None and b[0].n_outliers == 0
    assert profile.box_stats(e, "x", ["g"]).count() == 0
    assert profile.outliers(e, "x").count() == 0
    assert profile.describe(e, ["x"]).first()["count"] == 0
    assert profile.rule_violations(e, {"neg": F.col("x") < 0}).first().violations == 0


def test_ranking_and_evaluation_on_empty(spark):
    e = empty(spark)
    assert rank.top_k(e, "g", 3).count() == 0
    assert rank.top_k_by(e, ["g"], "id", 3).count() == 0
    assert rank.arg_max(e, ["g"], "x", ["id"]).count() == 0
    assert rank.ntile_bucket(e, "x", 10, ["id"]).count() == 0
    assert rank.share_of_total(e, "x", [F.col("id")]).count() == 0
    sweep = evaluate.cutoff_sweep(e, "y", "x", [0.1, 0.5]).collect()
    assert [(r.tp, r.fp, r.tn, r.fn, r.accuracy) for r in sweep] == [(0, 0, 0, 0, None)] * 2
    assert evaluate.lift_table(e, "y", "x", ["id"]).count() == 0
    assert aggs.histogram(e, "x", 5).count() == 0
    assert [r.above for r in aggs.count_above_mean(e, ["x"]).collect()] == [0]


def test_cleaning_features_series_on_empty(spark):
    e = empty(spark)
    assert clean.cleanse(e, {"neg": F.col("x") < 0}).count() == 0
    assert clean.sample_rows(e, ["id"], frac=0.5).count() == 0
    tr, te = features.split_stratified(e, "y", ["id"], 0.7)
    assert tr.count() == 0 and te.count() == 0
    assert reshape.row_mean(e, ["id"], ["x", "y"]).count() == 0
    assert series.to_series(e, "d", ["g"], {"x": F.sum("x")}).count() == 0
    assert series.kpss_test(e.withColumn("t", F.col("id")), ["g"], "t", "x").count() == 0
