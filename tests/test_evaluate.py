import numpy as np
from pyspark.sql import functions as F

from quarry.operators import evaluate


def scored(spark, n=3000):
    rng = np.random.default_rng(5)
    s = np.round(rng.uniform(size=n), 3)
    y = (rng.uniform(size=n) < s).astype(int)
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                                 "id long, label int, score double"), y, s


def test_cutoff_sweep_equals_brute_force(spark):
    df, y, s = scored(spark)
    cuts = [round(0.01 + i * 0.79 / 99, 10) for i in range(100)] + [0.5]
    for inclusive in (True, False):
        got = {r.cutoff: r for r in evaluate.cutoff_sweep(df, "label", "score", cuts, inclusive).collect()}
        for c in cuts:
            pred = (s >= c) if inclusive else (s > c)
            tp = int(((pred == 1) & (y == 1)).sum())
            fp = int(((pred == 1) & (y == 0)).sum())
            assert (got[c].tp, got[c].fp) == (tp, fp)
            assert got[c].tp + got[c].fp + got[c].tn + got[c].fn == len(y)


def test_lift_gain_ends_at_100(spark):
    df, y, _ = scored(spark)
    t = sorted(evaluate.lift_table(df, "label", "score", ["id"], 10).collect())
    assert [r.bucket for r in t] == list(range(1, 11))
    assert abs(t[-1].gain - 100.0) < 1e-9 and sum(r.total for r in t) == len(y)


def test_multiclass_report_small(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    r = {x["class"]: x for x in evaluate.multiclass_report(df, "y", "p").collect()}
    assert r["a"].sensitivity == 0.5 and r["b"].ppv == 2 / 3 and r["c"].sensitivity == 0.0
    assert abs(r["a"].accuracy - 0.6) < 1e-12
    pe = (2 * 2 + 2 * 3 + 1 * 0) / 25
    assert abs(r["a"].kappa - (0.6 - pe) / (1 - pe)) < 1e-12


def test_forecast_accuracy(spark):
    df = spark.createDataFrame([("s", 100.0, 90.0), ("s", 200.0, 220.0)], "k string, a double, f double")
    r = evaluate.forecast_accuracy(df, ["k"], "a", "f").first()
    assert abs(r.mape - 10.0) < 1e-12 and abs(r.mae - 15.0) < 1e-12 and abs(r.me - (-5.0)) < 1e-12


def test_max_ks_tie_rule(spark):
    sweep = spark.createDataFrame([(0.1, 0.9, 0.5), (0.2, 0.8, 0.6), (0.3, 0.7, 0.5)],
                                  "cutoff double, sensitivity double, specificity double")
    assert tuple(evaluate.max_ks(sweep).first()) == (0.2, 0.4)
    tied = spark.createDataFrame([(0.1, 0.9, 0.5), (0.3, 0.8, 0.6)], "cutoff double, sensitivity double, specificity double")
    assert evaluate.max_ks(tied).first().cutoff == 0.3
    assert evaluate.max_ks(tied, prefer="smallest").first().cutoff == 0.1


def test_missing_keys_null_semantics(spark):
    from quarry.operators import joins
    a = spark.createDataFrame([("x",), (None,), ("y",)], "k string")
    b = spark.createDataFrame([("x",), (None,)], "k string")
    assert sorted(r.k for r in joins.missing_keys(a, b, "k").collect() if r.k) == ["y"]
    assert joins.missing_keys(a, b, "k").count() == 2
    assert [r.k for r in joins.missing_keys(a, b, "k", null_matches=True).collect()] == ["y"]
