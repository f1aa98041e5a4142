import numpy as np
from pyspark.sql import functions as F

from quarry.operators.order import hinges, quantiles, row_index, running_total


def test_row_index_matches_brute_force_with_hot_group(spark):
    # one group holds a third of the rows, keys repeat across groups, one NULL group
    data = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"g{i % 5}"), float((i * 37) % 101))
            for i in range(3000)]
    df = spark.createDataFrame(data, "id long, g string, v double").repartition(7)
    got = {r.id: r.rn for r in row_index(df, [F.col("v").desc(), F.col("id")], by=["g"]).collect()}
    import pandas as pd
    pdf = pd.DataFrame(data, columns=["id", "g", "v"]).fillna({"g": "<null>"})
    pdf = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True])
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    assert got == dict(zip(pdf.id, pdf.rn))


def test_running_total_weighted_unchanged_under_repartition(spark):
    data = [(i, float(i % 13)) for i in range(500)]
    base = spark.createDataFrame(data, "id long, w double")
    want = np.cumsum([w for _, w in data])
    for parts in (1, 5, 16):
        got = sorted(running_total(base.repartition(parts), ["id"], F.col("w"), out="c").collect())
        assert np.allclose([r.c for r in got], want)


def test_quantiles_equal_numpy_type7(spark):
    vals = [float(x) for x in np.random.default_rng(3).normal(size=777)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.prob: r.value for r in quantiles(df, "x", probs).collect()}
    for p in probs:
        assert abs(got[p] - np.quantile(vals, p)) < 1e-12


def test_hinges_differ_from_type7_on_even_n(spark):
    odd = spark.createDataFrame([(float(x),) for x in list(range(1, 11)) + [100]], "x double")
    r = hinges(odd, "x").first()
    assert (r.q1, r.median, r.q3, r.n) == (3.5, 6.0, 8.5, 11)
    even = spark.createDataFrame([(float(x),) for x in list(range(1, 10)) + [100]], "x double")
    r = hinges(even, "x").first()
    assert (r.q1, r.median, r.q3) == (3.0, 5.5, 8.0)
    assert quantiles(even, "x", [0.25]).first().value == 3.25
