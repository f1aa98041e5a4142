"""Exact multi-rank selection against sorting, with tiny limits that force every path."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate, features, order, profile, rank, select


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ranks_by_sorting(rows, wanted):
    out = set()
    for g in {r[0] for r in rows}:
        vs = sorted((v for h, v in rows if h == g and v is not None), key=lambda v: (math.isnan(v), v))
        for k in wanted(len(vs)):
            out.add((g, k, vs[k - 1], len(vs)))
    return out


@pytest.mark.parametrize("limit", [30, 50_000])
def test_ranks_equal_sorting(spark, monkeypatch, limit):
    r = random.Random(limit)
    monkeypatch.setattr(select, "MOST_CUTS", 64)
    rows = [(g, r.choice([None, 0.0, 1.5, float(r.randint(0, 9)), r.gauss(0, 1e6), 1e300, -1e300, math.inf]))
            for g in (None, "a", "b", "hot", "hot", "hot") for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = lambda n: sorted({1, max(1, n // 4), max(1, n // 2), n})
    positions = lambda n: F.array_distinct(F.array(F.lit(1).cast("long"), *[F.greatest(F.lit(1), F.floor(n / d)).cast("long") for d in (4, 2, 1)]))
    got = {(x["g"], x["__k"], x["__v"], x["__n"]) for x in select.order_statistics(df, "x", positions, ["g"], 4, limit).collect()}
    assert got == ranks_by_sorting(rows, wanted)
    whole = [(0, v) for _, v in rows]
    got = {(0, x["__k"], x["__v"], x["__n"]) for x in select.order_statistics(df, "x", positions, (), 4, limit).collect()}
    assert got == ranks_by_sorting(whole, wanted)


@pytest.mark.parametrize("kind", ["int", "long", "decimal(18,2)", "float", "string", "date"])
def test_other_types_and_values_a_sketch_cannot_tell_apart(spark, kind):
    base = (1 << 62) if kind == "long" else 0
    df = spark.range(300).select((F.col("id") * 7 % 150 + F.lit(base)).alias("v"))
    df = df.select((F.date_add(F.lit("2020-01-01"), F.col("v").cast("int")) if kind == "date" else F.col("v")).cast(kind).alias("x"))
    rows = sorted(r["x"] for r in df.collect())
    got = select.order_statistics(df, "x", lambda n: F.array(F.lit(1), F.lit(10), F.lit(151), n).cast("array<long>"), limit=20).collect()
    assert {r["__k"]: r["__v"] for r in got} == {k: rows[k - 1] for k in (1, 10, 151, 300)}


def test_before_and_ties(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [5] * 100 + [1, 2, 3] + [9] * 7], "g int, v double")
    for limit in (2, 1000):
        want = select.select_ranks(df, ["g"], lambda n: F.array(F.lit(3), F.lit(50), n).cast("array<long>"), 3, limit).collect()
        assert {(r["k"], r["v"], r["before"], r["ties"], r["n"]) for r in want} == {(3, 3.0, 2, 1, 110), (50, 5.0, 3, 100, 110), (110, 9.0, 103, 7, 110)}


@pytest.mark.parametrize("falling", [True, False])
@pytest.mark.parametrize("n", [1, 4, 10])
def test_ntile_equals_sorted_rows(spark, falling, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, float("nan"), 0.5, 0.5, r.random()]), r.choice(["x", "y", None])) for i in range(203)]
    df = spark.createDataFrame(rows, "id long, s double, t string").repartition(4)
    value = lambda s: (0, 0) if s is None else (1, math.inf) if math.isnan(s) else (1, s)
    rank_of = lambda x: (tuple(-y for y in value(x[1])) if falling else value(x[1]), (x[2] is not None, x[2] or ""), x[0])
    want, base, more = {}, len(rows) // n, len(rows) % n
    for i, x in enumerate(sorted(rows, key=rank_of)):
        want[x[0]] = next(b for b in range(1, n + 1) if i < b * base + min(b, more))
    got = rank.ntile_bucket(df, "s", n, ["t", "id"], falling)
    assert {x["id"]: x["bucket"] for x in got.collect()} == want
    assert "rangepartitioning" not in plan(got)


def test_ntile_of_rows_equal_in_every_order_column(spark):
    df = spark.createDataFrame([(1, 0.5)] * 10 + [(2, 0.7)] * 3, "id long, s double")
    got = [x["bucket"] for x in rank.ntile_bucket(df, "s", 4, ["id"]).collect()]
    assert sorted(got) == [1] * 4 + [2] * 3 + [3] * 3 + [4] * 3


def test_no_sort_of_rows_in_the_plans(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 37 % 1009 / 7).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    made = [order.quantiles(df, "x", [i / 100 for i in range(101)]), profile.box_stats(df, "x"), profile.outliers(df, "x"),
            profile.describe(df, ["x", "k"]), rank.ntile_bucket(df, "x", 10, ["k"]), evaluate.lift_table(df, "y", "x", ["k"]),
            *features.split_stratified(df, "y", ["k"])]
    for d in made:
        assert "rangepartitioning" not in plan(d) and "ranges-" not in plan(d)


def test_bisection_counts_cuts_in_generated_code(spark):
    cuts = [0.1 * i for i in range(-3, 12)]
    df = spark.createDataFrame([(x / 20,) for x in range(-10, 40)] + [(None,)], "v double")
    for size in (0, 1, 2, 15):
        for inclusive in (True, False):
            got = select.count_below(df, F.col("v"), F.array(*map(F.lit, cuts[:size])), size, "n", inclusive).collect()
            assert all(r["n"] == sum(c <= r["v"] if inclusive else c < r["v"] for c in cuts[:size]) for r in got if r["v"] is not None)
    sweep = evaluate.cutoff_sweep(df.select("v", F.lit(1).alias("y")), "y", "v", cuts)
    assert "lambda" not in plan(sweep).lower() and "filter(array" not in plan(sweep).lower()


def test_sketches_kept_as_data_and_merged(spark):
    r = random.Random(11)
    rows = [(i % 7, r.gauss(0, 1) if i % 5 else 0.0) for i in range(20_000)] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(6)
    kept = profile.quantile_sketches(df, "x", ["g"])
    assert kept.count() == 7 and kept.agg(F.sum("n")).first()[0] == 20_000
    values = sorted(v for _, v in rows if v is not None)
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    for found in (profile.merged_quantiles(kept, probs).collect(), profile.merged_quantiles(profile.quantile_sketches(df, "x"), probs).collect()):
        assert [x["prob"] for x in found] == probs
        for x in found:
            low, high = sum(v < x["value"] for v in values) / 20_000, sum(v <= x["value"] for v in values) / 20_000
            assert low - 0.002 <= x["prob"] <= high + 0.002
    assert profile.merged_quantiles(profile.quantile_sketches(df.limit(0), "x"), probs).count() == 0
