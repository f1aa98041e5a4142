from pyspark.sql import functions as F

from frames import rows
from quarry.operators import aggs, clean, profile, rank


def nulls_frame(spark):
    # 6 rows: a all-NULL column, a constant column, a constant-with-one-NULL column
    return spark.createDataFrame(
        [(1, None, "k", "c"), (2, None, "k", "c"), (2, None, "k", None), (3, None, "k", "c"),
         (None, None, "k", "c"), (2, None, "k", "c")], "a int, empty double, const string, const_null string")


def test_null_profiles(spark):
    df = nulls_frame(spark)
    assert dict(rows(profile.null_counts(df))) == {"a": 1, "empty": 6, "const": 0, "const_null": 1}
    assert profile.null_total(df).first().nulls == 8
    const = {r.column: (r.n_null, r.is_constant) for r in profile.constant_columns(df).collect()}
    assert const == {"a": (1, False), "empty": (6, True), "const": (0, True), "const_null": (1, False)}
    assert profile.drop_constant(df).columns == ["a", "const_null"]
    assert profile.drop_all_null(df).columns == ["a", "const", "const_null"]
    assert profile.duplicate_count(df).first().duplicates == 1  # (2, NULL, k, c) twice


def test_null_profile_diff_and_key(spark):
    df = nulls_frame(spark)
    d = rows(profile.null_profile_diff(df, df.where(F.col("a").isNotNull())))
    assert d == [("a", 1, 0), ("empty", 6, 5)]  # the all-NULL column has one row less in b
    k = profile.is_key(df, ["a"]).first()
    assert (k.rows, k.distinct_keys, k.is_key) == (6, 4, False)


def test_n_distinct_null_modes(spark):
    df = nulls_frame(spark)
    assert profile.n_distinct(df, "a").first()[0] == 3
    assert profile.n_distinct(df, "a", count_null=True).first()[0] == 4


def test_box_stats_and_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in list(range(1, 11)) + [100]], "x double")
    b = profile.box_stats(df, "x", rule="hinge").first()
    assert (b.q1, b.q3, b.upper_fence, b.upper_whisker, b.n_outliers) == (3.5, 8.5, 16.0, 10.0, 1)
    assert [r.x for r in profile.outliers(df, "x").collect()] == [100.0]


def test_rules_and_cleanse_partition_the_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (7, 1.0, 5.0), (2, None, 1.0), (3, 2.0, 0.0)],
                               "p int, d double, secs double")
    rules = {"too_many": F.col("p") > 6, "fast": F.try_divide(F.col("d"), F.col("secs")) > 0.1}
    v = {(r.rule): r.violations for r in profile.rule_violations(df, rules).collect()}
    assert v == {"too_many": 1, "fast": 1}  # zero duration -> NULL, not broken
    kept = clean.cleanse(df, rules).count()
    broken = df.where(F.coalesce(rules["too_many"], F.lit(False)) | F.coalesce(rules["fast"], F.lit(False))).count()
    assert (kept, broken) == (3, 1) and kept + broken == df.count()  # a rule that is unknown does not drop the row


def test_clean_helpers(spark):
    df = spark.createDataFrame([("99", " ", 1.0), ("NY", "a", None), (None, "b", 30.0)], "s string, c string, v double")
    assert rows(clean.replace_value(df, "s", "99", "NY").select("s")) == [("NY",), ("NY",), (None,)]
    assert clean.drop_blank(df, ["c"]).count() == 2
    assert rows(clean.fill_null(df, {"v": 0.0}).select("v")) == [(0.0,), (1.0,), (30.0,)]
    assert rows(clean.cap(df, {"v": (None, 10.0)}).select("v")) == [(1.0,), (10.0,), (None,)]
    got = rows(clean.set_where(df, "v", F.col("s") == "NY", None).select("s", "v"))
    assert got == [("99", 1.0), ("NY", None), (None, 30.0)]


def test_sample_rows_exact_and_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sorted(r.k for r in clean.sample_rows(df, ["k"], frac=0.15, seed=3).collect())
    b = sorted(r.k for r in clean.sample_rows(df.repartition(7), ["k"], frac=0.15, seed=3).collect())
    assert len(a) == 150 and a == b


def test_top_k_ties_broken_by_key(spark):
    df = spark.createDataFrame([("g1", "b"), ("g1", "a"), ("g2", "z"), ("g2", "y"), ("g2", "y")], "g string, k string")
    assert rows(rank.top_k(df, "k", 2)) == [("a", 1), ("y", 2)]
    assert rows(rank.top_k_by(df, ["g"], "k", 1)) == [("g1", "a", 1, 1), ("g2", "y", 2, 1)]
    am = rows(rank.arg_max(df.withColumn("m", F.lit(1.0)), ["g"], "m", ["k"]))
    assert am == [("g1", "a", 1.0), ("g2", "y", 1.0)]


def test_ntile_remainder_rule(spark):
    df = spark.range(23).withColumn("s", (F.col("id") * 7 % 23).cast("double"))
    got = {r.id: r.bucket for r in rank.ntile_bucket(df, "s", 5, ["id"]).collect()}
    order = sorted(range(23), key=lambda i: (-(i * 7 % 23), i))
    sizes = [5, 5, 5, 4, 4]  # SQL ntile: the first N % n buckets get one more row
    want, pos = {}, 0
    for b, size in enumerate(sizes, start=1):
        for i in order[pos:pos + size]:
            want[i] = b
        pos += size
    assert got == want


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(0, 11)], "x double")
    h = {r.bin: r.n for r in aggs.histogram(df, "x", 5).collect()}
    assert h == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}


def test_hot_key_results_equal_brute_force(spark):
    # one key holds a third of the rows: partial aggregation and WindowGroupLimit must not change results
    import pandas as pd
    data = [("hot" if i % 3 == 0 else f"g{i % 11}", f"k{(i * 7) % 13}", float((i * 31) % 97)) for i in range(6000)]
    df = spark.createDataFrame(data, "g string, k string, v double").repartition(9)
    pdf = pd.DataFrame(data, columns=["g", "k", "v"])
    got = {(r.g, r.k): r.n for r in rank.top_k_by(df, ["g"], "k", 2).collect()}
    cnt = pdf.groupby(["g", "k"]).size().reset_index(name="n").sort_values(["g", "n", "k"], ascending=[True, False, True])
    want = {(r.g, r.k): r.n for r in cnt.groupby("g").head(2).itertuples()}
    assert got == want
    am = {r.g: (r.k, r.v) for r in rank.arg_max(df, ["g"], "v", ["k"], cols=["k", "v"]).collect()}
    best = pdf.sort_values(["g", "v", "k"], ascending=[True, False, True]).groupby("g").head(1)
    assert am == {r.g: (r.k, r.v) for r in best.itertuples()}


def test_unpivot_then_pivot_restores(spark):
    from quarry.operators import reshape
    wide = spark.createDataFrame([("p1", 1, 0, 1), ("p2", 0, 1, 0), ("p3", 0, 0, 0), ("", 1, 1, 1)],
                                 "part string, red int, hot int, old int")
    long = reshape.unpivot_flags(wide, ["part"], ["red", "hot", "old"])
    back = long.groupBy("part").pivot("category", ["red", "hot", "old"]).count().fillna(0)
    got = sorted(tuple(r) for r in back.collect())
    assert got == [("p1", 1, 0, 1), ("p2", 0, 1, 0)]  # all-zero row and blank key drop out, as in the reference
