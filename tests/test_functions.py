import datetime as dt

from pyspark.sql import functions as F

from quarry import functions as QF


def test_to_int_and_suffix(spark):
    df = spark.createDataFrame([("0015A",), ("xx30A",), ("-100",), (None,)], "t string")
    got = [r[0] for r in df.select(QF.to_int(F.substring("t", 1, 2))).collect()]
    assert got == [0, None, -1, None]
    pct = spark.createDataFrame([("10.65%",), (" 7%",), ("bad%",), ("12",), (None,)], "r string")
    assert [r[0] for r in pct.select(QF.parse_suffixed("r")).collect()] == [10.65, 7.0, None, 12.0, None]


def test_round_even_halves(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(QF.round_even("x")).collect()] == [0.0, 2.0, 2.0, -0.0]


def test_ratio_zero_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(QF.ratio("a", "b", pct=True)).collect()] == [None, 25.0, None]


def test_parse_any_two_formats(spark):
    df = spark.createDataFrame([("1-7-2016 09:05:03",), ("11/7/2016 9:05",), ("garbage",), (None,)], "s string")
    got = [r[0] for r in df.select(QF.parse_any("s", ["d-M-yyyy HH:mm:ss", "d/M/yyyy H:mm"])).collect()]
    assert got[0] == dt.datetime(2016, 7, 1, 9, 5, 3)
    assert got[1] == dt.datetime(2016, 7, 11, 9, 5)
    assert got[2] is None and got[3] is None


def test_two_digit_year(spark):
    df = spark.createDataFrame([("05-Jan-24",), ("31-Dec-99",)], "s string")
    got = [r[0] for r in df.select(QF.parse_date("s", "dd-MMM-yy")).collect()]
    assert got[0].year == 2024 and got[1].year == 2099  # Spark's two-digit base is 2000


def test_elapsed_and_rate_zero_time(spark):
    a = dt.datetime(2020, 1, 1, 10, 0, 0)
    df = spark.createDataFrame([(a, a, 3.0), (a, a + dt.timedelta(minutes=30), 10.0),
                                (a + dt.timedelta(hours=1), a, 1.0), (None, a, 1.0)],
                               "s timestamp, e timestamp, d double")
    out = df.select(QF.elapsed("s", "e").alias("secs"), QF.elapsed("s", "e", "hour").alias("h"),
                    QF.rate("d", "s", "e").alias("speed")).collect()
    assert [r.secs for r in out] == [0, 1800, -3600, None]
    assert [r.h for r in out] == [0.0, 0.5, -1.0, None]
    assert [r.speed for r in out] == [None, 20.0, -1.0, None]


def test_cap_keeps_null_and_bucket_edges(spark):
    df = spark.createDataFrame([(-5.0,), (3.0,), (50.0,), (None,)], "x double")
    assert [r[0] for r in df.select(QF.cap_value("x", 0, 10)).collect()] == [0, 3.0, 10, None]
    b = spark.createDataFrame([(0,), (3,), (4,), (23,), (24,), (-1,), (None,)], "h int")
    got = [r[0] for r in b.select(QF.bucket_label("h", [0, 4, 8, 24], ["a", "b", "c"])).collect()]
    assert got == ["a", "a", "b", "c", None, None, None]


def test_recode_keep_and_null(spark):
    df = spark.createDataFrame([("maxda",), ("mazda",), (None,)], "m string")
    keep = [r[0] for r in df.select(QF.recode_value("m", {"maxda": "mazda"})).collect()]
    null = [r[0] for r in df.select(QF.recode_value("m", {"maxda": "mazda"}, default="null")).collect()]
    assert keep == ["mazda", "mazda", None] and null == ["mazda", None, None]
