from pyspark.sql import functions as F

from quarry import sources
from quarry.operators import clean


def test_row_local_operators_on_a_file_stream(spark):
    path = sources.scratch_path(spark, "stream-in")
    df = spark.createDataFrame([(1, 2, 10.0), (2, 9, 5.0), (3, 1, None)], "id long, passengers int, fare double")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    rules = {"too_many": F.col("passengers") > 6}
    out = clean.fill_null(clean.cleanse(stream, rules), {"fare": 0.0})
    q = out.writeStream.format("memory").queryName("quarry_stream_test").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT * FROM quarry_stream_test").collect())
    finally:
        q.stop()
    assert got == [(1, 2, 10.0), (3, 1, 0.0)]
